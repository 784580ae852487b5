"""The data source: splits, formats, compression, conditions and many files."""

import bz2
import gzip
import json
import random
import time

import pyarrow as pa
import pytest

from strandmill.functions import kmers
from strandmill.sources import fastx, sequences


def made(rng, n, kind):
    rows = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 90)))
        rows.append((f"r{i} x", seq, "".join(rng.choice("@+>I#") for _ in seq) if kind == "fastq" else None))
    if kind == "fastq":
        return rows, "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows)
    width = lambda s: "\n".join(s[j : j + 30] for j in range(0, len(s), 30))
    return rows, "".join(f">{i}\n{width(s)}\n" + "\n" * rng.randint(0, 1) for i, s, _ in rows)


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_every_cut_gives_all_records_once(tmp_path, kind):
    rng = random.Random(len(kind))
    rows, text = made(rng, 12, kind)
    path = tmp_path / "f"
    for body in (text, "\n\n" + text, text.rstrip("\n"), text.replace("\n", "\r\n")):
        path.write_bytes(body.encode())
        n = len(body)
        for size in (7, 64, 301, n):
            got = [r for a in range(0, n, size) for r in fastx.records(fastx.Piece(str(path), "s", 3, a, min(a + size, n)))]
            assert [(r[3], r[4], r[5]) for r in got] == rows and [r[2] for r in got] == sorted({r[2] for r in got}) and {(r[0], r[1], r[6]) for r in got} == {("s", 3, kind)}


def test_reading_by_spark(spark, tmp_path):
    rng = random.Random(1)
    fastx.register(spark)
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    a, fa = made(rng, 200, "fasta")
    b, fq = made(rng, 200, "fastq")
    (folder / "a.fa").write_text(fa)
    (folder / "deep" / "b.fastq").write_text(fq)
    (folder / "c.fq.gz").write_bytes(gzip.compress(fq.encode()))
    (folder / "d.dat").write_bytes(bz2.compress(fa.encode()))  # told by its first bytes, though it is cut
    (folder / ".hidden").write_text("x")
    got = spark.read.format("fastx").option("part", 2000).load(str(folder))
    rows = sorted((r["sample"].rsplit("/", 1)[1], r["id"], r["seq"], r["qual"]) for r in got.collect())
    assert rows == sorted([("a.fa", *x) for x in a] + [("b.fastq", *x) for x in b] + [("c.fq.gz", *x) for x in b] + [("d.dat", *x) for x in a])
    # the same as Spark's own readers give
    paths = [str(folder / "a.fa"), str(folder / "c.fq.gz")]
    one = spark.read.format("fastx").option("paths", json.dumps(paths)).load().select("sample", "ordinal", "id", "seq", "qual", "format")
    two = sequences.read_sequences(spark, paths).select(one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert spark.read.format("fastx").load(str(folder / "*.fa")).select("sample").distinct().collect() == [(str(folder / "*.fa"),)]  # what stands for one file names it
    with pytest.raises(Exception, match="no such file"):
        spark.read.format("fastx").load(str(tmp_path / "none")).count()


def test_conditions_pick_files(spark, tmp_path):
    fastx.register(spark)
    for name, body in (("a.fa", ">x\nACGT\n"), ("b.fq", "@y\nAC\n+\nII\n"), ("bad.txt", "neither")):
        (tmp_path / name).write_text(body)
    df = spark.read.format("fastx").option("paths", json.dumps([str(tmp_path / x) for x in ("a.fa", "b.fq", "bad.txt")])).load()
    with pytest.raises(Exception, match="neither"):
        df.count()
    # the bad file is never opened
    assert [r["id"] for r in df.where("ordinal IN (0, 1)").orderBy("id").collect()] == ["x", "y"]
    assert df.where(df["sample"] == str(tmp_path / "b.fq")).where("length(seq) = 2").count() == 1
    assert [r["id"] for r in df.where("ordinal < 2 AND ordinal IN (0, 1) AND format = 'fastq'").collect()] == ["y"]
    reader = fastx.FastxReader({"path": str(tmp_path)})
    assert [p.pieces[0].path for p in reader.partitions()] == [str(tmp_path / "a.fa")] and len(reader.partitions()) == 1


def test_planning_opens_no_file(tmp_path, monkeypatch):
    for i in range(10_000):
        (tmp_path / f"{i}.fa").write_text(f">{i}\nAC\n")
    began = time.time()
    monkeypatch.setattr("builtins.open", lambda *a, **k: pytest.fail("a file was opened"))
    parts = fastx.FastxReader({"path": str(tmp_path)}).partitions()
    assert sum(len(p.pieces) for p in parts) == 10_000 and 10 < len(parts) < 100 and time.time() - began < 20


def test_small_files_share_batches(tmp_path):
    """Records of many files come together: a batch for each cost more than what is in it."""
    for i in range(40):
        (tmp_path / f"{i}.fa").write_text(f">r{i}\nACGT\n")
    reader = fastx.FastxReader({"path": str(tmp_path)})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(got) == 1 and sorted(got[0].column(3).to_pylist()) == sorted(f"r{i}" for i in range(40))
    assert len(set(got[0].column(0).to_pylist())) == 40


def test_letters_of_packed_bases():
    raw = [b"", b"ab", None, bytes(range(256))]
    want = [None if x is None else "".join("ACGT"[b >> s & 3] for b in x for s in (6, 4, 2, 0)) for x in raw]
    assert kmers.letters_of(pa.array(raw, pa.binary())).to_pylist() == want


def test_folders_with_empty_parts(spark, tmp_path):
    """Tasks without rows leave files that hold nothing, plain or compressed."""
    with gzip.open(tmp_path / "part-0.gz", "wb"), open(tmp_path / "part-1", "w"):
        pass
    (tmp_path / "part-2").write_text(">a\nACGT\n")
    assert [r["id"] for r in sequences.read_sequences(spark, str(tmp_path)).collect()] == ["a"]
