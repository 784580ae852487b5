import bz2
import gzip
import io
import json
import random
import re

import pytest

from strandmill import api, cli
from strandmill.errors import SketchError
from strandmill.params import ALL, MASH, SCALED, FilterParams, SketchParams
from strandmill.plans import file_queries
from strandmill.sources import formats, sequences, tables, wire


def some(n=3, scheme=MASH, label=True):
    rng = random.Random(n)
    out = []
    for i in range(n):
        rows = [(rng.getrandbits(64), "ACGT" * 5 + "A", rng.randint(1, 9), rng.randint(0, 1), b"x\0" if label and i == 1 else None) for _ in range(i * 4)]
        p = SketchParams(scheme, 1000, 900, i == 0, 21, 42, 0.001 if scheme == SCALED else None)
        out.append(formats.sketch(f"näme {i}", rows, p, FilterParams(i == 1, 2 if i else None, 7 if i == 2 else None, 0.5, 0.25), 10**10 + i, 77, "c" * i))
    return out


@pytest.mark.parametrize("scheme", [MASH, SCALED, ALL])
def test_native_round_trip(scheme):
    want = some(4, scheme)
    got = formats.read_native(formats.write_native(want))
    assert got == want


def test_mash_round_trip():
    want = some(4)
    got = formats.read_mash(formats.write_mash(want))
    for g, w in zip(got, want, strict=True):
        assert [(r[0], r[2]) for r in g["rows"]] == [(r[0], r[2]) for r in w["rows"]]
        assert all(r[1] == "" and r[3] == r[2] // 2 for r in g["rows"])
        assert (g["name"], g["comment"], g["seq_length"], g["num_valid_kmers"]) == (w["name"], w["comment"], w["seq_length"], w["num_valid_kmers"])
        assert g["params"] == SketchParams(MASH, 0, 0, True, 21, 42) and g["filters"] == FilterParams()


@pytest.mark.parametrize("scheme", [MASH, SCALED])
def test_json_round_trip(scheme):
    want = some(3, scheme)
    data = formats.write_json(want)
    head = json.loads(data)
    assert (head["kmer"], head["alphabet"], head["hashType"], head["hashBits"], head["hashSeed"], head["preserveCase"], head["canonical"]) == (21, "ACGT", "MurmurHash3_x64_128", 64, 42, False, True)
    assert ("scale" in head) == (scheme == SCALED) and all(isinstance(h, str) for s in head["sketches"] for h in s["hashes"])
    got = formats.read_json(data)
    for g, w in zip(got, want, strict=True):
        assert [r[:3] for r in g["rows"]] == [r[:3] for r in w["rows"]] and g["comment"] == "" and g["params"].no_strict
        assert g["filters"] == (w["filters"] if w["filters"].filter_on else FilterParams(False))


def test_json_without_kmers_and_counts():
    head = {"kmer": 4, "hashType": "MurmurHash3_x64_128", "hashSeed": 1, "sketchSize": 2, "sketches": [{"name": "a", "hashes": ["18446744073709551615", "3"]}]}
    got = formats.read_json(json.dumps(head).encode())[0]
    assert got["rows"] == [(3, "", 1, 0, None), ((1 << 64) - 1, "", 1, 0, None)] and got["seq_length"] == 0
    for bad in (b"{", b"[]", b'{"kmer":1}', b'{"kmer":3,"hashType":"sip","sketches":[]}'):
        with pytest.raises(SketchError):
            formats.read_json(bad)


def test_wire_follows_far_pointers_and_defaults():
    import struct

    # two segments: the root's struct lies in the second, behind a far pointer
    first = struct.pack("<Q", 2 | 0 << 3 | 1 << 32)
    second = struct.pack("<QQ", 0 | 1 << 32, 7 ^ 42)
    data = struct.pack("<III", 1, 1, 2) + b"\0" * 4 + first + second
    root = wire.Message(data).root()
    assert root.num("I", 0, 42) == 7 and root.num("Q", 5, 9) == 9 and root.text(0) == "" and root.structs(0) == [] and root.sub(0) is None
    for bad in (b"", b"\0\0\0\0\xff\xff\xff\xff"):
        with pytest.raises(SketchError):
            wire.Message(bad)


FASTA = b">a one\nACGTAC\nGTNN\n>b\nacgt\n"
FASTQ = b"@r1\nACGTACGT\n+\nIIIIIIII\n@r2 x\nGGGG\n+r2\n@@@@\n"


def test_parser():
    assert list(sequences.parse(io.BytesIO(FASTA))) == [("a one", "ACGTACGTNN", None, "fasta"), ("b", "acgt", None, "fasta")]
    assert list(sequences.parse(io.BytesIO(FASTQ))) == [("r1", "ACGTACGT", "IIIIIIII", "fastq"), ("r2 x", "GGGG", "@@@@", "fastq")]
    for bad in (b"", b"ACGT\n", b"@r\nACGT\n+\nII\n"):
        with pytest.raises(SketchError):
            list(sequences.parse(io.BytesIO(bad)))


def test_scans(spark, tmp_path):
    files = {"x.fa": FASTA, "y.fastq": FASTQ, "z.fa.gz": gzip.compress(FASTA), "w.fq.bz2": bz2.compress(FASTQ)}
    paths = []
    for n, d in files.items():
        (tmp_path / n).write_bytes(d)
        paths.append(str(tmp_path / n))
    got = sequences.read_sequences(spark, paths).orderBy("ordinal", "record_no").collect()
    assert [(r["sample"], r["seq"]) for r in got][:2] == [(paths[0], "ACGTACGTNN"), (paths[0], "acgt")]
    assert [r["seq"] for r in got][4:6] == ["ACGTACGTNN", "acgt"] and {r["format"] for r in got if r["sample"].endswith("bz2")} == {"fastq"}
    assert {r["sample"]: r["format"] for r in sequences.formats(sequences.read_sequences(spark, paths)).collect()}[paths[1]] == "fastq"
    big = sequences.read_large_fasta(spark, paths[0], "s").orderBy("record_no").collect()
    assert [(r["id"], r["seq"]) for r in big] == [("a one", "ACGTACGTNN"), ("b", "acgt")]


@pytest.fixture(scope="module")
def genomes(tmp_path_factory):
    rng = random.Random(11)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    at = tmp_path_factory.mktemp("genomes")
    out = []
    for i in range(3):
        seq = list(base)
        for j in rng.sample(range(3000), 40 * i):
            seq[j] = rng.choice("ACGT")
        seq = "".join(seq)
        (at / f"g{i}.fa").write_text(f">one\n{seq[:1000]}\n{seq[1000:2000]}\n>two\n{seq[2000:]}\n")
        out.append(str(at / f"g{i}.fa"))
    return out


@pytest.mark.parametrize("ending", [".sk", ".bsk", ".msh"])
def test_cli_sketch_and_load(spark, genomes, tmp_path, ending):
    flag = {".sk": [], ".bsk": ["-b"], ".msh": ["-B"]}[ending]
    assert cli.run(["sketch", *genomes, "-n", "100", "-o", str(tmp_path / "all"), *flag], spark) == 0
    c = api.Collection.open(spark, str(tmp_path / f"all{ending}"))
    assert c.names() == genomes and len(c) == 3 and all(len(s) == 100 for s in c)
    made = api.sketch_files(spark, genomes, SketchParams(MASH, 100))
    assert [[h for h, *_ in s.hashes] for s in c] == [[h for h, *_ in s.hashes] for s in made]
    assert cli.run(["sketch", str(tmp_path / f"all{ending}")], spark) == 1


def test_cli_in_place_dist_hist_info(spark, genomes, tmp_path, capfdbinary):
    import shutil

    here = []
    for g in genomes:
        here.append(str(tmp_path / g.split("/")[-1]))
        shutil.copy(g, here[-1])
    assert cli.run(["sketch", *here, "-n", "200"], spark) == 0
    sketched = [p + ".sk" for p in here]
    capfdbinary.readouterr()
    assert cli.run(["dist", *sketched, "-p"], spark) == 0
    rows = json.loads(capfdbinary.readouterr().out)
    assert len(rows) == 6 and [(r["reference"], r["query"]) for r in rows[:2]] == [(here[0], here[1]), (here[0], here[2])]
    near = {(r["query"], r["reference"]): r for r in rows}
    assert near[here[1], here[0]]["jaccard"] > near[here[2], here[0]]["jaccard"] > 0
    assert cli.run(["dist", *sketched, "-q", f"{here[1]},{here[2]}", "-d", "0.04", "-o", str(tmp_path / "d")], spark) == 0
    assert all(r["mashDistance"] <= 0.04 and r["query"] != here[0] for r in json.loads((tmp_path / "d.json").read_bytes()))
    assert cli.run(["dist", sketched[0], here[1], "--old-dist"], spark) == 0
    old = json.loads(capfdbinary.readouterr().out)
    assert len(old) == 1 and old[0]["query"] == here[0] and old[0]["reference"] == here[1] and old[0]["totalHashes"] == 200
    assert cli.run(["hist", here[0]], spark) == 0
    assert list(json.loads(capfdbinary.readouterr().out)) == [here[0]]
    assert cli.run(["info", *sketched], spark) == 0
    out = capfdbinary.readouterr().out.decode()
    assert "Length: 3000 bp" in out and out.count("GC estimate") == 3


def test_cli_errors(spark, genomes, tmp_path, capsys):
    for bad in (
        ["sketch", "/nowhere.fa"], ["sketch", genomes[0], "-s", "none", "--seed", "3"], ["sketch", genomes[0], "-s", "scaled", "--oversketch", "3"], ["sketch", genomes[0], "--scale", "0.1"],
        ["hist", genomes[0], "--err-filter", "50"], ["sketch", genomes[0], "-n", "100000", "-O"],
    ):
        assert cli.run(bad, spark) == 1, bad
    assert "100000 k-mers are asked for" in capsys.readouterr().err
    assert cli.run(["sketch", genomes[0], "-n", "100000", "-N", "-o", str(tmp_path / "x")], spark) == 0
    cli.run(["sketch", genomes[0], "-n", "50", "-o", str(tmp_path / "k21")], spark)
    assert cli.run(["dist", str(tmp_path / "k21.sk"), genomes[1], "-k", "20"], spark) == 1
    assert "kmer_length" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.run(["dist", genomes[0], "--strand-filter", "2"], spark)


def test_schemes_and_parameters(spark, genomes):
    s = api.sketch_files(spark, genomes[:1], SketchParams(SCALED, 10, scale=0.01))[0]
    assert s.sketch_params["scale"] == 0.01 and len(s) >= 10 and all(h <= s.params.limit or i < 10 for i, (h, *_) in enumerate(s.hashes))
    a = api.sketch_files(spark, genomes[:1], SketchParams(ALL, kmer_length=4))[0]
    assert a.seq_length == 0 and a.sketch_params["hash_type"] == "None" and sum(a.counts) >= a.num_valid_kmers
    first = SketchParams(MASH, 300, 300, kmer_length=17, hash_seed=5)
    assert api.inherit(SketchParams(MASH, 200_000, 1000), first) == SketchParams(MASH, 200_000, 300, False, 17, 5)
    assert api.inherit(SketchParams(MASH, 100, 100), first) == SketchParams(MASH, 300, 300, False, 17, 5)
    with pytest.raises(SketchError):
        api.inherit(SketchParams(SCALED, scale=0.1), first, ("scheme",))


def test_filters_follow_the_format(spark, tmp_path):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    reads = [seq[i : i + 80] for i in range(0, 320, 4)] * 2 + ["".join(rng.choice("ACGT") for _ in range(80))]
    (tmp_path / "r.fastq").write_text("".join(f"@r{i}\n{r}\n+\n{'I' * len(r)}\n" for i, r in enumerate(reads)))
    (tmp_path / "r.fasta").write_text("".join(f">r{i}\n{r}\n" for i, r in enumerate(reads)))
    paths = [str(tmp_path / "r.fastq"), str(tmp_path / "r.fasta")]
    p = SketchParams(MASH, 1000, 1000, True)
    q, a = api.sketch_files(spark, paths, p, FilterParams(err_filter=0.2))
    assert len(q) < len(a) and q.data["filters"].filter_on and not a.data["filters"].filter_on and min(q.counts) >= q.data["filters"].abun_low > 1
    c = api.Collection.of(spark, [a.data])
    assert min(c.filtered(FilterParams(True, 5))[0].counts) >= 5
    same = c.filtered(FilterParams(True, 5), compat=True)[0]
    assert same.counts == a.counts and same.data["filters"].abun_low == 5


def test_collections(spark, genomes):
    c = api.sketch_files(spark, genomes, SketchParams(MASH, 100))
    one, two, three = c
    assert c[-1] == three and c[genomes[1]] == two and genomes[0] in c and "x" not in c and 3 not in c
    with pytest.raises(IndexError):
        c[3]
    with pytest.raises(KeyError):
        c["x"]
    assert c.without(0).names() == genomes[1:] and c.without(genomes[2]).names() == genomes[:2]
    assert c.filter_to_names([genomes[2]]).names() == genomes[2:]
    at, best = c.without(0).best_match(one)
    assert at == 0 and best == two
    contained = {g: s.compare(one)[0] for g, s in zip(genomes, (one, two, three), strict=True)}
    assert contained[genomes[0]] == 1.0 and c.filter_to_matches(one, contained[genomes[1]]).names() == [g for g in genomes if contained[g] >= contained[genomes[1]]]
    again = api.Collection.from_sketches([one, three]).add(c)
    assert again.names() == [genomes[0], genomes[2], *genomes]
    # equal sketches aren't compared, whatever their place
    assert {(r["query"], r["reference"]) for r in again.distances(pairwise=True).collect()} == {(a, b) for a in genomes for b in genomes if a != b}
    assert repr(c) == "<Collection with 3 sketches>"


def test_sketch_values(spark, genomes):
    s = api.sketch_file(spark, genomes[0], n_hashes=50, filter=False)
    t = s.copy()
    t.name, t.comment = "other", "note"
    assert (s.name, s.comment, t.name, t.comment) == (genomes[0], "", "other", "note") and s != t and len(t) == 50
    t.counts = [0] + [3] * 49
    assert len(t) == 49 and set(t.counts) == {3} and len(s) == 50
    for bad in ([1], [-1] * 49):
        with pytest.raises(SketchError):
            t.counts = bad
    m = s.merge(t)
    assert m.seq_length == 6000 and dict((h, n) for h, _, n, _ in m.hashes)[t.hashes[0][0]] == 3 + s.counts[1]
    with pytest.raises(SketchError):
        s.merge(api.Sketch(formats.sketch("x", [], SketchParams(kmer_length=20))))
    assert s.compare_counts(s)[:3] == (50, 50, 50) and s.compare_matrix(t, s) == [[0] + [3] * 49, s.counts]
    assert len(api.Sketch("empty")) == 0 and api.Sketch("empty").sketch_params["no_strict"]


def test_tables(spark, genomes, tmp_path):
    c = api.sketch_files(spark, genomes, SketchParams(MASH, 30))
    tables.save_tables(c.sketches, c.minmers, str(tmp_path / "t"))
    back = api.Collection(*tables.load_tables(spark, str(tmp_path / "t")))
    assert list(back) == list(c)
    c.save(str(tmp_path / "c.bsk"))
    assert list(api.Collection.open(spark, str(tmp_path / "c.bsk"))) == list(c)
    c.save(f"file://{tmp_path}/far/c.sk")
    assert [[h[:3] for h in x.hashes] for x in api.Collection.open(spark, str(tmp_path / "far/c.sk"))] == [[h[:3] for h in x.hashes] for x in c]
    with pytest.raises(SketchError):
        c.save(str(tmp_path / "c.txt"))


def test_stdin(spark, monkeypatch):
    path = sequences.spooled(io.BytesIO(FASTA))
    monkeypatch.setattr(sequences, "spooled", lambda: path)
    assert {r["sample"] for r in sequences.read_sequences(spark, "-").collect()} == {"-"}


def test_files_whose_paths_end_alike(spark, tmp_path, monkeypatch):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.fa").write_text(">1\nACGTACGT\n")
    (tmp_path / "x" / "a.fa").write_text(">2\nGGGGCCCCA\n")
    (tmp_path / "with space [1]*%20.fa").write_text(">3\nTTTTT\n")
    monkeypatch.chdir(tmp_path)
    paths = [f"file:{tmp_path}/a.fa", f"file:{tmp_path}/x/a.fa", str(tmp_path / "with space [1]*%20.fa")]
    got = {r["sample"]: (r["ordinal"], r["seq"]) for r in sequences.read_sequences(spark, paths).collect()}
    assert got == {paths[0]: (0, "ACGTACGT"), paths[1]: (1, "GGGGCCCCA"), paths[2]: (2, "TTTTT")}
    for i, (p, n) in enumerate([("a.sk", 3), ("x/a.sk", 4)]):
        (tmp_path / p).write_bytes(formats.write_json([s | {"name": f"{i}"} for s in some(n)]))
    back = api.Collection.open(spark, [str(tmp_path / "x/a.sk"), str(tmp_path / "a.sk")])
    assert back.names() == ["1"] * 4 + ["0"] * 3
    with pytest.raises(SketchError):
        sequences.read_sequences(spark, str(tmp_path / "none.fa"))


def reads(rng, n):
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 30, 60])))
        out.append((f"r{i}", seq, "".join(rng.choice("@@@+>I") for _ in seq)))
    return out


@pytest.mark.parametrize("size", [64, 777, 1 << 20])
def test_files_are_split_between_records(spark, tmp_path, size):
    rng = random.Random(size)
    want = reads(rng, 600)
    (tmp_path / "q.fastq").write_text("".join(f"@{i}\n{s}\n+{i}\n{q}\n" for i, s, q in want))
    (tmp_path / "q.fa").write_text("\n\n" + "".join(f">{i} >x\n{s[:20]}\n{s[20:]}\n" for i, s, _ in want))
    paths = [str(tmp_path / "q.fastq"), str(tmp_path / "q.fa")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = sequences.read_sequences(spark, paths)
        got = df.orderBy("ordinal", "record_no").collect()
        assert df.rdd.getNumPartitions() > 4 or size > 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["id"], r["seq"]) for r in got] == [(i, s) for i, s, _ in want] + [(f"{i} >x", s) for i, s, _ in want]
    assert all(r["qual"] in (q, None) for r, (_, _, q) in zip(got, want, strict=False))
    if size > 1000:
        assert [r["qual"] for r in got[:600]] == [q for _, _, q in want]


@pytest.mark.parametrize("bad", [b"@r\nACGT\n+\nII\n", b"@r\nACGT\n", b"@r\nACGT\n+\n", b"@r\nAC\nGT\n+\nIIII\n"])
def test_malformed_reads(spark, tmp_path, bad):
    (tmp_path / "b.fq").write_bytes(FASTQ + bad)
    with pytest.raises(Exception, match="malformed"):
        sequences.read_sequences(spark, str(tmp_path / "b.fq")).collect()


def test_whole_files_of_other_kinds(spark, tmp_path):
    import lzma

    (tmp_path / "a.fa.xz").write_bytes(lzma.compress(FASTA))
    (tmp_path / "b.fq").write_bytes(gzip.compress(FASTQ))  # compressed under a plain name
    got = sequences.read_sequences(spark, [str(tmp_path / "a.fa.xz"), str(tmp_path / "b.fq")]).orderBy("ordinal", "record_no").collect()
    assert [r["seq"] for r in got] == ["ACGTACGTNN", "acgt", "ACGTACGT", "GGGG"]
    for data in (b"", b"\n \n", b"ACGT\n"):
        (tmp_path / "e.fa").write_bytes(data)
        with pytest.raises(SketchError):
            sequences.read_sequences(spark, str(tmp_path / "e.fa"))


def test_one_pass_has_all_facts(spark, genomes, tmp_path):
    rng = random.Random(5)
    (tmp_path / "r.fastq").write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in reads(rng, 200)))
    paths = [*genomes, str(tmp_path / "r.fastq")]
    for params in (SketchParams(MASH, 50, 50, True), SketchParams(SCALED, 10, scale=0.05)):
        c = api.sketch_files(spark, paths, params, FilterParams(False))
        from strandmill.operators import sketching

        want = {r["sample"]: (r["seq_length"], r["num_valid_kmers"]) for r in sketching.totals(sequences.read_sequences(spark, paths), params).collect()}
        assert c.names() == paths and {s.name: (s.seq_length, s.num_valid_kmers) for s in c} == want


def test_merging_keeps_the_scale(spark, genomes):
    a, b = api.sketch_files(spark, genomes[:2], SketchParams(SCALED, 3, scale=0.01))
    limit = a.params.limit
    assert any(h > limit for h, *_ in api.sketch_files(spark, genomes[:1], SketchParams(SCALED, 100, scale=0.01))[0].hashes)
    wide, other = api.sketch_files(spark, genomes[:2], SketchParams(SCALED, 100, scale=0.01))
    assert all(h <= limit for h, *_ in wide.merge(other).hashes)
    two = wide.merge(other, size=2)
    assert len(two) >= 2 and [h for h, *_ in two.hashes] == [h for i, (h, *_) in enumerate(wide.merge(other, scale=1.0).hashes) if i < 2 or h <= limit]


def test_near_pairs_are_all_pairs_below_one(spark, genomes):
    c = api.sketch_files(spark, genomes, SketchParams(MASH, 100))
    far = api.Collection.of(spark, [formats.sketch("far", [(1, "A" * 21, 1, 0, None)], SketchParams(MASH, 100, 100, True))])
    empty = api.Collection.of(spark, [formats.sketch("empty", [], SketchParams(MASH, 100, 100, True))])
    for both in (c.add(far), c.add(far).add(empty)):
        for old in (False, True):
            every = both.distances(pairwise=True, old=old).where("mashDistance <= 0.9").collect()
            near = both.distances(pairwise=True, old=old, max_dist=0.9)
            assert sorted(map(str, every)) == sorted(map(str, near.collect()))
    plan = c.distances(pairwise=True, max_dist=0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_files_by_source_come_from_the_tasks(spark, tmp_path):
    """One file a source, whatever its name and however tasks are dealt: no source and an empty one are one, as in Spark's folders."""
    names = ["src0", "a=b/c", None, "", "src0", "x%y", ""]
    docs = spark.createDataFrame([(i, s, f"text {i}") for i, s in enumerate(names)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = file_queries._by_source(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert [re.search(r"source=([^/]*)/", f)[1] for f in files] == ["__HIVE_DEFAULT_PARTITION__", "a%3Db%2Fc", "src0", "x%25y"]
    rows = sequences.read_sequences(spark, files).collect()
    want = {str(i): "".join("".join("ACGT"[b >> s & 3] for s in (6, 4, 2, 0)) for b in f"text {i}".encode()) for i in range(len(names))}
    assert {r["id"]: r["seq"] for r in rows} == want and len({r["sample"] for r in rows}) == 4
