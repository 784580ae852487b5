import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill import api
from strandmill.functions import hashing
from strandmill.operators import sketching
from strandmill.params import ALL, MASH, SCALED, U64, FilterParams, SketchParams, effective_scale, max_hash

from .test_kmers import RC, naive


def sequences(seed=1, samples=3, records=4, size=300):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(size))
    out = []
    for s in range(samples):
        for r in range(records):
            seq = base[: rng.randint(0, size)] + "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, size)))
            out.append((f"s{s}", r, seq))
    return out


def brute_counts(rows, k, seed):
    import numpy as np

    out = defaultdict(dict)
    for s, _, seq in rows:
        for w, flag in naive(seq, k):
            h = int(hashing.murmur_bytes(np.frombuffer(w.encode(), np.uint8)[None], seed)[0])
            n, e, _ = out[s].get(h, (0, 0, w))
            out[s][h] = (n + 1, e + flag, w)
    return out


def brute_sketch(counts, p):
    keep = sorted(counts)
    if p.scheme == SCALED:
        keep = [h for i, h in enumerate(keep) if i < p.kmers_to_sketch or h <= p.limit]
    else:
        keep = keep[: p.kmers_to_sketch]
    return {h: counts[h] for h in keep}


def got_rows(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["sample"]][r["hash"] % (1 << 64)] = (r["count"], r["extra_count"], r["kmer"])
    return out


@pytest.mark.parametrize(
    "p",
    [
        SketchParams(MASH, 20, kmer_length=7), SketchParams(MASH, 0, kmer_length=7), SketchParams(MASH, 100_000, kmer_length=5, hash_seed=42), SketchParams(MASH, 50, kmer_length=21),
        SketchParams(SCALED, 10, kmer_length=7, scale=0.2), SketchParams(SCALED, 0, kmer_length=7, scale=0.1), SketchParams(SCALED, 0, kmer_length=7, scale=1e-15), SketchParams(SCALED, 30, kmer_length=7, scale=1.0),
    ],
)
def test_sketches_against_loops(spark, p):
    rows = sequences()
    df = spark.createDataFrame(rows, "sample string, record_no long, seq string").repartition(5)
    want = {s: brute_sketch(c, p) for s, c in brute_counts(rows, p.kmer_length, p.hash_seed).items()}
    assert {s: r for s, r in got_rows(sketching.minmers(df, p)).items()} == {s: r for s, r in want.items() if r}


def test_small_chunks_keep_counts_exact(spark, monkeypatch):
    rows = sequences(5, 2, 30, 400)
    p = SketchParams(MASH, 25, kmer_length=6)
    monkeypatch.setattr(sketching, "_CHUNK", 500)
    c = {}
    for s, _, seq in rows:
        c.setdefault(s, sketching._Counter(p)).add(seq)
    want = brute_counts(rows, 6, 0)
    for s, x in c.items():
        x.flush()
        assert dict(zip(x.hash.tolist(), zip(x.count.tolist(), x.extra.tolist(), x.kmer, strict=True), strict=True)) == brute_sketch(want[s], p)


@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_complete_sketches_against_loops(spark, k):
    rows = sequences(9)
    df = spark.createDataFrame(rows, "sample string, record_no long, seq string").repartition(4)
    index = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
    plain = defaultdict(Counter)
    for s, _, seq in rows:
        for i in range(len(seq) - k + 1):
            if set(seq[i : i + k]) <= set("ACGT"):
                plain[s][seq[i : i + k]] += 1
    want = defaultdict(dict)
    for s, c in plain.items():
        for w in c:
            r = w[::-1].translate(RC)
            lo, hi = min(w, r), max(w, r)
            if lo == hi:
                want[s][index(w)] = (2 * c[w], c[w], w)
            elif c[lo]:
                want[s][index(lo)] = (c[lo] + c[hi], c[hi], lo)
            else:
                want[s][index(hi)] = (c[hi], 0, hi)
    assert got_rows(sketching.minmers(df, SketchParams(ALL, kmer_length=k))) == want


def test_totals(spark):
    rows = sequences(3) + [("s0", 99, None), ("empty", 0, "")]
    df = spark.createDataFrame(rows, "sample string, record_no long, seq string")
    got = {r["sample"]: (r["seq_length"], r["num_valid_kmers"]) for r in sketching.totals(df, SketchParams(kmer_length=7)).collect()}
    want = defaultdict(lambda: [0, 0])
    for s, _, seq in rows:
        want[s][0] += len(seq or "")
        want[s][1] += len(naive(seq or "", 7))
    assert got == {s: tuple(x) for s, x in want.items()}
    assert {r["seq_length"] for r in sketching.totals(df, SketchParams(ALL, kmer_length=2)).collect()} == {0}


def test_limits():
    assert max_hash(0.001) == U64 // 1000 and max_hash(1.0) == U64 and max_hash(0.0) == 1 and max_hash(1e-18) == 18
    assert abs(effective_scale(max_hash(0.01)) - 0.01) < 1e-9


def test_hash_text_and_order(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (-(1 << 63),)], "hash long")
    got = [r[0] for r in df.orderBy(sketching.hash_ord()).select(sketching.hash_text()).collect()]
    assert got == ["0", "5", str(1 << 63), str(U64)]


def peak(run, batch) -> tuple[int, list]:
    """Bytes that a stage holds at most beside its input, and its rows."""
    tracemalloc.start()
    try:
        rows = [pa.Table.from_batches([b]).to_pydict() for b in run(iter([batch]))]
        return tracemalloc.get_traced_memory()[1], rows
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("samples", [1, 3, 400])
def test_counting_holds_a_bounded_number_of_bases(samples):
    """A batch of 8 MB of packed bases: its numbers of k-mers would be 256 MB."""
    rng = np.random.default_rng(2)
    raw = [rng.integers(0, 256, 20_000).astype(np.uint8).tobytes() for _ in range(400)]
    batch = pa.record_batch([pa.array([f"s{i % samples}" for i in range(400)]), pa.array(raw, pa.binary())], names=["sample", "seq"])
    held, rows = peak(sketching._indices(4), batch)
    assert held < 80_000_000
    assert sum(sum(r["c"]) for r in rows) == 400 * (4 * 20_000 - 3)
    assert len(rows) == 1 + (samples == 400)  # many small samples go on together
    held, rows = peak(sketching._stage(SketchParams(MASH, 100)), batch)
    assert held < 120_000_000 and sum(len(r["hash"]) for r in rows) == 100 * samples and len(rows) == 1


def test_scaled_hashes_are_moved_a_few_times(monkeypatch):
    rng = np.random.default_rng(4)
    c = sketching._Counter(SketchParams(SCALED, 1000, scale=0.05))
    moved = []
    merge = sketching._Counter._merge
    monkeypatch.setattr(sketching._Counter, "_merge", lambda self: (moved.append(len(self.hash)), merge(self)))
    for _ in range(8):
        c.add(rng.integers(0, 256, 1 << 18).astype(np.uint8).tobytes())
    c.flush()
    assert len(c.hash) > 300_000 and sum(moved) < 3 * len(c.hash)


@pytest.fixture
def counted(spark):
    """Sequences that count how often a task reads each of their records."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(s, "ACGTTGCATGNACCA" * (i + 1), i, "fastq" if (s, i) == ("s1", 3) else "fasta") for s in ("s0", "s1") for i in range(3, 9)]
    rows += [("s2", "AC", 0, "fastq"), ("s2", None, 1, "fasta")]
    shape = "sample string, seq string, record_no long, format string"
    return spark.createDataFrame(rows, shape).mapInArrow(watch, shape), seen, len(rows)


def test_complete_sketches_read_their_records_once(counted):
    """Counts, k-mers, formats and the filters that follow them; a sample too short for a k-mer has a row as well."""
    df, seen, n = counted
    c = api.sketch_sequences(df, SketchParams(ALL, 4**4, 4**4, True, 4), FilterParams(None, 1, 10**6, 0.0, 0.0))
    heads = [(r["name"], r["seq_length"], r["num_valid_kmers"], r["filter_params"]["filter_on"]) for r in c.sketches.orderBy("sketch_id").collect()]
    texts = ["ACGTTGCATGNACCA" * (i + 1) for i in range(3, 9)]
    valid = sum(sum("N" not in t[i : i + 4] for i in range(len(t) - 3)) for t in texts)
    assert heads == [("s0", 0, valid, False), ("s1", 0, valid, True), ("s2", 0, 0, True)]
    rows = c.minmers.groupBy("sketch_id").agg(F.sum("count").alias("n")).collect()
    palindromes = sum(sum(t[i : i + 4] == t[i : i + 4].translate(RC)[::-1] for i in range(len(t) - 3)) for t in texts)
    assert {(r["sketch_id"], r["n"]) for r in rows} == {(0, valid + palindromes), (1, valid + palindromes)}
    assert seen.value == n


def test_scaled_sketches_read_their_records_once(counted):
    """However their columns are used: the branches of the pick share one pass."""
    df, seen, n = counted
    got = sketching.minmers(df, SketchParams(SCALED, 3, 3, True, 5, scale=0.5))
    assert got.select("sample", "hash").distinct().count() == got.count() > 6
    assert seen.value == n
