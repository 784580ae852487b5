import math
import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import combine, distance, filters, stats
from strandmill.params import FilterParams, SketchParams, common_params, max_hash, ordered, signed
from strandmill.errors import SketchError

ROWS = "sample string, hash long, kmer string, count long, extra_count long"


def frame(spark, groups):
    """groups: name -> list of (hash, count[, extra])."""
    return spark.createDataFrame([(s, h, "ACGT", n, e[0] if e else 0) for s, rows in groups.items() for h, n, *e in rows], ROWS)


def naive_threshold(counts, level):
    hist = [0] * max(counts, default=0)
    for c in counts:
        hist[c - 1] += 1
    cut, cum, w = level * sum((i + 1) * n for i, n in enumerate(hist)), 0, 0
    for i, n in enumerate(hist):
        cum += i * n
        if cum > cut:
            break
        w = i + 1
    if not w:
        return 1
    win = max(1, w // 20)
    sums = [(sum(hist[i : i + win]), -i) for i in range(w - win)]
    return -min(sums)[1] + win + 1 if sums else win


def test_threshold(spark):
    rng = random.Random(1)
    cases = [([1], 0.2), ([1, 1], 0.2), ([1, 9], 0.2), ([1, 10, 10, 9], 0.1), ([1, 1, 2, 4], 0.1), ([2], 1.0)]
    assert [naive_threshold(*c) for c in cases] == [1, 1, 8, 8, 1, 2]
    for level in (0.0, 0.1, 0.2, 0.5, 1.0):
        groups = {f"v{i}": c for i, (c, x) in enumerate(cases) if x == level}
        for i in range(60):
            top = rng.choice([3, 10, 60, 400])
            groups[f"r{i}"] = [rng.randint(1, top) for _ in range(rng.randint(1, 40))]
        df = frame(spark, {s: list(enumerate(c)) for s, c in groups.items()})
        got = {r["sample"]: r["threshold"] for r in filters.guess_threshold(df, level).collect()}
        assert got == {s: naive_threshold(c, level) for s, c in groups.items()}


def kept(df):
    return sorted(r["hash"] for r in df.collect())


def test_abundance_and_strand(spark):
    df = frame(spark, {"a": [(1, 1), (2, 10), (3, 10), (4, 9)]})
    assert kept(filters.by_abundance(df, 9)) == [2, 3, 4] and kept(filters.by_abundance(df, 2, 9)) == [4] and len(kept(filters.by_abundance(df))) == 4
    assert kept(filters.by_strand(frame(spark, {"a": [(1, 10, 1), (2, 10, 2), (3, 10, 8), (4, 10, 9)]}), 0.15)) == [1, 2, 3, 4]
    assert kept(filters.by_strand(frame(spark, {"a": [(1, 16, 1), (2, 16, 2), (3, 16, 8), (4, 16, 9)]}), 0.15)) == [3, 4]


def test_filters_in_order(spark):
    rng = random.Random(2)
    rows = [(i, n, rng.randint(0, n)) for i, n in enumerate(rng.choice([1, 1, 1, 2, 20, 30, 31]) for _ in range(300))]
    df = frame(spark, {"a": rows})
    p = FilterParams(True, 2, 30, 0.1, 0.2)
    strand = [r for r in rows if r[1] < 16 or min(r[2], r[1] - r[2]) / r[1] >= 0.2]
    low = max(2, naive_threshold([r[1] for r in strand], 0.1))
    got, found = filters.filter_counts(df, p)
    assert kept(got) == [r[0] for r in strand if low <= r[1] <= 30]
    assert found.first()["threshold"] == naive_threshold([r[1] for r in strand], 0.1)
    assert len(kept(filters.filter_counts(df, FilterParams(False, 2))[0])) == 300
    assert p.resolved(True).filter_on and FilterParams().resolved(True).filter_on and not FilterParams().resolved(False).filter_on


def test_trim_and_strictness(spark):
    df = frame(spark, {"a": [(i, 1) for i in range(5)], "b": [(-1, 1), (3, 1)]})
    p = SketchParams(kmers_to_sketch=9, final_size=3)
    assert kept(filters.final_trim(df, p)) == [-1, 0, 1, 2, 3]
    with pytest.raises(SketchError, match="b: 3 k-mers are asked for, but only 2 are there"):
        filters.check_full(df.select("sample").distinct(), filters.final_trim(df, p), p)
    filters.check_full(df.select("sample").distinct(), df, SketchParams(final_size=3, no_strict=True))


def naive_raw(q, r, scale):
    """A merge of two sorted lists that ends with the shorter one, then what a scale lets in of the rest."""
    i = j = common = 0
    while i < len(q) and j < len(r):
        if q[i] == r[j]:
            i, j, common = i + 1, j + 1, common + 1
        elif q[i] < r[j]:
            i += 1
        else:
            j += 1
    if scale:
        top = max_hash(scale)
        while i < len(q) and q[i] < top:
            i += 1
        while j < len(r) and r[j] < top:
            j += 1
    total = i - common + j
    return (common / j if j else 0.0, common / total if total else 1.0, common, total)


def compared(spark, cases, k, scale=None, old=False, max_dist=1.0, every=False, bits=64):
    """The distances of each case's own pair, or of every query to every reference."""
    def side(at, by, x):
        rows = spark.createDataFrame([(f"{x}{i}", h) for i, c in enumerate(cases) for h in c[at]], f"{by} string, hash long")
        heads = spark.createDataFrame([(f"{x}{i}", len(c[at]), ordered(max(c[at])) if c[at] else None) for i, c in enumerate(cases)], f"{by} string, {x}n long, {x}t long")
        return rows, heads

    (q, queries), (r, refs) = side(0, "query", "q"), side(1, "reference", "r")
    return distance.distances(q, r, queries, refs, k, scale, old, max_dist, bits, None if every else F.substring("query", 2, 9) == F.substring("reference", 2, 9))


def measured(df):
    return {int(r["query"][1:]): (r["containment"], r["jaccard"], r["commonHashes"], r["totalHashes"]) for r in df.collect()}


def test_raw_distance(spark):
    rng = random.Random(3)
    some = lambda top: sorted(rng.sample(range(top), rng.randint(0, min(12, top))))
    for scale, fixed in ((None, [([0, 1, 2], [1, 2]), ([0, 2], [1, 2]), ([0, 1], [2, 3]), ([], []), ([], [5])]), (1e-18, [([10, 15, 20], [15, 20]), ([5, 10, 15], [5, 10]), ([5, 10, 15, 20], [5, 10]), ([5, 10], [5, 10, 15, 20])])):
        cases = fixed + [(some(30), some(30)) for _ in range(300)]
        got = measured(compared(spark, cases, 21, scale))
        for i, (q, r) in enumerate(cases):
            if q and r or not scale:
                assert got[i] == naive_raw(q, r, scale), (q, r)
    first = measured(compared(spark, [([0, 1, 2], [1, 2]), ([5, 10], [5, 10, 15, 20])], 21, 1e-18))
    assert first[1] == (2 / 3, 2 / 3, 2, 3)


def test_old_distance_and_mash_distance(spark):
    got = compared(spark, [([0, 1, 2], [1, 2, 9]), ([1], []), ([], [1]), ([1], [2])], 21, old=True).orderBy("query").collect()
    assert (got[0]["containment"], got[0]["jaccard"], got[0]["commonHashes"], got[0]["totalHashes"]) == (2 / 3, 2 / 4, 2, 3)
    assert math.isnan(got[1]["jaccard"]) and got[1]["mashDistance"] == 0.0
    assert got[2]["jaccard"] == 0.0 and got[2]["mashDistance"] == got[3]["mashDistance"] == 1.0
    assert abs(got[0]["mashDistance"] + math.log(2 * 0.5 / 1.5) / 21) < 1e-12


@pytest.mark.parametrize("block,scale,old", [(256, None, False), (2, 2e-17, False), (2, None, True)])
def test_pairs_within_a_distance_are_those_of_all_pairs(spark, monkeypatch, block, scale, old):
    """Whatever the threshold, sizes, scale and way; hashes that all sketches have go in blocks."""
    monkeypatch.setattr(distance, "BLOCK", block)
    rng = random.Random(7)
    base = [rng.sample(range(1, 400), 60) for _ in range(4)]
    near = lambda: sorted({0, *(h for h in rng.choice(base) if rng.random() < rng.choice([0.5, 0.9, 1.0])), *rng.sample(range(1, 400), rng.randint(0, 9))})
    cases = [(near()[: rng.randint(1, 60)], near()[: rng.randint(1, 60)]) for _ in range(40)] + [([], [3]), ([0], []), ([5], [6])]
    whole = {(r["query"], r["reference"]): tuple(map(str, r)) for r in compared(spark, cases, 3, scale, old, every=True, bits=10).collect()}
    assert len(whole) == len(cases) ** 2
    if not old:
        for (q, r), got in list(whole.items())[::7]:
            a, b = cases[int(q[1:])][0], cases[int(r[1:])][1]
            if a and b:
                assert got[2:4] + got[5:] == tuple(map(str, naive_raw(a, b, scale)))
    for most in (0.1, 0.6):
        got = {(r["query"], r["reference"]): tuple(map(str, r)) for r in compared(spark, cases, 3, scale, old, most, every=True).collect()}
        assert got == {p: r for p, r in whole.items() if float(r[4]) <= most} and len(got) < len(whole)


def test_few_candidates_are_counted(spark):
    """Groups of like sketches: pairs are pruned before they are made."""
    rng = random.Random(3)
    rows, heads = [], []
    shared = sorted(rng.sample(range(1 << 40), 30))
    for g in range(60):
        own = sorted(rng.sample(range(1 << 40), 100))
        for i in range(4):
            hashes = sorted({*shared, *(h for h in own if rng.random() < 0.95)})
            rows += [(f"s{g}-{i}", h) for h in hashes]
            heads.append((f"s{g}-{i}", len(hashes), ordered(hashes[-1])))
    rows, heads = spark.createDataFrame(rows, "sample string, hash long"), spark.createDataFrame(heads, "sample string, n long, top long")
    q, r, queries, refs = distance.sides(rows, heads)
    least = distance.least_jaccard(0.02, 21)
    candidates = distance.near_pairs(q, r, queries, refs, least).count()
    out = distance.distances(q, r, queries, refs, 21, max_dist=0.02)
    answer, meeting = out.count(), distance.common_hashes(q, r).count()
    assert answer <= candidates <= 2 * answer and meeting == 240 * 240 > 20 * candidates
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "array" not in out._jdf.queryExecution().analyzed().toString()


def test_a_hash_of_all_sketches_is_split(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 8)
    rows = spark.range(100).selectExpr("concat('s', id) AS query", "7L AS hash")
    refs = rows.withColumnRenamed("query", "reference")
    keys = []
    real = type(rows).join

    def seen(self, other, on=None, how=None):
        out = real(self, other, on, how)
        if on == ["hash", "i", "j"]:
            keys.extend(r["count"] for r in out.groupBy("hash", "i", "j").count().collect())
        return out

    monkeypatch.setattr(type(rows), "join", seen)
    got = distance.common_hashes(rows, refs)
    assert got.count() == 10_000 and sum(keys) == 10_000 and len(keys) > 100 and max(keys) < 1000


@pytest.mark.parametrize("bits", [64, 12])
def test_hashes_up_to(spark, bits):
    rng = random.Random(bits)
    sets = {f"s{i}": rng.sample(range(1 << bits) if bits < 64 else [rng.getrandbits(64) for _ in range(2000)], 300) for i in range(3)}
    asked = [(s, x) for s in sets for x in [*rng.sample(sets[s], 20), 0, (1 << bits) - 1, *(rng.getrandbits(bits) for _ in range(20))]]
    rows = spark.createDataFrame([(s, signed(h)) for s, hs in sets.items() for h in hs], "sample string, hash long")
    got = distance.hashes_upto(rows, spark.createDataFrame([(s, ordered(x)) for s, x in asked], "sample string, x long"), "sample", bits)
    assert {(r["sample"], r["x"]): r["upto"] for r in got.collect()} == {(s, ordered(x)): sum(h <= x for h in sets[s]) for s, x in asked}


def test_jaccard_is_symmetric(spark):
    rng = random.Random(4)
    cases = [(sorted(rng.sample(range(25), 8)), sorted(rng.sample(range(25), 6))) for _ in range(100)]
    a, b = (measured(compared(spark, c, 21)) for c in (cases, [(r, q) for q, r in cases]))
    assert all(a[i][1:] == b[i][1:] for i in a)


def test_merge(spark):
    rng = random.Random(5)
    for size, scale, tail in ((None, None, False), (5, None, False), (None, 1e-18, False), (3, 1e-18, False), (None, None, True)):
        a, b = ({h: rng.randint(1, 9) for h in rng.sample(range(40), 10)} for _ in range(2))
        df = [frame(spark, {"x": sorted(s.items())}).drop("sample") for s in (a, b)]
        every = sorted(h for h in a.keys() | b.keys() if tail or h <= min(max(a), max(b)))
        want = [(h, a.get(h, 0) + b.get(h, 0)) for i, h in enumerate(every) if (size is None and scale is None) or (size is not None and i < size) or (scale is not None and h <= max_hash(scale))]
        assert sorted((r["hash"], r["count"]) for r in combine.merge(*df, size=size, scale=scale, keep_tail=tail).collect()) == want
    nothing = frame(spark, {"x": [(1, 1)]}).drop("sample").limit(0)
    assert combine.merge(df[0], nothing).count() == 0 and combine.merge(df[0], nothing, keep_tail=True).count() == 10


def test_compare_counts(spark):
    q = frame(spark, {"x": [(1, 1), (2, 2), (3, 4), (9, 7)]}).drop("sample")
    r = frame(spark, {"x": [(0, 3), (1, 5), (2, 6), (3, 7)]}).drop("sample")
    got = combine.compare_counts(q, r).first()
    assert tuple(got)[:5] == (3, 4, 3, 18, 7)
    assert [round(x, 4) for x in tuple(got)[5:]] == [1.5556, 0.3818, -1.5]
    none = combine.compare_counts(q, r.where("hash = 0")).first()
    assert none["common"] == 0 and all(math.isnan(none[c]) for c in ("var", "skew", "kurt"))


def test_matrix_and_set_counts(spark):
    ref = frame(spark, {"r": [(5, 1), (-3, 1), (7, 2)]})
    others = frame(spark, {"a": [(7, 4), (8, 1)], "b": [(-3, 6)]})
    got = {r["sample"]: r["counts"] for r in combine.matrix_rows(combine.count_matrix(ref, others)).collect()}
    assert got == {"a": [0, 4, 0], "b": [0, 0, 6]}
    new = spark.createDataFrame([(5, 0), (7, 9)], "hash long, count long")
    assert [(r["hash"], r["count"]) for r in combine.with_counts(ref, new).collect()] == [(7, 9)]


def test_hist_and_cardinality(spark):
    df = frame(spark, {"a": [(1, 1), (2, 1), (3, 1)], "b": list(enumerate([4, 2, 4, 3, 126497]))})
    got = {r["sample"]: r["hist"] for r in stats.dense_histogram(df).collect()}
    assert got["a"] == [3] and len(got["b"]) == 126497 and got["b"][:4] == [0, 1, 1, 2] and sum(got["b"]) == 5
    import numpy as np

    rng = random.Random(6)
    groups = {f"g{i}": [(h - (1 << 64) if h >> 63 else h, 1) for h in sorted(rng.getrandbits(64) >> s for _ in range(n))] for i, (n, s) in enumerate([(1, 0), (2, 0), (50, 3), (300, 12), (300, 60), (40, 30)])}
    got = {r["sample"]: int(r["cardinality"]) for r in stats.cardinality(frame(spark, groups)).collect()}
    for s, rows in groups.items():
        top = max(h % (1 << 64) for h, _ in rows)
        x = np.float32(len(rows) - 1) / (np.float32(top) / np.float32((1 << 64) - 1))
        assert got[s] == min(int(x), (1 << 64) - 1), s


def test_gc_and_depth(spark):
    df = spark.createDataFrame([("a", 1, "GGAT", 3, 0), ("a", 2, "cATT", 1, 0), ("n", 1, "", 2, 0)], ROWS)
    got = {r["sample"]: r for r in stats.info(df).collect()}
    assert abs(got["a"]["gc"] - 100 * 7 / 16) < 1e-5 and got["a"]["depth"] == 2.0 and math.isnan(got["n"]["gc"])


def test_params():
    a, b = SketchParams(), SketchParams(kmer_length=22)
    assert a.incompatible(b) == ("k", 21, 22) and a.incompatible(SketchParams(hash_seed=1))[0] == "hash seed"
    assert a.incompatible(SketchParams(final_size=7)) is None
    with pytest.raises(SketchError):
        common_params([])
    with pytest.raises(SketchError, match="k 22"):
        common_params([a, b])
    assert SketchParams("none", kmer_length=3).expected_size() == 64 and SketchParams("none").hash_info() == ("None", 0, 0, None)


def test_filter_params():
    p = FilterParams(True, 2, 90, 0.25, 0.1)
    assert p.to_map() == {"strandFilter": "0.1", "errFilter": "0.25", "minCopies": "2", "maxCopies": "90"}
    assert FilterParams.from_map(p.to_map()) == p and FilterParams.from_map({}) == FilterParams(False) and FilterParams(False, 2).to_map() == {}
    assert p.tightened(FilterParams(True, 5, None, 0.1, 0.3)) == FilterParams(True, 5, 90, 0.25, 0.3)
    assert p.tightened(FilterParams(True, 5, None), compat=True).abun_high is None
    with pytest.raises(SketchError):
        FilterParams.from_map({"minCopies": "x"})


def test_dense_histogram_fills_gaps(spark):
    from strandmill.operators import stats

    rows = [("a", d) for d in (1, 1, 4, 20_000)] + [("b", 3), ("c", 1)]
    df = spark.createDataFrame(rows, "sample string, count bigint").withColumn("hash", F.monotonically_increasing_id())
    out = stats.dense_histogram(df)
    got = {r["sample"]: r["hist"] for r in out.collect()}
    want = [2, 0, 0, 1, *[0] * 19_995, 1]
    assert got == {"a": want, "b": [0, 0, 1], "c": [1]}
    # no place is looked up among all others
    assert "element_at" not in out._jdf.queryExecution().optimizedPlan().toString()
