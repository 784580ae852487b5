"""Stored indices, searches by many queries, and merging of many sketches."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill import api
from strandmill.operators import combine, distance
from strandmill.params import ALL, MASH, SCALED, FilterParams, SketchParams
from strandmill.sources import formats, index


@pytest.fixture(scope="module")
def sketches():
    rng = random.Random(2)
    base = [[rng.getrandbits(64) for _ in range(60)] for _ in range(3)]
    made = []
    for i in range(14):
        hashes = sorted({h for h in base[i % 3] if rng.random() < 0.8} | {rng.getrandbits(64) for _ in range(rng.randint(0, 40))})
        made.append(formats.sketch(f"s{i}", [(h, "A" * 21, 1 + i, 0, None) for h in hashes], SketchParams(MASH, 100, 100, True), seq_length=10 * i, num_valid_kmers=i))
    return [*made, formats.sketch("empty", [], SketchParams(MASH, 100, 100, True)), formats.sketch("s3", made[3]["rows"], SketchParams(MASH, 100, 100, True))]


def rows(df):
    return sorted(map(str, df.collect()))


def test_an_index_gives_the_same_answers(spark, sketches, tmp_path):
    c = api.Collection.of(spark, sketches)
    path = str(tmp_path / "it's an index")
    c.save_index(path, 4)
    kept = api.Collection.open_index(spark, path)
    assert rows(kept.minmers) == rows(c.minmers) and rows(kept.sketches) == rows(c.sketches)
    queries = api.Collection.of(spark, sketches[::2])
    assert rows(kept.best_matches(queries)) == rows(c.best_matches(queries))
    for more in ({}, {"max_dist": 0.05}, {"old": True}):
        assert rows(kept.distances(queries, **more)) == rows(c.distances(queries, **more))
    want = {s["name"]: s for s in sketches}
    for q, r, containment in kept.best_matches(queries).select("query", "reference", "containment").collect():
        best, place = max((api.Sketch(s).compare(api.Sketch(want["s2"]))[0], -i) for i, s in enumerate(sketches)) if q == 1 else (None, None)
        assert best is None or (containment == best and r == -place)


def test_a_search_leaves_the_index_in_place(spark, sketches, tmp_path, monkeypatch):
    """All references as queries: what is stored is joined without an exchange, hot hashes apart."""
    for block in (256, 2):
        monkeypatch.setattr(distance, "BLOCK", block)
        path = str(tmp_path / f"i{block}")
        api.Collection.of(spark, sketches).save_index(path, 4)
        kept = api.Collection.open_index(spark, path)
        conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
        old = {k: spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            minmers = kept.stored.minmers.select("sketch_id", "hash")
            met = distance.meetings(minmers.withColumnRenamed("sketch_id", "query").repartition(3), minmers.withColumnRenamed("sketch_id", "reference"), None)
            tree = met._jdf.queryExecution().executedPlan().toString()
            asked = spark.createDataFrame([(1, 5)], "reference long, x long")
            steps = distance.stepped(kept.stored.places.withColumnRenamed("sketch_id", "reference"), asked, "reference")._jdf.queryExecution().executedPlan().toString()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        for plan, some in ((tree, True), (steps, False)):
            lines = plan.split("\n")
            scans = [i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x]
            assert scans
            # the way up from a bucketed scan to the first join has no exchange, but where rows of hot hashes were picked before
            depth = lambda x: len(x) - len(x.lstrip(" :|+-*"))
            free = 0
            for i in scans:
                d, up = depth(lines[i]), i - 1
                while up >= 0 and "Join" not in lines[up]:
                    if depth(lines[up]) < d:
                        d = depth(lines[up])
                        if "Exchange" in lines[up]:
                            break
                    up -= 1
                free += "Join" in lines[up]
            assert free >= 1


def test_steps_are_counts(spark):
    rng = random.Random(6)
    for bits in (64, 12):
        sets = {s: list({rng.getrandbits(bits) for _ in range(200)}) for s in ("a", "b")}
        from strandmill.params import ordered, signed

        r = spark.createDataFrame([(s, signed(h)) for s, hs in sets.items() for h in hs], "sample string, hash long")
        asked = [(s, x) for s in sets for x in [*sets[s][:20], 0, (1 << bits) - 1, *(rng.getrandbits(bits) for _ in range(30))]]
        got = {(x["sample"], x["x"]): x["upto"] for x in distance.stepped(distance.steps(r, "sample", bits), spark.createDataFrame([(s, ordered(x)) for s, x in asked], "sample string, x long"), "sample", bits).collect()}
        for s, x in asked:
            assert got.get((s, ordered(x)), 0) == sum(h <= x for h in sets[s])


@pytest.mark.parametrize("params", [SketchParams(MASH, 30, 30, True), SketchParams(SCALED, 30, scale=0.3)])
def test_merging_many_is_merging_one_by_one(spark, params):
    rng = random.Random(4)
    made = [api.Sketch(formats.sketch(f"m{i}", sorted((h, "C" * 21, rng.randint(1, 9), 1, None) for h in {rng.randrange(1 << 64) if i % 2 else (7919 * rng.randrange(90) << 50) % (1 << 64) for _ in range(40)}), params, seq_length=5, num_valid_kmers=2)) for i in range(5)]
    c = api.Collection.from_sketches(made)
    for size, tail in ((None, False), (10, False), (None, True)):
        counts = {}
        for s in made:
            for h, m, n, e in s.hashes:
                counts[h] = (m, counts.get(h, (m, 0, 0))[1] + n, counts.get(h, (m, 0, 0))[2] + e)
        cut = max(counts) if tail else min(s.hashes[-1][0] for s in made)
        want = [(h, *counts[h]) for h in sorted(counts) if h <= cut]
        if size or params.scheme == SCALED:
            want = [x for i, x in enumerate(want) if size and i < size or params.scheme == SCALED and x[0] <= params.limit]
        many = c.merged(size, keep_tail=tail)
        assert len(many) == 1 and many[0].hashes == want and (many[0].name, many[0].seq_length, many[0].num_valid_kmers) == ("m0", 25, 10)
        if params.scheme == MASH:  # one by one gives the same
            one = made[0]
            for s in made[1:]:
                one = one.merge(s, size, keep_tail=tail)
            assert one.hashes == want
    bare = api.Collection.from_sketches([*made, api.Sketch(formats.sketch("none", [], params))])
    assert len(bare.merged()[0]) == 0 and len(bare.merged(keep_tail=True)[0]) == len(c.merged(keep_tail=True)[0])


def test_merging_into_several(spark):
    r = spark.createDataFrame([("x", "a", 1, "k", 1, 0), ("x", "b", 1, "k", 2, 1), ("x", "b", 9, "k", 1, 0), ("y", "c", 5, "k", 4, 0)], "to string, s string, hash long, kmer string, count long, extra_count long")
    got = combine.merge_many(r, "s", into="to").select("to", "hash", "count", "extra_count").collect()
    assert sorted(map(tuple, got)) == [("x", 1, 3, 1), ("y", 5, 4, 0)]


def test_digests_tell_sketches_apart(spark, sketches):
    """By everything they hold, in whatever order and parts their rows come."""
    one = sketches[0]
    more = [one, one | {"name": "t"}, one | {"rows": one["rows"][1:]}, one | {"rows": [(h, m, n, e, b"") for h, m, n, e, _ in one["rows"]]}, one | {"rows": [(h, m, n + 1, e, x) for h, m, n, e, x in one["rows"]]}, one | {"comment": "c"}, one]
    c = api.Collection.of(spark, more)
    got = [r["same"] for r in c.profile().orderBy("sketch_id").collect()]
    assert got[0] == got[6] and len(set(got)) == 6
    mixed = api.Collection(c.sketches, c.minmers.repartition(5).sortWithinPartitions(F.rand(1)))
    assert [r["same"] for r in mixed.profile().orderBy("sketch_id").collect()] == got


def test_sparse_and_dense_matrix(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(s, h, (h * 7 + i) % 5 + 1) for i, s in enumerate("abc") for h in range(-9000, 9000, 2 + i)], "sample string, hash long, count long")
    ref = r.where("sample = 'a'")
    dense, sparse = combine.count_matrix(ref, r), combine.sparse_matrix(ref, r)
    assert rows(dense.where("count > 0")) == rows(sparse) and dense.count() == 3 * ref.count() and dense.select("sample", "ref_pos").distinct().count() == 3 * ref.count()
    assert combine.count_matrix(ref.limit(0), r).count() == 0
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    assert combine.count_matrix(ref, r.where("sample = 'b'").withColumn("hash", F.col("hash") * 2 + 1)).agg(F.sum("count")).first()[0] == 0


def test_index_reads_few_files(spark, tmp_path):
    r = spark.range(5000).selectExpr("0L AS sketch_id", "id * 3 AS hash", "'A' AS kmer", "1L AS count", "0L AS extra_count", "CAST(NULL AS BINARY) AS label")
    heads = spark.createDataFrame([(0, "n", 1, 1, "", None, None)], api.SKETCHES)
    index.write_index(heads, r, spark.createDataFrame([], index._PROFILE), str(tmp_path / "x"), buckets=8)
    kept = index.open_index(spark, str(tmp_path / "x"))
    found = kept.minmers.where("hash = 300")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan and "EqualTo(hash,300)" in plan and found.count() == 1
