import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from strandmill.llm import exact_dedup, line_dedup, simhash

from .conftest import TEXTS

SPACES = " \t\n\x0b\x0c\r"


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in SPACES)].append((-len(t or ""), i is None, i))
    best = {k: min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for k, g in groups.items()}
    out = []
    for i, t in rows:
        k = "".join(c for c in t or "" if c not in SPACES)
        out.append((i, best[k], len(groups[k]), i == best[k], hashlib.sha256(k.encode()).hexdigest()))
    return Counter(out)


def test_exact_edges(edge, empty):
    got = exact_dedup.exact_dedup(edge)
    assert Counter(map(tuple, got.collect())) == brute_exact(TEXTS)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot text" + " " * rng.randint(0, 3) if i % 3 else f"text {rng.randint(0, 40)}") for i in range(1200)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert Counter(map(tuple, got.collect())) == brute_exact(rows)


def brute_lines(rows, min_chars=20, min_docs=3):
    found = defaultdict(set)
    key = lambda x: lowered(x.strip(SPACES))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                found[key(x)].add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if i is None or len(key(x)) < min_chars or len(found[key(x)]) < min_docs or max(found[key(x)]) == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_edges(edge, empty):
    assert Counter(map(tuple, line_dedup.line_dedup(edge).collect())) == brute_lines(TEXTS)
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_line_hot_keys_over_partition_edges(spark, parts):
    rng = random.Random(parts)
    common = ["the line that nearly every text has", "a line that a few of the texts have", "a line of just two of the texts"]
    rows = []
    for i in range(400):
        t = [f"own line number {i} and {j}, long enough" for j in range(rng.randint(0, 3))]
        t += [common[0].upper() if rng.random() < 0.3 else common[0]] * rng.randint(0, 3)
        t += [common[1]] * (rng.random() < 0.02) + [common[2]] * (i in (7, 300)) * 2
        rng.shuffle(t)
        rows.append((i, "\n".join(t)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert Counter(map(tuple, got.collect())) == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_bitmaps():
    for positions in ([0], [3], [7], [8], [0, 5, 9, 31], list(range(40))):
        bits = line_dedup.keeps(line_dedup.pack(positions), 45)
        assert np.nonzero(~bits)[0].tolist() == positions
    assert line_dedup.keeps(None, 3).all()


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(" " if c in SPACES else c for c in lowered(text or "")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    some = sorted(root)
    for a in range(len(some)):
        for b in range(a):
            if (some[a] ^ some[b]).bit_count() <= radius:
                root[top(some[a])] = top(some[b])
    return {f: top(f) for f in fps}


def check_components(rows, got, radius):
    """rows: (id, fingerprint)."""
    of = brute_components({f for _, f in rows}, radius)
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = Counter((i, f"{f:016x}", least.get(of[f])) for i, f in rows)
    assert Counter(map(tuple, got)) == want


def test_simhash_edges(edge, empty):
    rows = [(i, brute_fingerprint(t)) for i, t in TEXTS if t is None or len(t) < 60_000]
    short = edge.where(F.coalesce(F.length("text"), F.lit(0)) < 60_000)
    check_components(rows, simhash.near_dups(short).collect(), 2)
    assert simhash.near_dups(empty).count() == 0
    assert simhash.fingerprint("A b\tC d " * 9000) == simhash.fingerprint("a B c D " * 9000)


def test_simhash_fingerprints():
    rng = random.Random(5)
    words = ["Ab", "c", "é,", "DDD", "x.", "\x85y"]
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(n))
        for k in (3, 5):
            assert simhash.fingerprint(t, k) == brute_fingerprint(t, k)


@pytest.mark.parametrize(("radius", "bucket"), [(2, 64), (2, 1), (3, 64), (3, 1)])
def test_simhash_links_through_tables_and_through_balls(spark, radius, bucket):
    rng = random.Random(radius)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        fps.add(c)
        for _ in range(8):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(c)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), radius, bucket)
    labels = {r["node"] % (1 << 64): r["root"] for r in simhash.components(edges).collect()}
    of = brute_components(fps, radius)
    groups = lambda m: sorted(sorted(g) for g in _grouped(m))
    assert groups({f: labels.get(f, f"only {f}") for f in fps}) == groups(of)


def _grouped(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out.values()


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_registered_simhash_query(spark):
    """The whole query against brute force."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_components(rows, __spark_entry__.queries()["op2_simhash"](spark, sf).collect(), 2)


def shingles(text, k=5):
    words = [w for w in "".join(" " if c in SPACES else c for c in lowered(text or "")).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def check_similar(rows, got, far=0.6, near=0.85):
    """rows: id -> text; got: id -> component. All pairs by brute force: near ones share a component, and a component hangs
    together over pairs that are not far apart."""
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
            if j >= near:
                assert got[a] == got[b], (a, b, j)
            if j >= far:
                root[top(a)] = top(b)
    for i, c in got.items():
        assert c <= i and got[c] == c and top(i) == top(c)


def test_similar_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert got.keys() == rows.keys()
    check_similar(rows, got)


def test_similar_large_group_of_near_copies(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(400)]
    rows = {}
    for i in range(600):
        text = list(base) if i % 3 else [word() for _ in range(rng.randint(50, 200))]
        if i % 3:
            for at in rng.sample(range(400), 4):
                text[at] = word()
        rows[i] = " ".join(text)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string").repartition(4)).collect()}
    assert {got[i] for i in rows if i % 3} == {1} and all(got[i] == i for i in rows if not i % 3)


def test_similar_edges(edge, empty):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar(edge).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 4): 1, (6, 4): 1, (7, 7): 1, (8, 7): 2, (9, 9): 1, (10, 10): 1, (11, 11): 1})
    assert simhash.similar(empty).count() == 0


def similar_of(spark, rows, **how):
    df = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in simhash.similar(df, **how).collect()}


def variant(rng, base, share):
    """A text whose last words are new, as many as a share of all."""
    keep = round(len(base) * (1 - share))
    return base[:keep] + [f"n{rng.getrandbits(60)}" for _ in range(len(base) - keep)]


def test_similar_is_exact_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    check_similar(rows, got, far=0.8, near=0.8)


def test_similar_links_nothing_below(spark):
    rng = random.Random(11)
    rows = {}
    for i in range(100):
        base = [f"b{rng.getrandbits(60)}" for _ in range(300)]
        rows[2 * i], rows[2 * i + 1] = " ".join(base), " ".join(variant(rng, base, rng.uniform(0.118, 0.14)))
    assert similar_of(spark, rows) == {i: i for i in rows}


def test_similar_finds_all_at_the_threshold(spark):
    rng = random.Random(12)
    rows = {}
    for i in range(200):
        base = [f"b{rng.getrandbits(60)}" for _ in range(300)]
        rows[2 * i], rows[2 * i + 1] = " ".join(base), " ".join(variant(rng, base, rng.uniform(0.095, 0.106)))
    assert similar_of(spark, rows) == {i: i - i % 2 for i in rows}


@pytest.mark.parametrize("crowd", [2, 16, 1000])
def test_similar_pairs_among_many_that_share_a_passage(spark, crowd):
    rng = random.Random(13)
    passage = [f"p{rng.getrandbits(60)}" for _ in range(240)]
    rows = {}
    for i in range(150):
        own = passage + [f"o{rng.getrandbits(60)}" for _ in range(50)]
        rows[2 * i], rows[2 * i + 1] = " ".join(own), " ".join(variant(rng, own, rng.uniform(0.02, 0.1)) if i % 3 else variant(rng, own, 0.175))
    got = similar_of(spark, rows, crowd=crowd)
    check_similar(rows, got, far=0.8, near=0.8)
    assert len(set(got.values())) > 100


def test_similar_id_with_many_texts(spark):
    rng = random.Random(14)
    texts = {i: " ".join(f"w{rng.getrandbits(60)}" for _ in range(50)) for i in range(1, 7)}
    rows = [*texts.items(), *[(9, texts[i]) for i in (1, 2, 3, 5)]]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 9: 1}


def test_candidates_of_a_shared_passage_are_few(spark):
    """More shingles than any table of counters: what many documents share comes last in their order, so it pairs none of them."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = " ".join(word() for _ in range(300))
    texts = [f"{passage} {' '.join(word() for _ in range(900))}" for _ in range(400)]
    twins = [t.rsplit(" ", 20)[0] for t in texts[:30]]
    docs = [*texts, *twins]
    rows = [(i, i, len(s := sorted({hash((*w[j : j + 5],)) for w in [t.split()] for j in range(len(w) - 4)})), [-1] * 8, s) for i, t in enumerate(docs)]
    assert len({x for r in rows for x in r[4]}) > 1 << 18
    found = spark.createDataFrame(rows, "id long, root long, n int, bits array<long>, shingles array<long>").repartition(4)
    got = {tuple(r) for r in simhash.crowded(found, 0.8).collect()}
    assert got == {(i, 400 + i) for i in range(30)}


def test_pipeline_groups_by_fingerprints_too(spark):
    """What op2 puts in one component stays one document, whatever the sets of shingles say."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, "one two three four five " * 60 + " ".join(f"w{rng.getrandbits(40)}" for _ in range(12))) for i in range(6)]
    rows += [(10 + i, " ".join(f"v{rng.getrandbits(40)}" for _ in range(40))) for i in range(5)] + [(20, None), (21, " "), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    named = docs.where("doc_id is not null")
    of = lambda found: {r["doc_id"]: r["component_id"] for r in found.collect()}
    prints, plain, both = of(simhash.near_dups(named)), of(simhash.similar(named)), of(simhash.similar(named, radius=simhash.RADIUS))
    assert prints != plain and len(set(prints.values()) & set(range(6))) < 6 == len({plain[i] for i in range(6)})
    assert all(both[i] == both[c] for i, c in [*prints.items(), *plain.items()]) and {both[i] for i in range(10, 15)} == set(range(10, 15))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {*both.values(), None}
