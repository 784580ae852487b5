"""SimHash near-dedup by multi-index hashing.

Equal fingerprints collapse first, so everything after works on distinct fingerprints. The
64 bits fall into two segments. By the pigeonhole principle two fingerprints that differ in
at most r bits differ in at most r // 2 of the first segment, or in at most (r - 1) // 2 of
the second; so each fingerprint enumerates the Hamming balls of those radii within its
segments, fetches the table entries there and verifies the whole distance.

A table bucket with more than BUCKET fingerprints would pair up its members; what it holds
and what probes it takes another exact way: two fingerprints within r bits share a point
that is at most ceil(r / 2) bits from one and floor(r / 2) from the other, so members and
probers of hot buckets meet at the points of their whole-width balls. A point meets no more
fingerprints than a ball holds, whatever the data. Links become components by rounds of
minimum labels and pointer jumping, each round written to the shared folder.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._work import LOWER, UPPER, durable, text_of
from .mph import mix

SHINGLE = 3
RADIUS = 2
SEED = 42
SEGMENT = 32
BUCKET = 64
_TABLE = bytes.maketrans((UPPER + "\t\n\x0b\x0c\r").encode(), (LOWER + " " * 5).encode())
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _salt() -> Column:
    """Deals out rows of one fingerprint, or of one id, over the ways back to them."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(64))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = text.encode().translate(_TABLE).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    ends = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    octets = h.view(np.uint8).reshape(-1, 8)
    n, out = len(h), 0
    if n < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    for i in np.nonzero(2 * ones > n)[0].tolist():
        out |= 1 << i
    return out


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The different 64-bit hashes of the word shingles, ascending; none for a text without words."""
    words = [w for w in text.encode().translate(_TABLE).split(b" ") if w]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64))


#: A text has BANDS points, each of them the hash of ROWS minima; points with more than CROWD nodes go the second way.
BANDS, ROWS = 30, 5
CROWD = 32


def bands(h: np.ndarray) -> np.ndarray:
    """The points of a shingle set. Two sets share one with a probability of 1 - (1 - j ** ROWS) ** BANDS at a Jaccard
    similarity of j: all but 7 in a million at 0.8. None for an empty set."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    shifts = np.arange(BANDS * ROWS // 2, dtype=np.uint64)[:, None]
    least = np.full((len(shifts), 2), 0xFFFFFFFF, dtype="<u4")
    for at in range(0, len(h), 1 << 12):  # the whole set, in steps of bounded memory
        halves = mix(h[None, at : at + (1 << 12)] + shifts).astype("<u8").view("<u4").reshape(len(shifts), -1, 2)
        np.minimum(least, halves.min(axis=1), out=least)
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[4 * ROWS * i : 4 * ROWS * (i + 1)], i) for i in range(BANDS)], dtype=np.uint64).view(np.int64)


def _points(shingle: int):
    """Of each text: a key of its set, its points, and its fingerprint, that of op2."""

    def run(batches):
        for b in batches:
            keys, points, fps = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_set(t, shingle)
                fps.append(fingerprint(t))
                keys.append(xxhash.xxh128_digest(h.tobytes()))
                points.append(bands(h))
            pair = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), _lists(points), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "k1", "k2", "points", "fp"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int64), *[v.view(np.int64) for v in arrays]])
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype=np.int32), pa.array(flat))


#: 64-bit words of a set's parities: bit i tells whether an odd number of its hashes fall on i.
WORDS = 8
_SETS = "id long, n int, bits array<long>, shingles array<long>"


def parities(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(h) for h in sets], pa.int32()), _lists([parities(h) for h in sets]), _lists(sets)], names=["id", "n", "bits", "shingles"])

    return run


def may_agree(n, bits, m, other, similarity: float) -> Column:
    """Whether two sets, by their sizes and parities, may have that Jaccard similarity. Bits that differ need a shingle
    each that is in one set only, and similar sets have few of these, so no pair that has it is turned away."""
    apart = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(WORDS)), F.lit(0))
    n, m = F.col(n), F.col(m)
    sizes = F.least(n, m) >= F.greatest(n, m) * F.lit(similarity - 1e-9)
    return sizes & (apart <= (n + m) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)


def meetings(met: DataFrame, hot: DataFrame, crowd: int) -> DataFrame:
    """a < b, distinct: all pairs of nodes at the points that aren't hot, and at a hot point one of its nodes with all others.

    met has distinct (node, point), hot the points with more than crowd nodes and the node that meets the others, which is
    the first in one of four orders."""
    cold = met.join(hot.select("point"), "point", "left_anti").groupBy("point").agg(F.sort_array(F.collect_list("node")).alias("all")).where(F.size("all") > 1)
    firsts = cold.select("all", F.posexplode("all").alias("at", "a")).select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))
    stars = met.join(hot, "point").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    return firsts.unionAll(stars).where(F.col("a") < F.col("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, n, bits, shingles) have at least that Jaccard similarity, counted over the whole sets
    of the pairs that their sizes and parities leave."""
    k = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"_n{x}"), F.col("bits").alias(f"_bits{x}"))
    left = pairs.repartition(k, "a").join(slim("a"), "a").join(slim("b"), "b").where(may_agree("_na", "_bitsa", "_nb", "_bitsb", similarity)).select("a", "b").distinct()
    left = durable(left, "wide-left")
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"_{x}"))
    both, total = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
    return left.join(whole("a"), "a").join(whole("b"), "b").where(both / (total - both) >= similarity).select("a", "b").distinct()


def _firsts(found: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """The shingles that come first in each set (id, key, n, shingles), at least as many as it may miss and one more that are
    rare, with how many sets hold them among theirs where that is more than one: id, key, n, token, often.

    A set's shingles are hashes in ascending order, which says nothing of how rare they are. Its first ones are counted; more than crowd sets
    make one common, and who has common ones among its first looks as much further as their share there asks for, at the
    fourth time to its end. So shingles of a long text beyond its first ones are neither counted nor shuffled."""
    key = ["id", "key"]
    need = (F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-6) + 1).cast("int")
    fresh = found.select(*key, "n", "shingles", F.lit(0).alias("start"), F.least("n", need).alias("upto"))
    state, parts = fresh.select(*key, "n", "upto"), []
    for i in count():
        span = F.slice("shingles", F.col("start") + 1, F.col("upto") - F.col("start"))
        parts.append(durable(fresh.select(*key, "n", F.explode(span).alias("token")), f"wide-tokens-{i}"))
        tokens = reduce(DataFrame.unionAll, parts)
        often = durable(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > 1), f"wide-often-{i}")
        common = tokens.join(often.where(F.col("often") > crowd), "token", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("common"))
        rare = F.col("upto") - F.col("common")
        further = F.col("n") if i > 2 else F.least("n", F.greatest(F.col("upto") + need - rare, F.ceil(need * F.col("upto") / F.nullif(rare, F.lit(0))).cast("int")))
        short = state.join(common, key).where((rare < need) & (F.col("upto") < F.col("n")))
        ahead = durable(short.select(*key, F.col("upto").alias("start"), further.alias("upto")), f"wide-ahead-{i}")
        if ahead.isEmpty():
            return tokens.join(often, "token", "left")
        fresh = ahead.join(found.select(*key, "n", "shingles"), key)
        state = durable(state.join(ahead.select(*key, F.col("upto").alias("_upto")), key, "left").select(*key, "n", F.coalesce("_upto", "upto").alias("upto")), f"wide-upto-{i}")


def crowded(found: DataFrame, similarity: float, crowd: int = CROWD) -> DataFrame:
    """a < b, distinct: every pair of documents of different roots whose sets (id, root, n, bits, shingles) may have that
    similarity or more; none of those that have it is left out. An id may have several sets.

    Shingles are ordered: first those that at most crowd sets have among their first, by hash, then the others, the rarer ones
    first. Two sets that are similar enough share a shingle among the first of both, as many as the smaller or the
    larger one may miss and one more; and where the first shingle they share stands at the i-th and j-th place of sets of
    n and m, they share at most 1 + min(n - i, m - j), which must be enough. Shingles of one set alone meet nothing."""
    found = found.withColumn("shingles", F.sort_array("shingles")).withColumn("key", F.xxhash64("shingles"))
    common = F.coalesce("often", F.lit(1)) > crowd
    order = Window.partitionBy("id", "key").orderBy(common, F.when(common, F.col("often")), "token")
    first = lambda part: F.col("n") - F.ceil(F.col("n") * F.lit(part) - 1e-6) + 1
    both = 2 * similarity / (1 + similarity)  # of the mean size of two similar sets, this share is in both
    ranked = _firsts(found, similarity, crowd).withColumn("rank", F.row_number().over(order)).where(F.col("often").isNotNull() & (F.col("rank") <= first(similarity)))
    ranked = ranked.select("id", "key", "token", "rank", (F.col("rank") <= first(both)).alias("small"))
    keep = durable(ranked.join(found.select("id", "key", "root", "n", "bits"), ["id", "key"]).drop("key"), "wide-first")
    small = keep.where("small").select("token", F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("n").alias("_n"), F.col("bits").alias("_bits"), F.col("rank").alias("_rank"))
    near = (F.col("_n") <= F.col("n")) & (F.col("root") != F.col("_root")) & may_agree("n", "bits", "_n", "_bits", similarity)
    enough = 1 + F.least(F.col("n") - F.col("rank"), F.col("_n") - F.col("_rank")) >= (F.col("n") + F.col("_n")) * F.lit(both / 2) - 1e-6
    return keep.join(small, "token").where(near & enough).select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def _near(rows: DataFrame, nodes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """a < b: links of nodes whose texts have equal fingerprints, each with the smallest, or fingerprints that links() joins.
    rows: id, k1, k2, fp; nodes: k1, k2, node."""
    # texts of one set may differ in fingerprint, as repeats count there
    of = durable(rows.select("k1", "k2", "fp").distinct().join(nodes, ["k1", "k2"]).select("fp", "node"), "wide-fps")
    least = durable(of.groupBy("fp").agg(F.min("node").alias("low")), "wide-prints")
    equal = of.join(least, "fp").where(F.col("low") < F.col("node")).select(F.col("low").alias("a"), F.col("node").alias("b"))
    found = links(least.select("fp"), radius, bucket)
    low = lambda x: least.select(F.col("fp").alias(x), F.col("low").alias(f"_{x}"))
    ends = found.join(low("a"), "a").join(low("b"), "b").where(F.col("_a") != F.col("_b"))
    return equal.unionAll(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct()


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD, radius: int | None = None, bucket: int = BUCKET,
) -> DataFrame:
    """One row per input row with an id: id, component_id, the smallest id reachable over links of that similarity or more.

    radius: fingerprints within as many bits are links, too, found by multi-index hashing as in near_dups(); None: none are.
    A link is else a Jaccard similarity counted over the whole shingle sets. Candidates meet at the points of their minima; what
    a point with more than crowd nodes leaves in different components is compared by the rarest shingles, without exception.
    Nulls and wordless texts have the empty set. Rows with a null id take no part; rows that share an id are one document,
    which links with all that any of them links with. Other columns are ignored; an empty table gives no rows."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text_col)).alias("text"))
    rows = durable(texts.mapInArrow(_points(shingle), "id long, k1 long, k2 long, points array<long>, fp long").withColumn("salt", _salt()), "wide")
    key = ["k1", "k2"]
    # equal sets are one node, named by the smallest id, and go back by salt
    salted = rows.select("id", *key, "salt")
    part = durable(salted.groupBy(*key, "salt").agg(F.min("id").alias("low")), "wide-salts")
    nodes = durable(part.groupBy(*key).agg(F.min("low").alias("node")), "wide-nodes")
    members = part.join(nodes, key).select(*key, "salt", "node")
    same = salted.join(members, [*key, "salt"]).select("id", "node")
    # an id with several texts links their nodes, each with the smallest
    several = same.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where(F.col("a") < F.col("last")).select("id", "a")
    shared = same.join(several, "id").where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b")).distinct()
    if radius is not None:
        shared = shared.unionAll(_near(rows, nodes, radius, bucket)).distinct()
    named = rows.select("id", *key, "points").join(nodes.withColumnRenamed("node", "id"), ["id", *key], "left_semi")
    every = named.select(F.col("id").alias("node"), F.explode("points").alias("point"))
    # points of one node have nothing to say
    met = durable(every.join(every.groupBy("point").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("point"), "point").select("node", "point").distinct(), "wide-met")
    turn = F.xxhash64(F.col("point").bitwiseAND(F.lit(3)))
    sizes = met.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("node").bitwiseXOR(turn)).alias("least"))
    hot = durable(sizes.where(F.col("n") > crowd).select("point", F.col("least").bitwiseXOR(turn).alias("first")), "wide-hot")
    pairs = durable(meetings(met, hot, crowd), "wide-pairs")
    # the whole sets only of nodes that meet others
    sets = durable(texts.join(met.select(F.col("node").alias("id")).distinct(), "id", "left_semi").mapInArrow(_sets(shingle), _SETS).distinct(), "wide-sets")
    links = durable(verified(pairs, sets, similarity).unionAll(shared), "wide-links")
    labels = components(links, "wide")
    # hot points whose nodes aren't all in one component: their nodes go the second way
    at = met.join(hot.select("point"), "point").join(labels, "node", "left").select("point", "node", F.coalesce("root", "node").alias("root"))
    at = durable(at, "wide-at")
    open_ = at.groupBy("point").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high")).select("point")
    left = durable(at.join(open_, "point").select(F.col("node").alias("id"), "root").distinct(), "wide-open")
    if not left.isEmpty():
        some = durable(sets.join(left, "id").select("id", "root", "n", "bits", "shingles"), "wide-some")
        more = durable(verified(durable(crowded(some, similarity, crowd), "wide-more"), some, similarity), "wide-extra")
        labels = components(links.unionAll(more), "wide-all")
    return same.join(labels, "node", "left").select(F.col("id").alias(id_col), F.coalesce("root", "node").alias("component_id"))


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a signed long). A null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text_col)).alias("text")).mapInArrow(_fingerprints(shingle), "id long, fp long")


def masks(width: int, radius: int, shift: int = 0) -> list[int]:
    """The bit patterns of weight radius or less within width bits, shifted; signed 64-bit."""
    out = [sum(1 << (b + shift) for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _segments(radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment; a radius below 0 means none is needed."""
    return [(0, SEGMENT, radius // 2), (SEGMENT, 64 - SEGMENT, (radius - 1) // 2)]


def _key(c: Column, shift: int, width: int) -> Column:
    """The segment's bits in place, others 0."""
    mask = ((1 << width) - 1) << shift
    return c.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(patterns: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in patterns])


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a < b for distinct fingerprints of the column fp: all pairs within radius bits that a bucket of bounded size brings
    together, and through the points of balls at least a chain of links within radius between the others."""
    segs = [(i, *s) for i, s in enumerate(_segments(radius)) if s[2] >= 0]
    entry = lambda i, shift, width: F.struct(F.lit(i).alias("seg"), _key(F.col("fp"), shift, width).alias("key"))
    tables = fps.select("fp", F.inline(F.array(*[entry(i, shift, width) for i, shift, width, _ in segs])))
    sizes = tables.groupBy("seg", "key").count()
    hot = sizes.where(F.col("count") > bucket).select("seg", "key", F.lit(True).alias("hot"))

    def ball(i, shift, width, r):
        return F.transform(_flips(masks(width, r, shift)), lambda m: F.struct(F.lit(i).alias("seg"), _key(F.col("fp"), shift, width).bitwiseXOR(m).alias("key")))

    probe = [ball(*s) for s in segs]
    probes = fps.select("fp", F.inline(F.concat(*probe)))
    cold_tables = tables.withColumnRenamed("fp", "b").join(hot, ["seg", "key"], "left_anti")
    found = (
        probes.withColumnRenamed("fp", "a").join(cold_tables, ["seg", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    # a probe of a radius-0 ball is the entry itself, so probers cover members
    warm = probes.join(hot, ["seg", "key"], "left_semi").select("fp").distinct()
    near, far = radius // 2, radius - radius // 2
    point = lambda r: F.transform(_flips(masks(64, r)), lambda m: F.col("fp").bitwiseXOR(m))
    met = warm.select("fp", F.explode(point(near)).alias("point"))
    if far == near:  # any two that meet are within radius
        met = met.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).select("a", F.explode("all").alias("b"))
    else:
        met = met.withColumnRenamed("fp", "a").join(warm.select(F.col("fp").alias("b"), F.explode(point(far)).alias("point")), "point").select("a", "b")
    return found.unionAll(met.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """node, root: the smallest node reachable, for every node of the edges (a, b).

    Rounds take the smallest label among the neighbours and jump through the labels; both
    sides of an edge carry it, and a round costs joins on node. Their number grows with the
    logarithm of a component's diameter, not with its size.
    """
    both = durable(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{tag}-0")
    for i in range(1, 200):
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        # what a root hears through its members goes to it as well
        heard = labels.join(around, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("low"))
        hook = heard.groupBy(F.col("root").alias("at")).agg(F.min("low").alias("hook"))
        lower = heard.join(hook, F.col("root") == F.col("at")).select("node", "root", F.least("low", "hook").alias("low"))
        up = lower.select(F.col("node").alias("at"), F.col("low").alias("top"))
        new = durable(lower.join(up, F.col("low") == F.col("at"), "left").select("node", F.least("low", "top").alias("root"), (F.col("root") != F.least("low", "top")).alias("moved")), f"{tag}-{i}")
        labels = new.select("node", "root")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of radius bits or less, itself
    included. Null and wordless texts have fingerprint zero and link like any other. Rows
    with a null id get their component, but never name one unless all its ids are null.
    Repeated rows each come back. An empty table gives no rows; other columns are ignored.
    """
    # a hot fingerprint has one entry below, and one per salt on the way back; the salt is written, so it stays what it is
    salted = durable(fingerprints(docs, id_col, text_col, shingle).withColumn("salt", _salt()), "fps")
    part = durable(salted.groupBy("fp", "salt").agg(F.min("id").alias("low")), "salts")
    nodes = durable(part.groupBy("fp").agg(F.min("low").alias("low")), "nodes")
    linked = durable(links(nodes.select("fp"), radius, bucket), "links")
    labels = components(linked)
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    by_salt = part.select("fp", "salt").join(by_fp, "fp")
    return salted.join(by_salt, ["fp", "salt"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
