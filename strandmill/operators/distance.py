"""Set similarity between sketches, by an inverted index.

A sketch is its rows; a pair is a row of numbers. Hashes that two sketches share are met by a join on the
hash, counted before anything is shuffled again; a hash of many sketches is cut into pairs of blocks of
sketches, so no key grows with their number. How many hashes of a sketch lie up to another one's largest
comes from ranks, within ranges of hashes. Where a greatest distance is asked for, pairs are found by the
first hashes of both sketches alone, and only what these leave is counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import max_hash, ordered
from ..sources.tables import held
from .sketching import hash_ord

#: Sketches in a block of a hash that has more pairs than a block squared.
BLOCK = 256
#: Blocks either way that the frame of all pairs is made in.
SIDES = 16
#: Binary digits of the ranges that a sketch's hashes are numbered in.
RANGES = 10


def mash_distance(j: Column, k: Column | int) -> Column:
    """-ln(2j / (1 + j)) / k within 0 and 1; 1 for no similarity, 0 where it is undefined."""
    d = -F.log(2.0 * j / (1.0 + j)) / k
    return F.when(j.isNull() | F.isnan(j), 0.0).when(j == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), d)) + F.lit(0.0))


def least_jaccard(max_dist: float, k: int) -> float:
    """The similarity that a distance of max_dist stands for, a little less than it, so that rounding loses nothing."""
    x = math.exp(-k * max_dist)
    return max(0.0, x / (2.0 - x) * (1 - 1e-9)) if max_dist < 1 else 0.0


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, empty).otherwise(a / F.greatest(b, F.lit(1)))


def profiles(rows: DataFrame, by: str = "sample", *more: Column) -> DataFrame:
    """Group, n (its hashes), top (the largest, in order-preserving form), and more aggregates."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(hash_ord()).alias("top"), *more)


def meetings(q: DataFrame, r: DataFrame, most: int | None = None) -> DataFrame:
    """A row, with the columns of both, for every hash that a row of q (query, hash, ...) and one of r (reference, hash, ...) share; a
    group has a hash once. most: pairs that there are at all, if known; where a hash can't have more than a block's, none is
    looked for."""
    if most is not None and most <= BLOCK * BLOCK:
        return q.join(r, "hash")
    # each side by itself, so that what lies in buckets by hash stays where it is
    many = lambda d, n: d.groupBy("hash").agg(F.count(F.lit(1)).alias(n))
    hot = many(q, "a").join(many(r, "b"), "hash").where(F.col("a") * F.col("b") > BLOCK * BLOCK).select("hash", F.ceil(F.col("a") / BLOCK).cast("int").alias("a"), F.ceil(F.col("b") / BLOCK).cast("int").alias("b"))
    hot = held(hot)
    cold = q.join(hot, "hash", "left_anti").join(r, "hash")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = q.join(hot, "hash").select(*q.columns, block("query", "a").alias("i"), upto("b").alias("j"))
    right = r.join(hot, "hash").select(*r.columns, upto("a").alias("i"), block("reference", "b").alias("j"))
    return cold.unionByName(left.join(right, ["hash", "i", "j"]).drop("i", "j"))


def common_hashes(q: DataFrame, r: DataFrame, most: int | None = None) -> DataFrame:
    """query, reference, commonHashes of all pairs that share a hash."""
    return meetings(q, r, most).groupBy("query", "reference").agg(F.count(F.lit(1)).alias("commonHashes"))


def _cell(o: Column, bits: int) -> Column:
    """The range of hashes, of 2**RANGES, that a hash of so many bits is in."""
    return F.call_function("shiftright", o, F.lit(max(0, bits - RANGES)))


def hashes_upto(rows: DataFrame, asked: DataFrame, by: str, bits: int = 64) -> DataFrame:
    """by, x, upto: for each distinct (by, x) of asked the number of the group's hashes up to x. Hashes have that many bits."""
    both = rows.select(by, hash_ord().alias("o"), F.lit(1).alias("is")).unionAll(asked.select(by, F.col("x"), F.lit(0)).distinct()).withColumn("cell", _cell(F.col("o"), bits))
    # within a range by its order, and before it by the ranges' counts, 2**RANGES a group at most
    inside = both.withColumn("within", F.sum("is").over(Window.partitionBy(by, "cell").orderBy("o"))).where(F.col("is") == 0).drop("is")
    cells = both.groupBy(by, "cell").agg(F.sum("is").alias("has"))
    before = cells.select(by, "cell", (F.sum("has").over(Window.partitionBy(by).orderBy("cell")) - F.col("has")).alias("before"))
    return inside.join(before, [by, "cell"]).select(by, F.col("o").alias("x"), (F.col("within") + F.col("before")).alias("upto"))


def steps(rows: DataFrame, by: str, bits: int = 64) -> DataFrame:
    """by, cell, o, next, at: of each hash its place in its group, from 1, and the next hash, in every range of hashes that
    lies between. To be stored: stepped() looks numbers up in it by (by, cell)."""
    per = Window.partitionBy(by).orderBy("o")
    placed = rows.select(by, hash_ord().alias("o")).select(by, "o", F.lead("o").over(per).alias("next"), F.row_number().over(per).alias("at"))
    last = F.lit((1 << 63) - 1).cast("long")
    return placed.select(by, F.explode(F.sequence(_cell(F.col("o"), bits), F.coalesce(_cell(F.col("next"), bits), _cell(last, bits) if bits == 64 else _cell(F.lit(ordered((1 << bits) - 1)), bits)))).alias("cell"), "o", "next", "at")


def stepped(stored: DataFrame, asked: DataFrame, by: str, bits: int = 64) -> DataFrame:
    """What hashes_upto() gives, from steps(), whose rows stay where they are; groups without a hash up to x have no row."""
    found = asked.distinct().withColumn("cell", _cell(F.col("x"), bits)).join(stored, [by, "cell"])
    return found.where((F.col("o") <= F.col("x")) & (F.col("next").isNull() | (F.col("x") < F.col("next")))).select(by, "x", F.col("at").alias("upto"))


def measured(pairs: DataFrame, q: DataFrame, r: DataFrame, k: int | Column, scale: float | None = None, old: bool = False, bits: int = 64, stored: DataFrame | None = None) -> DataFrame:
    """containment, jaccard, mashDistance, commonHashes, totalHashes of pairs (query, reference, commonHashes, and qn, qt, rn, rt:
    the hashes and the largest hash of each; other columns stay). q: query, hash; r: reference, hash.

    Both sketches count up to the smaller of their largest hashes, and with a scale on both
    also below its limit. old: the reference's hashes are looked up in the query. stored: the references' steps()."""
    c = F.col("commonHashes")
    rest = [x for x in pairs.columns if x not in ("qn", "qt", "rn", "rt", "commonHashes")]
    if old:
        t = F.col("rn")
        jaccard = F.when(t == 0, float("nan")).otherwise(c / F.greatest(c + 2 * (t - c), F.lit(1)))
        both = pairs.select(*rest, "commonHashes", t.alias("totalHashes"), F.when(t == 0, float("nan")).otherwise(c / F.greatest(t, F.lit(1))).alias("containment"), jaccard.alias("jaccard"))
    else:
        cut = F.when((F.col("qn") > 0) & (F.col("rn") > 0), F.least("qt", "rt"))
        if scale:
            cut = F.greatest(cut, F.lit(ordered(max_hash(scale)) - 1))
        pairs = pairs.withColumn("x", cut)
        for by, rows, n, top, to in (("query", q, "qn", "qt", "i"), ("reference", r, "rn", "rt", "j")):
            # a sketch whose largest hash is the cut counts in whole
            asked = pairs.where((F.col("x") < F.col(top)) & (F.col(n) > 0)).select(by, "x")
            part = stepped(stored, asked, by, bits) if stored is not None and by == "reference" else hashes_upto(rows.select(by, "hash"), asked, by, bits)
            part = part.withColumnRenamed("upto", to)
            whole = F.when(F.col("x").isNull() | (F.col(n) == 0), F.lit(0)).when(F.col("x") >= F.col(top), F.col(n))
            pairs = pairs.join(part, [by, "x"], "left").withColumn(to, F.coalesce(whole, F.col(to), F.lit(0)).cast("long"))
        both = pairs.withColumn("totalHashes", F.col("i") - c + F.col("j")).select(*rest, "commonHashes", "totalHashes", _ratio(c, F.col("j"), 0.0).alias("containment"), _ratio(c, F.col("totalHashes"), 1.0).alias("jaccard"))
    return both.select(*rest, "containment", "jaccard", mash_distance(F.col("jaccard"), k).alias("mashDistance"), "commonHashes", "totalHashes")


def every_pair(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Each of queries (query, ...) beside each of refs (reference, ...): as many rows as the answer has. Made block by block."""
    upto = F.explode(F.sequence(F.lit(0), F.lit(SIDES - 1)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(SIDES)).cast("int")
    a, b = queries.withColumn("_i", block("query")).withColumn("_j", upto), refs.withColumn("_j", block("reference")).withColumn("_i", upto)
    return a.join(b, ["_i", "_j"]).drop("_i", "_j")


def near_pairs(q: DataFrame, r: DataFrame, queries: DataFrame, refs: DataFrame, jaccard: float, old: bool = False, most: int | None = None) -> DataFrame:
    """query, reference: every pair whose similarity may be jaccard (above 0) or more. q: query, hash; r: reference, hash; queries: query, qn,
    qt; refs: reference, rn, rt.

    Of two sketches the one that ends first counts in whole, so a similar pair shares that part of its n hashes at least.
    Hashes are ordered by how many sketches have them, the rare ones first. Then the first hash that a similar pair
    shares is among the first of the one that ends first, as many as it can do without and one more; and behind it both
    have enough hashes left. So hashes of many sketches bring pairs together only where a sketch has hardly any others."""
    often = q.select("hash").unionAll(r.select("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    place = lambda rows, by, x: rows.join(often, "hash").withColumn(f"{x}a", F.row_number().over(Window.partitionBy(by).orderBy("often", "hash"))).drop("often")
    a, b = place(q, "query", "q").join(queries, "query"), place(r, "reference", "r").join(refs, "reference")
    need = lambda n, part: F.ceil(F.col(n) * part - 1e-6)

    def met(x: str, y: str, first, part: float):
        """Pairs by the first hashes of side x, which must have that part of its own in common."""
        o, early = need(f"{x}n", part), F.col(f"{x}a") <= F.col(f"{x}n") - need(f"{x}n", part) + 1
        found = meetings(a.where(early), b, most) if x == "q" else meetings(a, b.where(early), most)
        return found.where(first & (1 + F.least(F.col(f"{x}n") - F.col(f"{x}a"), F.col(f"{y}n") - F.col(f"{y}a")) >= o)).select("query", "reference")

    if old:  # common / (2 * the reference's - common): only the reference's hashes count
        return met("r", "q", F.lit(True), 2 * jaccard / (1 + jaccard)).distinct()
    return met("q", "r", F.col("qt") <= F.col("rt"), jaccard).unionAll(met("r", "q", F.col("rt") < F.col("qt"), jaccard)).distinct()


def counted(pairs: DataFrame, q: DataFrame, r: DataFrame) -> DataFrame:
    """query, reference, commonHashes of the pairs, each with its hashes in common, which may be none."""
    mine = pairs.join(q.select("query", "hash"), "query")
    found = mine.join(r.select("reference", "hash"), ["reference", "hash"]).groupBy("query", "reference").agg(F.count(F.lit(1)).alias("commonHashes"))
    return pairs.join(found, ["query", "reference"], "left").withColumn("commonHashes", F.coalesce("commonHashes", F.lit(0).cast("long")))


def distances(
    q: DataFrame, r: DataFrame, queries: DataFrame, refs: DataFrame, k: int, scale: float | None = None, old: bool = False, max_dist: float = 1.0, bits: int = 64, apart: Column | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """query, reference, containment, jaccard, mashDistance, commonHashes, totalHashes of all pairs within max_dist, and the
    other columns of queries (query, qn, qt, ...) and refs (reference, rn, rt, ...), which have all groups, those without
    hashes too (qn or rn 0). q: query, hash; r: reference, hash. apart: which pairs are compared. All four are read several
    times: tables.held() is for that. stored: the references' steps() with the same bits, if there are."""
    some, most = least_jaccard(max_dist, k), queries.count() * refs.count()
    if some > 0:
        slim = queries.select("query", "qn", "qt"), refs.select("reference", "rn", "rt")
        pairs = near_pairs(q, r, *slim, some, old, most)
        # a sketch without hashes is like any other, where no scale says otherwise; every pair is in the answer
        bare_q, bare_r = queries.where(F.col("qn") == 0), refs.where(F.col("rn") == 0)
        bare = [every_pair(a.select("query"), b.select("reference")) for a, b, none in ((bare_q, refs, bare_q), (queries.where(F.col("qn") > 0), bare_r, bare_r)) if not none.isEmpty()]
        for more in bare:
            pairs = pairs.unionAll(more)
        pairs = pairs.join(queries, "query").join(refs, "reference")
        pairs = counted(pairs if apart is None else pairs.where(apart), q, r)
    else:
        pairs = every_pair(queries, refs)
        pairs = (pairs if apart is None else pairs.where(apart)).join(common_hashes(q.select("query", "hash"), r.select("reference", "hash"), most=most), ["query", "reference"], "left").withColumn("commonHashes", F.coalesce("commonHashes", F.lit(0).cast("long")))
    out = measured(pairs if old else held(pairs), q, r, k, scale, old, bits, stored)
    return out.where(F.col("mashDistance") <= max_dist)


def sides(rows: DataFrame, heads: DataFrame, by: str = "sample") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(q, r, queries, refs) of one table of rows (by, hash) and its profiles (by, n, top, ...)."""
    one = lambda name, n, top: heads.select(F.col(by).alias(name), F.col("n").alias(n), F.col("top").alias(top))
    return rows.select(F.col(by).alias("query"), "hash"), rows.select(F.col(by).alias("reference"), "hash"), one("query", "qn", "qt"), one("reference", "rn", "rt")


def best_match(distances: DataFrame, order: str = "reference") -> DataFrame:
    """The reference with the greatest containment of each query; the first one on ties."""
    return distances.groupBy("query").agg(F.min_by(F.struct("reference", "containment", "jaccard"), F.struct(-F.col("containment"), F.col(order))).alias("m")).select("query", "m.*")
