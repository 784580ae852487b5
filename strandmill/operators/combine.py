"""Merging sketches and comparing their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import max_hash, ordered
from .sketching import capped, hash_ord, smallest


def merge(a: DataFrame, b: DataFrame, size: int | None = None, scale: float | None = None, keep_tail: bool = False, by: str | None = None) -> DataFrame:
    """Rows of one sketch out of two: counts add up, and only hashes up to the smaller of the two largest stay, above
    which the sketches can't be compared (so an empty side empties the result; keep_tail keeps all). Then size and scale
    clip: both, as a scaled sketch does; either alone, that one. by: a column that pairs up many sketches at once.
    """
    keys = [by] if by else []
    side = lambda d, n: d.select(*keys, "hash", "kmer", "count", "extra_count", *([F.col("label")] if "label" in d.columns else [F.lit(None).cast("binary").alias("label")]), F.lit(n).alias("_side"))
    both = side(a, 0).unionByName(side(b, 1))
    first = lambda c: F.min_by(c, "_side").alias(c)
    merged = both.groupBy(*keys, "hash").agg(first("kmer"), capped(F.sum("count")).alias("count"), capped(F.sum("extra_count")).alias("extra_count"), first("label"))
    if not keep_tail:
        tops = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, hash_ord())).alias("_a"), F.max(F.when(F.col("_side") == 1, hash_ord())).alias("_b"))
        tops = tops.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(*keys, F.least("_a", "_b").alias("_m"))
        merged = (merged.join(tops, keys) if keys else merged.join(F.broadcast(tops))).where(hash_ord() <= F.col("_m")).drop("_m")
    return _clipped(merged, size, scale, by)


def _clipped(merged: DataFrame, size: int | None, scale: float | None, by: str | None) -> DataFrame:
    keys = [by] if by else []
    low = hash_ord() <= ordered(max_hash(scale)) if scale is not None else None
    if size is None:
        return merged if low is None else merged.where(low)
    few = smallest(merged, size, by) if keys else merged.orderBy(hash_ord()).limit(size)
    if low is None:
        return few
    # what the scale lets in above each group's size-th hash
    last = few.groupBy(*keys).agg(F.max(hash_ord()).alias("_last"))
    more = merged.where(low)
    more = more.join(last, keys, "left") if keys else more.join(F.broadcast(last))  # without keys one row
    return few.unionByName(more.where(F.col("_last").isNull() | (hash_ord() > F.col("_last"))).drop("_last"))


def merge_many(rows: DataFrame, by: str, heads: DataFrame | None = None, size: int | None = None, scale: float | None = None, keep_tail: bool = False, into: str | None = None) -> DataFrame:
    """Rows of one sketch out of any number, in one aggregation: what merge() makes of them one after another, in any order, if only
    the last one clips by scale (clipping by size alone may come at every step).

    by: the column that tells sketches apart; heads: all of them (by), with those that have no rows, which empty
    the result; into: a column, of rows and heads, of the sketches that come out, if they are several. Counts add up; hashes up to the
    least of all largest ones stay (keep_tail: all), then size and scale clip as in merge(). Where k-mers and labels
    differ, those of the first sketch in order stay."""
    keys = [into] if into else []
    first = lambda c: F.min_by(c, F.struct(F.col(c).isNull(), by)).alias(c)
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("binary").alias("label")
    slim = rows.select(*keys, by, "hash", "kmer", "count", "extra_count", label)
    merged = slim.groupBy(*keys, "hash").agg(first("kmer"), capped(F.sum("count")).alias("count"), capped(F.sum("extra_count")).alias("extra_count"), first("label"))
    if not keep_tail:
        tops = slim.groupBy(*keys, by).agg(F.max(hash_ord()).alias("_top"))
        if heads is not None:
            tops = heads.select(*keys, by).join(tops, [*keys, by], "left")
        least = tops.groupBy(*keys).agg(F.min("_top").alias("_m"), F.count(F.when(F.col("_top").isNull(), 1)).alias("_bare"))
        least = least.where(F.col("_bare") == 0).drop("_bare")
        merged = (merged.join(least, keys) if keys else merged.join(F.broadcast(least))).where(hash_ord() <= F.col("_m")).drop("_m")  # without keys one row
    return _clipped(merged, size, scale, into)


def compare_counts(query: DataFrame, ref: DataFrame, by: list[str] | None = None) -> DataFrame:
    """common, ref_pos, query_pos, ref_count, query_count, var, skew, kurt of the query's counts where the reference has the hash.

    The positions are how many hashes of each side lie up to the smaller of the largest hashes. by: columns that pair up
    many sketches at once."""
    keys = by or []
    both = query.select(*keys, "hash", F.col("count").alias("qc"), F.lit(None).cast("bigint").alias("rc")).unionByName(ref.select(*keys, "hash", F.lit(None).cast("bigint").alias("qc"), F.col("count").alias("rc")))
    rows = both.groupBy(*keys, "hash").agg(F.max("qc").alias("qc"), F.max("rc").alias("rc"))
    tops = rows.groupBy(*keys).agg(F.max(F.when(F.col("qc").isNotNull(), hash_ord())).alias("a"), F.max(F.when(F.col("rc").isNotNull(), hash_ord())).alias("b"))
    tops = tops.select(*keys, F.when(F.col("a").isNull() | F.col("b").isNull(), None).otherwise(F.least("a", "b")).alias("m"))
    rows = rows.join(tops, keys) if keys else rows.join(F.broadcast(tops))  # without keys one row
    hit = F.col("qc").isNotNull() & F.col("rc").isNotNull()
    matched, within = F.when(hit, F.col("qc").cast("double")), hash_ord() <= F.col("m")
    number = lambda c: F.coalesce(c, F.lit(float("nan")))
    return rows.groupBy(*keys).agg(
        F.count(matched).alias("common"),
        F.count(F.when(within & F.col("rc").isNotNull(), 1)).alias("ref_pos"),
        F.count(F.when(within & F.col("qc").isNotNull(), 1)).alias("query_pos"),
        F.coalesce(F.sum(F.when(hit, F.col("rc"))), F.lit(0)).alias("ref_count"),
        F.coalesce(F.sum(F.when(hit, F.col("qc"))), F.lit(0)).alias("query_count"),
        number(F.var_pop(matched)).alias("var"), number(F.skewness(matched)).alias("skew"), number(F.kurtosis(matched)).alias("kurt"),
    )


#: Ranges that a sketch's hashes are numbered in, side by side.
_RANGES = 64


def places(ref: DataFrame) -> DataFrame:
    """hash, ref_pos: the place of each of a sketch's hashes in their order, from 0."""
    o = ref.select("hash", hash_ord().alias("_o"))
    cuts = o.agg(F.percentile_approx("_o", [i / _RANGES for i in range(1, _RANGES)], F.lit(1000)).alias("_cuts"))  # one row
    dealt = o.join(F.broadcast(cuts)).select("hash", "_o", F.size(F.filter("_cuts", lambda x: x < F.col("_o"))).alias("_range"))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    numbered = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_range").orderBy("_o")))
    return numbered.join(F.broadcast(before), "_range").select("hash", (F.col("_rn") - 1 + F.col("_before")).cast("int").alias("ref_pos"))


def sparse_matrix(ref: DataFrame, others: DataFrame, by: str = "sample") -> DataFrame:
    """Group, ref_pos, count: each sketch's count of each of the reference's hashes that it has."""
    return others.select(by, "hash", "count").join(places(ref), "hash").select(by, "ref_pos", "count")


#: Places of a row of the matrix that are made together.
_PLACES = 4096


def count_matrix(ref: DataFrame, others: DataFrame, by: str = "sample") -> DataFrame:
    """Group, ref_pos, count: sparse_matrix() with its zeros, one row for every group and hash."""
    n = ref.count()
    if not n:
        return sparse_matrix(ref, others, by)
    block = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _PLACES)))
    inside = F.explode(F.sequence(F.col("_b") * _PLACES, F.least(F.lit(n), (F.col("_b") + 1) * _PLACES) - 1))
    every = others.select(by).distinct().select(by, block.alias("_b")).select(by, inside.alias("ref_pos"))
    return every.join(sparse_matrix(ref, others, by), [by, "ref_pos"], "left").select(by, "ref_pos", F.coalesce("count", F.lit(0)).alias("count"))


def matrix_rows(matrix: DataFrame, by: str = "sample") -> DataFrame:
    """Group, counts: one array a sketch, in order of the reference's hashes."""
    return matrix.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "count"))), lambda x: x["count"]).alias("counts"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with other counts, by hash; a count of 0 drops its row."""
    return rows.drop("count").join(counts.select("hash", "count"), "hash").where(F.col("count") > 0).select(rows.columns)
