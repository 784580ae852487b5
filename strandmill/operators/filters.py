"""Filters over the rows of sketches, each by group: sample, hash, kmer, count, extra_count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SketchError
from ..params import MASH, U32, FilterParams, SketchParams
from ..sources.tables import held
from .sketching import smallest


def by_abundance(rows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    return rows.where(F.col("count").between(low or 0, U32 if high is None else high))


def by_strand(rows: DataFrame, ratio: float) -> DataFrame:
    """Below 16 copies a k-mer may come from one strand; from there on the rarer strand must have its share."""
    rarer = F.least(F.col("extra_count"), F.col("count") - F.col("extra_count"))
    return rows.where((F.col("count") < 16) | (rarer / F.greatest(F.col("count"), F.lit(1)) >= ratio))


def histogram(rows: DataFrame, by: str = "sample") -> DataFrame:
    """Group, depth, n: how many hashes have that count."""
    return rows.where(F.col("count") >= 1).groupBy(by, F.col("count").alias("depth")).agg(F.count("*").alias("n"))


def guess_threshold(rows: DataFrame, level: float, by: str = "sample") -> DataFrame:
    """Group, threshold: the count below which k-mers look like read errors.

    Depths from the bottom that hold at most level of all k-mers are candidates; a window of a
    twentieth of them slides over the histogram, and its last emptiest place, but never the
    last place of all, sets the cut. Works on the sparse histogram: a window's sum changes
    only where a depth enters or leaves it, so the places next to those are all that matter.
    """
    whole = Window.partitionBy(by)
    order = whole.orderBy("depth")
    # by depth d (from 1) the running sum of (d - 1) * n must stay within level * sum of d * n; the first depth where it
    # doesn't ends the candidates, and between depths the sum doesn't change
    run = histogram(rows, by).select(
        by, "depth", F.sum("n").over(order).alias("below"),
        F.sum((F.col("depth") - 1) * F.col("n")).over(order).alias("cum"),
        (F.lit(float(level)) * F.sum(F.col("depth") * F.col("n")).over(whole)).alias("cut"),
        F.max("depth").over(whole).alias("deepest"),
    )
    bad = F.min(F.when(F.col("cum") > F.col("cut"), F.col("depth"))).over(whole)
    run = run.select(by, "depth", "below", F.coalesce(bad - 1, F.col("deepest")).alias("w")).withColumn("win", F.greatest(F.lit(1), F.expr("w div 20")))
    run = held(run)  # a row per depth, read by all that follows
    w = run.select(by, "w", "win").distinct()
    # window starts i in [0, w - win): sum of depths i + 1 .. i + win
    starts = run.select(by, "w", "win", F.explode(F.array(F.col("depth") - 1, F.col("depth"), F.col("depth") - F.col("win") - 1, F.col("depth") - F.col("win"))).alias("i"))
    ends = w.select(by, "w", "win", F.explode(F.array(F.lit(0).cast("bigint"), F.col("w") - F.col("win") - 1)).alias("i"))
    starts = starts.unionByName(ends).where((F.col("i") >= 0) & (F.col("i") < F.col("w") - F.col("win"))).distinct()
    # the running count at a place: that of the last depth at or below it
    marks = run.select(by, F.col("depth").alias("at"), F.col("below").alias("known"), F.lit(None).cast("bigint").alias("i"), F.lit(0).alias("side"))
    asks = starts.select(by, F.col("i").alias("at"), F.lit(None).cast("bigint").alias("known"), "i", F.lit(1).alias("side"))
    asks = asks.unionByName(starts.select(by, (F.col("i") + F.col("win")).alias("at"), F.lit(None).cast("bigint").alias("known"), "i", F.lit(2).alias("side")))
    last = Window.partitionBy(by).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = marks.unionByName(asks).withColumn("cum", F.coalesce(F.last("known", ignorenulls=True).over(last), F.lit(0))).where(F.col("side") > 0)
    sums = read.groupBy(by, "i").agg(F.sum(F.when(F.col("side") == 2, F.col("cum")).otherwise(-F.col("cum"))).alias("s"))
    best = sums.groupBy(by).agg(F.max_by("i", F.struct(-F.col("s"), F.col("i"))).alias("i"))
    found = F.when(F.col("w") <= 0, F.lit(1)).when(F.col("i").isNull(), F.col("win")).otherwise(F.col("i") + F.col("win") + 1)
    return w.join(best, by, "left").select(by, found.cast("bigint").alias("threshold"))


def filter_counts(rows: DataFrame, params: FilterParams, by: str = "sample") -> tuple[DataFrame, DataFrame | None]:
    """(rows that pass, group and threshold where one was guessed). Strand, then errors, then abundance, and only if on."""
    if not params.filter_on:
        return rows, None
    out, found = rows, None
    if params.strand_filter > 0:
        out = by_strand(out, params.strand_filter)
    if params.err_filter > 0:
        out = held(out)  # counted once, for the guess and for what it cuts
        found = guess_threshold(out, params.err_filter, by)
        low = F.greatest(F.col("threshold"), F.lit(params.abun_low or 0))
        out = out.join(found, by).where(F.col("count") >= low).drop("threshold")
    if params.abun_low is not None or params.abun_high is not None:
        out = by_abundance(out, params.abun_low, params.abun_high)
    return out, found


def final_trim(rows: DataFrame, params: SketchParams, by: str = "sample") -> DataFrame:
    """A mash sketch ends with final_size rows at most."""
    return smallest(rows, params.final_size, by) if params.scheme == MASH else rows


def check_full(names: DataFrame, rows: DataFrame, params: SketchParams, by: str = "sample") -> None:
    """Strict mash sketches must have final_size rows; the first sample that has too few is an error."""
    if params.scheme != MASH or params.no_strict:
        return
    n = names.select(by).join(rows.groupBy(by).count(), by, "left").select(by, F.coalesce("count", F.lit(0)).alias("n"))
    short = n.where(F.col("n") < params.final_size).orderBy(by).limit(1).collect()
    if short:
        raise SketchError(f"{short[0][by]}: {params.final_size} k-mers are asked for, but only {short[0]['n']} are there")
