"""Estimates and summaries of sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import histogram
from .sketching import hash_ord

_TOP = 18446744073709551615.0


def single(c: Column) -> Column:
    """Rounded to 32-bit floating point, as DOUBLE."""
    return c.cast("float").cast("double")


def dense_histogram(rows: DataFrame, by: str = "sample") -> DataFrame:
    """Group, hist: number of hashes by count from 1 on. Long where a count is large; keep histogram() for work."""
    hist = histogram(rows, by)
    packed = hist.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("m"))
    # each depth behind as many zeros as lie between it and the one before: as many steps as places
    gap = lambda x, i: x["depth"] - F.when(i > 0, F.get("m", i - 1)["depth"]).otherwise(F.lit(0)) - 1
    return packed.select(by, F.flatten(F.transform("m", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), gap(x, i).cast("int")), F.array(x["n"])))).alias("hist"))


#: What each figure is made of, so that any of them come from one aggregation.
_PARTS = {
    "cardinality": lambda: {"n": F.count("*"), "top": F.max(hash_ord())},
    "depth": lambda: {"total": F.sum("count"), "n": F.count("*")},
    "gc": lambda: {"total": F.sum("count"), "gc_bases": F.sum(F.col("count") * F.length(F.regexp_replace("kmer", "[^GgCc]", ""))), "longest": F.max(F.length("kmer"))},
}


def _cardinality() -> Column:
    # hash_ord + 2^63 in exact decimals
    last = (F.col("top").cast("decimal(38,0)") + F.lit("9223372036854775808").cast("decimal(38,0)")).cast("float").cast("double")
    part = single(last / F.lit(_TOP))
    value = single((F.col("n") - 1).cast("double") / F.when(part == 0, F.lit(None).cast("double")).otherwise(part))
    # by way of BIGINT, which is exact, in two halves of the unsigned range
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    below = value < 2.0**63
    whole = F.when(below, F.when(below, value).cast("bigint").cast("decimal(20,0)")).when(value < 2.0**64, F.when(~below & (value < 2.0**64), value - 2.0**63).cast("bigint").cast("decimal(20,0)") + half)
    whole = F.when(value >= 2.0**64, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)")
    return F.coalesce(whole, F.lit(0).cast("decimal(20,0)"))


def _gc() -> Column:
    bases = F.col("total") * F.col("longest")
    return single(F.when(bases == 0, float("nan")).otherwise(100.0 * F.col("gc_bases") / F.greatest(bases, F.lit(1))))


_FIGURES = {"cardinality": _cardinality, "depth": lambda: single(F.col("total") / F.col("n")), "gc": _gc}


def _figures(rows: DataFrame, by: str, *names: str) -> DataFrame:
    parts = {k: v for name in names for k, v in _PARTS[name]().items()}
    return rows.groupBy(by).agg(*[v.alias(k) for k, v in parts.items()]).select(by, *[_FIGURES[name]().alias(name) for name in names])


def cardinality(rows: DataFrame, by: str = "sample") -> DataFrame:
    """Group, cardinality: (n - 1) over the part of the hash range that the n hashes take, in 32-bit floating point; within 64 bits unsigned."""
    return _figures(rows, by, "cardinality")


def mean_depth(rows: DataFrame, by: str = "sample") -> DataFrame:
    return _figures(rows, by, "depth")


def gc_percent(rows: DataFrame, by: str = "sample") -> DataFrame:
    """Group, gc: percent of G and C among the k-mers' bases, by count; NaN without k-mers."""
    return _figures(rows, by, "gc")


def info(rows: DataFrame, by: str = "sample") -> DataFrame:
    """Group, cardinality, depth, gc, in one aggregation."""
    return _figures(rows, by, "cardinality", "depth", "gc")
