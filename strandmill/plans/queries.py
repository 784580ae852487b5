"""The engine's operators as queries over the driver's tables; texts serve as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, filters, sketching, stats
from ..operators import distance as D
from ..params import SCALED, FilterParams, SketchParams
from ..sources.sequences import sequences_of_text
from ..sources.tables import held, spread

#: k of the complete sketches, and parameters of the others.
SHORT, LONG = 4, 8
MASHED = SketchParams(kmers_to_sketch=1000)
DOC_MASHED = SketchParams(kmers_to_sketch=100)
SCALING = SketchParams(SCALED, kmers_to_sketch=1000, scale=0.01)
FILTERS = FilterParams(True, 2, 5000, 0.05, 0.02)
SMALL_SCALE = 1e-15


def sequences(spark: SparkSession, sf_dir: str, by: str = "source") -> DataFrame:
    return sequences_of_text(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")), by)


def counts(spark, sf_dir, k=LONG, by="source") -> DataFrame:
    return sketching.all_counts(sequences(spark, sf_dir, by), k)


def _hash():
    return sketching.hash_text().alias("hash")


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("sample", _hash(), "kmer", "count", "extra_count")


def _distances(rows: DataFrame, pick=None, scale=None, k=LONG, old=False, max_dist=1.0) -> DataFrame:
    """pick: which samples are queries. Complete sketches have hashes of 2 * LONG bits."""
    rows = held(rows.select("sample", "hash"))
    q, r, queries, refs = D.sides(rows, held(D.profiles(rows)))
    if pick is not None:
        q, queries = q.where(pick(F.col("query"))), queries.where(pick(F.col("query")))
    out = D.distances(q, r, queries, refs, k, scale, old, max_dist, 2 * k if k == LONG else 64, F.col("query") != F.col("reference"))
    return _rounded(out)


def _rounded(out: DataFrame) -> DataFrame:
    """Logarithms differ in the last bit between libraries."""
    return out.select("query", "reference", "containment", "jaccard", F.round("mashDistance", 12).alias("mashDistance"), "commonHashes", "totalHashes")


def allcounts_k4(spark, sf_dir):
    return _rows(counts(spark, sf_dir, SHORT))


def hist(spark, sf_dir):
    return filters.histogram(counts(spark, sf_dir))


def dense_hist(spark, sf_dir):
    return stats.dense_histogram(counts(spark, sf_dir, SHORT, "doc_id")).select("sample", F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist"))


def info_stats(spark, sf_dir):
    return stats.info(counts(spark, sf_dir)).select("sample", F.col("cardinality").cast("string").alias("cardinality"), "depth", "gc")


def cardinality(spark, sf_dir):
    return stats.cardinality(counts(spark, sf_dir, SHORT, "doc_id")).select("sample", F.col("cardinality").cast("string").alias("cardinality"))


def filter_abundance(spark, sf_dir):
    return _rows(filters.by_abundance(counts(spark, sf_dir), 5, 50))


def filter_strands(spark, sf_dir):
    return _rows(filters.by_strand(counts(spark, sf_dir), 0.1))


def guess_threshold(spark, sf_dir):
    return filters.guess_threshold(counts(spark, sf_dir), 0.05)


def filter_pipeline(spark, sf_dir):
    return _rows(filters.filter_counts(counts(spark, sf_dir), FILTERS)[0])


def raw_distance(spark, sf_dir):
    return _distances(counts(spark, sf_dir), lambda c: c == "src0")


def old_distance(spark, sf_dir):
    return _distances(counts(spark, sf_dir), lambda c: c == "src0", old=True)


def pairwise_distance(spark, sf_dir):
    return _distances(counts(spark, sf_dir))


def max_dist(spark, sf_dir):
    return _distances(counts(spark, sf_dir), max_dist=0.04)


def query_by_name(spark, sf_dir):
    return _distances(counts(spark, sf_dir), lambda c: c.isin("src3", "src7"))


def best_match(spark, sf_dir):
    return D.best_match(_distances(counts(spark, sf_dir)))


def filter_to_matches(spark, sf_dir):
    rows = held(counts(spark, sf_dir))
    near = _distances(rows, lambda c: c == "src0").where(F.col("containment") >= 0.8).select(F.col("reference").alias("sample"))
    return _rows(rows.join(near, "sample", "left_semi"))


def filter_to_names(spark, sf_dir):
    return _rows(counts(spark, sf_dir).where(F.col("sample").isin("src1", "src2")))


def _two(spark, sf_dir):
    """Counted once, however often an operator reads the two."""
    rows = held(counts(spark, sf_dir, LONG, "lang"))
    return [rows.where(F.col("sample") == x).drop("sample") for x in ("en", "fr")]


def merge_sized(spark, sf_dir):
    return combine.merge(*_two(spark, sf_dir), size=1000).select(_hash(), "kmer", "count", "extra_count")


def merge_scaled(spark, sf_dir):
    return combine.merge(*_two(spark, sf_dir), scale=SMALL_SCALE).select(_hash(), "kmer", "count", "extra_count")


def merge_all(spark, sf_dir):
    return combine.merge(*_two(spark, sf_dir)).select(_hash(), "kmer", "count", "extra_count")


def merge_sources(spark, sf_dir):
    """All sources at once."""
    rows = held(counts(spark, sf_dir))
    return combine.merge_many(rows, "sample", size=2000).select(_hash(), "kmer", "count", "extra_count")


def compare_counts(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return combine.compare_counts(a, b).select("common", "ref_pos", "query_pos", "ref_count", "query_count", *[F.round(c, 4).alias(c) for c in ("var", "skew", "kurt")])


def compare_matrix(spark, sf_dir):
    rows = held(counts(spark, sf_dir, SHORT))
    return combine.count_matrix(rows.where(F.col("sample") == "src0"), rows).select("sample", F.col("ref_pos").cast("long").alias("ref_pos"), "count")


def sparse_matrix(spark, sf_dir):
    """What each source has of the hashes of one, without zeros."""
    rows = held(sketching.minmers(sequences(spark, sf_dir), MASHED))
    return combine.sparse_matrix(rows.where(F.col("sample") == "src0"), rows).select("sample", F.col("ref_pos").cast("long").alias("ref_pos"), "count")


def set_counts(spark, sf_dir):
    rows = held(counts(spark, sf_dir, SHORT, "lang")).where(F.col("sample") == "en").drop("sample")
    new = rows.select("hash", F.expr("count div 1000").alias("count"))
    return combine.with_counts(rows, new).select(_hash(), "kmer", "count", "extra_count")


def kmer_hash(spark, sf_dir):
    """How often each of the 1,000 smallest 21-mer hashes of all texts occurs."""
    rows = sketching.minmers(sequences(spark, sf_dir).withColumn("sample", F.lit("all")), MASHED)
    return _rows(rows)


def mash_sketch(spark, sf_dir):
    return _rows(sketching.minmers(sequences(spark, sf_dir), MASHED))


def mash_sketch_docs(spark, sf_dir):
    return _rows(sketching.minmers(sequences(spark, sf_dir, "doc_id"), DOC_MASHED))


def scaled_sketch(spark, sf_dir):
    return _rows(sketching.minmers(sequences(spark, sf_dir), SCALING))


def totals(spark, sf_dir):
    return sketching.totals(sequences(spark, sf_dir), MASHED)


def mash_pairwise(spark, sf_dir):
    return _distances(sketching.minmers(sequences(spark, sf_dir), MASHED), k=21)


def scaled_distance(spark, sf_dir):
    return _distances(sketching.minmers(sequences(spark, sf_dir), SCALING), k=21, scale=SCALING.scale)


QUERIES = {
    f.__name__: f
    for f in (
        allcounts_k4, hist, dense_hist, info_stats, cardinality, filter_abundance, filter_strands, guess_threshold, filter_pipeline,
        raw_distance, old_distance, pairwise_distance, max_dist, query_by_name, best_match, filter_to_matches, filter_to_names,
        merge_sized, merge_scaled, merge_all, merge_sources, compare_counts, compare_matrix, sparse_matrix, set_counts,
        kmer_hash, mash_sketch, mash_sketch_docs, scaled_sketch, totals, mash_pairwise, scaled_distance,
    )
}
