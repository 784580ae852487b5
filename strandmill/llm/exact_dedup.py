"""Exact dedup: a tree merge of digest runs, in DataFrame operations only.

Every row gives one digest of its normalised text. The rows of a run (an input partition,
modulo RUNS) collapse to one entry per digest: the identifier that stays and the number of
rows. Rounds then merge FAN runs into one until one run remains. In a round the entries are
exchanged by (run, digest), so a run is spread over tasks, sorted within them, and a sort
aggregation passes over the merged order and keeps the smallest identifier; a hot digest brings
at most one entry per run into a round. Spark sorts what it has exchanged instead of merging
what came sorted. The answer goes back down by (run, digest), which deals a hot digest out over
the runs.

Verified: a key is digest, a second independent hash and the normalised length, so entries
merge only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import SPACES, durable, text_of

#: Leaf runs, and runs that a round merges into one: three rounds, at any size of the input.
RUNS, FAN = 64, 4
KEY = ["_digest", "_check", "_len"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code points of the original text, key of the normalised text and leaf run of every row."""
    norm = F.translate(text_of(F.col("_text")), SPACES, "")
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .select("_id", F.char_length(text_of(F.col("_text"))).cast("long").alias("_n"), norm.alias("_norm"))
        .select(
            "_id", "_n",
            F.unhex(F.sha2("_norm", 256)).alias("_digest"), F.xxhash64("_norm").alias("_check"),
            F.char_length("_norm").alias("_len"), (F.spark_partition_id() % RUNS).alias("_run"),
        )
    )


def _merged(entries: DataFrame, *run) -> DataFrame:
    return entries.groupBy(*run, *KEY).agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Nulls count as the empty text. Of equal texts the row with the most code points, then the
    smallest id, stays; a null id stays only where every id of its group is null (as the
    largest id). Repeated rows with one id: all of them count in group_size, and every copy
    of the staying id is kept. An empty table gives no rows; other columns are ignored.
    """
    leaf = durable(digests(docs, id_col, text_col), "digests")
    # ~id: the smallest id is the largest complement; null is below every value
    entries = leaf.select("_run", *KEY, F.struct("_n", F.expr("~_id").alias("_not")).alias("_best"), F.lit(1).cast("long").alias("_size"))
    runs = level0 = _merged(entries, "_run")
    width = RUNS
    while width > 1:
        runs, width = _merged(runs.withColumn("_run", F.expr(f"cast(_run div {FAN} as int)")), "_run"), width // FAN
    root = runs.select(*KEY, "_best", "_size")
    down = level0.select("_run", *KEY).join(root, KEY)
    return leaf.join(down, ["_run", *KEY]).select(
        F.col("_id").alias(id_col),
        F.expr("~_best._not").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.expr("_id <=> ~_best._not").alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
