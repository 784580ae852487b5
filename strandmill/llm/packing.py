"""Packing into optimal length buckets.

A document's length is its number of token ids, end id and all, as the token shards have them.
It becomes windows of max_len ids at most, so lengths have a bound and the global histogram of
lengths has at most max_len entries, whatever the input. Dynamic programming over it chooses the
bucket boundaries with the least padding. Inside each bucket windows take their places in order
of (document, window) and fill batches of budget tokens, padded length times windows; places
come from a range partitioning and the partitions' counts, so a bucket with most of the rows is
spread over tasks like any other.

A window carries its ids, in the shards' form (little-endian, a fixed number of bytes each), and the number
of its document's row, so that rows that share an id, or have none, are told apart. The answer lies in
order of buckets and batches: a batch is read from one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import token_shards
from ._work import durable, text_of


@dataclass(frozen=True)
class Plan:
    """max_len: tokens of a window; buckets: at most so many; budget: tokens of a batch, padding included."""

    max_len: int = 2048
    buckets: int = 16
    budget: int = 65536


def boundaries(hist: dict[int, int], buckets: int) -> list[int]:
    """Padded lengths, ascending, of at most buckets buckets with the least padding in all; on ties the smaller boundaries."""
    sizes = sorted(n for n in hist if hist[n] > 0)
    if not sizes:
        return []
    m, k = len(sizes), min(buckets, len(sizes))
    length = np.array(sizes, dtype=np.float64)
    count = np.concatenate([[0.0], np.cumsum([hist[n] for n in sizes])])
    # padding of one bucket over entries a..b-1 is length[b-1] * rows - their tokens; the tokens are fixed, so the
    # least padding is the least padded total
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(k):
        new, frm = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for b in range(1, m + 1):
            cost = best[:b] + length[b - 1] * (count[b] - count[:b])
            frm[b] = int(np.argmin(cost))
            new[b] = cost[frm[b]]
        back.append(frm)
        best = new
    out, b = [], m
    for frm in reversed(back):
        if b == 0:
            break
        out.append(sizes[b - 1])
        b = int(frm[b])
    return out[::-1]


_WINDOWS = "id long, row long, seg long, first long, n_tokens long, ids binary"


def _windowed(path: str, width: int, max_len: int, end_id: int):
    """id, text, row -> the windows of each text's ids and one end id."""

    def run(batches):
        encoder = token_shards.Encoder.get(path, width)
        if max(encoder.tok.get_vocab_size() - 1, end_id) >> 8 * width:
            raise ValueError(f"the ids need more than {width} bytes")
        for b in batches:
            held, seg, at = np.zeros(0, encoder.kind), 0, 0  # of a long text, what has come and is in no window yet
            for got, per, whole in encoder.encode(b.column(1)):
                ends = np.cumsum(per)
                out: list[tuple] = []
                for i, (a, e) in enumerate(zip((ends - per).tolist(), ends.tolist(), strict=True)):
                    done = whole or i < len(per) - 1
                    ids = np.concatenate([held, got[a:e], np.full(int(done), end_id, encoder.kind)]) if len(held) or seg else np.append(got[a:e], np.full(int(done), end_id, encoder.kind))
                    upto = len(ids) if done else len(ids) // max_len * max_len
                    for first in range(0, upto, max_len):
                        part = ids[first : min(first + max_len, upto)]
                        out.append((at, seg, len(part), part.tobytes()))
                        seg += 1
                    held, seg, at = (held[:0], 0, at + 1) if done else (ids[upto:], seg, at)
                if out:
                    which, segs, sizes, ids = zip(*out, strict=True)
                    place, segs = pa.array(which), np.array(segs, np.int64)
                    yield pa.record_batch([b.column(0).take(place), b.column(2).take(place), pa.array(segs), pa.array(segs * max_len), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=[x.split()[0] for x in _WINDOWS.split(", ")])

    return run


def windows(docs: DataFrame, tokenizer: str | None, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan(), tokens=None, width: int = 2) -> DataFrame:
    """id, row, seg, first, n_tokens, ids of every window: the number of its row, its own number and its first id within the
    document, and its ids. tokens: a column of lengths, instead of those by the tokenizer; ids are null then. A length of
    zero has one empty window. To be written before it is used twice, as the numbers of rows are dealt out anew each time."""
    key, row = F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row")
    if tokens is None:
        return docs.select(key, text_of(F.col(text_col)).alias("text"), row).mapInArrow(_windowed(tokenizer, width, plan.max_len, token_shards.END_ID), _WINDOWS)
    whole = docs.select(key, tokens.cast("long").alias("n"), row)
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {plan.max_len}"))
    first = F.col("seg") * plan.max_len
    return whole.select("id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seg")).select(
        "id", "row", "seg", first.alias("first"), F.least(F.lit(plan.max_len), F.col("n") - first).alias("n_tokens"), F.lit(None).cast("binary").alias("ids")
    )


def pack(docs: DataFrame, tokenizer: str | None, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan(), tokens=None, width: int = 2) -> DataFrame:
    """One row per window: id, seg, first, n_tokens, bucket (padded length), batch (from 0 within a bucket), slot (from 0
    within a batch), row (a number of the document's row), ids (width bytes each).

    Every id of every document is in one window: the ids of a row's windows in order of seg are those of its
    text and one end id. Null and empty texts have a window with their end id alone. Rows with null ids
    come first in their bucket; repeated rows, and rows that share an id, have windows each. An empty table
    gives no rows; other columns are ignored. A batch holds budget // bucket windows, one at least.
    """
    # what tells equal rows apart is written with them, so that they spread over the ranges and every reading sees the same
    rows = durable(windows(docs, tokenizer, id_col, text_col, plan, tokens, width), "windows", "zstd")
    hist = {r["n"]: r["count"] for r in rows.groupBy(F.greatest("n_tokens", F.lit(1)).alias("n")).count().collect()}  # max_len rows at most
    edges = boundaries(hist, plan.buckets)
    if not edges:
        return rows.select(F.col("id").alias(id_col), "seg", "first", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"), "row", "ids")
    bucket = F.lit(edges[-1])
    for e in reversed(edges[:-1]):
        bucket = F.when(F.col("n_tokens") <= e, e).otherwise(bucket)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "id", "seg", "row"]
    dealt = rows.withColumn("bucket", bucket.cast("int")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = durable(dealt.select("id", "seg", "first", "n_tokens", "bucket", "row", "ids", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "dealt", "zstd")
    part = dealt.groupBy("bucket", "part").agg(F.count("*").alias("rows"), F.min("at").alias("begin"))  # buckets + partitions rows
    before = part.select("bucket", "part", "begin", (F.sum("rows").over(Window.partitionBy("bucket").orderBy("part")) - F.col("rows")).alias("before"))
    place = (F.col("at") - F.col("begin") + F.col("before")).alias("place")
    per = F.greatest(F.lit(1).cast("long"), F.expr(f"{plan.budget} div bucket"))
    return (
        dealt.join(F.broadcast(before), ["bucket", "part"]).select("id", "seg", "first", "n_tokens", "bucket", "row", "ids", place)
        .select(F.col("id").alias(id_col), "seg", "first", "n_tokens", "bucket", F.floor(F.col("place") / per).cast("long").alias("batch"), F.pmod("place", per).cast("int").alias("slot"), "row", "ids")
    )
