"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

Lines become (hash, document, position) rows, range-partitioned by all three and sorted
within partitions by hash, then document downwards, then position. A streaming pass meets
the document that keeps a key first and sends the positions the others lose. A key that
runs over a partition's edge is settled in a second step from what its partitions say about
it; there are at most two such keys a partition. A hot key thus spreads over as many
partitions as it needs. Documents get a zlib-packed bitmap, and their text moves once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._work import SPACES, ascii_lower, durable, quoted, text_of

MIN_CHARS = 20
MIN_DOCS = 3

DROPPED, PENDING, WITNESS = 0, 1, 2
_STREAMED = "key binary, doc long, row long, pos int, kind int"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key (16 bytes), doc, row (hash of the text, which tells rows of one id apart), pos of every line long enough."""
    line = ascii_lower(F.trim(F.col("_line"), F.lit(SPACES)))
    return (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc"), text_of(F.col(text_col)).alias("_text"))
        .select("doc", F.xxhash64("_text").alias("row"), F.posexplode(F.split("_text", "\n", -1)).alias("pos", "_line"))
        .select("doc", "row", "pos", line.alias("_line"))
        .where(F.char_length("_line") >= min_chars)
        .select(F.substring(F.unhex(F.sha2("_line", 256)), 1, 16).alias("key"), "doc", "row", "pos")
    )


def _stream(min_docs: int):
    """Over one sorted partition: dropped lines, and what is left open at its edges."""

    def run(batches):
        key = None  # of the group being read
        first = True  # no earlier group in this partition
        docs: list[int] = []  # the group's first documents, min_docs at most
        held: list[tuple] = []  # lines of the documents after the first, until the group is settled
        out: list[tuple] = []
        for b in batches:
            for k, d, r, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    first = key is None
                    key, docs, held = k, [], []
                if len(docs) < min_docs and (not docs or docs[-1] != d):
                    docs.append(d)
                if first:
                    out.append((k, d, r, p, PENDING))
                elif d == docs[0]:
                    pass  # the largest document keeps its lines
                elif len(docs) >= min_docs:
                    out.extend((*x, DROPPED) for x in held)
                    held = []
                    out.append((k, d, r, p, DROPPED))
                else:
                    held.append((k, d, r, p))
            if out:
                yield _batch(out)
                out = []
        if key is not None and not first:
            # the last group may go on in the next partition
            out = [(key, d, 0, -1, WITNESS) for d in docs]
            out += [(*x, PENDING) for x in held]
            yield _batch(out)

    def _batch(rows):
        k, d, r, p, kind = zip(*rows, strict=True)
        return pa.record_batch([pa.array(k, pa.binary()), pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(p, pa.int32()), pa.array(kind, pa.int32())], names=["key", "doc", "row", "pos", "kind"])

    return run


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row, pos of every line that goes."""
    # written, as finding the ranges reads the rows once and dealing them out once more
    found = durable(lines(docs, id_col, text_col, min_chars), "found")
    order = [F.col("key"), F.col("doc").desc(), F.col("row"), F.col("pos")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = found.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _STREAMED)
    streamed = durable(streamed, "lines")
    opened = streamed.where(F.col("kind") != DROPPED)
    # at most two keys a partition
    edge = opened.select("key", "doc").distinct().groupBy("key").agg(F.count("*").alias("_docs"), F.max("doc").alias("_last")).where(F.col("_docs") >= min_docs)
    late = opened.where(F.col("kind") == PENDING).join(F.broadcast(edge), "key").where(F.col("doc") != F.col("_last"))
    cols = ["doc", "row", "pos"]
    return streamed.where(F.col("kind") == DROPPED).select(cols).unionAll(late.select(cols))


def pack(positions) -> bytes:
    """zlib-packed keep bits, line 0 in the lowest bit, up to the last line that goes; later lines stay."""
    bits = np.ones(max(positions) // 8 * 8 + 8, dtype=np.uint8)  # whole bytes; the spare bits keep
    bits[np.asarray(positions)] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def keeps(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """The keep bits of a document of n_lines lines."""
    out = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")[:n_lines]
        out[: len(bits)] = bits.astype(bool)
    return out


def _pack_batches(batches):
    for b in batches:
        maps = [pack(x) for x in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc", "row", "bitmap"])


def keep_bitmaps(docs: DataFrame, **kw) -> DataFrame:
    """doc, row, bitmap of every document that loses a line; a document without a bitmap keeps all lines."""
    per = dropped_lines(docs, **kw).groupBy("doc", "row").agg(F.collect_set("pos").alias("pos"))
    return per.mapInArrow(_pack_batches, "doc long, row long, bitmap binary")


def _apply(digest: bool):
    def run(batches):
        for b in batches:
            texts, maps = b.column("text").to_pylist(), b.column("bitmap").to_pylist()
            kept, total, gone = [], [], []
            for t, m in zip(texts, maps, strict=True):
                parts = t.split("\n")
                total.append(len(parts))
                if m is None:
                    kept.append(t)
                    gone.append(0)
                    continue
                bits = keeps(m, len(parts))
                kept.append("\n".join(x for x, k in zip(parts, bits.tolist(), strict=True) if k))
                gone.append(len(parts) - int(bits.sum()))
            kept = [hashlib.sha256(x.encode()).hexdigest() for x in kept] if digest else kept
            yield pa.record_batch([b.column("keep"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["keep", "n_lines", "n_dropped", "kept"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, keep: list[str] | None = None, names: tuple[str, str, str] = ("_n_lines", "_n_dropped", "_kept"), **kw) -> DataFrame:
    """The columns in keep (id only, by default) and, under names, the lines of each text, how many go, and the text that
    stays, or its SHA-256 if digest.

    A null or empty text is one empty line. Rows with a null id lose nothing and count in no
    key. Rows that share an id are one document when keys are counted, and each loses its own
    lines. Keys found in min_docs documents stay in the largest id only. An empty table gives
    no rows; columns may have any names but, those in keep, names.
    """
    keep = keep or [id_col]
    maps = keep_bitmaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **kw)
    held = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.struct(*held).alias("keep"), F.col(id_col).cast("long").alias("doc"), text_of(F.col(text_col)).alias("text")).withColumn("row", F.xxhash64("text"))
    joined = rows.join(maps, ["doc", "row"], "left").select("keep", "text", "bitmap")
    shape = StructType([joined.schema["keep"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])
    out = joined.mapInArrow(_apply(digest), shape)
    return out.select(*[F.col(f"keep.c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(n) for c, n in zip(("n_lines", "n_dropped", "kept"), names, strict=True)])
