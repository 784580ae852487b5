"""Vector code compression: product codes over integer codebooks, exactly.

Vectors become whole numbers and are cut into parts; each part position has a codebook, which
rounds of assignment and averaging move. The nearest entry is found by screening: a float32 matrix
product gives every distance within an interval that rounding can't leave, and only entries
whose interval reaches down to the best one's upper end are measured again in 64-bit integers;
ties go to the smaller index. So the answer is that of integer arithmetic throughout.

A round is one pass: tasks add up their parts by entry, Spark adds up the tasks, and the driver
holds codebooks alone (entries x length, whatever the input), which go out with the next pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vectors import common_length, finite, sent, unpacked, whole
from ._work import durable

#: Unit roundoffs of the two float kinds; rows screened at once; pairs measured again at once.
_U32, _U64 = 2.0**-24, 2.0**-53
_ROWS, _PAIRS = 2048, 1 << 16


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, both of integers below 2**31 whose squared distances fit 64 bits."""
    index, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    width, book32 = x.shape[1], book.astype(np.float32).T.copy()
    square = (book * book).sum(1).astype(np.float64)
    size = np.sqrt(square)
    # a float32 dot product of w terms, in any order, of inputs that were rounded once each: (w + 2) roundings a term
    gamma = (width + 2) * _U32 / (1 - (width + 2) * _U32)
    for at in range(0, len(x), _ROWS):
        part = x[at : at + _ROWS]
        # squared distances without the row's own square, which moves no order
        near = square[None] - 2.0 * (part.astype(np.float32) @ book32).astype(np.float64)
        norm = np.sqrt((part * part).sum(1).astype(np.float64))
        both = norm[:, None] * size[None]
        # the last factor covers the roundings of the bound itself
        error = (2 * gamma * both + 4 * _U64 * (square[None] + 2 * both)) * (1 + 1e-6)
        row, entry = np.nonzero(near - error <= (near + error).min(1, keepdims=True))
        exact = np.concatenate([((part[row[i : i + _PAIRS]] - book[entry[i : i + _PAIRS]]) ** 2).sum(1) for i in range(0, len(row), _PAIRS)])
        begin = np.searchsorted(row, np.arange(len(part)))
        best = np.minimum.reduceat(exact, begin)
        hit = np.nonzero(exact == best[row])[0]
        first = hit[np.unique(row[hit], return_index=True)[1]]  # entries ascend within a row
        index[at : at + _ROWS], far[at : at + _ROWS] = entry[first], best
    return index, far


def _summing(books: list[np.ndarray]):
    """Each task's sums of parts and their counts by part position, entry and place; sums as two words that Spark can add."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            x = unpacked(b.column(0).to_pylist())
            for p, (part, book) in enumerate(zip(np.split(x, len(books), axis=1), books, strict=True)):
                index, _ = nearest(part, book)
                order = np.argsort(index, kind="stable")
                used, begin, n = np.unique(index[order], return_index=True, return_counts=True)
                sums[p][used] += np.add.reduceat(part[order], begin, axis=0)
                counts[p][used] += n
        for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
            used = np.nonzero(n)[0]
            width = s.shape[1]
            flat = s[used].reshape(-1)
            cols = [np.full(len(flat), p, np.int32), np.repeat(used, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(used)), flat >> 32, flat & 0xFFFFFFFF, np.repeat(n[used], width)]
            yield pa.record_batch([pa.array(c) for c in cols], names=["part", "entry", "at", "high", "low", "n"])

    return run


def _coding(books: list[np.ndarray]):
    def run(batches):
        for b in batches:
            x = unpacked(b.column(2).to_pylist())
            error, code = np.zeros(len(x), np.int64), np.zeros((len(x), len(books)), np.uint8)
            for p, (part, book) in enumerate(zip(np.split(x, len(books), axis=1), books, strict=True)):
                index, far = nearest(part, book)
                code[:, p] = index
                error += far
            yield pa.record_batch([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def train(coded: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks, one a part position: first the parts of the rows with the smallest ids (rows of one id in their order),
    then after each round the floors of the means of what each entry was nearest to; unused entries stay."""
    first = coded.orderBy("id", "row").limit(entries).select("v").collect()
    books = [np.ascontiguousarray(b) for b in np.split(unpacked([bytes(r["v"]) for r in first]), parts, axis=1)]
    for _ in range(rounds):
        found = coded.select("v").mapInArrow(_summing(books), "part int, entry int, at int, high long, low long, n long")
        for r in found.groupBy("part", "entry", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect():  # entries x length rows
            books[r["part"]][r["entry"], r["at"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


_SHAPE = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """One row per vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null, empty or hold null or non-finite components have no row, nor have those
    of another length than most. Null ids and labels stay; in the codebooks' start null ids come
    first, and all null labels are one. Repeated rows have a row and a weight each. Fewer rows than
    entries make smaller codebooks; an empty table gives no rows. A length that parts doesn't
    divide is an error. Squared distances must be 64-bit numbers, so a component beyond
    isqrt(2**62 / length) / 2 counts as that, either way; label_error stays at the greatest long.
    Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    dim = common_length(rows)
    if dim is None:
        return spark.createDataFrame([], _SHAPE)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    coded = whole(rows.where(F.size("v") == dim), scale, math.isqrt((1 << 62) // dim) // 2, "whole")
    books = train(coded, parts, entries, rounds)
    label = coded.schema["label"].dataType.simpleString()
    codes = durable(coded.select("id", "label", "v").mapInArrow(_coding(books), f"id long, label {label}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    by = sent(codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    return codes.join(by, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
