"""Vectors as rows of whole numbers, for the operators that count in integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import durable


def finite(v: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite."""
    v = v.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def common_length(rows: DataFrame, vec_col: str = "v") -> int | None:
    """The length that most vectors have, the smaller one on ties; None without any."""
    found = rows.groupBy(F.size(vec_col).alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    return found[0]["dim"] if found else None


def _floored(scale: float, limit: int):
    def run(batches):
        for b in batches:
            v = b.column(2)
            dim = len(v.flatten()) // max(1, len(v))
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False)), -limit, limit).astype("<i4")
            packed = pa.array([r.tobytes() for r in x.reshape(len(v), dim)], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), packed], names=["id", "label", "row", "v"])

    return run


def whole(rows: DataFrame, scale: float, limit: int, tag: str) -> DataFrame:
    """id, label, row (a number of its own), v: floor(scale * x) of each component within limit either way, as little-endian
    32-bit integers; written, so that all that follows sees the same numbers of rows."""
    label = rows.schema["label"].dataType.simpleString()
    numbered = rows.select("id", "label", F.col("v").cast("array<double>"), F.monotonically_increasing_id().alias("row"))
    return durable(numbered.mapInArrow(_floored(scale, limit), f"id long, label {label}, row long, v binary"), tag)


def unpacked(column) -> np.ndarray:
    """A column of packed vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(len(column), -1).astype(np.int64)


#: Rows of a table that is sent to every task; a larger one is joined by exchange.
SENT = 1 << 16


def sent(small: DataFrame) -> DataFrame:
    """A table with few rows for each key, broadcast if it is as small as SENT, else left to Spark, which splits hot keys."""
    return F.broadcast(small) if small.limit(SENT + 1).count() <= SENT else small
