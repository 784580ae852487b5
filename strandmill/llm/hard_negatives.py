"""Hard negatives by a two-dimensional block matrix product.

Vectors become whole numbers. Anchors are dealt into blocks and rows into blocks. A task has one block of
each and multiplies them tile by tile: partial scores of a chunk of dimensions, 64-bit integers, are added
up to the whole tile, which is reduced at once to what can be in the answer. No score but these leaves
the task, so what is shuffled is vectors and a few candidates a block; neither a block nor a tile grows
with the input, whatever labels or vectors repeat.

The product runs twice over disjoint work: over blocks of one label, for each anchor's nearest rows of
its label, and over all blocks, for the rows of other labels in the window below each of these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._vectors import common_length, finite, sent, whole
from ._work import durable


@dataclass(frozen=True)
class Grid:
    """anchors and rows: of a block, at most about these; width: dimensions of a chunk."""

    anchors: int = 16384
    rows: int = 65536
    width: int = 32


#: Anchors and rows of a tile, and rows of a block where there are few.
_TILE = 512, 2048
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers, through doubles where every sum is one exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(len(column), -1)


def _keys(frame: pd.DataFrame) -> np.ndarray:
    """(id, row) of each row, which come sorted by them."""
    return frame[["id", "row"]].to_numpy(dtype=np.int64)


def _tile(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """All scores of some anchors and rows, added up over chunks of dimensions."""
    score = np.zeros((len(a), len(b)), np.int64)
    for c in range(0, a.shape[1], width):
        score += product(a[:, c : c + width].astype(np.int64), b[:, c : c + width].astype(np.int64))
    return score


def _largest(score: np.ndarray, k: int):
    """(anchor, row) of each anchor's k largest scores but _LEAST, the first of equal ones first; score is used up."""
    who, which = [], []
    at = np.arange(len(score))
    for _ in range(min(k, score.shape[1])):
        best = score.argmax(1)
        ok = score[at, best] != _LEAST
        who.append(at[ok])
        which.append(best[ok])
        score[at, best] = _LEAST
    return (np.concatenate(who), np.concatenate(which)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _positives(k: int):
    """Of a tile of one label: each anchor's k nearest other rows."""

    def run(score: np.ndarray, asks: pd.DataFrame, rows: pd.DataFrame) -> dict:
        a, b = _keys(asks), _keys(rows)
        place = np.searchsorted(b[:, 1], a[:, 1], sorter=(order := np.argsort(b[:, 1])))
        mine = order[np.minimum(place, len(b) - 1)]
        own = np.nonzero(b[mine, 1] == a[:, 1])[0]
        score[own, mine[own]] = _LEAST
        held = score.copy()
        who, which = _largest(score, k)
        return {"anchor": a[who, 1], "id": b[which, 0], "row": b[which, 1], "score": held[who, which]}

    return run


def _negatives(k: int, positives: int, low: int, high: int):
    """Of a tile: for each anchor and positive, the k nearest rows of other labels within low and high percent of its score."""

    def run(score: np.ndarray, asks: pd.DataFrame, rows: pd.DataFrame) -> dict:
        a, b = _keys(asks), _keys(rows)
        score[asks["mark"].to_numpy()[:, None] == rows["mark"].to_numpy()[None]] = _LEAST
        bounds = np.frombuffer(b"".join(asks["bounds"]), ">i8").reshape(len(a), positives + 1).astype(np.int64)
        out = []
        for p in range(positives):
            has, bound = bounds[:, 0] > p, bounds[:, p + 1]
            # whole numbers between these are those within the window
            least, most = np.where(has, -((-low * bound) // 100), _MOST), np.where(has, (high * bound) // 100, _LEAST)
            below = np.where(score <= most[:, None], score, _LEAST)
            some = np.nonzero((below.max(1) >= least) & has)[0]
            who, which = _largest(below[some], k)
            who = some[who]
            found = score[who, which]
            ok = found >= least[who]
            who, which = who[ok], which[ok]
            out.append({"anchor": a[who, 1], "p": np.full(len(who), p, np.int64), "id": b[which, 0], "row": b[which, 1], "score": found[ok]})
        return {c: np.concatenate([x[c] for x in out]) for c in ("anchor", "p", "id", "row", "score")}

    return run


def _best(found: list[dict], by: list[str], k: int) -> pd.DataFrame:
    """The first k of each group: of the largest scores, of equal ones those of the smallest id and row."""
    all_ = {c: np.concatenate([x[c] for x in found]) for c in found[0]}
    order = np.lexsort([all_["row"], all_["id"], -all_["score"], *[all_[c] for c in reversed(by)]])
    all_ = {c: x[order] for c, x in all_.items()}
    at = np.arange(len(order))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in by:
        new[1:] |= all_[c][1:] != all_[c][:-1]
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    return pd.DataFrame({c: x[rank < k] for c, x in all_.items()})


def _product(reduce, by: list[str], k: int, width: int, shape: str):
    """What reduce leaves of the product of an anchor block and a row block, tile by tile."""

    def run(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({c.split()[0]: [] for c in shape.split(", ")})
        asks, rows = asks.sort_values(["id", "row"]), rows.sort_values(["id", "row"])
        a, b = _matrix(asks["v"]), _matrix(rows["v"])
        asks, rows = asks.drop(columns="v"), rows.drop(columns="v")
        out = []
        for i in range(0, len(a), _TILE[0]):
            some = slice(i, i + _TILE[0])
            tiles = (slice(j, j + _TILE[1]) for j in range(0, len(b), _TILE[1]))
            out.append(_best([reduce(_tile(a[some], b[t], width), asks.iloc[some], rows.iloc[t]) for t in tiles], by, k))
        return pd.concat(out)

    return run


def _blocks(asks: DataFrame, rows: DataFrame, sizes: DataFrame | None, counts: tuple[int, int], how: Grid):
    """Blocks of asks and rows (id, row, mark, v, asks with bounds) that meet. counts: numbers of anchors and rows; sizes: g,
    na, nb, for blocks within groups g. There are about as many row blocks as cores, until these would be larger than
    how.rows, so an anchor goes to a number of blocks that the input doesn't move, and a row to one anchor block."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most = min(how.rows, max(_TILE[1], -(-counts[1] // cores)))
    blocks = lambda n, most: F.ceil(n / most).cast("int")
    place = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def sized(d: DataFrame) -> DataFrame:
        if sizes is None:
            return d.withColumn("g", F.lit(0).cast("long")).withColumn("na", F.lit(counts[0])).withColumn("nb", F.lit(counts[1]))
        return d.join(sizes, F.col("mark") == F.col("g"))

    a, b = sized(asks), sized(rows)
    na, nb = blocks(F.col("na"), how.anchors), blocks(F.col("nb"), most)
    a = a.select("g", place(na).alias("i"), upto(nb).alias("j"), "id", "row", "mark", "bounds", "v")
    b = b.select("g", upto(na).alias("i"), place(nb).alias("j"), "id", "row", "mark", "v")
    at = ["g", "i", "j"]
    a = a.toDF(*a.columns)  # both sides stem from one table
    return a.groupBy(*at).cogroup(b.groupBy(*at))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    per = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")
    return rows.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k)


_SHAPE = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, how: Grid = Grid(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its nearest
    rows of the same label the nearest rows of other labels whose scores are low to high percent of the positive's.

    anchors: a condition on the table's columns; label: an expression for whole numbers, by default
    the column label. Scores are inner products of floor(scale * x); ties go to the smaller id. Rows
    with a null id or label, or a vector that is null, empty or holds null or non-finite
    components, take no part, nor do vectors of another length than most. Rows that share an id, or are
    equal, are rows of their own, told apart by a number in no stated order; an anchor is never its own
    positive. Scores times a hundred must be 64-bit numbers, so a component beyond
    isqrt(2**56 / length) counts as that, either way. Anchors without a positive, and positives
    without a negative, have no row; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    mark = (F.col("label") if label is None else label).cast("long")
    packed = vectors.select(F.col(id_col).cast("long").alias("id"), F.struct(mark.alias("mark"), F.coalesce(anchors, F.lit(False)).alias("asks")).alias("label"), F.col(vec_col).alias("v"))
    rows = packed.where(finite(F.col("v")) & F.col("id").isNotNull() & F.col("label.mark").isNotNull())
    dim = common_length(rows)
    if dim is None:
        return spark.createDataFrame([], _SHAPE)
    kept = whole(rows.where(F.size("v") == dim), scale, math.isqrt((1 << 56) // dim), "whole").select("id", "row", "v", F.col("label.mark").alias("mark"), F.col("label.asks").alias("asks"))
    asks, all_rows = kept.where("asks").drop("asks"), kept.drop("asks")

    of = asks.groupBy(F.col("mark").alias("g")).agg(F.count(F.lit(1)).alias("na")).join(kept.groupBy(F.col("mark").alias("g")).agg(F.count(F.lit(1)).alias("nb")), "g")
    same = _blocks(asks.withColumn("bounds", F.lit(b"")), all_rows, sent(of), (asks.count(), n := kept.count()), how)
    shape = "anchor long, id long, row long, score long"
    near = same.applyInPandas(_product(_positives(positives), ["anchor"], positives, how.width, shape), shape)
    near = durable(_first(near, ["anchor"], positives), "positives")

    # each anchor's number of positives and their scores, as many as asked for, in 64-bit words
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "score")))
    bound = near.groupBy("anchor").agg(ranked.alias("all"))
    words = [word(F.size("all").cast("long")), *[word(F.coalesce(F.get("all", F.lit(p))["score"], F.lit(0).cast("long"))) for p in range(positives)]]
    bound = bound.select("anchor", F.concat(*words).alias("bounds"))
    known = durable(asks.join(bound, asks["row"] == bound["anchor"]).drop("anchor"), "asks")
    if not (found := known.count()):
        return spark.createDataFrame([], _SHAPE)
    every = _blocks(known, all_rows, None, (found, n), how)
    shape = "anchor long, p int, id long, row long, score long"
    far = every.applyInPandas(_product(_negatives(negatives, positives, low, high), ["anchor", "p"], negatives, how.width, shape), shape)
    far = _first(far, ["anchor", "p"], negatives)
    names = known.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = near.join(names, "anchor").select("anchor", (F.col("rank") - 1).alias("p"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor", "p"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
