"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is its counts of hashed byte n-grams (3 and 5 bytes) and of a few ranges of its shape
(repetition, capitals, signs, digits), damped and weighted by inverse document frequency; the
leading singular vectors of a bounded sample of labelled rows take it to a latent-semantic
vector. The labelled vectors (at most FIT_ROWS x DIMS floats) are broadcast; every task computes
the cosine of every document with every one of them in blocks, and the labels of the NEIGHBOURS
nearest vote, weighted by a power of the similarity.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from ._work import free, map_rows, text_of

#: Most labelled rows that the vectors are fitted on, half of each label if there are so many.
FIT_ROWS = 2048
#: Hashed n-gram features, and latent dimensions.
BINS = 2048
DIMS = 48
#: How many of the nearest labelled vectors vote, with those as near as the last; a vote is the cosine to this power.
NEIGHBOURS = 32
POWER = 4
#: Upper ends of the ranges of each shape share, and a shape feature's count for each n-gram of the text.
EDGES = (0.0, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95)
SHAPES = 7
SHAPE_WEIGHT = 0.2
_UPPER, _SIGNS, _DIGITS = (bytes(b for b in range(128) if f(chr(b))) for f in (str.isupper, lambda c: not (c.isalnum() or c.isspace()), str.isdigit))
BLOCK = 256
_PIECE = 1 << 20


def shapes(text: str) -> list[float]:
    """Shares of the whole text: words that repeat the one before, repeated words, the commonest word, repeated lines,
    capitals, signs, digits."""
    words, lines, data = text.split(), text.split("\n"), text.encode()
    n, size = max(1, len(words)), max(1, len(data))
    tally = Counter(words)
    # the number of different words grows like a power of all words; a text of one word has a power of 0
    varied = math.log(len(tally)) / math.log(len(words)) if len(words) > 1 else 1.0
    share = lambda kind: 1 - len(data.translate(None, kind)) / size
    return [
        sum(map(eq, words, words[1:])) / n, 1 - varied, max(tally.values(), default=0) / n if len(words) > 9 else 0.0, 1 - len(set(lines)) / len(lines),
        share(_UPPER), share(_SIGNS), share(_DIGITS),
    ]


def counts(text: str) -> np.ndarray:
    """Hashed 3- and 5-byte n-grams of the whole text, in pieces that overlap by what an n-gram needs, and its shapes."""
    out = np.zeros(BINS + SHAPES * (len(EDGES) + 1), dtype=np.float32)
    data = np.frombuffer(b"\x01\x02" + text.encode() + b"\x02\x01\x01", dtype=np.uint8)
    for at in range(0, max(1, len(data) - 4), _PIECE):
        b = data[at : at + _PIECE + 4].astype(np.uint32)
        if len(b) < 5:
            break
        three = b[:-2] * np.uint32(65599) + b[1:-1] * np.uint32(2053) + b[2:] * np.uint32(17)
        five = three[:-2] * np.uint32(40503) + b[3:-1] * np.uint32(9176263) + b[4:] * np.uint32(131071)
        three = three[:-2]  # as many as five-byte ones, so that pieces add up
        for h in (three, five):
            out[:BINS] += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1), minlength=BINS).astype(np.float32)
    for i, x in enumerate(shapes(text)):
        out[BINS + i * (len(EDGES) + 1) + bisect_left(EDGES, x)] = SHAPE_WEIGHT * len(data)
    return out


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(c) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading(x: np.ndarray, dims: int) -> np.ndarray:
    """An orthogonal basis of the leading right singular vectors' space, by subspace iteration; cosines don't depend on
    which basis of the space it is."""
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(dims + 16, *x.shape))).astype(np.float32)
    for _ in range(12):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :dims])


class Model:
    """idf, basis and the labelled vectors with their labels; of bounded size."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels
        n1 = float(labels.sum())
        # each label votes with one weight in all, whatever its number of rows
        self.vote = np.where(labels == 1, 1.0 / max(n1, 1), 1.0 / max(len(labels) - n1, 1)).astype(np.float32)

    def latent(self, c: np.ndarray) -> np.ndarray:
        return _unit(_weighted(c, self.idf) @ self.basis).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text; higher: label 1 is likelier. Without labelled rows all are 0.5."""
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK):
            x = self.latent(np.stack([counts(t) for t in texts[at : at + BLOCK]]))
            # the power, taken relative to the nearest, never underflows to no vote at all
            sim = np.maximum(x @ self.vectors.T, 1e-6)
            last = max(0, sim.shape[1] - NEIGHBOURS)
            near = sim >= np.partition(sim, last, axis=1)[:, last : last + 1]
            w = np.where(near, (sim / sim.max(axis=1, keepdims=True)) ** POWER * self.vote, 0.0)
            out[at : at + BLOCK] = w[:, self.labels == 1].sum(1) / w.sum(1)
        return np.clip(out, 0.0, 1.0)


def _counted(batches):
    for b in batches:
        rows = [counts(t).astype(np.float32).tobytes() for t in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array(rows, pa.binary()), b.column(1)], names=["c", "y"])


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Learned from at most rows labelled rows, the first by a hash of their ids, none of them held out."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    half = [marks.where(F.col("y") == y).orderBy(*order).limit(rows // 2) for y in (0, 1)]
    picked = half[0].unionAll(half[1])
    texts = docs.select(F.col(id_col).alias("_id"), text_of(F.col(text_col)).alias("_text"))
    # rows of one id are one labelled row: the largest text by hash
    sample = texts.join(F.broadcast(picked), "_id").groupBy("_id", "y").agg(F.max_by("_text", F.struct(F.xxhash64("_text"), F.length("_text"))).alias("_text"))
    got = sample.select("_text", "y").mapInArrow(_counted, "c binary, y int").toArrow()
    if not got.num_rows:
        return Model(np.ones(len(counts("")), np.float32), np.zeros((len(counts("")), DIMS), np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int))
    raw = sorted(zip(got.column("c").to_pylist(), got.column("y").to_pylist(), strict=True))
    c = np.stack([np.frombuffer(x, dtype=np.float32) for x, _ in raw])
    y = np.array([x for _, x in raw])
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1).astype(np.float32)
    x = _weighted(c, idf)
    basis = _leading(x, DIMS)
    return Model(idf, basis, _unit(x @ basis).astype(np.float32), y)


def _scored(model, at: int, name: str):
    def run(batches):
        for b in batches:
            s = model.value.score([t or "" for t in b.column(at).to_pylist()])
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """docs with a column of that name, from the text alone; null texts count as empty. No column of docs may have the name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: FIT_ROWS and DIMS
    return map_rows(docs, _scored(sent, docs.columns.index(text_col), name), StructField(name, DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null texts count as empty; empty texts are scored like others. A null id is not held out
    and learns nothing. Repeated rows each come back; an id labelled both ways counts as
    label 1. An empty table gives no rows, no labelled rows give the score 0.5; other columns
    are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    out = score(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), model, "_text")
    return out.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is least or more.

    Null and empty texts and null ids are scored like others and stay null; repeated rows are
    scored alike. An empty table gives no rows; columns may have any names."""
    model = fit(docs, labels, id_col, text_col, label_col)
    name = free(docs.columns, "_score")
    return score(docs, model, text_col, name).where(F.col(name) >= least).drop(name)


def unsigned_crc32(text: str) -> int:
    """What held_out() takes the remainder of."""
    return zlib.crc32(text.encode())
