"""Approximate nearest neighbours by inner product: an adaptive dimension scan over inverted lists.

Equal vectors collapse first: only the smallest ids of a vector can be among the k nearest,
and queries that are equal vectors have one answer. Vectors are told apart by numbers that are dealt
out, never by hashes. They fall into bands by their length, in powers of 2**16, so that
a few huge ones leave the others' distances as they are. Within a band whose lengths reach M, vectors x
become (x, sqrt(M^2 - |x|^2)) / M, which turns the largest inner product into the smallest
Euclidean distance, and go through a random rotation, after which any leading dimensions estimate the
whole distance. A k-means over a bounded sample of each band places every vector in a list. Queries scan their probed lists in column
blocks: after each block a hypothesis test on the partial distance drops the candidates that
are unlikely to beat the query's k-th best. While many are left a block is one matrix product
for all queries and rows; then it goes pair by pair. A first round over each query's home list
gives the bound; a second scans the other lists. What survives is scored exactly, in double
precision, on the original vectors.

Large lists are cut into blocks of rows and of queries, so a task holds a bounded number.
Vectors travel as raw doubles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._work import durable


@dataclass(frozen=True)
class Index:
    """sample: rows a band's lists are fitted on, at most; lists: a band's number of them, by default one for every 1,024
    vectors, 2,048 at most; share and least: part of a band's lists that a query probes, and how many at
    least; eps: the test's width, in standard errors; width: dimensions a block; rows: vectors, and queries, in a task."""

    sample: int = 8192
    lists: int | None = None
    share: float = 0.65
    least: int = 16
    eps: float = 2.5
    width: int = 16
    rows: int = 2048
    seed: int = 7


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # + 0.0 makes negative zeros equal to zeros
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2.0 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


#: Powers of two that the lengths of a band's vectors span: 2,200 of them hold all doubles, so there are 138 bands at most.
BAND = 16


def _length(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, binary logarithms of lengths) of non-zero vectors, whatever the size of their components."""
    e = np.frexp(np.abs(v).max(1))[1]
    small = np.ldexp(v, -e[:, None])
    size = np.sqrt((small * small).sum(1))
    return small / size[:, None], np.log2(size) + e


class _Model:
    """The rotation and each band's greatest length and list centres; a bounded size, so it is sent with the tasks. Lists are
    numbered through all bands."""

    def __init__(self, rotation: np.ndarray):
        self.rotation = rotation
        self.most: list[float] = []  # binary logarithms
        self.centres: list[np.ndarray] = []
        self.bands: list[int] = []

    def add(self, band: int, most: float, sample: np.ndarray, k: int, seed: int) -> None:
        self.bands.append(band)
        self.most.append(most)
        self.centres.append(_kmeans(self.data(sample, most), k, seed))

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(c) for c in self.centres])])

    def data(self, v: np.ndarray, most: float) -> np.ndarray:
        unit, size = _length(v)
        x = unit * np.exp2(np.minimum(size - most, 0.0))[:, None]
        return np.column_stack([x, np.sqrt(np.maximum(1.0 - (x * x).sum(1), 0.0))]) @ self.rotation

    def query(self, v: np.ndarray) -> np.ndarray:
        """As a unit vector, which leaves the order of a query's candidates as it is."""
        return np.column_stack([_length(v)[0], np.zeros(len(v))]) @ self.rotation

    def placed(self, v: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        out = np.zeros(len(v), np.int64)
        band = np.floor(_length(v)[1] / BAND).astype(np.int64)
        for b, most, centres, start in zip(self.bands, self.most, self.centres, self.starts(), strict=False):
            if len(at := np.nonzero(band == b)[0]):
                out[at] = start + _far(self.data(v[at], most), centres).argmin(1)
        return out

    def probed(self, v: np.ndarray, how: Index) -> np.ndarray:
        """Of each query, its lists of every band, the band with the longest vectors first."""
        x = self.query(v)
        return np.concatenate([start + np.argsort(_far(x, c), axis=1, kind="stable")[:, : _probes(len(c), how)] for c, start in zip(self.centres, self.starts(), strict=False)], axis=1)

    def most_of(self, at: int) -> float:
        return self.most[int(np.searchsorted(self.starts(), at, side="right")) - 1]


def _probes(lists: int, how: Index) -> int:
    return min(lists, max(how.least, math.ceil(lists * how.share)))


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None] - 2.0 * x @ centres.T


def _fit(distinct: DataFrame, how: Index, dim: int) -> _Model:
    model = _Model(_rotation(dim + 1, how.seed))
    sizes = distinct.groupBy("band").agg(F.count("*").alias("n"), F.max("size").alias("most")).orderBy(F.col("band").desc()).collect()  # a row a band
    first = Window.partitionBy("band").orderBy(F.xxhash64("v"), "key")
    picked = distinct.withColumn("n", F.row_number().over(first)).where(F.col("n") <= how.sample).select("band", "v").toPandas()
    for r in sizes:
        k = how.lists or max(1, min(2048, how.sample // 4, r["n"] // 1024))
        model.add(r["band"], r["most"], np.array(picked["v"][picked["band"] == r["band"]].tolist(), dtype=np.float64), k, how.seed)
    return model


def _packed(v: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(v, dtype="<f8")]


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _placer(model: _Model):
    def run(frames):
        for f in frames:
            v = np.array(f["v"].tolist(), dtype=np.float64)
            yield pd.DataFrame({"key": f["key"], "ids": f["ids"], "v": _packed(v), "list": model.placed(v).astype(np.int32)})

    return run


def _prober(model: _Model, how: Index):
    def run(frames):
        for f in frames:
            v = np.array(f["v"].tolist(), dtype=np.float64)
            yield pd.DataFrame({"key": f["key"], "v": _packed(v), "lists": [x.astype(np.int32) for x in model.probed(v, how)]})

    return run


def _sized(distinct: DataFrame) -> DataFrame:
    """With size, the binary logarithm of the length, and band."""
    most = F.array_max(F.transform("v", F.abs))
    # two steps, as the square of a small or a large component may not be a number
    half = F.pow(F.lit(2.0), F.floor(F.log2(most) / 2).cast("double"))
    small = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x / F.col("_h") / F.col("_h"), F.lit(2.0)))
    sized = distinct.withColumn("_h", half).withColumn("size", F.log2(small) / 2 + 2 * F.log2("_h")).drop("_h")
    return sized.withColumn("band", F.floor(F.col("size") / BAND).cast("int"))


#: Queries that a matrix of distances has; the share of its cells alive below which pairs go one by one.
_SIDE = 256
_DENSE = 0.1


def _survivors(x: np.ndarray, y: np.ndarray, most: np.ndarray, eps: float, width: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs that no test on the way drops, and whose whole squared distance is at most the query's most."""
    dim = x.shape[1]
    cuts = [*range(0, dim, width), dim]
    blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    squares = [(b * b).sum(1) for b in blocks]
    who, rows = [], []
    for at in range(0, len(y), _SIDE):
        part, edge = y[at : at + _SIDE], most[at : at + _SIDE]
        far, alive, pairs = np.zeros((len(part), len(x))), None, None
        for a, b, block, square in zip(cuts, cuts[1:], blocks, squares, strict=False):
            q = part[:, a:b]
            # the last block's test is on the distance itself
            limit = edge * ((b / dim) * (1 + eps / math.sqrt(b)) ** 2 if b < dim else 1.0) + slack
            if pairs is None:
                far += square[None] + (q * q).sum(1)[:, None] - 2.0 * (q @ block.T)
                ok = far <= limit[:, None]
                alive = ok if alive is None else alive & ok
                if b == dim or np.count_nonzero(alive) < _DENSE * alive.size:
                    pairs = np.nonzero(alive)
                    far = far[pairs]
            else:
                d = block[pairs[1]] - q[pairs[0]]
                far = far + np.einsum("ij,ij->i", d, d)
                ok = far <= limit[pairs[0]]
                pairs, far = (pairs[0][ok], pairs[1][ok]), far[ok]
        who.append(pairs[0] + at)
        rows.append(pairs[1])
    return np.concatenate(who), np.concatenate(rows)


def _scores(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Inner products in double precision; what isn't a number there counts as the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (v * w).sum(axis=1)
    return np.where(np.isnan(out), -math.inf, out)


def _scan(model: _Model, k: int, eps: float, width: int):
    """Over one block of a list and one block of the queries that probe it."""

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(rows) or not len(asks):
            return none
        v, w = _unpacked(rows["v"]), _unpacked(asks["v"])
        keys, weight = rows["key"].to_numpy(), np.array([len(i) for i in rows["ids"]])
        bound = asks["bound"].to_numpy(dtype=np.float64)
        # |x' - q'|^2 = 2 - 2 * score / (M * |q|); without a bound that is a number all stay
        longest = model.most_of(int(rows["list"].iloc[0]))
        with np.errstate(over="ignore", invalid="ignore"):
            e = np.frexp(bound)[1]
            share = np.ldexp(bound, -e) * np.exp2(np.clip(e - longest - _length(w)[1], -1000, 1000))
            most = np.where(np.isfinite(bound), 2 - 2 * share, math.inf)
        q, r = _survivors(model.data(v, longest), model.query(w), most, eps, width, 1e-9)
        score = np.concatenate([np.zeros(0), *[_scores(v[r[at : at + 65536]], w[q[at : at + 65536]]) for at in range(0, len(q), 65536)]])
        ok = ~(score < bound[q])  # k of the home list are as near as the bound
        q, r, score = q[ok], r[ok], score[ok]
        if not len(q):
            return none
        order = np.lexsort((keys[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        # a vector counts with its ids, the query's own apart; the last that is needed takes those as near along
        begin = np.nonzero(np.diff(q, prepend=-1))[0]
        sizes = np.diff(np.append(begin, len(q)))
        sums = np.cumsum(weight[r])
        before = np.repeat(sums[begin] - weight[r[begin]], sizes)
        enough = sums - before >= k + 1
        place = np.arange(len(q)) - np.repeat(begin, sizes)
        last = np.minimum.reduceat(np.where(enough, place, len(q)), begin)
        edge = np.repeat(score[begin + np.minimum(last, sizes - 1)], sizes)
        keep = score >= edge
        return pd.DataFrame({"q": asks["key"].to_numpy()[q[keep]], "key": keys[r[keep]], "score": score[keep]})

    return run


def _blocked(placed: DataFrame, asks: DataFrame, how: Index) -> tuple[DataFrame, DataFrame]:
    """Rows and queries by (list, row block, query block); block counts are one small row a list."""
    n = placed.groupBy("list").agg(F.ceil(F.count("*") / how.rows).cast("int").alias("nb"))
    m = asks.groupBy("list").agg(F.ceil(F.count("*") / how.rows).cast("int").alias("mb"))
    size = F.broadcast(n.join(m, "list"))  # at most as many rows as lists
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = placed.join(size, "list").select("list", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int").alias("i"), upto("mb").alias("j"), "key", "ids", "v")
    asks = asks.join(size, "list").select("list", upto("nb").alias("i"), F.pmod(F.xxhash64("key"), F.col("mb")).cast("int").alias("j"), "key", "v", "bound")
    return rows, asks


def _searched(placed: DataFrame, asks: DataFrame, model: _Model, k: int, how: Index) -> DataFrame:
    rows, asks = _blocked(placed, asks, how)
    at = ["list", "i", "j"]
    return rows.groupBy(*at).cogroup(asks.groupBy(*at)).applyInPandas(_scan(model, k, how.eps, how.width), "q long, key long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", how: Index = Index()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the other rows, ties to the smaller id.

    queries has the columns of vectors. Null ids, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part on either side. A row is left out of
    its own query's answer by its id; an id that repeats counts once, with the vector that comes
    first in order. All vectors must have the length most have; others take no part. Components may be
    of any size: a score that no double can hold is infinite, and one that isn't a number, as parts of it
    are infinite with either sign, ranks last. Fewer than k candidates found give
    fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = _usable(vectors, id_col, vec_col)
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim = sizes[0]["dim"]
    one = lambda rows: rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    # only k + 1 ids of a vector can be in an answer; the window drops others before the shuffle
    few = one(good).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    number = F.monotonically_increasing_id().alias("key")
    distinct = durable(_sized(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))).select(number, "ids", "v", "size", "band"), "vectors")
    if distinct.isEmpty():
        return empty
    model = _fit(distinct, how, dim)

    placed = durable(distinct.select("key", "ids", "v").mapInPandas(_placer(model), "key long, ids array<long>, v binary, list int"), "lists")
    asked = durable(one(_usable(queries, id_col, vec_col)), "asked")
    kinds = durable(asked.select("v").distinct().select(number, "v"), "kinds")
    asks = durable(kinds.mapInPandas(_prober(model, how), "key long, v binary, lists array<int>"), "probes")

    home = asks.select("key", "v", F.col("lists")[0].alias("list"), F.lit(float("nan")).alias("bound"))
    first = durable(_searched(placed, home, model, k, how), "home")
    sized = placed.select("key", F.size("ids").alias("n"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    bound = (
        first.join(sized, "key").withColumn("seen", F.sum("n").over(best))
        .where(F.col("seen") >= k + 1).groupBy("q").agg(F.max("score").alias("bound"))
    )
    rest = asks.join(bound, asks["key"] == bound["q"], "left").select("key", "v", F.explode(F.slice("lists", 2, len(model.starts()) + int(model.starts()[-1]))).alias("list"), F.coalesce("bound", F.lit(float("nan"))).alias("bound"))
    second = _searched(placed, rest, model, k, how)

    found = first.unionAll(second).join(placed.select("key", "ids"), "key")
    ids = found.select("q", "score", F.explode("ids").alias("vec_id"))
    per = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    kept = ids.withColumn("r", F.row_number().over(per)).where(F.col("r") <= k + 1)
    answers = kept.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("d"), "vec_id"))).alias("all"))
    answered = asked.join(kinds, "v").select("id", "key").join(answers, F.col("key") == F.col("q"))
    own = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.negative("x.d").alias("score"))
