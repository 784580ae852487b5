"""Hard negatives and vector codes against loops over whole numbers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import hard_negatives, vector_codes

SHAPE = "vec_id long, embedding array<double>, label int, id string, row int, v int, mark string, g int, score double, anchor int, code string"


def table(spark, rows):
    """With columns named like those inside the operators."""
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "m", 3, 0.5, 4, "c") for i, v, label in rows], SHAPE).repartition(3)


def usable(rows, dim):
    return [(i, v, label) for i, v, label in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def floored(v, scale, most):
    return [max(-most, min(most, math.floor(min(max(scale * x, -1e300), 1e300)))) for x in v]


ODD = [(500, None, 1), (501, [], 1), (502, [1.0, None, 0.0, 0.0], 1), (503, [float("nan")] * 4, 1), (504, [float("inf")] * 4, 2), (505, [1.0, 2.0], 1), (506, [0.0] * 4, None)]


def brute_negatives(rows, every, positives=5, negatives=3, low=50, high=95):
    """Rows told apart by their place among equal ids."""
    most = math.isqrt((1 << 56) // 4)
    good = sorted((i, n, floored(v, 256.0, most), label) for n, (i, v, label) in enumerate(usable(rows, 4)) if i is not None and label is not None)
    out = []
    for i, n, a, label in good:
        if i % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, m, other == label) for j, m, b, other in good if m != n)
        for s, j, _, _ in [x for x in near if x[3]][:positives]:
            fits = [x for x in near if not x[3] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return out


@pytest.mark.parametrize("grid", [hard_negatives.Grid(), hard_negatives.Grid(3, 7, 2), hard_negatives.Grid(1, 1000, 1)])
def test_hard_negatives(spark, grid):
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(0.6, 0.5), 2) for _ in range(4)], rng.choice([1, 1, 1, 2, 3])) for i in range(160)]
    rows += [(200 + i, rows[5][1], 1 + i % 2) for i in range(60)]  # a third have one vector: ties throughout
    rows += [*ODD, (None, [1.0] * 4, 1), (300, [1e200, -1e200, 1.0, 1.0], 1), (301, [1e18] * 4, 2), (20, rows[20][1], rows[20][2])]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0, how=grid)
    assert Counter(map(tuple, got.collect())) == Counter(brute_negatives(rows, 20))


def test_hard_negatives_of_few_and_none(spark):
    assert hard_negatives.mine(table(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(table(spark, ODD), F.lit(True)).count() == 0
    alone = [(0, [1.0, 0.0], 1), (1, [0.7, 0.0], 2)]
    assert hard_negatives.mine(table(spark, alone), F.lit(True)).count() == 0  # no positive
    assert hard_negatives.mine(table(spark, [*alone, (2, [1.0, 0.0], 1)]), F.col("vec_id") == 0).collect() == [(0, 2, 1, 1, 65536, 45824)]
    assert hard_negatives.mine(table(spark, alone), F.lit(None).cast("boolean")).count() == 0


def written(spark) -> int:
    """Bytes that all shuffles so far wrote."""
    inner = spark.sparkContext._jsc.sc()
    inner.listenerBus().waitUntilEmpty()
    seen = inner.statusStore().executorList(False)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


def test_scores_stay_in_their_tasks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0.5, 0.5) for _ in range(64)], i % 3) for i in range(2000)]
    before = written(spark)
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 2 == 0)
    assert got.where("rank = 1").count() > 1000
    # the matrix of 1,000 anchors and 2,000 rows is 16 MB, whatever is made of it
    assert written(spark) - before < 8_000_000


def test_products_are_whole():
    rng = np.random.default_rng(3)
    for most in (10, 1 << 20, (1 << 27) - 1):
        a, b = (rng.integers(-most, most + 1, (n, 9)) for n in (5, 8))
        assert (hard_negatives.product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])).all()
    assert hard_negatives.product(np.zeros((0, 3), np.int64), np.zeros((2, 3), np.int64)).shape == (0, 2)


def brute_nearest(x, book):
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x]
    return [d.index(min(d)) for d in far], [min(d) for d in far]


@pytest.mark.parametrize("most", [2, 300, 1 << 24, 1 << 28])
def test_nearest_entries_are_those_of_whole_numbers(most):
    """Near ties that float32 can't tell apart, and real ties."""
    rng = np.random.default_rng(most)
    for width in (1, 4, 16):
        book = rng.integers(-most, most + 1, (40, width))
        book[20:30] = book[:10] + rng.integers(-1, 2, (10, width))
        book[30:] = book[:10]
        x = np.concatenate([rng.integers(-most, most + 1, (60, width)), book[:10], book[:10] + 1, np.zeros((1, width), np.int64)])
        index, far = vector_codes.nearest(x, book)
        want = brute_nearest(x, book)
        assert index.tolist() == want[0] and far.tolist() == want[1]


def test_few_entries_are_measured_twice(monkeypatch):
    seen = []
    real = np.nonzero
    monkeypatch.setattr(vector_codes.np, "nonzero", lambda a: (seen.append(np.count_nonzero(a)) if getattr(a, "ndim", 0) == 2 else None, real(a))[1])
    rng = np.random.default_rng(1)
    vector_codes.nearest(rng.integers(-900, 900, (2000, 16)), rng.integers(-900, 900, (256, 16)))
    assert sum(seen) < 2100  # about one a row: the intervals hold


def brute_codes(rows, parts=4, entries=8, rounds=4, dim=8):
    most = math.isqrt((1 << 62) // dim) // 2
    good = [(i, floored(v, 1024.0, most), label) for i, v, label in usable(rows, dim)]
    good.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    cut = [[v[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)] for _, v, _ in good]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [brute_nearest([c[p] for c in cut], books[p]) for p in range(parts)]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [c[p] for c, i in zip(cut, found[p][0], strict=True) if i == e]
                    if mine:
                        books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(found[p][1][n] for p in range(parts)) for n in range(len(good))]
    by = defaultdict(int)
    for (_, _, label), e in zip(good, error, strict=True):
        by[label] += e
    code = ["".join(f"{found[p][0][n]:02x}" for p in range(parts)) for n in range(len(good))]
    return [(i, c, e, min(by[label], (1 << 63) - 1), digest) for (i, _, label), c, e in zip(good, code, error, strict=True)]


def test_vector_codes(spark):
    rng = random.Random(9)
    rows = [(i, [round(rng.gauss(0, 0.4), 3) for _ in range(8)], rng.choice([1, 1, 2, None])) for i in range(10, 130)]
    rows += [(200 + i, rows[3][1], 7) for i in range(60)]  # a third are copies of one vector
    rows += [(i, v and v * 2, label) for i, v, label in ODD] + [(None, [0.1] * 8, 1), (40, rows[30][1], 2), (3, rows[7][1], 1), (4, rows[7][1], 1)]
    for more in ([], [(400, [1e200] * 4 + [-1e200] * 4, 1), (401, [1e9] * 8, 1)]):
        got = vector_codes.compress(table(spark, rows + more), entries=8)
        assert Counter(map(tuple, got.collect())) == Counter(brute_codes(rows + more))


def test_vector_codes_of_few_and_none(spark):
    assert vector_codes.compress(table(spark, [])).count() == 0 and vector_codes.compress(table(spark, ODD[:5])).count() == 0
    few = [(2, [0.5, 1.0, 0.0, -0.001], 1), (1, [0.0] * 4, None)]
    assert Counter(map(tuple, vector_codes.compress(table(spark, few)).collect())) == Counter(brute_codes(few, dim=4))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0, 3.0], 1)]))
