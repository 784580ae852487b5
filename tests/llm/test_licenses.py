"""License scans against loops over all blocks and templates."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandmill.llm import licenses

from .conftest import TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, stated=licenses.TEMPLATES, phrases=licenses.PHRASES, threshold=0.9):
    ws = word_list(text)
    places, base = [], set()
    for phrase, label in phrases:
        p = word_list(phrase)
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score, blocks = set(base), 1.0 if places else 0.0, set()
    for label, t in stated:
        run = word_list(t)
        theirs, n = set(run), 4
        while n < len(run):
            n *= 2
        for at in range(0, max(1, len(ws)), n):
            share = len(theirs & set(ws[at : at + 2 * n])) / len(theirs) if theirs else 0.0
            if share >= threshold - 1e-12:
                labels.add(label)
                score = max(score, share)
                blocks.add((at, n, label, share))
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks


def check(docs, rows, **more):
    got = licenses.scan(docs, blocks=True, **more).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:8], frozenset(map(tuple, r["blocks"]))) for r in got) == Counter((i, *brute(t, **more)[:7], frozenset(brute(t, **more)[7])) for i, t in rows)
    return got


def test_edges(spark, edge, empty):
    check(edge, TEXTS)
    assert licenses.scan(empty).count() == 0
    out = licenses.scan(edge)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    # ids of other kinds, and null columns
    assert licenses.scan(edge.select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).select("n_words", "labels", "score").distinct().collect() == [(0, "", 0.0)]


def noise(rng, n):
    return " ".join(rng.choice("the of and to license software is a in or free use copy xq zv 日本 é".split()) for _ in range(n))


def test_planted_notices(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        label, t = rng.choice(licenses.TEMPLATES)
        ws = t.split()
        for _ in range(rng.choice([0, 0, 1, len(ws) // 12, len(ws) // 8, len(ws) // 4])):  # words lost, or replaced
            ws[rng.randrange(len(ws))] = rng.choice(["", "zzz"])
        t = rng.choice([" ", "\n", "\n * "]).join(ws)
        rows.append((i, f"{noise(rng, rng.randrange(60))} {t.upper() if i % 3 else t}. {noise(rng, rng.randrange(300))}"))
    rows += [(200 + i, rows[0][1]) for i in range(70)]  # a third are copies
    rows += [(300, "Mit\tLicense mit license; the Apache-License? GNU General  Public License"), (301, "mit licenses unmit license"), (302, "mit"), (303, "license"), (304, " ".join(t for _, t in licenses.TEMPLATES) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = check(docs, rows)
    assert any(r["labels"] and not r["base_labels"] for r in got) and any(not r["labels"] for r in got)
    check(docs, rows, threshold=0.5)
    check(docs, rows, threshold=1.0)


def test_without_templates_or_phrases(spark):
    rows = [(1, "MIT License here"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows, stated=())
    check(docs, rows, phrases=())
    check(docs, rows, stated=(("one", "here"), ("none", " .. ")), phrases=(("license here", "x"), ("mit", "y")))
    with pytest.raises(ValueError, match="threshold"):
        licenses.scan(docs, threshold=0.0)


def test_join_is_exact(spark):
    """Random sets under random orders: no pair is lost, whatever the order of words."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    for threshold in (0.5, 0.8):
        stated = [(str(i), " ".join(rng.sample(vocabulary, rng.randint(1, 8)))) for i in range(12)]
        templates = licenses.templates_of(stated, threshold)
        number = {w: i for i, w in enumerate(vocabulary)}
        rank = rng.sample(range(30), 30)
        blocks = [(i, rng.choice([4, 8]), 0, rng.sample(range(30), rng.randint(1, 20))) for i in range(300)]
        got = licenses.met(spark.createDataFrame(blocks, "row long, size int, at long, words array<int>"), templates, number, rank)
        want = {(b[0], b[1], n, c) for b in blocks for n, t in enumerate(templates) if t.size == b[1] and (c := len({number[w] for w in t.words} & set(b[3]))) >= t.need}
        assert {(r["row"], r["size"], r["template"], r["common"]) for r in got.collect()} == want and want


def test_candidates_are_few(spark):
    """Prefixes of rare words keep blocks of common ones out of the join."""
    templates = licenses.templates_of()
    names = sorted(set().union(*[t.words for t in templates]))
    number = {w: i for i, w in enumerate(names)}
    common = [number[w] for w in ("the", "of", "and", "to", "in", "is", "a", "or", "this", "any") if w in number]
    rank = [1000 if i in common else 0 for i in range(len(names))]
    rank = [r for r, _ in sorted(enumerate(sorted(range(len(names)), key=lambda w: rank[w])), key=lambda x: x[1])]
    blocks = spark.range(2000).selectExpr("id AS row", "64 AS size", "0L AS at", f"array({','.join(f'{c}' for c in common)}) AS words")
    assert licenses.met(blocks, templates, number, rank).count() == 0
