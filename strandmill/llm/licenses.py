"""License scans: stated phrases, and an exact set-similarity join of text blocks with license templates.

A template is a set of words. A text's blocks are windows of its words, for each size n of templates (a
power of two that holds them) 2n words long and begun every n words, so any run of n words lies whole
in one, and the whole text is in blocks. A block meets a template where it holds at least `threshold`
of the template's words.

The join orders words by how often they occur in the whole corpus, rarest first. If a block meets a
template, a word is among the first words of both, as many as the threshold can do without and one
more (prefix filter); these words alone are joined on. Blocks with fewer of the templates' words than
are needed go before that (length filter), and a pair goes where what lies behind the word it met at
can't make up the rest (positional filter). What is left is counted exactly. Words that are in no
template take part in no count, so blocks are kept without them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._parts import utf8
from ._work import durable, text_of

#: Phrases and what they say.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: The notices of public licenses, without names and years.
TEMPLATES = (
    ("cc", "licensed under CC BY"),
    ("cc-nc", "licensed under CC BY NC"),
    ("cc", "this work is licensed under a Creative Commons Attribution International License"),
    ("cc-nc", "this work is licensed under a Creative Commons Attribution NonCommercial International License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words of all templates, at most: the driver and every task hold them.
MOST_WORDS = 1 << 20

_BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90))
#: Bytes that aren't part of a word become spaces, capitals small letters.
_PLAIN = bytes.maketrans(_BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BREAKS) + b"abcdefghijklmnopqrstuvwxyz")
_FEWEST = 4


def words(text: str) -> list[str]:
    return [w.decode() for w in text.encode("utf-8", "replace").translate(_PLAIN).split()]


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset
    size: int  # the power of two that holds its running words
    need: int  # words that a block must have of it


def templates_of(stated=TEMPLATES, threshold: float = 0.9) -> list[Template]:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    out = []
    for label, text in stated:
        run = words(text)
        if run:
            n = len(set(run))
            # the least whole number that is the threshold's share, whatever the product's last bit
            need = max(1, next(m for m in range(max(0, int(threshold * n) - 1), n + 1) if m >= threshold * n - 1e-9))
            out.append(Template(label, frozenset(run), max(_FEWEST, 1 << (len(run) - 1).bit_length()), need))
    if sum(len(t.words) for t in out) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    return out


_SHAPE = "row long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<size: int, at: long, words: array<int>>>, word int, times long"
_NAMES = ("id", "row", "n_words", "n_base", "first_word", "last_word", "base", "blocks", "word", "times")
_BLOCKS = pa.list_(pa.struct([("size", pa.int32()), ("at", pa.int64()), ("words", pa.list_(pa.int32()))]))
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _BLOCKS, pa.int32(), pa.int64())


def _batch(ids: pa.Array, cols: list) -> pa.RecordBatch:
    made = [pa.nulls(len(ids), k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)]
    return pa.record_batch([ids, *made], names=_NAMES)


def _places(ids: np.ndarray, phrase: list[int], begin: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another within a text. begin: places where texts begin."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.nonzero(ids[:n] == phrase[0])[0]
    for i, w in enumerate(phrase[1:], 1):
        at = at[ids[at + i] == w]
    # the last word belongs to the same text
    return at[np.searchsorted(begin, at, side="right") == np.searchsorted(begin, at + len(phrase) - 1, side="right")]


def _scanner(vocabulary: dict[bytes, int], phrases: list[tuple[list[int], str]], sizes: dict[int, int], n_template: int):
    """row, text, id -> a row a text with what the phrases say and its blocks, and at the end of a task the words' counts. sizes: the
    fewest words that a template of a size needs; the first n_template words are in templates."""

    def run(batches):
        times, kind = np.zeros(n_template, np.int64), None
        for b in batches:
            kind = b.column(2).type
            data, offsets = utf8(b.column(1))
            plain = data[offsets[0] : offsets[-1]].tobytes().translate(_PLAIN)
            texts = [plain[x:y].split() for x, y in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)]
            count = np.array([len(t) for t in texts], np.int64)
            begin = np.concatenate([[0], np.cumsum(count)])
            find = vocabulary.get
            ids = np.array([find(w, -1) for t in texts for w in t], np.int64)
            known = ids[(ids >= 0) & (ids < n_template)]
            times += np.bincount(known, minlength=n_template)
            base = [(at := _places(ids, p, begin[:-1][count > 0]), label) for p, label in phrases]
            filled = np.nonzero(count)[0]
            text_at = lambda at: filled[np.searchsorted(begin[:-1][filled], at, side="right") - 1]
            n_base, labels = np.zeros(len(texts), np.int64), [set() for _ in texts]
            first, last = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
            for at, label in base:
                who = text_at(at)
                np.add.at(n_base, who, 1)
                np.minimum.at(first, who, at - begin[who])
                np.maximum.at(last, who, at - begin[who])
                for i in np.unique(who).tolist():
                    labels[i].add(label)
            blocks = [[] for _ in texts]
            at = np.nonzero((ids >= 0) & (ids < n_template))[0]
            who = text_at(at)
            place, w = at - begin[who], ids[at]
            for n, need in sizes.items():
                # a text's windows are numbered from a start of its own
                starts = np.concatenate([[0], np.cumsum(count // n + 1)])
                one = starts[who] + place // n
                back = place >= n
                window, word = np.concatenate([one, one[back] - 1]), np.concatenate([w, w[back]])
                full = np.bincount(window, minlength=int(starts[-1]) + 1) >= need  # before repeats go
                some = full[window]
                pair = np.unique(window[some] * n_template + word[some])
                window, word = pair // n_template, pair % n_template
                each, cut = np.unique(window, return_index=True)
                owner = np.searchsorted(starts, each, side="right") - 1
                for i in np.nonzero(np.diff(np.append(cut, len(word))) >= need)[0].tolist():
                    o, end = int(owner[i]), cut[i + 1] if i + 1 < len(cut) else len(word)
                    blocks[o].append({"size": n, "at": int(each[i] - starts[o]) * n, "words": word[cut[i] : end].tolist()})
            none = n_base == 0
            cols = [b.column(0), count, n_base, pa.array(first, mask=none), pa.array(last, mask=none), [sorted(x) for x in labels], blocks]
            yield _batch(b.column(2), [*cols, None, None])
        if kind is not None:
            yield _batch(pa.nulls(n_template, kind), [None] * 7 + [np.arange(n_template, dtype=np.int32), times])

    return run


#: Rows of the index of prefixes that are sent to every task; a longer one is joined by exchange.
_SENT = 1 << 15


def met(blocks: DataFrame, templates: list[Template], number: dict[str, int], rank: list[int]) -> DataFrame:
    """row, size, at, template (its place), common: all pairs of a block and a template of its size that share the words the
    template needs. blocks: row, size, at, words (numbers); rank: each number's place in the order of words, rarest first."""
    spark = blocks.sparkSession
    index = [
        (t.size, w, n, i, len(order), t.need, order)
        for n, t in enumerate(templates)
        for order in [sorted(rank[number[x]] for x in t.words)]
        for i, w in enumerate(order[: len(order) - t.need + 1])
    ]
    prefixes = spark.createDataFrame(index, "size int, word int, template int, i int, length int, need int, theirs array<int>")
    needs = {}
    for t in templates:
        needs[t.size] = min(needs.get(t.size, t.need), t.need)
    least = F.lit(None).cast("int")
    for n, m in needs.items():
        least = F.when(F.col("size") == n, m).otherwise(least)
    places = F.array(*[F.lit(r) for r in rank])
    ordered = blocks.select("row", "size", "at", F.array_sort(F.transform("words", lambda w: F.get(places, w))).alias("mine"))
    ahead = ordered.where(F.size("mine") >= least).select("row", "size", "at", "mine", F.posexplode(F.slice("mine", 1, F.size("mine") - least + 1)).alias("j", "word"))
    rest = F.least(F.col("length") - F.col("i"), F.size("mine") - F.col("j"))
    pairs = ahead.join(F.broadcast(prefixes) if len(index) <= _SENT else prefixes, ["size", "word"])
    pairs = pairs.where((F.size("mine") >= F.col("need")) & (F.least("i", "j") + rest >= F.col("need")))
    counted = pairs.select("row", "size", "at", "template", "need", F.size(F.array_intersect("mine", "theirs")).alias("common"))
    return counted.where(F.col("common") >= F.col("need")).select("row", "size", "at", "template", "common").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stated=TEMPLATES, phrases=PHRASES, threshold: float = 0.9, blocks: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score; with `blocks` also blocks: an
    array of (at, size, label, score), a block being the 2 * size words from word at on.

    base: all places where a phrase's words stand one after another. labels: those of the phrases and of
    all templates that a block meets. score: the largest share of a template's words in a block that meets
    it, 1 where a phrase stands, else 0. A null text is an empty one: no words, no places (first_word and
    last_word null), no labels (empty strings), score 0. Repeated rows and null ids are scanned row by
    row; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    templates = templates_of(stated, threshold)
    in_templates = sorted(set().union(*[t.words for t in templates]))
    said = [(words(p), label) for p, label in phrases]
    others = sorted({w for p, _ in said for w in p} - set(in_templates))
    number = {w: i for i, w in enumerate(in_templates + others)}
    sizes = {}
    for t in templates:
        sizes[t.size] = min(sizes.get(t.size, t.need), t.need)
    numbered = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), text_of(F.col(text_col)).alias("text"), F.col(id_col).alias("id"))
    scanner = _scanner({w.encode(): i for w, i in number.items()}, [([number[w] for w in p], label) for p, label in said if p], sizes, len(in_templates))
    rows = durable(numbered.mapInArrow(scanner, f"id {kind}, {_SHAPE}"), "licenses")
    texts, times = rows.where(F.col("word").isNull()), [0] * len(in_templates)
    for r in rows.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("times").alias("n")).collect():  # a row a word of the templates
        times[r["word"]] = r["n"]
    rank = [0] * len(times)
    for i, w in enumerate(sorted(range(len(times)), key=lambda w: (times[w], w))):
        rank[w] = i
    label = F.get(F.array(*[F.lit(t.label) for t in templates]), F.col("template")) if templates else F.lit(None).cast("string")
    share = F.col("common") / (F.get(F.array(*[F.lit(len(t.words)) for t in templates]), F.col("template")) if templates else F.lit(1))
    found = met(texts.select("row", F.inline("blocks")), templates, number, rank)
    each = F.struct("at", "size", label.alias("label"), share.alias("score"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_set(each)).alias("blocks"))
    of = F.col("found.blocks")
    whole = texts.drop("blocks").join(found.withColumnRenamed("row", "_row").select("_row", F.struct("blocks").alias("found")), F.col("row") == F.col("_row"), "left")
    names = F.array_sort(F.array_union("base", F.coalesce(F.transform(of, lambda x: x["label"]), F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(of, lambda x: x["score"])), F.lit(0.0)))
    out = whole.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(names, ",").alias("labels"), score.alias("score"),
        F.coalesce(of, F.array().cast("array<struct<at: long, size: int, label: string, score: double>>")).alias("blocks"),
    )
    return out if blocks else out.drop("blocks")
