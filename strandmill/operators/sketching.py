"""Sketches from sequences: counted bottom-k, scaled and complete.

`sequences` has a row a record: sample, seq (and, where known, format). A seq is a text, or binary:
four bases a byte, the first in the highest bits. The Arrow stage counts
k-mers a sample and a task, with the bound that a bottom-k sketch allows: a hash above the
task's own n-th smallest can't be among the n smallest of all, so it never leaves the task.
Spark then adds the counts up by (sample, hash) and takes the top k of each sample, for
which the limit too is applied before the exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kmers as K
from ..params import ALL, SCALED, U32, SketchParams, ordered
from ..sources.tables import held

_OUT = "sample string, hash bigint, kmer string, count bigint, extra_count bigint"
#: With the facts of a sample and task, in rows without a hash: its first file and record, their format, bases, k-mers.
_FACTS = f"{_OUT}, ordinal int, first bigint, format string, bases bigint, valid bigint"
_NUMBERS = "sample string, ix bigint, rc bigint, c bigint"
#: A sample's first record.
_FIRST = (("ordinal", pa.int32()), ("first", pa.int64()), ("format", pa.string()))
#: Bytes of a sample counted at once, bytes that wait for it in a task, hashes (or numbers of k-mers) that a task holds, rows
#: of a batch that come or go together, and k-mers that wait to be counted.
_CHUNK = 1 << 20
_WAITING = 1 << 23
_HELD = 1 << 20
_STEP, _SENT = 64, 1 << 16
_WINDOWS = 1 << 18
SIGN = 1 << 63


def hash_ord(c="hash") -> Column:
    """Sorts BIGINTs like the unsigned values of their bits."""
    return F.col(c).bitwiseXOR(F.lit(-SIGN))


def hash_text(c="hash") -> Column:
    """A hash as unsigned decimal text."""
    return F.conv(F.hex(c), 16, 10)


def _few(batches):
    """The same batches in pieces of few rows, so that what Python makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, _STEP):
            yield b.slice(at, _STEP)


class _Counter:
    """Counts of one sample in one task: sorted hashes, their counts, reversed counts and k-mers. What blocks find waits until
    it is as much as what is held, so that a hash is moved a few times only, however many are held."""

    def __init__(self, params: SketchParams):
        self.params, self.limit = params, np.uint64(params.limit)
        self.parts: list = []  # records that wait, texts or packed bases
        self.size = 0
        self.hash = np.zeros(0, np.uint64)
        self.count = self.extra = np.zeros(0, np.int64)
        self.names = np.zeros(0, f"S{max(1, params.kmer_length)}")
        self.found: list = []  # (hashes, flags, k-mers) that wait
        self.waits = 0
        self.bases = self.valid = 0
        self.head: tuple | None = None  # (ordinal, record number, format) of the first record

    @property
    def kmer(self) -> list[str]:
        return self.names.astype(str).tolist()

    def add(self, seq: str | bytes) -> None:
        self.parts.append(seq)
        self.size += len(seq)
        if self.size >= _CHUNK:
            self._read()

    def flush(self) -> None:
        self._read()
        self._merge()

    def _read(self) -> None:
        if not self.parts:
            return
        code = K.joined_codes(self.parts)
        self.parts, self.size = [], 0
        for block in K.blocks(code, self.params.kmer_length):
            self._count(block)

    def _count(self, code: np.ndarray) -> None:
        p = self.params
        hashes, flag, text = K.canonical(code, p.kmer_length, p.hash_seed)
        self.valid += len(hashes)
        # only what may still be kept: of all if the sketch is full, else of this block
        if len(self.hash) >= p.kmers_to_sketch:
            top = self.hash[p.kmers_to_sketch - 1] if p.kmers_to_sketch else np.uint64(0)
            ok = hashes <= max(top, self.limit) if p.kmers_to_sketch or p.scheme == SCALED else np.zeros(len(hashes), bool)
        else:
            ok = self._first(hashes)
        at = np.nonzero(ok)[0]
        if not len(at):
            return
        self.found.append((hashes[at], flag[at], np.array(text(at), dtype=self.names.dtype)))
        self.waits += len(at)
        if self.waits >= max(len(self.hash), 1 << 12):
            self._merge()

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        """Which of a block's hashes may be kept if nothing else is: those up to its n-th smallest different one, and what a
        scale lets in. That one mostly is among the 2n smallest, so that the rest isn't sorted."""
        n = self.params.kmers_to_sketch
        few = np.sort(np.partition(hashes, 2 * n)[: 2 * n] if n and len(hashes) > 4 * n else hashes)
        new = few[np.concatenate([[True], few[1:] != few[:-1]])] if len(few) else few
        if len(new) < n < len(few) < len(hashes):
            few = np.sort(hashes)
            new = few[np.concatenate([[True], few[1:] != few[:-1]])]
        ok = np.ones(len(hashes), bool) if len(new) < n else hashes <= new[n - 1] if n else np.zeros(len(hashes), bool)
        return ok | (hashes <= self.limit) if self.params.scheme == SCALED else ok

    def _merge(self) -> None:
        if not self.found:
            return
        hashes, flags, names = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.waits = [], 0
        hashes = np.concatenate([self.hash, hashes])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        start = np.nonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))[0]
        start = start[: self._kept(hashes[start]) + 1]
        keep = self._kept(hashes[start])
        total = lambda held, new: np.add.reduceat(np.concatenate([held, new])[order], start)[:keep].astype(np.int64)
        if not keep:
            self.hash, self.count, self.extra, self.names = hashes[:0], self.count[:0], self.extra[:0], self.names[:0]
            return
        self.count, self.extra = total(self.count, np.ones(len(flags), np.int64)), total(self.extra, flags)
        self.names = np.concatenate([self.names, names])[order[start[:keep]]]
        self.hash = hashes[start[:keep]]

    def _kept(self, hashes: np.ndarray) -> int:
        below = int(np.searchsorted(hashes, self.limit, side="right")) if self.params.scheme == SCALED else 0
        return min(len(hashes), max(self.params.kmers_to_sketch, below))


def _batches(counters: dict[str, _Counter], facts: bool):
    """Record batches of many small samples, or of one large one."""
    shape = to_shape(facts)
    held: list[tuple[str, _Counter]] = []
    n = 0
    for item in counters.items():
        held.append(item)
        n += len(item[1].hash) + 1
        if n >= _SENT:
            yield _batch(held, facts, shape)
            held, n = [], 0
    if held:
        yield _batch(held, facts, shape)


def to_shape(facts: bool) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in (_FACTS if facts else _OUT).split(", ")])


def _batch(held: list[tuple[str, _Counter]], facts: bool, shape: pa.Schema) -> pa.RecordBatch:
    sizes = [len(c.hash) for _, c in held]
    names = pa.array([s for s, _ in held], pa.string())
    join = lambda name: np.concatenate([getattr(c, name) for _, c in held])
    cols = [names.take(pa.array(np.repeat(np.arange(len(held)), sizes))), pa.array(join("hash").view(np.int64)), pa.array(join("names")).cast(pa.string()), pa.array(join("count")), pa.array(join("extra"))]
    if facts:
        rows = [(*c.head, c.bases, c.valid) for _, c in held]
        cols = [pa.concat_arrays([c, names if i == 0 else pa.nulls(len(held), c.type)]) for i, c in enumerate(cols)]
        cols += [pa.concat_arrays([pa.nulls(sum(sizes), f.type), pa.array(x, f.type)]) for f, x in zip(list(shape)[5:], zip(*rows, strict=True), strict=True)]
    return pa.record_batch(cols, schema=shape)


def _stage(params: SketchParams, facts: bool = False):
    """Counts the samples of a task side by side, so that they may come in any order; when what is held reaches its bound,
    all is sent on, and Spark adds up."""

    def run(batches):
        counters: dict[str, _Counter] = {}
        waiting = 0

        def out():
            for c in counters.values():
                c.flush()
            yield from _batches(counters, facts)

        for b in _few(batches):
            heads = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True) if facts else iter(())
            empty = b"" if pa.types.is_binary(b.column(1).type) or pa.types.is_large_binary(b.column(1).type) else ""
            for s, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = counters.get(s)
                if c is None:
                    c = counters[s] = _Counter(params)
                seq = seq or empty
                c.add(seq)
                waiting += len(seq)
                if facts:
                    head = next(heads)
                    c.bases += len(seq) if empty == "" else 4 * len(seq)
                    if c.head is None or head[:2] < c.head[:2]:
                        c.head = head
                if waiting >= _WAITING:
                    for c in counters.values():
                        c.flush()
                    waiting = 0
                    # a sample counts for some hashes even if it has none
                    if sum(len(c.hash) + 64 for c in counters.values()) >= _HELD:
                        yield from out()
                        counters = {}
        yield from out()

    return run


class _Numbers:
    """How often each plain 2-bit k-mer of each sample occurs in a task: tables where k-mers are few, else sorted runs."""

    def __init__(self, k: int):
        self.k, self.held = k, 0
        self.of: dict[str, list | np.ndarray] = {}

    def add(self, sample: str, records: list) -> None:
        found, n = [], 0
        for block in K.blocks(K.joined_codes(records), self.k):
            found.append(K.plain(block, self.k))
            n += len(found[-1])
            if n >= _WINDOWS:
                self._put(sample, np.concatenate(found))
                found, n = [], 0
        if n:
            self._put(sample, np.concatenate(found))

    def _put(self, sample: str, value: np.ndarray) -> None:
        if self.k <= 10:
            seen = np.bincount(value, minlength=4**self.k)
            if sample in self.of:
                self.of[sample] += seen
            else:
                self.of[sample] = seen
                self.held += len(seen)
        else:
            self.of.setdefault(sample, []).append(np.unique(value.astype(np.uint64), return_counts=True))
            self.held += 2 * len(self.of[sample][-1][0])

    def out(self):
        """Batches of sample, ix, rc (its reverse complement), c of many small samples, or of one large one."""
        held, n = [], 0
        for s in list(self.of):
            x = self.of.pop(s)
            if isinstance(x, list):
                ix, at = np.unique(np.concatenate([v for v, _ in x]), return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([c for _, c in x]), minlength=len(ix)).astype(np.int64)
            else:
                ix = np.nonzero(x)[0].astype(np.uint64)
                c = x[ix.astype(np.int64)]
            held.append((s, ix, c))
            n += len(ix)
            if n >= _SENT:
                yield self._batch(held)
                held, n = [], 0
        if held:
            yield self._batch(held)
        self.held = 0

    def _batch(self, held: list) -> pa.RecordBatch:
        names = pa.array([s for s, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(ix) for _, ix, _ in held])))
        ix, c = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        cols = [names, pa.array(ix.astype(np.int64)), pa.array(K.reversed_packed(ix, self.k).astype(np.int64)), pa.array(c.astype(np.int64))]
        return pa.record_batch(cols, names=["sample", "ix", "rc", "c"])


def _indices(k: int, facts: bool = False):
    """Counts of the plain (not canonical) 2-bit k-mers of each sample, with their reverse complements. A task holds a bounded
    number of them, and of records a bounded number of bytes or one. With facts, rows without a k-mer have each sample's first
    record (ordinal, record number, format)."""

    def run(batches):
        numbers = _Numbers(k)
        by: dict[str, list] = {}
        first: dict[str, tuple] = {}
        waiting = 0

        def out():
            for b in numbers.out():
                yield pa.record_batch([*b.columns, *[pa.nulls(b.num_rows, t) for _, t in _FIRST]], names=[*b.schema.names, *[n for n, _ in _FIRST]]) if facts else b

        def heads():
            if first:
                more = [pa.array(c, t) for c, (_, t) in zip(zip(*first.values(), strict=True), _FIRST, strict=True)]
                yield pa.record_batch([pa.array(list(first), pa.string()), *[pa.nulls(len(first), pa.int64())] * 3, *more], names=["sample", "ix", "rc", "c", *[n for n, _ in _FIRST]])
                first.clear()

        def counted():
            for t, parts in by.items():
                numbers.add(t, parts)
                if numbers.held >= 4 * _HELD:
                    yield from out()

        for b in _few(batches):
            if facts:
                for s, *head in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                    if s not in first or tuple(head[:2]) < first[s][:2]:
                        first[s] = tuple(head)
                if len(first) >= _SENT:
                    yield from heads()
            for s, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if seq:
                    by.setdefault(s, []).append(seq)
                    waiting += len(seq)
                if waiting >= _CHUNK:
                    yield from counted()
                    by.clear()
                    waiting = 0
        yield from counted()
        yield from out()
        yield from heads()

    return run


def _samples(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.col("sample").cast("string").alias("sample"), "seq")


def capped(c: Column) -> Column:
    """Counts stay within 32 bits unsigned."""
    return F.least(c, F.lit(U32))


def smallest(counted: DataFrame, n: int, by: str = "sample", order: Column | None = None) -> DataFrame:
    """The n smallest hashes of each group; Spark limits each group before the exchange, too."""
    return counted.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(hash_ord() if order is None else order))).where(F.col("_rn") <= n).drop("_rn")


def all_counts(sequences: DataFrame, k: int) -> DataFrame:
    """sample, hash (the 2-bit index), kmer, count, extra_count over both strands.

    Of a k-mer and its reverse complement the row has the smaller one that occurs; extra
    counts the greater one's, where both occur, and half of a palindrome's, which counts double.
    """
    return _folded(_samples(sequences).mapInArrow(_indices(k), _NUMBERS), k)


def _folded(numbers: DataFrame, k: int) -> DataFrame:
    """all_counts() out of what tasks counted."""
    of = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    pairs = numbers.withColumn("lo", F.least("ix", "rc"))
    folded = pairs.groupBy("sample", "lo").agg(
        of(F.col("ix") == F.col("lo")).alias("c_lo"), of(F.col("ix") != F.col("lo")).alias("c_hi"), F.max(F.greatest("ix", "rc")).alias("hi")
    )
    same, only_hi = F.col("lo") == F.col("hi"), F.col("c_lo") == 0
    key = F.when(only_hi, F.col("hi")).otherwise(F.col("lo"))
    return folded.select(
        "sample", key.alias("hash"), K.text_of_packed(key, k).alias("kmer"),
        capped(F.when(same, F.col("c_lo") * 2).otherwise(F.col("c_lo") + F.col("c_hi"))).alias("count"),
        capped(F.when(same, F.col("c_lo")).when(only_hi, F.lit(0)).otherwise(F.col("c_hi"))).alias("extra_count"),
    )


def _added_up(raw: DataFrame) -> DataFrame:
    return raw.groupBy("sample", "hash").agg(F.min("kmer").alias("kmer"), capped(F.sum("count")).alias("count"), capped(F.sum("extra_count")).alias("extra_count"))


def hashed_counts(sequences: DataFrame, params: SketchParams) -> DataFrame:
    """sample, hash, kmer, count, extra_count; at least every hash that the sketch keeps, with its exact counts."""
    return _added_up(_samples(sequences).mapInArrow(_stage(params), _OUT))


def scanned(sequences: DataFrame, params: SketchParams) -> DataFrame:
    """What one pass over the records (sample, seq, ordinal, record_no, format) has to say, to be written or kept: task by
    task, the counts of the hashes that may be in a sketch, and the facts of each sample."""
    rows = sequences.select(F.col("sample").cast("string").alias("sample"), "seq", F.coalesce(F.col("ordinal").cast("int"), F.lit(0)), F.coalesce(F.col("record_no").cast("bigint"), F.lit(0).cast("bigint")), "format")
    if params.scheme == ALL:
        return rows.mapInArrow(_indices(params.kmer_length, True), f"{_NUMBERS}, ordinal int, first bigint, format string")
    return rows.mapInArrow(_stage(params, True), _FACTS)


def counts_of(scan: DataFrame, params: SketchParams) -> DataFrame:
    """hashed_counts() of a pass, or all_counts()."""
    if params.scheme == ALL:
        return _folded(scan.where(F.col("ix").isNotNull()), params.kmer_length)
    return _added_up(scan.where(F.col("hash").isNotNull()).select("sample", "hash", "kmer", "count", "extra_count"))


def facts_of(scan: DataFrame, params: SketchParams) -> DataFrame:
    """sample, ordinal, format (of the first record), seq_length, num_valid_kmers of a pass. A complete sketch has never counted
    bases: 0."""
    if params.scheme == ALL:
        return scan.groupBy("sample").agg(
            F.min("ordinal").alias("ordinal"), F.min_by("format", F.when(F.col("ix").isNull(), F.struct("ordinal", "first"))).alias("format"),
            F.lit(0).cast("bigint").alias("seq_length"), F.coalesce(F.sum("c"), F.lit(0)).alias("num_valid_kmers"),
        )
    return scan.where(F.col("hash").isNull()).groupBy("sample").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("format", F.struct("ordinal", "first")).alias("format"),
        F.sum("bases").alias("seq_length"), F.sum("valid").alias("num_valid_kmers"),
    )


def minmers(sequences: DataFrame, params: SketchParams) -> DataFrame:
    """The rows of each sample's sketch, before filters."""
    if params.scheme == ALL:
        return all_counts(sequences, params.kmer_length)
    counted = hashed_counts(sequences, params)
    # a scaled sketch is picked by several branches, each of which would scan the records anew once columns are dropped
    return picked(held(counted) if params.scheme == SCALED else counted, params)


def picked(counted: DataFrame, params: SketchParams) -> DataFrame:
    """The rows of each sample's sketch out of its counts: the smallest, and for a scaled sketch all up to its limit."""
    if params.scheme == ALL:
        return counted
    if params.scheme != SCALED:
        return smallest(counted, params.kmers_to_sketch)
    # the top k is its own branch, which Spark can limit early; the rest is a plain filter above each sample's k-th. All
    # branches take all columns of one aggregation, and the order from a column of it, so that it runs once
    rows = counted.groupBy("sample", "hash").agg(F.max(hash_ord()).alias("_o"), *[F.max(c).alias(c) for c in ("kmer", "count", "extra_count")])
    few = smallest(rows, params.kmers_to_sketch, order=F.col("_o"))
    last = few.groupBy("sample").agg(F.max(F.struct("_o", "hash", "kmer", "count", "extra_count")).alias("_last")).select("sample", F.col("_last._o").alias("_last"))
    more = rows.where(F.col("_o") <= ordered(params.limit)).join(last, "sample", "left").where(F.col("_last").isNull() | (F.col("_o") > F.col("_last"))).drop("_last")
    return few.unionByName(more).drop("_o")


def _valid(k: int):
    def run(batches):
        for b in _few(batches):
            n = []
            for seq in b.column(1).to_pylist():
                bad = np.concatenate([[0], np.cumsum(K.joined_codes([seq]) > 3)]) if seq else np.zeros(1)
                n.append(int((bad[k:] == bad[:-k]).sum()) if len(bad) > k else 0)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["sample", "n"])

    return run


def totals(sequences: DataFrame, params: SketchParams) -> DataFrame:
    """sample, seq_length, num_valid_kmers. A complete sketch has never counted bases: 0."""
    rows = _samples(sequences)
    packed = rows.schema["seq"].dataType.typeName() == "binary"
    valid = rows.mapInArrow(_valid(params.kmer_length), "sample string, n bigint").groupBy("sample").agg(F.sum("n").alias("num_valid_kmers"))
    length = F.coalesce(F.octet_length("seq") * 4 if packed else F.length("seq"), F.lit(0))
    bases = F.lit(0).cast("bigint") if params.scheme == ALL else F.sum(length)
    return rows.groupBy("sample").agg(bases.alias("seq_length")).join(valid, "sample")
