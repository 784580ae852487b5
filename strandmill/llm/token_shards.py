"""Token-id output: binary shards in order of the document key, with keyed access.

A file set is a folder:
  shards/    Parquet, sorted; a shard is some rows, its pages and then its index:
             shard long, page int (-1: the index), start long (ids of the shard before the
             page), n_docs long, n_tokens long, sizes binary (ids of each document, unsigned
             32-bit little-endian), and of a page: ids binary (raw little-endian ids of WIDTH
             bytes; a document is in one page); of the index: lo long, hi long (least and
             greatest key), keys binary (signed 64-bit little-endian, ascending), starts binary
             (start of each page, unsigned 64-bit little-endian), index binary (minimal perfect
             hash from key to (offset, length) in the shard's ids, with fingerprints)
  manifest/  Parquet: shard long, base long (ids of all shards before it), lo long, hi long
Keyed access takes the shard from the key ranges, then the place from the shard's index in
constant time. A shard has a bounded number of documents, however many a task writes. Files
go through Spark's writer, so any store and any retry is fine.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._parts import WIDE, Grown, Parts, utf8
from ._work import text_of
from .mph import Index, build

END_ID = 0
#: Ids of a page. Documents of a shard after which the next one begins; a shard's index is one row.
PAGE = 1 << 19
SHARD_DOCS = 1 << 18
_ROWS = "shard long, page int, start long, n_docs long, n_tokens long, lo long, hi long, keys binary, sizes binary, starts binary, index binary, ids binary"
#: Bytes of text encoded at a time, and the known parts and their ids after which an encoder forgets and begins anew.
_STEP = 1 << 20
_KNOWN, _STORED = (1 << 20) - (1 << 17), 1 << 23

_encoders: dict[tuple, Encoder] = {}


#: Classes of bytes: a letter, digit, sign, apostrophe, space, other white space, what may begin rare white space; 0: others.
_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _LINE, _RARE = range(1, 8)


def _class(b: int) -> int:
    c = chr(b)
    if b in b"\x1c\x1d\x1e\x1f\x7f\xc2\xe1\xe2\xe3\xef":
        return _RARE
    if b >= 128:
        return 0
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c == " " else _LINE if c.isspace() else _QUOTE if c == "'" else _SIGN if c > " " else 0


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)
_BLANK = (_SPACE, _LINE)
#: Of two neighbours' classes, 8 * first + second: whether a part always begins with the second; with the first.
_WITH_SECOND = np.zeros(64, bool)
_WITH_FIRST = np.zeros(64, bool)
for _a in range(8):
    for _b in range(8):
        _apart = _a in (_LETTER, _DIGIT, _SIGN) and _b in (_LETTER, _DIGIT, _SIGN, _QUOTE) and _a != _b and (_a, _b) != (_SIGN, _QUOTE)
        _WITH_SECOND[8 * _a + _b] = _apart or (_b in _BLANK and _a not in _BLANK) or (_a == _LINE and _b not in _BLANK)
        _WITH_FIRST[8 * _a + _b] = _a in _BLANK and _b not in _BLANK
_PLAIN = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def rare(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places of d, all of class _RARE, begin white space, or what libraries see differently, beyond the
    common six characters; texts with it are taken whole."""
    d = np.concatenate([d, np.zeros(2, np.uint8)])
    a, b, c = d[at], d[at + 1], d[at + 2]
    out = (a < 128) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))))
    out |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F) & (c <= 0xAF)))
    return out | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))


class Encoder:
    """tokenizers' ids of whole texts, by way of their parts.

    The byte-level pre-tokenizer always cuts before white space that follows something else,
    before the last of several white spaces, after white space that isn't a space, and between
    ASCII letters, digits and signs (but not after an apostrophe). The ids of the parts between
    such cuts, each encoded once and kept, are the ids of the text. Texts that hold a special
    token or rare white space are one part. What is kept has a bound.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.after_space = np.array([x.startswith("\u0120") for x in names])
        self.line = self.tok.token_to_id("\u010a")
        self._forget()

    @classmethod
    def get(cls, path: str, width: int) -> Encoder:
        if (path, width) not in _encoders:
            _encoders[path, width] = cls(path, width)
        return _encoders[path, width]

    def _forget(self) -> None:
        self.parts = Parts()
        self.first, self.count = Grown(np.int64), Grown(np.int64)  # of each known part: where its ids begin in stored, and how many
        self.stored = Grown(self.kind)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        got = []
        for at in range(0, len(texts), 128):  # the library's own results are large
            got += [np.array(e.ids, dtype=self.kind) for e in self.tok.encode_batch_fast(texts[at : at + 128], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.kind), *got]), np.array([len(x) for x in got], np.int64)

    def _joined(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, line: bool) -> tuple[np.ndarray, np.ndarray]:
        """_ids of parts that hold no white space but, unless line, a space that each begins with: many in one text, cut where
        an id begins with that space, or is the line end put before each."""
        if not len(start):
            return self._ids([])
        ends = np.cumsum(size + line)
        begin = ends - size
        flat = np.full(int(ends[-1]), 10, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin, size) + within] = data[np.repeat(start, size) + within]
        cuts = [*(begin[::64] - line).tolist(), len(flat)]
        ids, per = self._ids([flat[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)])
        first = np.nonzero(ids == self.line if line else self.after_space[ids])[0]
        # as many beginnings in each text as it has parts; else it isn't a vocabulary that keeps white space apart
        if not np.array_equal(np.searchsorted(first, np.cumsum(per)), np.minimum(np.arange(1, len(per) + 1) * 64, len(start))):
            return self._ids([flat[a : a + n].tobytes().decode() for a, n in zip(begin.tolist(), size.tolist(), strict=True)])
        counts = np.diff(np.append(first, len(ids))) - line
        return (np.delete(ids, first) if line else ids), counts

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> None:
        """Ids of the parts that got the next numbers; whole: those that must be taken as they are."""
        count, before = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        spaced = ~whole & (data[start] == 32)
        for which, line in ((spaced, False), (~whole & ~spaced, True), (whole, None)):
            at = np.nonzero(which)[0]
            if line is None:
                ids, per = self._ids([data[a : a + n].tobytes().decode() for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)])
            else:
                ids, per = self._joined(data, start[at], size[at], line)
            count[at], before[at] = per, self.stored.n + np.cumsum(per) - per
            self.stored.add(ids)
        self.first.add(before)
        self.count.add(count)

    def _cuts(self, d: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the parts of d begin, which of them must be taken whole); begin: where its texts (not empty) begin. The last
        text ends with d."""
        kind = _CLASS[d]
        pair = kind[:-1] << 3
        pair |= kind[1:]
        cut = np.zeros(len(d), bool)
        cut[:-1] = _WITH_FIRST[pair]
        cut[begin[1:] - 1] = False  # white space that ends a text stays together
        cut[1:] |= _WITH_SECOND[pair]
        cut[begin] = True
        odd = np.nonzero(kind == _RARE)[0]
        odd = odd[rare(d, odd)].tolist()
        raw = d.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd.append(at)
                at = raw.find(s, at + 1)
        ends = np.append(begin[1:], len(d))
        texts = np.unique(np.searchsorted(begin, odd, side="right") - 1)
        for i in texts.tolist():
            cut[begin[i] + 1 : ends[i]] = False
        start = np.nonzero(cut)[0]
        # white space but for one space before something else
        first = kind[start]
        size = np.diff(np.append(start, len(d)))
        whole = (first == _LINE) | ((first == _SPACE) & (size == 1))
        many = np.nonzero((first == _SPACE) & (size > 1))[0]
        whole[many] = np.isin(kind[start[many] + 1], _BLANK)
        if len(texts):
            whole[np.searchsorted(start, begin[texts])] = True
        return start, whole

    def encode(self, column: pa.Array):
        """(ids, number of each row's ids, whole) of some rows at a time, in order; of a very long text in steps. Where the last
        row goes on in the next step, it isn't whole."""
        data, offsets = utf8(column)
        row, at = 0, 0 if not len(column) else int(offsets[0])
        while row < len(column):
            upto = int(np.searchsorted(offsets, at + _STEP, side="right")) - 1
            end = int(offsets[max(upto, row)]) if upto > row else at
            if upto <= row:  # not even the one text
                upto, end = row + 1, int(offsets[row + 1])
                if end - at > _STEP and not self._odd(data[at:end]):
                    cut = _PLAIN.search(memoryview(data), at + _STEP, end)
                    end = cut.start() if cut else end
            inside = np.clip(offsets[row : upto + 1], at, end)
            whole = end == offsets[upto]
            yield *self._some(data[at:end], inside - at), whole
            row, at = upto - (not whole), end

    def _odd(self, d: np.ndarray) -> bool:
        """Whether a text must be taken whole."""
        raw = d.tobytes()
        return any(s in raw for s in self.special) or bool(rare(d, np.nonzero(_CLASS[d] == _RARE)[0]).any())

    def _some(self, d: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        sizes = np.diff(offsets)
        if not len(d):
            return np.zeros(0, self.kind), np.zeros(len(sizes), np.int64)
        if self.parts.n > _KNOWN or self.stored.n > _STORED:
            self._forget()
        full = np.nonzero(sizes)[0]
        start, whole = self._cuts(d, offsets[full])
        size = np.diff(np.append(start, len(d)))
        padded = np.concatenate([d, np.zeros(WIDE, np.uint8)])
        number, new = self.parts.number(padded, start, size)
        if len(new):
            self._learn(d, start[new], size[new], whole[new])
        count = self.count.a[number]
        ends = np.cumsum(count)
        ids = self.stored.a[np.repeat(self.first.a[number] - (ends - count), count) + np.arange(int(ends[-1]))]
        before = np.append(ends - count, ends[-1])
        per = np.zeros(len(sizes), np.int64)
        per[full] = np.diff(np.append(before[np.searchsorted(start, offsets[full])], ends[-1]))
        return ids, per


def _writer(path: str, width: int, end_id: int, most_ids: int, most_docs: int):
    def run(batches):
        encoder = Encoder.get(path, width)
        if max(encoder.tok.get_vocab_size() - 1, end_id) >> 8 * width:
            raise ValueError(f"the ids need more than {width} bytes")
        shard = TaskContext.get().partitionId() << 20
        keys: list[np.ndarray] = []  # of the shard
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []  # of the page
        starts: list[int] = []
        docs = begun = held = start = open_ids = 0

        def paged():
            """The page that ends with the last whole document."""
            nonlocal ids, begun, held, start
            row = {"shard": shard, "page": len(starts), "start": start, "n_docs": docs - begun, "n_tokens": held}
            row["sizes"] = np.concatenate(sizes)[begun:docs].astype("<u4").tobytes()
            row["ids"] = np.concatenate(ids).tobytes()
            starts.append(start)
            ids, begun, start, held = [], docs, start + held, 0
            return _row(row)

        def closed():
            """The shard's index, after its pages."""
            k, n = np.concatenate(keys), np.concatenate(sizes)
            once = np.concatenate([[True], k[1:] != k[:-1]])  # of rows with one key the first has the entry
            index = build(k[once], (np.cumsum(n) - n)[once], n[once])
            return _row({"shard": shard, "page": -1, "start": 0, "n_docs": docs, "n_tokens": start, "lo": int(k[0]), "hi": int(k[-1]), "keys": k.astype("<i8").tobytes(), "sizes": n.astype("<u4").tobytes(), "starts": np.array(starts, "<u8").tobytes(), "index": index})

        for b in batches:
            key = b.column(0).to_numpy()
            at = 0
            for got, per, whole in encoder.encode(b.column(1)):
                full = len(per) - (not whole)
                per[0] += open_ids  # what a long text has given before
                more = per.copy()
                more[0] -= open_ids
                got = np.insert(got, np.cumsum(more)[:full], end_id).astype(encoder.kind)
                open_ids = 0 if whole else int(per[-1])
                ids.append(got)
                held += len(got)
                keys.append(key[at : at + full])
                sizes.append(per[:full] + 1)
                at, docs = at + full, docs + full
                if whole and held >= most_ids:
                    yield paged()
                if whole and docs >= most_docs:
                    if held:
                        yield paged()
                    yield closed()
                    shard, keys, sizes, starts = shard + 1, [], [], []
                    docs = begun = start = 0
        if held:
            yield paged()
        if docs:
            yield closed()

    return run


_names = [x.split()[0] for x in _ROWS.split(", ")]
_types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _ROWS.split(", ")]


def _row(row: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array([row.get(n)], t) for n, t in zip(_names, _types, strict=True)], names=_names)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2, end_id: int = END_ID, page: int = PAGE, shard_docs: int = SHARD_DOCS) -> None:
    """Encode every whole text (null: empty), end_id after each, and write the file set below path.

    A row with a null id has no key and so no place in keyed files; it is left out. Rows that
    share an id are all written; keyed access gives the first in each shard. Other columns are
    ignored. An empty table gives an empty file set. page: ids after which a page ends;
    shard_docs: documents after which a shard ends; both as steps of the encoder end. The manifest
    tells a shard's keys, width and end_id; a page's bytes are width times its n_tokens, which is
    what readers go by. An error, if the ids don't fit the width.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), text_of(F.col(text_col)).alias("text"))
    # the text's hash only separates rows of one key
    rows = rows.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    made = rows.mapInArrow(_writer(tokenizer, width, end_id, page, shard_docs), _ROWS)
    made.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/shards")
    spark = docs.sparkSession
    shards = _indices(spark, path)  # one row a shard
    shards.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"), "lo", "hi", F.lit(width).alias("width"), F.lit(end_id).alias("end_id")).coalesce(1).write.parquet(f"{path}/manifest")


def _all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{path}/shards")


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return _all(spark, path).where("page >= 0")


def _indices(spark: SparkSession, path: str) -> DataFrame:
    return _all(spark, path).where("page = -1")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard long, base long, lo long, hi long, width int, end_id int").parquet(f"{path}/manifest")


def _placed(batches):
    """Of every document of a shard: the place and length that the index gives."""
    for b in batches:
        for r in b.to_pylist():
            index, keys, sizes = Index(r["index"]), np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            once = np.concatenate([[True], keys[1:] != keys[:-1]])
            found, offset, length = index.find_all(keys)
            if not found.all():
                raise ValueError("a key is not in its shard's index")
            # rows that repeat a key follow its first one
            before = np.cumsum(sizes) - sizes
            group = np.maximum.accumulate(np.where(once, np.arange(len(keys)), 0))
            offset, length = offset + before - before[group], np.where(once, length, sizes)
            cols = [np.full(len(keys), r["shard"]), keys, r["base"] + offset, offset, length]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["shard", "key", "start", "at", "n_tokens"])


def _digested(batches):
    for b in batches:
        for r in b.to_pylist():
            sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['n_tokens']}").astype("<u4")
            ends = np.cumsum(sizes)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            cols = [np.full(len(sizes), r["shard"]), r["start"] + ends - sizes, sizes, crc]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["shard", "at", "n_tokens", "ids_crc32"])


def describe(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files: the index gives
    each key its place and length in its shard, and what the pages hold there gives the sum."""
    manifest = _manifest(spark, path).select("shard", "base")  # one row a shard
    index = _indices(spark, path).select("shard", "keys", "sizes", "index").join(manifest, "shard").select("shard", "base", "keys", "sizes", "index")
    placed = index.mapInArrow(_placed, "shard long, key long, start long, at long, n_tokens long")
    held = _pages(spark, path).select("shard", "start", "n_tokens", "sizes", "ids").mapInArrow(_digested, "shard long, at long, n_tokens long, ids_crc32 long")
    return placed.join(held, ["shard", "at", "n_tokens"]).select("key", "start", "n_tokens", "ids_crc32")


def _looked_up(batches):
    for b in batches:
        for r in b.to_pylist():
            keys = np.array(r["wanted"], "<i8")
            found, offset, length = Index(r["index"]).find_all(keys)
            # a stranger's fingerprint agrees once in 2^32; the keys themselves settle it
            known = np.frombuffer(r["keys"], "<i8")
            found &= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
            starts = np.frombuffer(r["starts"], "<u8").astype(np.int64)
            page = np.searchsorted(starts, offset[found], side="right") - 1
            cols = [np.full(len(page), r["shard"]), page, keys[found], offset[found] - starts[page], length[found]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["shard", "page", "key", "at", "n"])


def _sliced(batches):
    for b in batches:
        out = [{"key": r["key"], "ids": np.frombuffer(r["part"], f"<u{r['width']}").tolist()} for r in b.to_pylist()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64()))]))


#: Wanted keys that meet a shard's index in one row.
_ASKED = 1 << 16


def fetch(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """key, ids of those of the keys that the files hold; each wanted key once, of rows that repeat it the first of each
    shard. Null keys find nothing. The manifest (one row a shard) gives the shard, its index the place, the page its ids."""
    wanted = keys.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("long").alias("key")).distinct()
    shards = _manifest(spark, path).select("shard", F.col("lo").alias("a"), F.col("hi").alias("b"))
    placed = wanted.join(F.broadcast(shards), F.col("key").between(F.col("a"), F.col("b"))).select("key", "shard")
    many = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(_ASKED)).cast("int").alias("lists"))
    salted = placed.join(many, "shard").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("lists")))
    lists = salted.groupBy("shard", "salt").agg(F.collect_list("key").alias("wanted"))  # about _ASKED keys each
    looked = _indices(spark, path).select("shard", "keys", "starts", "index").join(lists, "shard").select("shard", "keys", "starts", "index", "wanted")
    looked = looked.mapInArrow(_looked_up, "shard long, page long, key long, at long, n long")
    part = F.expr("substring(ids, cast(at * width + 1 as int), cast(n * width as int))")
    pages = _pages(spark, path).select("shard", F.col("page").cast("long").alias("page"), F.expr("cast(octet_length(ids) / n_tokens as int)").alias("width"), "ids")
    return pages.join(looked, ["shard", "page"]).select("key", "width", part.alias("part")).mapInArrow(_sliced, "key long, ids array<long>")
