"""SentencePiece sampling by forward filtering and backward sampling, and lossless decoding.

The pieces of a model span a lattice over a text; a segmentation has weight exp(theta * sum
of its pieces' log weights). The forward pass gives every place the weight of all ways there;
the backward pass draws, from the end, the piece that ends at each place. No piece crosses
from a word into the next space, nor a line end, so the lattice falls apart into chunks. The
forward pass takes each different chunk once and keeps what it found (up to a bound), all new
chunks of a step together; the backward passes go through all chunks as they occur. Where no
piece that matches crosses a place, the forward pass begins anew; a run without such places
that is very long goes edge by edge instead of place by place. A draw is a hash of (seed, row
key, chunk, place) against probabilities that depend on the chunk alone, so a row's
segmentation does not depend on partitions, batches or order.

Of a BPE model the scores are merge ranks; Zipf's law makes them log weights, -log(1 + rank).
A character without a piece of its own, and U+2581 itself, goes to byte pieces.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._parts import WIDE, Grown, Parts, Table, utf8
from ._work import text_of
from .mph import mix, mix_one

SPACE = "▁"
_CUTS = ".,;:!?"
#: Bytes of text taken at a time, and chunks and edges kept after which a sampler forgets and begins anew.
_STEP = 1 << 21
_KNOWN, _EDGES = 1 << 20, 1 << 23
#: Places of a run, and draws of a chunk, after which Python loops over edges are cheaper than vectors of few.
_RUN, _DRAWS = 64, 256
#: Codes of bytes without a character piece follow those of the characters.
_BYTE = 0x110000
_ALL = (1 << 64) - 1
_LAST = (1 << 32) - 1


class _Trie:
    """The pieces as sorted (node, code) transitions, walked for many texts at once."""

    def __init__(self, pieces: dict[str, int]):
        nodes: dict[tuple[int, int], int] = {}
        self.root = np.full(_BYTE + 256, -1, dtype=np.int32)
        ends: dict[int, int] = {}
        for p, i in pieces.items():
            at = -1
            for c in p:
                key = (at, ord(c))
                at = nodes.setdefault(key, len(nodes))
            ends[at] = i
        self.piece = np.full(len(nodes) + 256, -1, dtype=np.int32)
        for at, i in ends.items():
            self.piece[at] = i
        self.bytes_from = len(nodes)
        self.root[_BYTE:] = np.arange(len(nodes), len(nodes) + 256)
        deep = []
        for (at, c), to in nodes.items():
            if at < 0:
                self.root[c] = to
            else:
                deep.append((at << 21 | c, to))
        self.to = np.array([t for _, t in deep] or [-1], dtype=np.int32)
        # mix() takes different keys to different hashes
        self.table = Table(mix(np.array([k for k, _ in deep] or [-1], dtype=np.int64).view(np.uint64)), len(self.to))
        self.table.add(np.arange(len(self.to)))

    def matches(self, codes: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(start, piece) of every piece found, by start, of each length from 1 on; ends: the end of the chunk of each place."""
        at = np.arange(len(codes))
        node = self.root[codes]
        out, n = [], 1
        while len(at):
            found = self.piece[node]
            hit = found >= 0
            out.append((at[hit], found[hit]))
            more = at + n < ends[at]
            at, node = at[more], node[more]
            i = self.table.find(mix((node.astype(np.int64) << 21 | codes[at + n]).view(np.uint64)))
            ok = i >= 0
            at, node, n = at[ok], self.to[i[ok]], n + 1
        return out


class Sampler:
    """One model and one theta."""

    _made: dict[tuple, Sampler] = {}

    def __init__(self, path: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        of_byte = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in normal])
        if scores.min() < -100:  # ranks
            scores = -np.log1p(np.minimum(-scores, n))
        pieces = {names[i]: i for i in normal}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and p != "\n" for p in pieces):
            raise ValueError("a piece crosses from a word into a space or a line end")
        if len(of_byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.weight = np.ones(n)
        self.weight[normal] = np.exp(theta * scores)
        self.trie = _Trie(pieces)
        self.trie.piece[self.trie.bytes_from :] = [of_byte[b] for b in range(256)]
        self.single = np.zeros(_BYTE, dtype=bool)  # characters that are pieces; U+2581 in a text is not the mark
        self.single[[ord(p) for p in pieces if len(p) == 1 and p != SPACE]] = True
        self.single[ord(" ")] = True
        # between a letter and such a sign no piece crosses, so a word and what follows it are chunks of their own
        cuts = [c for c in _CUTS if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in pieces)]
        self.letter = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
        self.sign = np.array([b < 128 and chr(b) in cuts for b in range(256)])
        self.step = re.compile(rb"(?<=[^ ]) |\n")
        self.raw = [b""] * n
        for p, i in pieces.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in of_byte.items():
            self.raw[i] = bytes([b])
        self._forget()

    def _forget(self) -> None:
        self.parts = Parts()
        self.node, self.length = Grown(np.int64), Grown(np.int64)  # of each known chunk: its first place in edge, and its places
        # of each place the first of its edges; of an edge the probability of all up to it, in 2^32ths, its places, its piece
        self.edge, self.upto, self.span, self.piece = Grown(np.int64), Grown(np.uint32), Grown(np.uint16), Grown(np.int32)

    @classmethod
    def get(cls, path: str, theta: float) -> Sampler:
        if (path, theta) not in cls._made:
            cls._made[path, theta] = cls(path, theta)
        return cls._made[path, theta]

    def _codes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the chunks end to end, and each chunk's number of places."""
        text = "".join(chunks)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        length = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        known = self.single[codes]
        if not known.all():
            size = np.ones(len(codes), dtype=np.int64)
            odd = np.nonzero(~known)[0]
            raw = [text[i].encode() for i in odd.tolist()]
            size[odd] = [len(x) for x in raw]
            begin = np.cumsum(size) - size
            chunk_of = np.repeat(np.arange(len(chunks)), length)
            length = np.bincount(chunk_of, weights=size, minlength=len(chunks)).astype(np.int64)
            wide = np.repeat(codes, size)
            for at, x in zip(begin[odd].tolist(), raw, strict=True):
                wide[at : at + len(x)] = [_BYTE + b for b in x]
            codes = wide
        codes[codes == ord(" ")] = ord(SPACE)
        return codes, length

    def _learn(self, chunks: list[str]) -> None:
        """Lattices of the chunks that got the next numbers."""
        codes, length = self._codes(chunks)
        base = np.cumsum(length) - length
        found = self.trie.matches(codes, np.repeat(base + length, length))
        places = len(codes)
        # the edges of a place lie together, the longest first, which mostly is the likeliest
        ending, across = np.zeros(places + 1, np.int64), np.zeros(places + 2, np.int64)
        for n, (at, _) in enumerate(found, 1):
            ending[at + n] += 1
            across[at + 1] += 1
            across[at + n] -= 1
        edge = np.cumsum(ending) - ending
        free, size = edge.copy(), int(ending.sum())
        start, piece, span = np.empty(size, np.int64), np.empty(size, np.int32), np.empty(size, np.uint16)
        for n, (at, x) in reversed(list(enumerate(found, 1))):
            i = free[at + n]
            start[i], piece[i], span[i] = at, x, n
            free[at + n] += 1
        end, edge = start + span, edge[1:]
        # runs: no edge crosses from one into the next
        first = np.nonzero(np.cumsum(across)[:places] == 0)[0]
        sizes = np.diff(np.append(first, places))
        begins, long = np.repeat(first, sizes)[start], np.repeat(sizes > _RUN, sizes)[start]
        weight = self.weight[piece]
        share = np.empty(size)  # of its weight that a place has by each edge
        if long.any():
            few, far = np.nonzero(~long)[0], np.nonzero(long)[0]
            share[few] = self._forward(start[few], end[few], weight[few], begins[few])
            for a, b in _groups(begins[far]):
                share[far[a:b]] = _forward_one(start[far[a:b]], end[far[a:b]], weight[far[a:b]])
        else:
            share = self._forward(start, end, weight, begins)
        upto, rank = share, np.arange(size) - edge[end - 1]
        at = np.nonzero(rank > 0)[0]
        n = 1
        while len(at):  # the next edge of every place at a time
            now = at[rank[at] == n]
            upto[now] += upto[now - 1]
            at, n = at[rank[at] > n], n + 1
        upto = np.minimum(upto * 2.0**32, 2.0**32 - 1).astype(np.uint32)
        upto[np.append(edge[1:], size) - 1] = _LAST  # the last edge takes all that is left
        self.node.add(self.edge.n + base)
        self.length.add(length)
        self.edge.add(self.upto.n + edge)
        self.upto.add(upto)
        self.span.add(span)
        self.piece.add(piece)

    @staticmethod
    def _forward(start, end, weight, begins) -> np.ndarray:
        """Shares of the edges, which come by end, of runs side by side: one place of every run after the other."""
        places = int(end.max()) + 1 if len(end) else 0
        value, scale = np.ones(places), np.zeros(places, dtype=np.int64)  # forward weight is value * 2 ** scale: neither overflows nor vanishes
        share = np.empty(len(end))
        depth = end - begins
        order = np.argsort(depth.astype(np.uint8), kind="stable")  # at most _RUN
        # a run's first place is the last one of the run before, whose weight counts as 1 here
        fresh = start == begins
        steps = np.concatenate([np.nonzero(np.diff(depth[order], prepend=-1))[0], [len(order)]]).tolist()
        for a, b in zip(steps, steps[1:], strict=False):
            i = order[a:b]
            s, d, new = start[i], end[i], fresh[i]
            first = np.nonzero(np.diff(d, prepend=-1))[0]
            last = np.where(d - 1 == begins[i], 0, scale[d - 1])
            part = np.ldexp(np.where(new, 1.0, value[s]) * weight[i], np.maximum(np.where(new, 0, scale[s]) - last, -2000))
            total = np.add.reduceat(part, first)
            value[d[first]], e = np.frexp(total)
            scale[d[first]] = last[first] + e
            share[i] = part / np.repeat(total, np.diff(np.append(first, b - a)))
        return share

    def sample(self, keys: list[int], texts, seed: int) -> list[np.ndarray]:
        """Piece ids of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[list] = [[] for _ in keys]
        row = 0
        for ids, per, whole in self.steps(np.array(keys, dtype=np.int64), column, seed):
            for i, x in enumerate(np.split(ids, np.cumsum(per)[:-1])):
                out[row + i].append(x)
            row += len(per) - (not whole)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def steps(self, keys: np.ndarray, column: pa.Array, seed: int):
        """(ids, number of each row's ids, whole) of some rows at a time, in order; of a very long text in steps. Where the
        last row goes on in the next step, it isn't whole."""
        data, offsets = utf8(column)
        row, at = 0, 0 if not len(column) else int(offsets[0])
        begun = chunks = 0  # whether the first row goes on, and its chunks so far
        while row < len(column):
            upto = max(row + 1, int(np.searchsorted(offsets, at + _STEP, side="right")) - 1)
            end = int(offsets[upto])
            if end - at > _STEP and (cut := self.step.search(memoryview(data), at + _STEP, end)):
                end = cut.start()
            inside = np.clip(offsets[row : upto + 1], at, end) - at
            ids, per, last = self._some(keys[row:upto], data[at:end], inside, seed, begun, chunks)
            whole = end == offsets[upto]
            yield ids, per, whole
            row, at = upto - (not whole), end
            begun, chunks = (0, 0) if whole else (1, last)

    def _some(self, keys, d: np.ndarray, offsets: np.ndarray, seed: int, begun: int, chunks: int):
        """(ids, number of ids of each text, chunks of the last one, with those before)."""
        if not len(d):
            return np.zeros(0, np.int32), np.zeros(len(keys), np.int64), 0
        if self.parts.n > _KNOWN or self.upto.n > _EDGES:
            self._forget()
        full = np.nonzero(np.diff(offsets))[0]
        d = np.insert(d, offsets[full[begun:]], 32)  # texts that begin here have a space before
        begin = offsets[full] + np.maximum(0, np.arange(len(full)) - begun)
        cut = np.zeros(len(d), bool)
        blank, line = d == 32, d == 10
        cut[1:] = (blank[1:] & ~blank[:-1]) | (line[1:] & ~blank[:-1]) | line[:-1] | (self.letter[d[:-1]] & self.sign[d[1:]])
        cut[begin] = True
        start = np.nonzero(cut)[0]
        size = np.diff(np.append(start, len(d)))
        padded = np.concatenate([d, np.zeros(WIDE, np.uint8)])
        which, new = self.parts.number(padded, start, size)
        if len(new):
            self._learn([d[a : a + n].tobytes().decode() for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)])
        bound = np.append(np.searchsorted(start, begin), len(start))
        per = np.diff(bound)  # chunks of each text
        row = mix(keys[full].view(np.uint64) ^ mix(np.array([seed], dtype=np.uint64)))
        nth = np.arange(len(which)) - np.repeat(bound[:-1], per)
        nth[: per[0]] += chunks
        ids, took = self._backward(which, mix(np.repeat(row, per) + mix(nth.astype(np.uint64))))
        out = np.zeros(len(keys), np.int64)
        out[full] = np.add.reduceat(took, bound[:-1])
        return ids, out, int(nth[-1]) + 1 if full[-1] == len(keys) - 1 else 0

    def _backward(self, which: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, in order, how many each chunk has)."""
        edges, upto, span, piece = self.edge.a, self.upto.a, self.span.a, self.piece.a
        active, first, place = np.arange(len(which)), self.node.a[which] - 1, self.length.a[which]
        took, drawn = np.zeros(len(which), dtype=np.int64), []
        for _ in range(_DRAWS):
            if not len(active):
                break
            u = np.minimum(mix(stream + place.astype(np.uint64)) >> np.uint64(32), np.uint64(_LAST - 1)).astype(np.uint32)
            edge = edges[first + place]
            late = np.nonzero(upto[edge] <= u)[0]
            while len(late):
                edge[late] += 1
                late = late[upto[edge[late]] <= u[late]]
            drawn.append((active, piece[edge]))
            took[active] += 1
            place = place - span[edge]
            on = place > 0
            active, first, place, stream = active[on], first[on], place[on], stream[on]
        rest = []
        for i, f, p, s in zip(active.tolist(), first.tolist(), place.tolist(), stream.tolist(), strict=True):
            got = []
            while p > 0:
                u = min(mix_one((s + p) & _ALL) >> 32, _LAST - 1)
                e = int(edges[f + p])
                while upto[e] <= u:
                    e += 1
                got.append(int(piece[e]))
                p -= int(span[e])
            rest.append(np.array(got[::-1], np.int32))
            took[i] += len(got)
        end = np.cumsum(took)
        flat = np.zeros(int(end[-1]), dtype=np.int32)
        for step, (who, x) in enumerate(drawn):
            flat[end[who] - 1 - step] = x
        for i, got in zip(active.tolist(), rest, strict=True):
            begin = int(end[i] - took[i])
            flat[begin : begin + len(got)] = got
        return flat, took

    def decode(self, ids) -> str:
        """The text that sample() took apart, character for character."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode()[1:]


def _groups(of: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    cuts = [*np.nonzero(np.diff(of, prepend=-1))[0].tolist(), len(of)]
    return list(zip(cuts, cuts[1:], strict=False))


def _forward_one(start, end, weight) -> np.ndarray:
    """Shares of the edges, which come by end, of one long run."""
    low = int(start[0])
    value, scale = [1.0] * (int(end[-1]) - low + 1), [0] * (int(end[-1]) - low + 1)
    share = np.empty(len(end))
    s, w = (start - low).tolist(), weight.tolist()
    for a, b in _groups(end):
        d = int(end[a]) - low
        base = scale[d - 1]
        part = [math.ldexp(value[s[i]] * w[i], max(scale[s[i]] - base, -2000)) for i in range(a, b)]
        total = sum(part)
        value[d], e = math.frexp(total)
        scale[d] = base + e
        for i, x in enumerate(part):
            share[a + i] = x / total
    return share


def _encoded(path: str, theta: float, seed: int, full: bool):
    def run(batches):
        s = Sampler.get(path, theta)
        for b in batches:
            keys = b.column(1).to_numpy()
            row, counts, sums, held = 0, [], [], []
            n = crc = 0
            for ids, per, whole in s.steps(keys, b.column(2), seed):
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for i, size in enumerate(per.tolist()):
                    n, crc = n + size, zlib.crc32(raw[4 * at : 4 * (at + size)], crc)
                    at += size
                    if whole or i < len(per) - 1:
                        counts.append(n)
                        sums.append(crc)
                        n = crc = 0
                if full:
                    held.append(ids)
                row += len(per) - (not whole)
            cols, names = [b.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["id", "n_pieces", "ids_crc32"]
            if full:
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *counts], dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *held]))))
                names.append("ids")
            yield pa.record_batch(cols, names=names)

    return run


def sample_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", theta: float = 1.0, seed: int = 42, ids: bool = False) -> DataFrame:
    """One row per input row: id, n_pieces, ids_crc32 (of 32-bit little-endian ids), and ids if asked for, from which
    decode_pieces() gives the text back.

    Null and empty texts have no pieces. A null id draws as id 0; rows that share an id and a
    text have one segmentation. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("key"), text_of(F.col(text_col)).alias("text"))
    shape = f"id {kind}, n_pieces long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return rows.mapInArrow(_encoded(model, theta, seed, ids), shape).withColumnRenamed("id", id_col)


_plain: dict[str, object] = {}


def _encoded_plainly(path: str):
    def run(batches):
        import sentencepiece

        if path not in _plain:
            _plain[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = _plain[path].encode(part.column(1).to_pylist(), num_threads=1)
                yield pa.record_batch([part.column(0), pa.array(got, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids, the model's own segmentation instead of a drawn one.

    Null and empty texts have no pieces; null ids and repeated rows come back as they are. An empty table gives no rows;
    other columns are ignored. decode_pieces() gives the text back, with U+2581 as a space."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_encoded_plainly(model), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _decoded(path: str):
    def run(batches):
        s = Sampler.get(path, 1.0)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else s.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return run


def decode_pieces(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of rows of piece ids; null ids give a null text."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decoded(model), f"id {kind}, text string").withColumnRenamed("id", id_col)
