"""Numbers for byte strings that occur again and again: equal strings get equal numbers, with vector operations.

A string of up to WIDE bytes is told by its bytes themselves, as four words and a length; a hash
only finds the place in an open table, so no two strings are ever taken for one. Longer ones, and
one of two whose hashes agree, go through a dict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .mph import mix

WIDE = 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls: row i is bytes[offsets[i]:offsets[i + 1]]."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


class Grown:
    """An array that grows at its end; a holds more than the n entries in use."""

    def __init__(self, kind):
        self.a, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.a):
            more = np.zeros(max(end, 2 * len(self.a)), self.a.dtype)
            more[: self.n] = self.a[: self.n]
            self.a = more
        self.a[self.n : end] = values
        self.n = end


class Table:
    """Numbers by their 64-bit hashes, hash[number], in open addressing with vector operations."""

    def __init__(self, hashes: np.ndarray, room: int):
        self.hash = hashes
        self.slots = np.full(1 << (4 * room - 1).bit_length(), -1, np.int32)

    def add(self, numbers: np.ndarray) -> None:
        """Their hashes are distinct and not in the table; at most half the slots may be taken."""
        mask = len(self.slots) - 1
        at = (self.hash[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of several the last one stays
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number with each hash, or -1."""
        mask = len(self.slots) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        out = self.slots[at]
        todo = np.nonzero((out >= 0) & (self.hash[out] != h))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.hash[out[todo]] != h[todo])]
        return out


class Parts:
    """number() deals out 0, 1, 2, ... in order of first occurrence."""

    def __init__(self, room: int = 1 << 16):
        self.n, self.room = 0, 0
        self.long: dict[bytes, int] = {}
        self._grow(room)

    def _grow(self, room: int) -> None:
        more = room - self.room
        self.hash = np.concatenate([self.hash, np.zeros(more, np.uint64)]) if self.room else np.zeros(more, np.uint64)
        self.words = [np.concatenate([w, np.zeros(more, np.uint64)]) for w in self.words] if self.room else [np.zeros(more, np.uint64) for _ in range(WIDE // 8)]
        self.size = np.concatenate([self.size, np.zeros(more, np.int32)]) if self.room else np.zeros(more, np.int32)
        self.room = room
        self.table = Table(self.hash, room)
        self.table.add(np.nonzero(self.size[: self.n])[0])

    def number(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each string data[start:start + size], places in start of the first of each new one, in order of their
        numbers). data must go on for WIDE bytes after the last string."""
        loads = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)) if len(data) > 7 else np.zeros(1, "<u8")
        short = size <= WIDE
        words = []
        h = mix(size.astype(np.uint64))
        for i in range(WIDE // 8):
            if i < 2:  # most strings have no more
                w = loads[start + 8 * i] & _MASKS[np.clip(size - 8 * i, 0, 8)]
                h = mix(h ^ w)
            else:
                w = np.zeros(len(start), np.uint64)
                more = np.nonzero((size > 8 * i) & short)[0]
                if len(more):
                    w[more] = loads[start[more] + 8 * i] & _MASKS[np.minimum(size[more] - 8 * i, 8)]
                    h[more] = mix(h[more] ^ w[more])
            words.append(w)
        out = self.table.find(h)
        fresh = np.nonzero((out < 0) & short)[0]
        new = np.zeros(0, np.int64)
        if len(fresh):
            _, first = np.unique(h[fresh], return_index=True)
            new = fresh[np.sort(first)]
            while self.n + len(new) > self.room:
                self._grow(2 * self.room)
            numbers = np.arange(self.n, self.n + len(new))
            self.hash[numbers], self.size[numbers] = h[new], size[new]
            for mine, w in zip(self.words, words, strict=True):
                mine[numbers] = w[new]
            self.n += len(new)
            self.table.add(numbers)
            out[fresh] = self.table.find(h[fresh])
        same = (self.size[out] == size) & short
        for mine, w in zip(self.words[:2], words[:2], strict=True):
            same &= mine[out] == w
        more = np.nonzero(size > 16)[0]
        for mine, w in zip(self.words[2:], words[2:], strict=True):
            same[more] &= mine[out[more]] == w[more]
        odd = np.nonzero(~same)[0]
        if len(odd):
            late = []
            for i, a, b in zip(odd.tolist(), start[odd].tolist(), (start[odd] + size[odd]).tolist(), strict=True):
                key = data[a:b].tobytes()
                if key not in self.long:
                    if self.n == self.room:
                        self._grow(2 * self.room)
                    self.long[key] = self.n
                    self.n += 1
                    late.append(i)
                out[i] = self.long[key]
            new = np.concatenate([new, np.array(late, np.int64)])
        return out, new
