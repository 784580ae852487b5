"""A small reader and writer of the Cap'n Proto wire format, as far as sketch files need it.

Publicly specified: a message is a table of segment sizes and the segments; structs are
words of data and pointers, lists carry an element size. Values are little-endian, fields
hold their value XOR their default.
"""

from __future__ import annotations

import struct

from ..errors import SketchError

VOID, BIT, ONE, TWO, FOUR, EIGHT, POINTER, COMPOSITE = range(8)
_WIDTH = {ONE: 1, TWO: 2, FOUR: 4, EIGHT: 8}
_CODE = {ONE: "B", TWO: "H", FOUR: "I", EIGHT: "Q"}


class Reader:
    """One struct of a message."""

    def __init__(self, msg: Message, seg: int, data: int, n_data: int, n_ptr: int):
        self.msg, self.seg, self.data, self.n_data, self.n_ptr = msg, seg, data, n_data, n_ptr

    def num(self, code: str, index: int, default: int = 0):
        """The index-th value of that struct code, counted in its own width."""
        size = struct.calcsize(code)
        if (index + 1) * size > self.n_data * 8:
            return default
        raw = struct.unpack_from("<" + code, self.msg.segments[self.seg], self.data * 8 + index * size)[0]
        return raw ^ default if default else raw

    def bit(self, index: int) -> bool:
        return bool(self.num("B", index // 8) >> index % 8 & 1)

    def _ptr(self, i: int):
        return None if i >= self.n_ptr else self.msg.follow(self.seg, self.data + self.n_data + i)

    def sub(self, i: int) -> Reader | None:
        p = self._ptr(i)
        if p is None:
            return None
        if p[0] != "struct":
            raise SketchError("a pointer to a struct is expected")
        return Reader(self.msg, *p[1:])

    def raw(self, i: int) -> bytes | None:
        """A list of bytes, or None where the pointer is null."""
        p = self._ptr(i)
        if p is None:
            return None
        _, seg, at, kind, n = p
        if kind != ONE:
            raise SketchError("a list of bytes is expected")
        return bytes(self.msg.segments[seg][at * 8 : at * 8 + n])

    def text(self, i: int) -> str:
        raw = self.raw(i)
        return raw[:-1].decode() if raw else ""

    def nums(self, i: int) -> list[int]:
        p = self._ptr(i)
        if p is None:
            return []
        _, seg, at, kind, n = p
        if kind not in _WIDTH:
            raise SketchError("a list of numbers is expected")
        return list(struct.unpack_from(f"<{n}{_CODE[kind]}", self.msg.segments[seg], at * 8))

    def structs(self, i: int) -> list[Reader]:
        p = self._ptr(i)
        if p is None:
            return []
        _, seg, at, kind, n = p
        if kind != COMPOSITE:
            raise SketchError("a list of structs is expected")
        tag = struct.unpack_from("<Q", self.msg.segments[seg], at * 8)[0]
        count, nd, np_ = (tag & 0xFFFFFFFF) >> 2, tag >> 32 & 0xFFFF, tag >> 48
        return [Reader(self.msg, seg, at + 1 + j * (nd + np_), nd, np_) for j in range(count)]


class Message:
    def __init__(self, data: bytes):
        try:
            n = struct.unpack_from("<I", data)[0] + 1
            if n > 512:
                raise SketchError("too many segments")
            sizes = struct.unpack_from(f"<{n}I", data, 4)
        except struct.error as x:
            raise SketchError("not a sketch file") from x
        at = (4 + 4 * n + 7) // 8 * 8
        self.segments = []
        for size in sizes:
            if at + size * 8 > len(data):
                raise SketchError("the file ends early")
            self.segments.append(memoryview(data)[at : at + size * 8])
            at += size * 8

    def follow(self, seg: int, at: int):
        """("struct", segment, word, data words, pointers), ("list", segment, word, element kind, count), or None."""
        try:
            p = struct.unpack_from("<Q", self.segments[seg], at * 8)[0]
        except (struct.error, IndexError) as x:
            raise SketchError("a pointer leads out of the file") from x
        if not p:
            return None
        if p & 3 == 2:  # far
            to, word = p >> 32, p >> 3 & 0x1FFFFFFF
            if not p >> 2 & 1:
                return self.follow(to, word)
            pad, tag = struct.unpack_from("<QQ", self.segments[to], word * 8)
            return self._shape(tag, pad >> 32, pad >> 3 & 0x1FFFFFFF)
        low = p & 0xFFFFFFFF
        offset = (low >> 2) - (1 << 30 if low >> 31 else 0)
        return self._shape(p, seg, at + 1 + offset)

    @staticmethod
    def _shape(p: int, seg: int, at: int):
        if p & 3 == 0:
            return "struct", seg, at, p >> 32 & 0xFFFF, p >> 48
        return "list", seg, at, p >> 32 & 7, p >> 35

    def root(self) -> Reader:
        p = self.follow(0, 0)
        if p is None or p[0] != "struct":
            raise SketchError("not a sketch file")
        return Reader(self, *p[1:])


class Writer:
    """A message of one segment, built front to back."""

    def __init__(self):
        self.words = bytearray(8)

    def _room(self, n_bytes: int) -> int:
        at = len(self.words) // 8
        self.words += bytes(-(-n_bytes // 8) * 8)
        return at

    def _point(self, slot: int, at: int, high: int, kind: int) -> None:
        struct.pack_into("<Q", self.words, slot * 8, (high << 32) | ((at - slot - 1) << 2 & 0xFFFFFFFF) | kind)

    def root(self, n_data: int, n_ptr: int) -> Built:
        return self.struct(0, n_data, n_ptr)

    def struct(self, slot: int, n_data: int, n_ptr: int) -> Built:
        at = self._room((n_data + n_ptr) * 8)
        self._point(slot, at, n_data | n_ptr << 16, 0)
        return Built(self, at, n_data)

    def raw(self, slot: int, data: bytes) -> None:
        at = self._room(len(data))
        self.words[at * 8 : at * 8 + len(data)] = data
        self._point(slot, at, ONE | len(data) << 3, 1)

    def nums(self, slot: int, kind: int, values: list[int]) -> None:
        data = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
        at = self._room(len(data))
        self.words[at * 8 : at * 8 + len(data)] = data
        self._point(slot, at, kind | len(values) << 3, 1)

    def structs(self, slot: int, n: int, n_data: int, n_ptr: int) -> list[Built]:
        size = n_data + n_ptr
        at = self._room(8 + n * size * 8)
        struct.pack_into("<Q", self.words, at * 8, n << 2 | n_data << 32 | n_ptr << 48)
        self._point(slot, at, COMPOSITE | n * size << 3, 1)
        return [Built(self, at + 1 + i * size, n_data) for i in range(n)]

    def message(self) -> bytes:
        return struct.pack("<II", 0, len(self.words) // 8) + bytes(self.words)


class Built:
    """A struct being written."""

    def __init__(self, writer: Writer, at: int, n_data: int):
        self.writer, self.at, self.n_data = writer, at, n_data

    def num(self, code: str, index: int, value, default: int = 0) -> None:
        struct.pack_into("<" + code, self.writer.words, self.at * 8 + index * struct.calcsize(code), value ^ default if default else value)

    def bit(self, index: int, value: bool) -> None:
        self.writer.words[self.at * 8 + index // 8] |= int(value) << index % 8

    def slot(self, i: int) -> int:
        return self.at + self.n_data + i

    def text(self, i: int, value: str) -> None:
        self.writer.raw(self.slot(i), value.encode() + b"\0")

    def raw(self, i: int, value: bytes) -> None:
        self.writer.raw(self.slot(i), value)
