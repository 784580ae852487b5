"""Minimal perfect hash over 64-bit keys, with a fingerprint, an offset and a length in each slot.

Hash and displace: keys fall into buckets of about four; from the largest bucket on, each
takes the first pilot that sends all its keys to free slots of a table with as many slots as
keys. A key is found by two hashes and one compare, whatever the number of keys. Other keys
land on some slot too, whose fingerprint gives them away but for one in 2^32.
"""

from __future__ import annotations

import numpy as np

_MAGIC = b"MPH1"
_LOAD = 4
_TRIES = 256
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def build(keys, offsets, lengths) -> bytes:
    """The index of distinct keys, as bytes."""
    n = len(keys)
    raw = np.asarray(keys, dtype=np.int64).view(np.uint64)
    for seed in range(1, 1000):
        h = mix(raw ^ np.uint64(mix_one(seed)))
        pilots, slots = _place(h, n)
        if pilots is not None:
            break
    else:  # pragma: no cover
        raise ValueError("keys repeat")
    out = [_MAGIC, np.array([n, len(pilots), seed], dtype="<u4").tobytes(), pilots.astype("<u4").tobytes()]
    for values, kind in ((h & np.uint64(0xFFFFFFFF), "<u4"), (np.asarray(offsets), "<u8"), (np.asarray(lengths), "<u8")):
        table = np.zeros(n, dtype=kind)
        table[slots] = values
        out.append(table.tobytes())
    return b"".join(out)


def _place(h: np.ndarray, n: int):
    """(pilots, slot of each key), or (None, None) if two keys agree in all hash bits that matter."""
    nb = max(1, -(-n // _LOAD))
    bucket = ((h >> np.uint64(32)) % np.uint64(nb)).astype(np.int64)
    size = np.bincount(bucket, minlength=nb)
    order = np.argsort(bucket, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size)])
    free = np.ones(max(n, 1), dtype=bool)
    pilots, slots = np.zeros(nb, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        who = order[begin[b] : begin[b + 1]]
        if len(who) > 1 and len(np.unique(h[who])) < len(who):
            return None, None
        for at in range(0, 1 << 24, _TRIES):
            p = np.arange(at, at + _TRIES, dtype=np.uint64)
            s = (mix(h[who][None] ^ mix(p)[:, None]) % np.uint64(n)).astype(np.int64)
            ok = free[s].all(axis=1)
            if len(who) > 1:
                t = np.sort(s, axis=1)
                ok &= (t[:, 1:] != t[:, :-1]).all(axis=1)
            hit = int(ok.argmax())
            if ok[hit]:
                pilots[b], slots[who] = at + hit, s[hit]
                free[s[hit]] = False
                break
        else:  # pragma: no cover
            return None, None
    return pilots, slots


class Index:
    """Lookups over build()'s bytes, without a copy."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not an index")
        self.n, self.nb, seed = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        self._salt = mix_one(seed)
        at = 16
        self.pilots = np.frombuffer(data, "<u4", self.nb, at)
        at += 4 * self.nb
        self.marks = np.frombuffer(data, "<u4", self.n, at)
        at += 4 * self.n
        self.offsets = np.frombuffer(data, "<u8", self.n, at)
        self.lengths = np.frombuffer(data, "<u8", self.n, at + 8 * self.n)

    def find(self, key: int) -> tuple[int, int] | None:
        """(offset, length), or None where the fingerprint says that the key isn't there."""
        if not self.n:
            return None
        h = mix_one((key & _M) ^ self._salt)
        slot = mix_one(h ^ mix_one(int(self.pilots[(h >> 32) % self.nb]))) % self.n
        if int(self.marks[slot]) != h & 0xFFFFFFFF:
            return None
        return int(self.offsets[slot]), int(self.lengths[slot])

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the fingerprint agrees, offset, length) of each key."""
        if not self.n:
            none = np.zeros(len(keys), np.int64)
            return none > 0, none, none
        h = mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(self._salt))
        pilot = self.pilots[((h >> np.uint64(32)) % np.uint64(self.nb)).astype(np.int64)].astype(np.uint64)
        slot = (mix(h ^ mix(pilot)) % np.uint64(self.n)).astype(np.int64)
        return self.marks[slot] == (h & np.uint64(0xFFFFFFFF)), self.offsets[slot].astype(np.int64), self.lengths[slot].astype(np.int64)
