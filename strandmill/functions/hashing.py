"""The low word of 128-bit x64 MurmurHash3, over many byte strings of one length at once."""

from __future__ import annotations

import numpy as np

_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_N1, _N2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    """In place, as the rest: a block's numbers stay in a core's cache."""
    high = x >> np.uint64(64 - r)
    x <<= np.uint64(r)
    x |= high
    return x


def _mixed(word: np.ndarray, a: np.uint64, r: int, b: np.uint64) -> np.ndarray:
    x = _turn(word * a, r)
    x *= b
    return x


def _final(x: np.ndarray) -> np.ndarray:
    for factor in (_F1, _F2):
        x ^= x >> np.uint64(33)
        x *= factor
    x ^= x >> np.uint64(33)
    return x


def murmur_words(words: list[np.ndarray], length: int, seed: int = 0) -> np.ndarray:
    """Hashes of strings of length bytes given as little-endian 64-bit words, the last one padded with zeros."""
    n = len(words[0]) if words else 0
    h1 = np.full(n, seed, dtype=np.uint64)
    h2 = h1.copy()
    whole = length // 16
    for i in range(whole):
        h1 ^= _mixed(words[2 * i], _C1, 31, _C2)
        h1 = _turn(h1, 27)
        h1 += h2
        h1 *= np.uint64(5)
        h1 += _N1
        h2 ^= _mixed(words[2 * i + 1], _C2, 33, _C1)
        h2 = _turn(h2, 31)
        h2 += h1
        h2 *= np.uint64(5)
        h2 += _N2
    rest = length - 16 * whole
    if rest > 8:
        h2 ^= _mixed(words[2 * whole + 1], _C2, 33, _C1)
    if rest:
        h1 ^= _mixed(words[2 * whole], _C1, 31, _C2)
    h1 ^= np.uint64(length)
    h2 ^= np.uint64(length)
    h1 += h2
    h2 += h1
    h1, h2 = _final(h1), _final(h2)
    h1 += h2
    return h1


def murmur_bytes(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the rows of a matrix of bytes."""
    n, length = rows.shape
    padded = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    padded[:, :length] = rows
    words = padded.view("<u8")
    return murmur_words([np.ascontiguousarray(words[:, i]) for i in range(words.shape[1])] or [np.zeros(n, np.uint64)], length, seed)
