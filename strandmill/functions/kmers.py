"""k-mers of sequences: normalisation, canonical forms, hashes, and the Arrow stage that makes them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import murmur_words

BASES = np.frombuffer(b"ACGT", dtype=np.uint8)
#: 2-bit code of a base; 4 for anything else.
_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _c in _pair:
        _CODE[ord(_c)] = _i
#: ASCII of four bases as one little-endian word, by their 8 bits.
_FOUR = np.array([int.from_bytes(bytes(BASES[[b >> 6 & 3, b >> 4 & 3, b >> 2 & 3, b & 3]]), "little") for b in range(256)], dtype=np.uint64)
SKIPPED = b" \t\r\n\x0b\x0c"
#: The four 2-bit codes of a packed byte.
_FOUR_CODES = np.array([[b >> 6 & 3, b >> 4 & 3, b >> 2 & 3, b & 3] for b in range(256)], dtype=np.uint8)


def normalise(seq: Column) -> Column:
    """Upper case, U as T, gaps as -, no white space, everything else N."""
    clean = F.regexp_replace(F.translate(F.upper(seq), "U.~", "T--"), r"\s", "")
    return F.regexp_replace(clean, "[^ACGTN-]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def bases_of_text(text: Column) -> Column:
    """Any text as a sequence: four bases for each of its UTF-8 bytes, packed."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def letters(packed: Column) -> Column:
    """The text of packed bases."""
    out = F.translate(F.hex(packed), "0123456789ABCDEF", "abcdefghijklmnop")
    for i, letter in enumerate("abcdefghijklmnop"):
        out = F.replace(out, F.lit(letter), F.lit("ACGT"[i // 4] + "ACGT"[i % 4]))
    return out


#: The letters of the four bases of a byte, as a little-endian word.
_LETTERS = BASES[_FOUR_CODES].copy().view("<u4")[:, 0]


def lettered(packed: bytes) -> bytes:
    """letters() of one value, for a task's own use: it makes a text of gigabytes at the speed of memory."""
    return _LETTERS[np.frombuffer(packed, np.uint8)].tobytes()


def letters_of(packed: pa.Array) -> pa.Array:
    """letters() of binary values, for a task's own use."""
    texts = [None if x is None else lettered(x) for x in packed.to_pylist()]
    return pa.array(texts, pa.binary()).cast(pa.string())


#: The codes of the four bases of a byte, as a little-endian word.
_CODES = _FOUR_CODES.copy().view("<u4")[:, 0]


def joined_codes(records: list) -> np.ndarray:
    """2-bit codes of records of one kind, texts or packed bases (bytes), with a 4 between any two: no k-mer crosses from one
    into the next."""
    if records and isinstance(records[0], bytes):
        flat = _CODES[np.frombuffer(b"".join(records), dtype=np.uint8)].view(np.uint8)
        return np.insert(flat, 4 * np.cumsum([len(r) for r in records])[:-1], 4) if len(records) > 1 else flat
    return codes(b">".join([r.encode() for r in records]))


def codes(seq: bytes) -> np.ndarray:
    """2-bit codes without white space; 4 marks what no k-mer may hold."""
    raw = np.frombuffer(seq.translate(None, SKIPPED), dtype=np.uint8)
    return _CODE[raw]


def blocks(code: np.ndarray, k: int, size: int = 1 << 15):
    """The codes in overlapping blocks that hold every window once, small enough for a core's cache."""
    for at in range(0, max(0, len(code) - k + 1), size):
        yield code[at : at + size + k - 1]


def clean(code: np.ndarray, k: int) -> np.ndarray | slice:
    """The windows of k codes without a gap: all of them as a slice, else their places."""
    n = len(code) - k + 1
    gaps = np.nonzero(code > 3)[0]
    if not len(gaps):
        return slice(0, n)
    if len(gaps) > 64:
        bad = np.concatenate([[0], np.cumsum(code > 3)])
        return np.nonzero(bad[k:] == bad[:-k])[0]
    ok = np.ones(n, bool)
    for at in gaps.tolist():
        ok[max(0, at - k + 1) : at + 1] = False
    return np.nonzero(ok)[0]


def plain(code: np.ndarray, k: int) -> np.ndarray:
    """The k-mer of every window without a gap, as a 2-bit number in the narrowest type; k up to 32."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if 2 * k <= bits)
    part, out, width, done = (code & 3).astype(kind), None, 1, 0
    while True:  # widths double; the binary digits of k put them together
        if k & width:
            out = part[:n] if out is None else (out << kind(2 * width)) | part[done : done + n]
            done += width
        if done == k:
            return out[clean(code, k)]
        part = (part[: len(part) - width] << kind(2 * width)) | part[width:]
        width *= 2


def packed(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, k-mer, its reverse complement) of every window without a gap, as 2-bit numbers that sort like the text; k up to 32."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    where = np.nonzero(bad[k:] == bad[:-k])[0]
    one = (code & 3).astype(np.uint64)
    # widths double; the binary digits of k put them together
    fwd, rev, width = one, np.uint64(3) - one, 1
    out_f = out_r = None
    done, left = 0, k
    while left:
        if left & 1:
            f, r = fwd[done:], rev[done:]
            if out_f is None:
                out_f, out_r = f, r
            else:
                m = min(len(out_f), len(f))
                out_f = (out_f[:m] << np.uint64(2 * width)) | f[:m]
                out_r = out_r[:m] | (r[:m] << np.uint64(2 * done))
            done += width
        left >>= 1
        if left:
            m = len(fwd) - width
            if m <= 0:
                return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            fwd, rev = (fwd[:m] << np.uint64(2 * width)) | fwd[width:], rev[:m] | (rev[width:] << np.uint64(2 * width))
            width *= 2
    return where, out_f[:n][where], out_r[:n][where]


def reversed_packed(value: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers."""
    x = ~value.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        m = np.uint64(mask)
        x = ((x >> np.uint64(shift)) & m) | ((x & m) << np.uint64(shift))
    return x.byteswap() >> np.uint64(64 - 2 * k)


def text_of_packed(value: Column, k: int) -> Column:
    """The text of a packed k-mer, by four bases at a time."""
    out = []
    for at in range(0, k, 4):
        n = min(4, k - at)
        names = ["".join("ACGT"[i >> 2 * (n - 1 - j) & 3] for j in range(n)) for i in range(4**n)]
        part = F.shiftrightunsigned(value, 2 * (k - at - n)).bitwiseAND(F.lit(4**n - 1)).cast("int")
        out.append(F.element_at(F.lit(names), part + 1))
    return F.concat(*out)


def unpacked(value: np.ndarray, k: int) -> list[str]:
    """The text of packed k-mers."""
    if not len(value):
        return []
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    rows = BASES[((value[:, None] >> shifts[None]) & np.uint64(3)).astype(np.int64)]
    return np.ascontiguousarray(rows).view(f"S{k}")[:, 0].astype(str).tolist()


def text_words(value: np.ndarray, k: int) -> list[np.ndarray]:
    """The text of packed k-mers as little-endian words of eight bases, the last one padded with zeros."""
    words = []
    for at in range(0, k, 8):
        word = np.zeros(len(value), dtype=np.uint64)
        for part in (0, 4):
            first, n = at + part, min(4, k - at - part)
            if n > 0:
                four = (value >> np.uint64(2 * (k - first - n))) & np.uint64((1 << 2 * n) - 1)
                text = _FOUR[(four << np.uint64(2 * (4 - n))).astype(np.int64)] & np.uint64((1 << 8 * n) - 1)
                word |= text << np.uint64(8 * part)
        words.append(word)
    return words


def packed_hash(value: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Murmur hash of packed k-mers' text."""
    return murmur_words(text_words(value, k), k, seed)


def canonical(code: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, object]:
    """(hash, 1 where the reverse complement is the canonical one, a function from indices to k-mer texts) of every window.

    A palindrome counts as reversed."""
    if k <= 32:
        words, flag = canonical_words(code, k)
        return murmur_words(words, k, seed), flag.astype(np.int64), lambda at: _spelled([w[at] for w in words], k)
    where, fwd, rev = packed_words(code, k)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lambda at: []
    # the first word in which they differ decides
    flag = np.ones(len(where), bool)
    for f, r in zip(reversed(fwd), reversed(rev), strict=True):
        flag = np.where(f == r, flag, f > r)
    value = [np.where(flag, r, f) for f, r in zip(fwd, rev, strict=True)]
    sizes = _sizes(k)

    def text(at) -> list[str]:
        parts = [unpacked(v[at], n) for v, n in zip(value, sizes, strict=True)]
        return ["".join(p) for p in zip(*parts, strict=True)]

    return packed_words_hash(value, k, seed), flag.astype(np.int64), text


def canonical_words(code: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the smaller of the two texts of every window without a gap, as little-endian words of eight bases, the last one padded
    with zeros; whether it is the reverse complement's). Eight letters at any place are read as one number."""
    n = len(code) - k + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * -(-k // 8), np.zeros(0, bool)
    size = len(code) + 16
    there, back = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    np.take(BASES, code & 3, out=there[8:-8])
    np.take(BASES[::-1], (code & 3)[::-1], out=back[8:-8])
    # at i the eight letters from i - 8 on, and those of the other strand that end before place i of this one
    fwd = np.ascontiguousarray(np.ndarray(size - 7, "<u8", there, 0, (1,)))
    rev = np.ascontiguousarray(np.ndarray(size - 7, "<u8", back, 0, (1,))[::-1])
    ok, words = clean(code, k), []
    flag = same = None
    for at in range(0, k, 8):
        f, r = fwd[8 + at :][:n][ok], rev[k - at :][:n][ok]
        if k - at < 8:
            keep = np.uint64((1 << 8 * (k - at)) - 1)
            f, r = f & keep, r & keep
        # the first word in which they differ decides; a palindrome counts as reversed
        if flag is None:
            a, b = f.byteswap(), r.byteswap()
            flag = a >= b
            same = np.nonzero(a == b)[0]
        elif len(same):
            a, b = f[same].byteswap(), r[same].byteswap()
            flag[same] = a >= b
            same = same[a == b]
        words.append((f, r))
    return [np.where(flag, r, f) for f, r in words], flag


def _spelled(words: list[np.ndarray], k: int) -> list[str]:
    """The texts of k-mers from their words."""
    if not len(words[0]):
        return []
    rows = np.stack(words, axis=1).view(np.uint8)[:, :k]
    return np.ascontiguousarray(rows).view(f"S{k}")[:, 0].astype(str).tolist()


def _sizes(k: int) -> list[int]:
    """Bases in each word of a packed k-mer: 32, the rest in the last one."""
    return [32] * (k // 32) + [k % 32] * bool(k % 32)


def packed_words(code: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(start, words of the k-mer, words of its reverse complement) of every window without a gap: 32 bases a word, which come
    from one rolling pass for whole words and one for the last; no window has a row of bases of its own."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), [], []
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    where = np.nonzero(bad[k:] == bad[:-k])[0]
    clean = code & 3
    sizes = _sizes(k)
    rolled = {m: packed(clean, m)[1:] for m in set(sizes)}
    fwd, rev = [], []
    for i, m in enumerate(sizes):
        fwd.append(rolled[m][0][where + 32 * i])
        rev.append(rolled[m][1][where + k - 32 * i - m])
    return where, fwd, rev


def packed_words_hash(value: list[np.ndarray], k: int, seed: int) -> np.ndarray:
    """Murmur hash of the text of k-mers packed 32 bases a word."""
    return murmur_words([w for v, n in zip(value, _sizes(k), strict=True) for w in text_words(v, n)], k, seed)
