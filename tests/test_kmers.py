import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import hashing, kmers
from strandmill.operators import sketching
from strandmill.params import MASH, SCALED, SketchParams

RC = str.maketrans("ACGT", "TGCA")

#: MurmurHash3 x64 128, low word.
HASHES = {
    (0, "ATGCTAGCTACGTAACGTCGC"): 933085113509804,
    (0, "CAGTCGATCGATCGTAGCTGA"): 8582128962097342,
    (0, "TAATTTATACGGGCCTATTAA"): 196329111101504065,
    (0, "AAGGCCTAACTTAATAGGCCC"): 256930375650047524,
    (42, "cc"): 11640398043535405961,
    (42, "ca"): 14186609578245470552,
    (42, "ac"): 16979344014946734797,
}


@pytest.mark.parametrize(("key", "want"), HASHES.items())
def test_murmur(key, want):
    seed, text = key
    assert int(hashing.murmur_bytes(np.frombuffer(text.encode(), np.uint8)[None], seed)[0]) == want


def naive(seq, k):
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            r = w[::-1].translate(RC)
            out.append((min(w, r), int(w >= r)))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8, 15, 16, 17, 21, 24, 31, 32, 33, 40, 51, 64, 65, 100])
def test_canonical_against_slices(k):
    rng = random.Random(k)
    for _ in range(25):
        seq = "".join(rng.choice("ACGTACGTACGTN") if rng.random() < 0.97 else "N" for _ in range(rng.randint(0, 160)))
        h, flag, text = kmers.canonical(kmers.codes(seq.encode()), k, 7)
        got = list(zip(text(np.arange(len(h))), flag.tolist(), strict=True))
        want = naive(seq, k)
        assert got == want
        if want:
            rows = np.array([list(w.encode()) for w, _ in want], dtype=np.uint8)
            assert h.tolist() == hashing.murmur_bytes(rows, 7).tolist()


def test_case_uracil_and_white_space():
    a = kmers.canonical(kmers.codes(b"acgu\nACG\tTTR ACG"), 4, 0)[0]
    b = kmers.canonical(kmers.codes(b"ACGTACGTTRACG"), 4, 0)[0]
    assert a.tolist() == b.tolist()


def test_columns(spark):
    row = spark.createDataFrame([("ac gu.~rN\n", "aé", None)], "s string, t string, n string").select(
        kmers.normalise(F.col("s")).alias("s"), kmers.reverse_complement(F.lit("AACGN")).alias("r"), kmers.letters(kmers.bases_of_text(F.col("t"))).alias("t"), kmers.letters(kmers.bases_of_text(F.col("n"))).alias("n")
    ).first()
    want = "".join("ACGT"[d // 4] + "ACGT"[d % 4] for b in "aé".encode() for d in (b >> 4, b & 15))
    assert tuple(row) == ("ACGT--NN", "NCGTT", want, "")


def test_blocks_hold_every_window_once():
    rng = random.Random(2)
    code = kmers.codes("".join(rng.choice("ACGTN") for _ in range(500)).encode())
    for k in (1, 7, 33, 51):
        for size in (1, 10, 64, 499, 1000):
            got = np.concatenate([kmers.canonical(b, k, 0)[0] for b in kmers.blocks(code, k, size)])
            assert got.tolist() == kmers.canonical(code, k, 0)[0].tolist()
    assert list(kmers.blocks(code[:3], 4)) == []


def test_packed_bases_are_the_same_sequence(spark):
    """Binary sequences against their letters, through sketches and totals."""
    from strandmill.operators import sketching
    from strandmill.params import ALL, MASH, SketchParams

    rng = random.Random(6)
    rows = [("ab"[i % 2], bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 6, 40])))) for i in range(60)] + [("a", None)]
    packed = spark.createDataFrame(rows, "sample string, seq binary")
    text = packed.withColumn("seq", kmers.letters(F.col("seq")))
    for p in (SketchParams(MASH, 50, 50, True), SketchParams(ALL, kmer_length=4), SketchParams(ALL, kmer_length=11)):
        got, want = (sorted(map(tuple, sketching.minmers(d, p).collect())) for d in (packed, text))
        assert got == want and got
        assert sorted(map(tuple, sketching.totals(packed, p).collect())) == sorted(map(tuple, sketching.totals(text, p).collect()))


def test_reversed_packed_and_texts(spark):
    rng = np.random.default_rng(1)
    for k in (1, 3, 4, 8, 21, 31, 32):
        code = rng.integers(0, 4, 200).astype(np.uint8)
        _, f, r = kmers.packed(code, k)
        assert (kmers.reversed_packed(f, k) == r).all()
        rows = [(int(x),) for x in f.view(np.int64)]
        got = [x[0] for x in spark.createDataFrame(rows, "v bigint").select(kmers.text_of_packed(F.col("v"), k)).collect()]
        assert got == kmers.unpacked(f, k)


@pytest.mark.parametrize("k", [1, 4, 5, 8, 9, 16, 17, 21, 32])
def test_plain_numbers_are_narrow(k):
    rng = np.random.default_rng(k)
    for gaps in (0, 3, 150):
        code = rng.integers(0, 4, 600).astype(np.uint8)
        code[rng.integers(0, 600, gaps)] = 4
        got = kmers.plain(code, k)
        assert got.itemsize <= max(1, k // 2) and (got == kmers.packed(code, k)[1]).all()


@pytest.mark.parametrize("scheme", [MASH, SCALED])
def test_a_block_is_never_sorted_whole(scheme, monkeypatch):
    """Of a block only as many hashes as a sketch may keep are sorted, while it isn't full, too."""
    rng = np.random.default_rng(3)
    seq = "".join(rng.choice(list("ACGT"), 5000)) * 2
    p = SketchParams(scheme, 100, 100, True, scale=0.001 if scheme == SCALED else None)
    hashes, flag, text = kmers.canonical(kmers.codes(seq.encode()), p.kmer_length, p.hash_seed)
    names = np.array(text(np.arange(len(hashes))))
    new, at, n = np.unique(hashes, return_index=True, return_counts=True)
    most, sort = [0], np.sort
    monkeypatch.setattr(np, "unique", None)
    monkeypatch.setattr(np, "sort", lambda x: most.append(len(x)) or sort(x))
    c = sketching._Counter(p)
    c.add(seq)
    c.flush()
    keep = max(100, int((new <= np.uint64(p.limit)).sum()) if scheme == SCALED else 0)
    assert c.hash.tolist() == new[:keep].tolist() and c.count.tolist() == n[:keep].tolist() and c.kmer == names[at[:keep]].tolist()
    assert 0 < max(most) <= 400
