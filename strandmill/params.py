"""Parameters of sketches and filters, as frozen values that live on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from .errors import SketchError

U64 = (1 << 64) - 1
U32 = (1 << 32) - 1
MASH, SCALED, ALL = "mash", "scaled", "none"


def max_hash(scale: float | None) -> int:
    """The largest hash a scale lets in: the whole range over the whole number 1 / scale."""
    if scale is None:
        return 0
    parts = U64 if scale <= 0 else min(int(1.0 / scale), U64)
    return U64 // max(parts, 1)


def effective_scale(limit: int) -> float:
    return 1.0 / (float(U64) / float(limit))


def signed(h: int) -> int:
    """An unsigned 64-bit value as the BIGINT with the same bits."""
    return h - (1 << 64) if h >> 63 else h


def ordered(h: int) -> int:
    """The BIGINT that sorts like the unsigned value."""
    return h - (1 << 63)


@dataclass(frozen=True)
class SketchParams:
    """scheme: mash keeps the kmers_to_sketch smallest hashes, scaled those and all up to the scale's limit, none counts every k-mer."""

    scheme: str = MASH
    kmers_to_sketch: int = 1000
    final_size: int | None = None
    no_strict: bool = False
    kmer_length: int = 21
    hash_seed: int = 0
    scale: float | None = None

    def __post_init__(self):
        if self.scheme not in (MASH, SCALED, ALL):
            raise SketchError(f"{self.scheme} is not a sketch scheme")
        if not 1 <= self.kmer_length <= 255:
            raise SketchError("the k-mer length must lie between 1 and 255")
        if self.scheme == SCALED and self.scale is None:
            raise SketchError("a scaled sketch needs a scale")
        if self.final_size is None:
            object.__setattr__(self, "final_size", self.kmers_to_sketch)

    @property
    def k(self) -> int:
        return self.kmer_length

    @property
    def limit(self) -> int:
        return max_hash(self.scale) if self.scheme == SCALED else 0

    def hash_info(self) -> tuple[str, int, int, float | None]:
        """(hash, bits, seed, scale)."""
        if self.scheme == ALL:
            return "None", 0, 0, None
        return "MurmurHash3_x64_128", 64, self.hash_seed, self.scale if self.scheme == SCALED else None

    def expected_size(self) -> int:
        return {MASH: self.final_size, SCALED: self.kmers_to_sketch}.get(self.scheme, 4**self.kmer_length)

    def incompatible(self, other: SketchParams) -> tuple[str, object, object] | None:
        """What keeps two sketches from being compared, in order of checking; sizes and scales may differ."""
        a, b = self.hash_info(), other.hash_info()
        for what, x, y in (("k", self.k, other.k), ("hash type", a[0], b[0]), ("hash bits", a[1], b[1]), ("hash seed", a[2], b[2])):
            if x != y:
                return what, x, y
        return None

    def row(self) -> tuple:
        return self.scheme, self.kmers_to_sketch, self.final_size, self.no_strict, self.kmer_length, self.hash_seed, self.scale

    @classmethod
    def of(cls, row) -> SketchParams:
        d = row.asDict() if hasattr(row, "asDict") else dict(row)
        return cls(**d)


def common_params(all_params: list[SketchParams]) -> SketchParams:
    """Parameters of a collection: all must be compatible; the sizes are the largest."""
    if not all_params:
        raise SketchError("no sketches")
    first = all_params[0]
    for p in all_params[1:]:
        if bad := first.incompatible(p):
            raise SketchError(f"Sketch has {bad[0]} {bad[2]}, but the first one has {bad[1]}")
    return replace(first, kmers_to_sketch=max(p.kmers_to_sketch for p in all_params), final_size=max(p.final_size for p in all_params))


@dataclass(frozen=True)
class FilterParams:
    """filter_on: None follows the input, on for reads with qualities and off for plain sequences."""

    filter_on: bool | None = None
    abun_low: int | None = None
    abun_high: int | None = None
    err_filter: float = 0.0
    strand_filter: float = 0.0

    def resolved(self, fastq: bool) -> FilterParams:
        return replace(self, filter_on=fastq if self.filter_on is None else self.filter_on)

    def tightened(self, new: FilterParams, compat: bool = False) -> FilterParams:
        """Both at once: the stricter of each. compat: a missing new bound erases the old one as soon as the other is given."""
        low = max((x for x in (self.abun_low, new.abun_low) if x is not None), default=None)
        high = min((x for x in (self.abun_high, new.abun_high) if x is not None), default=None)
        if compat and (new.abun_low is None) != (new.abun_high is None):
            low, high = (None, high) if new.abun_low is None else (low, None)
        return FilterParams(self.filter_on if new.filter_on is None else new.filter_on, low, high, max(self.err_filter, new.err_filter), max(self.strand_filter, new.strand_filter))

    def to_map(self) -> dict[str, str]:
        """The text form that sketch files carry."""
        if not self.filter_on:
            return {}
        out = {}
        if self.strand_filter > 0:
            out["strandFilter"] = _number(self.strand_filter)
        if self.err_filter > 0:
            out["errFilter"] = _number(self.err_filter)
        if self.abun_low is not None:
            out["minCopies"] = str(self.abun_low)
        if self.abun_high is not None:
            out["maxCopies"] = str(self.abun_high)
        return out

    @classmethod
    def from_map(cls, m: dict[str, str] | None) -> FilterParams:
        m = m or {}
        try:
            whole = lambda k: int(m[k]) if k in m else None
            real = lambda k: float(m.get(k, 0.0))
            return cls(bool(m), whole("minCopies"), whole("maxCopies"), real("errFilter"), real("strandFilter"))
        except ValueError as x:
            raise SketchError(f"bad filter value: {x}") from x

    def row(self) -> tuple:
        return self.filter_on, self.abun_low, self.abun_high, self.err_filter, self.strand_filter

    @classmethod
    def of(cls, row) -> FilterParams:
        return cls(**(row.asDict() if hasattr(row, "asDict") else dict(row)))


def _number(x: float) -> str:
    return str(int(x)) if math.isfinite(x) and x == int(x) else repr(x)


SKETCH_PARAMS = "struct<scheme:string,kmers_to_sketch:bigint,final_size:bigint,no_strict:boolean,kmer_length:int,hash_seed:bigint,scale:double>"
FILTER_PARAMS = "struct<filter_on:boolean,abun_low:bigint,abun_high:bigint,err_filter:double,strand_filter:double>"
#: One row a sketch, and one row a hash of a sketch.
SKETCHES = f"sketch_id bigint, name string, seq_length bigint, num_valid_kmers bigint, comment string, filter_params {FILTER_PARAMS}, sketch_params {SKETCH_PARAMS}"
MINMERS = "sketch_id bigint, hash bigint, kmer string, count bigint, extra_count bigint, label binary"
