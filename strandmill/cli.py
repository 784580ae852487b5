"""Command line: sketch, dist, hist, info."""

from __future__ import annotations

import argparse
import json
import math
import os
import sys

from pyspark.sql import SparkSession

from . import api
from .errors import SketchError
from .params import ALL, MASH, SCALED, FilterParams, SketchParams
from .sources import formats, tables
from .sources.sequences import put


def _ranged(limit: float):
    def check(text: str) -> float:
        x = float(text)
        if not 0.0 <= x <= limit:
            raise argparse.ArgumentTypeError(f"{text} is not between 0 and {limit}")
        return x

    return check


def _whole(text: str) -> int:
    x = int(text)
    if x < 0:
        raise argparse.ArgumentTypeError(f"{text} is negative")
    return x


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandmill", description="Sketch, compare and describe sequence files")
    subs = p.add_subparsers(dest="command", required=True)
    for name in ("sketch", "dist", "hist", "info"):
        c = subs.add_parser(name)
        c.add_argument("inputs", nargs="+", help="sequence or sketch files; - for standard input")
        g = c.add_mutually_exclusive_group()
        g.add_argument("-f", "--filter", action="store_true", help="filter, whatever the format")
        g.add_argument("--no-filter", action="store_true", help="filter nothing")
        c.add_argument("--min-abun-filter", type=_whole)
        c.add_argument("--max-abun-filter", type=_whole)
        c.add_argument("--strand-filter", type=_ranged(1.0), default=0.1)
        c.add_argument("--err-filter", type=float, default=1.0, help="assumed error rate, percent")
        c.add_argument("-s", "--sketch-type", choices=(MASH, SCALED, ALL), default=None)
        c.add_argument("-k", "--kmer-length", type=_whole, default=None)
        c.add_argument("-n", "--n-hashes", type=_whole, default=None)
        c.add_argument("--scale", type=_ranged(1.0), default=None)
        c.add_argument("--seed", type=_whole, default=None)
        c.add_argument("--oversketch", type=_whole, default=None)
        c.add_argument("-N", "--no-strict", action="store_true")
        c.add_argument("-o", "--output", help="file to write")
        c.add_argument("-O", "--std-out", action="store_true", help="write to standard output")
        c.add_argument("--compat", action="store_true", help="only note filters of read sketches, as older files expect")
    s, d = subs.choices["sketch"], subs.choices["dist"]
    g = s.add_mutually_exclusive_group()
    g.add_argument("-b", "--binary-format", action="store_true", help=f"write {formats.NATIVE}")
    g.add_argument("-B", "--mash-binary-format", action="store_true", help=f"write {formats.MASHED}")
    g = d.add_mutually_exclusive_group()
    g.add_argument("-p", "--pairwise", action="store_true")
    g.add_argument("-q", "--queries", action="append", help="names, also several with commas")
    d.add_argument("-d", "--max-dist", type=_ranged(1.0), default=1.0)
    d.add_argument("--old-dist", action="store_true")
    return p


def filter_options(a: argparse.Namespace, k: int) -> FilterParams:
    """The error rate is a percentage of bases, so that of k-mers is k times as much, 100 % at most."""
    if not 0.0 <= a.err_filter <= 100.0 / k:
        raise SketchError(f"err-filter must lie between 0 and {100.0 / k}")
    on = True if a.filter else False if a.no_filter else None
    if on is None and (a.min_abun_filter is not None or a.max_abun_filter is not None):
        on = True
    return FilterParams(on, a.min_abun_filter, a.max_abun_filter, a.err_filter * k / 100.0, a.strand_filter)


def sketch_options(a: argparse.Namespace, on: bool | None) -> tuple[SketchParams, tuple[str, ...]]:
    """(parameters, those asked for by name)."""
    scheme = a.sketch_type or MASH
    wrong = {
        MASH: [("--scale", a.scale)],
        SCALED: [("--oversketch", a.oversketch), ("--no-strict", a.no_strict or None)],
        ALL: [("--n-hashes", a.n_hashes), ("--scale", a.scale), ("--seed", a.seed), ("--oversketch", a.oversketch), ("--no-strict", a.no_strict or None)],
    }[scheme]
    for name, value in wrong:
        if value is not None:
            raise SketchError(f"{name} doesn't go with {scheme} sketches")
    k = a.kmer_length if a.kmer_length is not None else 4 if scheme == ALL else 21
    n = a.n_hashes if a.n_hashes is not None else 1000
    over = a.oversketch if a.oversketch is not None else 200
    if scheme == MASH:
        params = SketchParams(MASH, n if on is False else n * over, n, a.no_strict, k, a.seed or 0)
    elif scheme == SCALED:
        params = SketchParams(SCALED, n, n, True, k, a.seed or 0, a.scale if a.scale is not None else 0.001)
    else:
        params = SketchParams(ALL, 4**k, 4**k, True, k)
    names = {"scheme": a.sketch_type, "kmer_length": a.kmer_length, "final_size": a.n_hashes, "scale": a.scale, "hash_seed": a.seed, "kmers_to_sketch": a.oversketch}
    return params, tuple(x for x, v in names.items() if v is not None)


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        on = True if a.filter else False if a.no_filter else None
        params, given = sketch_options(a, on)
        chosen = filter_options(a, params.k)
        spark = spark or SparkSession.builder.appName("strandmill").getOrCreate()
        for p in a.inputs:
            if p != "-" and "://" not in p and not os.path.exists(p):
                raise SketchError(f"{p}: no such file")
        return {"sketch": _sketch, "dist": _dist, "hist": _hist, "info": _info}[a.command](spark, a, params, given, chosen)
    except SketchError as x:
        print(f"error: {x}", file=sys.stderr)
        return 1


def _sketch(spark, a, params, given, chosen) -> int:
    ending = formats.NATIVE if a.binary_format else formats.MASHED if a.mash_binary_format else formats.TEXT[0]
    if a.output or a.std_out:
        out = api.load(spark, a.inputs, params, chosen, given, compat=a.compat)
        tables.write_sketches(out.nested(), a.output, ending)
        return 0
    for p in a.inputs:
        if formats.is_sketch(p):
            raise SketchError(f"{p} is a sketch already")
    made = api.sketch_files(spark, a.inputs, params, chosen)  # one job for all files
    for p, s in zip(a.inputs, made, strict=True):
        put(formats.write_any("x" + ending, [s.data]), p + ending)
    return 0


def _loaded(spark, a, params, given, chosen) -> api.Collection:
    return api.load(spark, a.inputs, params, chosen, given, compat=a.compat)


def _dist(spark, a, params, given, chosen) -> int:
    c = _loaded(spark, a, params, given, chosen)
    names = [n for q in a.queries or [] for n in q.split(",")] or None
    rows = c.distances(names=names, pairwise=a.pairwise, max_dist=a.max_dist, old=a.old_dist).collect()
    place = {n: i for i, n in reversed(list(enumerate(c.names())))}
    fields = ("containment", "jaccard", "mashDistance", "commonHashes", "totalHashes", "query", "reference")
    rows = sorted(({f: r[f] for f in fields} for r in rows), key=lambda r: (place[r["reference"]], place[r["query"]]))
    put(json.dumps([{f: None if isinstance(v, float) and math.isnan(v) else v for f, v in r.items()} for r in rows]).encode(), a.output, ".json" if a.output else "")
    return 0


def _hist(spark, a, params, given, chosen) -> int:
    """Of sketches that share a name the last one shows."""
    rows = _loaded(spark, a, params, given, chosen).hist().orderBy("sketch_id").collect()
    put(json.dumps({r["name"]: list(r["hist"]) for r in rows}).encode(), a.output, ".json" if a.output else "")
    return 0


def _info(spark, a, params, given, chosen) -> int:
    out = []
    for r in _loaded(spark, a, params, given, chosen).info().orderBy("sketch_id").collect():
        depth = "NaN" if r["depth"] is None else f"{r['depth']:.2f}"
        gc = "NaN" if r["gc"] is None or math.isnan(r["gc"]) else f"{r['gc']:.2f}"
        out += [r["name"], f"  Length: {r['seq_length']} bp", f"  Genome estimate: {r['cardinality']} bp", f"  Depth estimate: {depth}x", f"  GC estimate: {gc}%"]
    put(("\n".join(out) + "\n").encode(), a.output)
    return 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
