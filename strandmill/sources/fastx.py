"""The format "fastx" for spark.read: FASTA and FASTQ files by a Python data source.

    register(spark)
    spark.read.format("fastx").load("genomes/")
    spark.read.format("fastx").option("paths", json.dumps(["a.fa", "reads.fq.gz"])).load()

Planning lists folders and opens no file; small files share a partition, and large plain ones are split. A task
tells a file's format and compression by its first bytes, and finds the first record of its part itself, so a FASTQ
record has its quality wherever the file is cut. Conditions on sample and ordinal pick files before any is
opened, one on format before more than its beginning is read. Files must be reached by every worker's Python (a mounted
folder, or a store that pyarrow opens); read_sequences() goes through Spark's own readers.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import json
import lzma
import posixpath
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..errors import SketchError
from .sequences import _MARKS, FASTA, SEQUENCES, _batches, parse

#: Bytes of a partition, and what a file counts besides its size.
PART, EACH = 32 << 20, 64 << 10
_OPENERS = {b"\x1f\x8b": gzip.open, b"BZ": bz2.open, b"\xfd7": lzma.open}


@dataclass(frozen=True)
class Piece:
    """Records of a file that begin from start up to end, or all of a file that is compressed, if start is 0."""

    path: str
    sample: str
    ordinal: int
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def store_of(path: str):
    """(file system, path within)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of all files below the folder or that match the pattern, in order. Hidden files stay out."""
    from pyarrow import fs

    store, inner = store_of(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.Directory:
        found = [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
        shown = [f for f in found if not any(p[0] in "._" for p in f.path[len(inner.rstrip("/")) + 1 :].split("/"))]
    else:
        base = inner
        while any(c in base for c in "*?["):
            base = posixpath.dirname(base)
        found = store.get_file_info(fs.FileSelector(base or ".", recursive=True, allow_not_found=True))
        depth = inner.count("/")
        shown = [f for f in found if f.type == fs.FileType.File and f.path.count("/") == depth and fnmatch.fnmatchcase(f.path, inner)]
    if not shown:
        raise SketchError(f"{path}: no such file")
    return sorted((head + f.path, f.size) for f in shown)


class _Lines:
    """Lines of a stream with the places that they begin at."""

    def __init__(self, stream, at: int):
        self.stream, self.at = stream, at

    def next(self) -> tuple[int, bytes]:
        at, line = self.at, self.stream.readline()
        self.at += len(line)
        return at, line


def _whole_lines(f, start: int) -> _Lines:
    """From the first line that begins at start or later."""
    f.seek(max(0, start - 1))
    lines = _Lines(f, max(0, start - 1))
    if start:
        lines.next()
    return lines


def _fasta(f, start: int, end: int):
    lines = _whole_lines(f, start)
    at, line = lines.next()
    while line and line[:1] != b">":
        at, line = lines.next()
    while line and at < end:
        begun, name, parts = at, line[1:].strip(), []
        at, line = lines.next()
        while line and line[:1] != b">":
            parts.append(b"".join(line.split()))
            at, line = lines.next()
        yield begun, name.decode(), b"".join(parts).decode(), None


def _fastq(f, start: int, end: int):
    lines = _whole_lines(f, start)
    held = [x for x in (lines.next() for _ in range(12)) if x[1]]
    if start:  # a record is four lines; the first that looks like one begins it
        like = lambda a, b, c, d: a[:1] == b"@" and c[:1] == b"+" and len(b.strip()) == len(d.strip())
        at = next((i for i in range(len(held) - 3) if like(*[x[1] for x in held[i : i + 4]])), None)
        if at is None:  # it began before
            return
        held = held[at:]
    while True:
        while len(held) < 4:
            x = lines.next()
            if not x[1]:
                break
            held.append(x)
        while held and not held[0][1].strip():
            held.pop(0)
            held += [x] if (x := lines.next())[1] else []
        if not held or held[0][0] >= end:
            return
        (begun, name), (_, seq), (_, plus), (_, qual) = (*held[:4], *[(0, b"")] * 4)[:4]
        if name[:1] != b"@" or plus[:1] != b"+" or len(seq.strip()) != len(qual.strip()):
            raise SketchError("a FASTQ record is malformed")
        held = held[4:]
        yield begun, name[1:].strip().decode(), seq.strip().decode(), qual.strip().decode()


def records(piece: Piece, formats: set[str] | None = None):
    """(sample, ordinal, record_no, id, seq, qual, format) of a piece; record_no is the record's place, or its number in a
    compressed file."""
    store, inner = store_of(piece.path)
    with io.BufferedReader(store.open_input_file(inner), 1 << 20) as f:
        head = f.read(2)
        if head in _OPENERS:
            if piece.start == 0:
                f.seek(0)
                for no, (name, seq, qual, kind) in enumerate(parse(_OPENERS[head](f))):
                    if formats is not None and kind not in formats:
                        return
                    yield piece.sample, piece.ordinal, no, name, seq, qual, kind
            return
        f.seek(0)
        mark = b""
        while not mark.strip():
            mark = f.read(1)
            if not mark:
                raise SketchError(f"{piece.path} holds no sequences")
        kind = _MARKS.get(mark.decode("latin-1"))
        if kind is None:
            raise SketchError(f"{piece.path} is neither FASTA nor FASTQ")
        if formats is None or kind in formats:
            for begun, *record in (_fasta if kind == FASTA else _fastq)(f, piece.start, piece.end):
                yield piece.sample, piece.ordinal, begun, *record, kind


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]] if "path" in options else []
        if not paths:
            raise SketchError("no files")
        self.paths, self.part = paths, int(options.get("part", PART))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, EqualTo | In) else ""
            if name not in ("sample", "ordinal", "format"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self):
        out, held, size, seen = [], [], 0, set()
        for i, p in enumerate(self.paths):
            here = listed(p)
            for path, n in here:
                sample = p if len(here) == 1 else path
                if path in seen or sample not in self.wanted.get("sample", {sample}) or i not in self.wanted.get("ordinal", {i}):
                    continue
                seen.add(path)
                step = self.part if n > self.part and not path.endswith((".gz", ".bz2", ".xz")) else max(1, n)
                for start in range(0, max(1, n), step):
                    end = min(start + step, max(1, n))
                    if held and size + end - start + EACH > self.part:
                        out.append(Pieces(held))
                        held, size = [], 0
                    held.append(Piece(path, sample, i, start, end))
                    size += end - start + EACH
        return [*out, Pieces(held)]

    def read(self, partition: Pieces):
        # records of many small files make a batch
        yield from _batches(r for p in partition.pieces for r in records(p, self.wanted.get("format")))


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SEQUENCES

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets its conditions reach it."""
    spark.dataSource.register(FastxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
