"""FASTA and FASTQ files, plain or compressed, as rows: sample, ordinal, record_no, id, seq, qual, format.

Files are scanned as text whose separator is the line end before a record's mark, so Spark splits
plain (and bzip2) files between records and streams gzip ones, whatever their size; a record is
what must fit in memory. Only what Spark has no codec for (xz, or compressed data under another
name) is read whole.
"""

from __future__ import annotations

import atexit
import bz2
import gzip
import io
import lzma
import os
import shutil
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SketchError
from ..functions.kmers import bases_of_text

SEQUENCES = "sample string, ordinal int, record_no bigint, id string, seq string, qual string, format string"
FASTA, FASTQ = "fasta", "fastq"
_MARKS = {">": FASTA, "@": FASTQ}
_MAGIC = {b"\x1f\x8b": gzip.open, b"BZ": bz2.open, b"\xfd7": lzma.open}
_ROWS = 512
_BYTES = 2 << 20
_FEW = 32


def opened(data: bytes):
    """A stream of the plain bytes."""
    raw = io.BytesIO(data)
    return _MAGIC[data[:2]](raw) if data[:2] in _MAGIC else raw


def parse(stream):
    """(id, seq, qual or None, format) of each record of a stream of bytes."""
    line = stream.readline()
    while line and not line.strip():
        line = stream.readline()
    if not line:
        raise SketchError("the file holds no sequences")
    if line[:1] == b">":
        name, parts = line[1:].strip(), []
        for line in stream:
            if line[:1] == b">":
                yield name.decode(), b"".join(parts).decode(), None, FASTA
                name, parts = line[1:].strip(), []
            else:
                parts.append(line.strip())
        yield name.decode(), b"".join(parts).decode(), None, FASTA
    elif line[:1] == b"@":
        while line:
            if not line.strip():
                line = stream.readline()
                continue
            seq, plus, qual = stream.readline().strip(), stream.readline(), stream.readline().strip()
            if line[:1] != b"@" or plus[:1] != b"+" or len(qual) != len(seq):
                raise SketchError("a FASTQ record is malformed")
            yield line[1:].strip().decode(), seq.decode(), qual.decode(), FASTQ
            line = stream.readline()
    else:
        raise SketchError("neither FASTA nor FASTQ")


def few(batches):
    """The same batches in pieces of few rows, so that what Python makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, _FEW):
            yield b.slice(at, _FEW)


def _batches(records):
    """Record batches of (sample, ordinal, record_no, id, seq, qual, format), of bounded size but for single long records."""

    def made():
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SEQUENCES.split(", ")])

    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += len(r[4])
        if len(rows) >= _ROWS or size >= _BYTES:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


def _whole(found: dict[str, tuple[int, str]]):
    """Records of files that come whole: path, content."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ordinal, sample = found[path]
                yield from _batches((sample, ordinal, no, *r) for no, r in enumerate(parse(opened(data))))

    return run


def _address(uri: str) -> str:
    """A local file's address has one slash or three."""
    return uri.replace("file:///", "file:/", 1) if uri.startswith("file:///") else uri


def _fasta(chunk: str) -> tuple[str, str]:
    name, _, rest = chunk.partition("\n")
    return name.strip(), "".join(rest.split())


def _split(kind: str, found: dict[str, tuple[int, str]]):
    """Records of texts cut before each mark: path, start and length of the split, size of the file, text."""

    def records(batches):
        at = None  # the split
        late = None  # a FASTQ record that waits for its quality, which began with the mark
        no, ends = 0, False
        for b in few(batches):
            for path, start, length, size, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                first = at != (path, start)
                if first:
                    if late is not None:
                        yield unquoted(late, ends)
                    at, late, no, ends = (path, start), None, 0, start + length >= size
                    ordinal, sample = found[_address(path)]
                    if not start:
                        text = text.lstrip()
                        if not text:  # the separator after blank lines
                            at = None
                            continue
                        text = text[1:] if text[0] in _MARKS else text
                head = (sample, ordinal, start + no)
                if kind == FASTA:
                    name, seq = _fasta(text)
                    yield *head, name, seq, None, FASTA
                    no += 1
                    continue
                lines = text.rstrip().split("\n") if late is None else [text]
                if late is not None:
                    *record, seq = late
                    qual = "@" + text.strip()
                    if len(qual) != len(seq):
                        raise SketchError("a FASTQ record is malformed")
                    late = None
                    yield *record, seq, qual, FASTQ
                elif len(lines) >= 2 and (len(lines) > 2 and lines[2][:1] == "+"):
                    name, seq = lines[0].strip(), lines[1].strip()
                    if len(lines) == 3 and seq:
                        late = (*head, name, seq)
                    else:
                        qual = lines[3].strip() if len(lines) > 3 else ""
                        if len(qual) != len(seq) or any(x.strip() for x in lines[4:]):
                            raise SketchError("a FASTQ record is malformed")
                        yield *head, name, seq, qual, FASTQ
                    no += 1
                elif not (first and start and len(lines) == 1):  # else the rest of a record that the split before has
                    raise SketchError("a FASTQ record is malformed")
        if late is not None:
            yield unquoted(late, ends)

    def unquoted(late, ends):
        """A record whose quality lies in the next split."""
        if ends:
            raise SketchError("a FASTQ record is malformed")
        return *late, None, FASTQ

    return lambda batches: _batches(records(batches))


def files_at(spark: SparkSession, path: str) -> list:
    """(file system, path) of the file, or of all files of the folder or pattern; full paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # a file's own name goes before a pattern that it may look like
    here = [fs.getFileStatus(at)] if fs.exists(at) else [*(fs.globStatus(at) or [])]
    out = []
    for s in here:
        inside = [x for x in fs.listStatus(s.getPath()) if x.isFile() and x.getPath().getName()[0] not in "._"] if s.isDirectory() else [s]
        out += [(fs, x.getPath()) for x in inside]
    if not out:
        raise SketchError(f"{path}: no such file")
    return out


def _listed(spark: SparkSession, paths: list[str]) -> tuple[dict[str, tuple[int, str]], dict[str, tuple[str, str]]]:
    """Of each file, by its full path: (place among paths, sample name), and (the way to read it, its address as Spark's file
    metadata show it). A path that stands for one file names its sample; of others the files do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found, kinds = {}, {}
    for i, p in enumerate(paths):
        here = files_at(spark, spooled() if p == "-" else p)
        for fs, f in here:
            full = f.toString()
            if full not in found:
                kind = _kind(jvm, fs, f, codecs.getCodec(f))
                if kind is None:  # tasks without rows leave such files in a folder
                    if len(here) == 1:
                        raise SketchError(f"{full} holds no sequences")
                    continue
                found[full] = (i, p if len(here) == 1 else full)
                kinds[full] = (kind, _address(f.toUri().toString()))
    return found, kinds


def _kind(jvm, fs, path, codec) -> str | None:
    """The format of a file by its first sign, or "" where it must be read whole; None if nothing is in it."""
    raw = fs.open(path)
    reader = jvm.java.io.InputStreamReader(raw if codec is None else codec.createInputStream(raw), "ISO-8859-1")
    try:
        c = reader.read()
        while c in (9, 10, 11, 12, 13, 32):
            c = reader.read()
        if c < 0:
            return None
        if chr(c) in _MARKS:
            return _MARKS[chr(c)]
        if bytes([c, max(0, reader.read()) & 255]) in _MAGIC:
            return ""
        raise SketchError(f"{path.toString()} is neither FASTA nor FASTQ")
    finally:
        reader.close()


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All records of the files; ordinal is a file's place in paths, and record_no ascends within a file. A FASTQ record's
    quality is null where a split of its file cuts it off."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise SketchError("no files")
    found, kinds = _listed(spark, paths)
    if not found:
        raise SketchError(f"{paths[0]} holds no sequences")
    parts = []
    for mark, kind in _MARKS.items():
        if some := {f: at for f, (k, at) in kinds.items() if k == kind}:
            m = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length", "file_size")]
            texts = spark.read.option("lineSep", f"\n{mark}").text([escaped(f) for f in some]).select(*m, "value")
            parts.append(texts.mapInArrow(_split(kind, {at: found[f] for f, at in some.items()}), SEQUENCES))
    if some := [f for f, (k, _) in kinds.items() if not k]:
        parts.append(spark.read.format("binaryFile").load([escaped(f) for f in some]).select("path", "content").mapInArrow(_whole(found), SEQUENCES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def escaped(path: str) -> str:
    """The path of one file, whatever signs of patterns it holds."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def spooled(stream=None) -> str:
    """Standard input as a file, on the driver's own machine: for local use. It goes when the process ends."""
    with tempfile.NamedTemporaryFile(delete=False, suffix=".stdin") as f:
        shutil.copyfileobj(stream or sys.stdin.buffer, f)
    atexit.register(lambda: os.path.exists(f.name) and os.remove(f.name))
    return f.name


def read_large_fasta(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Records of a FASTA file, under a name of one's own."""
    out = read_sequences(spark, path)
    return out if sample is None else out.withColumn("sample", F.lit(sample))


def formats(sequences: DataFrame) -> DataFrame:
    """sample, format of its first record."""
    return sequences.groupBy("sample").agg(F.min_by("format", "record_no").alias("format"))


def sequences_of_text(docs: DataFrame, sample: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts as sequences of packed bases, one record each, of the samples that the column gives."""
    return docs.select(F.col(sample).cast("string").alias("sample"), F.col(id_col).alias("record_no"), F.col(id_col).cast("string").alias("id"), bases_of_text(F.col(text)).alias("seq"), F.lit(FASTA).alias("format"))


def with_suffix(path: str, ending: str) -> str:
    return path if path.endswith(ending) else path + ending


def put(data: bytes, path: str | None, ending: str = "") -> str | None:
    """Bytes to a file, on any store that Spark reaches, with the ending added if it is missing, or to standard output."""
    if path is None:
        sys.stdout.buffer.write(data)
        sys.stdout.buffer.flush()
        return None
    path = with_suffix(path, ending)
    if "://" in path or path.startswith("file:"):
        sc = SparkSession.builder.getOrCreate().sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(data)
        finally:
            out.close()
        return path
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path
