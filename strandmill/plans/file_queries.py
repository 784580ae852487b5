"""Queries through files, collections and the command line: what is written is read back."""

from __future__ import annotations

import json
import re
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import api, cli
from ..functions import kmers as K
from ..operators import filters, sketching
from ..params import ALL, MASH, FilterParams, SketchParams
from ..sources import fastx, tables
from ..sources import sequences as S
from ..sources.tables import scratch, spread
from .queries import DOC_MASHED, MASHED, SHORT, sequences

TRIMMED = SketchParams(MASH, 2000, 500, True)
KEPT = FilterParams(True, 3, 40, 0.0, 0.2)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), "source", K.bases_of_text(F.col("text")).alias("seq"))


def _lettered(rows: DataFrame) -> DataFrame:
    """id, source, seq with letters for packed bases, which are made last: they are four times as long."""

    def run(batches):
        for b in S.few(batches):
            yield pa.record_batch([b.column(0), b.column(1), K.letters_of(b.column(2))], names=["id", "source", "seq"])

    return rows.mapInArrow(run, "id string, source string, seq string")


def _letters(spark: SparkSession, sf_dir: str, empty: bool = True) -> DataFrame:
    """All texts, or without those that are empty."""
    rows = _packed(spark, sf_dir)
    return _lettered(rows if empty else rows.where(F.octet_length("seq") > 0))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("seq_md5"), "format")


def fasta_scan(spark, sf_dir):
    """All texts as FASTA files with lines of 60, read back."""
    path = scratch(spark)
    _letters(spark, sf_dir).select(F.concat(F.lit(">"), "id", F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.text(path)
    return _records(S.read_sequences(spark, path))


def fastq_scan(spark, sf_dir):
    """All texts as compressed FASTQ files, read back; qualities begin with the sign of a record."""
    path = scratch(spark)
    quality = F.concat(F.lit("@"), F.expr("repeat('I', length(seq) - 1)"))
    rows = _letters(spark, sf_dir, empty=False)
    text = F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), quality)
    # two bits a base at best: more effort gains little, and packing takes most of the time
    rows.select(text).write.options(compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(path)
    got = S.read_sequences(spark, path)
    return _records(got.where(F.col("qual") == quality))


def _fasta(name: str, seq: bytes) -> bytes:
    return b">%b\n%b\n" % ((name or "").encode(), seq)


def _fastq(name: str, seq: bytes) -> bytes:
    return b"@%b\n%b\n+\n%b\n" % ((name or "").encode(), seq, b"I" * len(seq))


def _placed(path: str, record_of):
    """Writes a file below path for every name, whose rows (file, id, seq as packed bases) come together, record by record;
    record_of: the form of a file's records. A task that runs again writes the same files."""

    def run(batches):
        store, inner = fastx.store_of(path)
        out, name, n = None, None, 0
        for b in S.few(batches):
            for file, i, seq in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if out is None or file != name:
                    if out is not None:
                        out.close()
                    at = f"{inner}/{file}"
                    store.create_dir(at.rpartition("/")[0])
                    out, name, n = store.open_output_stream(at, buffer_size=1 << 16), file, n + 1
                    record = record_of(file)
                out.write(record(i, K.lettered(seq)))
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    return run


def _put(rows: DataFrame, path: str, record_of) -> None:
    """The files of rows (file, id, seq), all rows of one in one task. Tasks write them through the same store that the data
    source reads files from, so that letters, four times as long as packed bases, are neither sorted nor sent anywhere: Spark's
    own writer sorts them by file, makes a folder and a checksum for each, and moves all at the end."""
    dealt = rows.select("file", "id", "seq").repartition("file").sortWithinPartitions("file")
    dealt.mapInArrow(_placed(path, record_of), "files bigint").write.format("noop").mode("overwrite").save()


def small_files(spark, sf_dir):
    """A file for every text, read by the data source; planning opens none."""
    path = scratch(spark)
    _put(_packed(spark, sf_dir).withColumn("file", F.concat(F.coalesce("id", F.lit("")), F.lit(".fa"))), path, lambda _: _fasta)
    fastx.register(spark)
    return _records(spark.read.format("fastx").load(path))


def normalised(spark, sf_dir):
    """Hexadecimal texts as sequences: letters that aren't bases, digits and gaps."""
    text = F.concat_ws(" u.~\n", F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lower(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", F.md5(K.normalise(text)).alias("seq_md5"), F.md5(K.reverse_complement(K.normalise(text))).alias("rc_md5"))


def _complete(spark, sf_dir) -> api.Collection:
    return api.sketch_sequences(sequences(spark, sf_dir), SketchParams(ALL, 4**SHORT, 4**SHORT, True, SHORT), FilterParams(False))


def _rows(c: api.Collection, *more: str) -> DataFrame:
    names = c.sketches.select("sketch_id", F.col("name").alias("sample"))
    return c.minmers.join(names, "sketch_id").select("sample", sketching.hash_text().alias("hash"), *more)


def _written(spark, sf_dir, ending: str) -> api.Collection:
    path = scratch(spark) + ending
    _complete(spark, sf_dir).save(path)
    return api.Collection.open(spark, path)


def native_files(spark, sf_dir):
    return _rows(_written(spark, sf_dir, ".bsk"), "kmer", "count", "extra_count")


def json_files(spark, sf_dir):
    return _rows(_written(spark, sf_dir, ".sk"), "kmer", "count")


def mash_files(spark, sf_dir):
    """This format holds hashed sketches only."""
    path = scratch(spark) + ".msh"
    api.sketch_sequences(sequences(spark, sf_dir), SketchParams(MASH, 300, 300)).save(path)
    return _rows(api.Collection.open(spark, path), "count")


def sketch_facts(spark, sf_dir):
    """What one pass says of each sample, read back from a native file: lengths, filters and parameters."""
    path = scratch(spark) + ".bsk"
    api.sketch_sequences(sequences(spark, sf_dir), MASHED, FilterParams(None, 1, 10**6, 0.0, 0.0)).save(path)
    s = api.Collection.open(spark, path).sketches
    f, p = F.col("filter_params"), F.col("sketch_params")
    return s.select(
        "sketch_id", F.col("name").alias("sample"), "seq_length", "num_valid_kmers", f["filter_on"].alias("filter_on"), f["abun_low"].cast("long").alias("abun_low"),
        p["kmers_to_sketch"].cast("long").alias("kmers_to_sketch"), p["kmer_length"].cast("long").alias("kmer_length"),
    )


def trimmed(spark, sf_dir):
    """Sketches of more hashes than stay."""
    rows = filters.final_trim(sketching.minmers(sequences(spark, sf_dir), TRIMMED), TRIMMED)
    return rows.select("sample", sketching.hash_text().alias("hash"), "kmer", "count", "extra_count")


def filtered_sketches(spark, sf_dir):
    """Filters on sketches that are ready."""
    return _rows(_complete(spark, sf_dir).filtered(KEPT), "kmer", "count", "extra_count")


def collection_edit(spark, sf_dir):
    """A sketch taken out, one put behind the others, one named twice."""
    c = _complete(spark, sf_dir)
    out = c.without("src3").without(0).add(c.filter_to_names(["src3", "src5"]))
    return out.sketches.select(F.col("name").alias("sample"), F.row_number().over(Window.orderBy("sketch_id")).alias("place"))  # a row a sketch


def _by_source(spark, sf_dir, record_of=lambda _: _fasta) -> list[str]:
    """One file a source, with the records of its texts that aren't empty."""
    path = scratch(spark)
    # folders are named as Spark's writer names those of a partition
    name = F.coalesce(F.nullif("source", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    for sign in "%\"#'*/:=?\\{[]^":
        name = F.replace(name, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    rows = _packed(spark, sf_dir).where(F.octet_length("seq") > 0)
    _put(rows.withColumn("file", F.concat(F.lit("source="), name, F.lit("/reads.txt"))), path, record_of)
    return sorted(f.toString() for _, f in S.files_at(spark, f"{path}/source=*"))


def reads_filter(spark, sf_dir):
    """Sources whose names end in an even digit as FASTQ files, the others as FASTA: filters that nobody turned on or off
    apply to reads with qualities alone."""
    files = _by_source(spark, sf_dir, lambda file: _fastq if file.split("/")[0][-1] in "02468" else _fasta)
    c = api.sketch_files(spark, files, SketchParams(ALL, 4**SHORT, 4**SHORT, True, SHORT), replace(KEPT, filter_on=None))
    return _rows(c, "kmer", "count", "extra_count").withColumn("sample", F.regexp_extract("sample", "source=([^/]*)/", 1))


def table_rows(spark, sf_dir):
    """Sketches written as tables from the executors and read back."""
    path = scratch(spark)
    c = api.sketch_sequences(sequences(spark, sf_dir), MASHED, FilterParams(False))
    tables.save_tables(c.sketches, c.minmers, path)
    return _rows(api.Collection(*tables.load_tables(spark, path)), "kmer", "count", "extra_count")


def _source(path: str) -> str:
    return re.search(r"source=([^/]*)/", path)[1]


def _command(spark, sf_dir, *options: str) -> str:
    """The output of a command over the sources' files."""
    files = _by_source(spark, sf_dir)
    out = scratch(spark) + ".json"
    if cli.run([options[0], *[f if "://" in f else f.replace("file:/", "file:///", 1) for f in files], *options[1:], "-n", "500", "-o", out], spark):
        raise RuntimeError("the command failed")
    return spark.read.option("wholetext", True).text(out).first()[0]


def cli_dist(spark, sf_dir):
    """dist -p over FASTA files."""
    rows = json.loads(_command(spark, sf_dir, "dist", "-p"))
    flat = [(_source(r["query"]), _source(r["reference"]), r["containment"], r["jaccard"], r["mashDistance"], r["commonHashes"], r["totalHashes"]) for r in rows]
    shape = "query string, reference string, containment double, jaccard double, mashDistance double, commonHashes long, totalHashes long"
    return spark.createDataFrame(flat, shape).withColumn("mashDistance", F.round("mashDistance", 12))


def cli_hist(spark, sf_dir):
    """hist over FASTA files."""
    rows = json.loads(_command(spark, sf_dir, "hist"))
    return spark.createDataFrame([(_source(n), ",".join(map(str, h))) for n, h in rows.items()], "sample string, hist string")


def _indexed(spark, sf_dir) -> api.Collection:
    """The sources' sketches, written in buckets and opened again."""
    path = scratch(spark)
    api.sketch_sequences(sequences(spark, sf_dir), MASHED, FilterParams(False)).save_index(path)
    return api.Collection.open_index(spark, path)


def index_rows(spark, sf_dir):
    return _rows(_indexed(spark, sf_dir), "kmer", "count", "extra_count")


def index_search(spark, sf_dir):
    """The source that each document is most like: many queries over a stored index."""
    refs = _indexed(spark, sf_dir)
    queries = api.sketch_sequences(sequences(spark, sf_dir, "doc_id"), DOC_MASHED, FilterParams(False), check=False)
    names = lambda c, by: c.sketches.select(F.col("sketch_id").alias(by), F.col("name").alias(f"{by}_name"))
    found = refs.best_matches(queries).join(names(queries, "query"), "query").join(names(refs, "reference"), "reference")
    return found.select(F.col("query_name").alias("query"), F.col("reference_name").alias("reference"), "containment", "jaccard")


def mixed_load(spark, sf_dir):
    """A sketch file of all sources and one more sequence file, which takes the sketches' parameters."""
    files = _by_source(spark, sf_dir)
    path = scratch(spark) + ".bsk"
    api.sketch_sequences(sequences(spark, sf_dir), SketchParams(MASH, 300, 300)).save(path)
    c = api.load(spark, [path, files[0]])
    rows = _rows(c, "kmer", "count", "extra_count")
    name = F.regexp_extract("sample", "source=([^/]*)/", 1)
    return rows.select(F.when(F.col("sample").contains("source="), F.concat(F.lit("file "), name)).otherwise(F.col("sample")).alias("sample"), "hash", "kmer", "count", "extra_count")


QUERIES = {
    f.__name__: f
    for f in (fasta_scan, fastq_scan, small_files, normalised, native_files, json_files, mash_files, sketch_facts, trimmed, filtered_sketches, collection_edit, cli_dist, cli_hist, index_rows, index_search, mixed_load, reads_filter, table_rows)
}
