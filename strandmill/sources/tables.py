"""Sketch collections as two tables, `sketches` and `minmers`, from and to files."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import SketchError
from ..params import FILTER_PARAMS, MINMERS, SKETCH_PARAMS, SKETCHES, FilterParams, SketchParams, signed
from . import formats
from .sequences import escaped, files_at, put

_KMER = "struct<hash:bigint,kmer:string,count:bigint,extra_count:bigint,label:binary>"
NESTED = f"name string, seq_length bigint, num_valid_kmers bigint, comment string, filter_params {FILTER_PARAMS}, sketch_params {SKETCH_PARAMS}, minmers array<{_KMER}>, ordinal int, place int"


def as_rows(sketches: list[dict]) -> list[tuple]:
    return [
        (s["name"], s["seq_length"], s["num_valid_kmers"], s["comment"], s["filters"].row(), s["params"].row(), [(signed(h), m, n, e, x) for h, m, n, e, x in s["rows"]])
        for s in sketches
    ]


def _decoded(order: dict[str, int], shape: pa.Schema):
    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [dict(zip(shape.names, (*r, order[path], i), strict=True)) for i, r in enumerate(_named(x) for x in as_rows(formats.read_any(path, data)))]
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return run


def _named(row: tuple) -> tuple:
    *head, f, p, rows = row
    f = dict(zip(("filter_on", "abun_low", "abun_high", "err_filter", "strand_filter"), f, strict=True))
    p = dict(zip(("scheme", "kmers_to_sketch", "final_size", "no_strict", "kmer_length", "hash_seed", "scale"), p, strict=True))
    return *head, f, p, [dict(zip(("hash", "kmer", "count", "extra_count", "label"), r, strict=True)) for r in rows]


def read_sketches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a sketch with its minmers nested, ordinal and place giving the order of files and of sketches within."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if not formats.is_sketch(p):
            raise SketchError(f"{p} has no ending of a sketch file")
    order: dict[str, int] = {}
    for i, p in enumerate(paths):
        for _, at in files_at(spark, p):
            order.setdefault(at.toString(), i)
    files = [escaped(f) for f in order]
    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(_decoded(order, to_arrow_schema(spark.createDataFrame([], NESTED).schema)), NESTED)


def split(nested: DataFrame, id_col: str = "sketch_id") -> tuple[DataFrame, DataFrame]:
    """(sketches, minmers) of nested rows that have an id."""
    heads = nested.select(*[F.col(c.split()[0]) if c.split()[0] != "sketch_id" else F.col(id_col).alias("sketch_id") for c in ("sketch_id", "name", "seq_length", "num_valid_kmers", "comment", "filter_params", "sketch_params")])
    return heads, nested.select(F.col(id_col).alias("sketch_id"), F.inline("minmers"))


def nest(sketches: DataFrame, minmers: DataFrame) -> DataFrame:
    """Nested rows again, minmers ascending by unsigned hash."""
    ordered = F.struct(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))).alias("o"), *[F.col(c) for c in ("hash", "kmer", "count", "extra_count", "label")])
    grouped = minmers.groupBy("sketch_id").agg(F.array_sort(F.collect_list(ordered)).alias("m"))
    bare = F.transform(F.col("m"), lambda x: F.struct(x["hash"].alias("hash"), x["kmer"].alias("kmer"), x["count"].alias("count"), x["extra_count"].alias("extra_count"), x["label"].alias("label")))
    return sketches.join(grouped, "sketch_id", "left").select(*sketches.columns, F.coalesce(bare, F.array().cast(f"array<{_KMER}>")).alias("minmers"))


def each(nested: DataFrame):
    """Sketches on the driver in order of their ids, a partition's at a time."""
    for r in nested.orderBy("sketch_id").toLocalIterator():
        rows = [(m["hash"] % (1 << 64), m["kmer"] or "", m["count"], m["extra_count"], None if m["label"] is None else bytes(m["label"])) for m in r["minmers"]]
        yield formats.sketch(r["name"], rows, SketchParams.of(r["sketch_params"]), FilterParams.of(r["filter_params"]), r["seq_length"], r["num_valid_kmers"], r["comment"] or "")


def plain(nested: DataFrame) -> list[dict]:
    """Sketches on the driver, for a file that holds them all; save_tables() is the way for many."""
    return list(each(nested))


def write_sketches(nested: DataFrame, path: str | None, ending: str | None = None) -> str | None:
    """One file of all sketches, in the form its ending says."""
    ending = ending or next((e for e in (formats.NATIVE, formats.MASHED, *formats.TEXT) if path and path.endswith(e)), formats.TEXT[0])
    return put(formats.write_any("x" + ending, plain(nested)), path, ending)


def spread(df: DataFrame) -> DataFrame:
    """A scan of files too small for their row groups to keep all cores busy (at most 4 MiB a core, Spark's smallest split)
    dealt out over the cores; larger ones stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n) if size <= n << 22 else df


def scratch(spark: SparkSession) -> str:
    """A path of one's own below spark.checkpoint.dir, which goes when the session ends; where that is unset, on a local
    master only, in a folder of this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise SketchError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"strandmill-{sc.applicationId}")
    path = f"{folder.rstrip('/')}/strandmill/{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def held(df: DataFrame) -> DataFrame:
    """df, made once: written below spark.checkpoint.dir where that is set, kept by the executors (and made anew where one
    is lost) where it isn't."""
    spark = df.sparkSession
    if not (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
        return df.persist()
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_tables(sketches: DataFrame, minmers: DataFrame, path: str) -> None:
    """Parquet, minmers by sketch: the form for many sketches."""
    sketches.write.parquet(f"{path}/sketches")
    minmers.repartition("sketch_id").sortWithinPartitions("sketch_id", "hash").write.parquet(f"{path}/minmers")


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(SKETCHES).parquet(f"{path}/sketches"), spark.read.schema(MINMERS).parquet(f"{path}/minmers")
