"""What the operators share: durable intermediate tables, text clean-up and table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only on a local master with none set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="strandmill-")
    return "file://" + _own[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/strandmill/{uuid.uuid4().hex}-{tag}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def durable(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files too small for their row groups to keep all cores busy (at most 4 MiB a core, Spark's smallest split)
    dealt out over the cores; larger ones stay as they are."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return scan.repartition(n) if size <= n << 22 else scan


def free(columns: list[str], name: str) -> str:
    """name, or name with as many underscores after it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(docs: DataFrame, run, *more: StructField) -> DataFrame:
    """mapInArrow over all columns of docs, which come in their places under names of their own, as theirs may be any;
    the result has them and the columns more."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shape = StructType([*plain.schema.fields, *more])
    return plain.mapInArrow(run, shape).toDF(*docs.columns, *[f.name for f in more])


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
