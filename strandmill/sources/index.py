"""Collections as tables that are searched many times: minmers in buckets by hash, sorted within.

A search shuffles its own hashes to the buckets; the stored rows stay where they are, and a file's range of
hashes in its footer keeps it from being read for hashes beyond. Beside them lie each sketch's size, largest hash and
digest, and the places of its hashes, in buckets by sketch and range of hashes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distance import steps
from ..params import MINMERS, SKETCHES

#: Rows of minmers in a bucket, about.
ROWS = 1 << 24
_PLACES = "sketch_id bigint, cell bigint, o bigint, next bigint, at int"
_PROFILE = "sketch_id bigint, name string, n bigint, top bigint, same string"


@dataclass(frozen=True)
class Index:
    sketches: DataFrame
    minmers: DataFrame
    profile: DataFrame
    places: DataFrame
    bits: int


def write_index(sketches: DataFrame, minmers: DataFrame, profile: DataFrame, path: str, bits: int = 64, buckets: int | None = None) -> None:
    """bits: of a hash; buckets: by default one for every ROWS rows, and the session's shuffle partitions at least."""
    spark = sketches.sparkSession
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-minmers.count() // ROWS))
    sketches.write.parquet(f"{path}/sketches")
    profile.write.parquet(f"{path}/profile")
    _store(minmers, f"{path}/minmers", buckets, ["hash"], ["hash"])
    _store(steps(minmers.select("sketch_id", "hash"), "sketch_id", bits), f"{path}/places", buckets, ["sketch_id", "cell"], ["sketch_id", "cell", "o"])
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(bits).alias("bits")).coalesce(1).write.parquet(f"{path}/layout")


def _store(rows: DataFrame, path: str, buckets: int, by: list[str], order: list[str]) -> None:
    name = f"strandmill_{uuid.uuid4().hex}"
    # dealt out as buckets are, so that each is one file
    dealt = rows.repartition(buckets, *by).sortWithinPartitions(*order)
    dealt.write.bucketBy(buckets, *by).sortBy(*order).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, and open_index() names them anew


def _named(spark: SparkSession, path: str, shape: str, buckets: int, by: str, order: str) -> DataFrame:
    name, place = f"strandmill_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that write_index() wrote, in any session."""
    buckets, bits = spark.read.schema("buckets int, bits int").parquet(f"{path}/layout").first()
    minmers = _named(spark, f"{path}/minmers", MINMERS, buckets, "hash", "hash")
    places = _named(spark, f"{path}/places", _PLACES, buckets, "sketch_id, cell", "sketch_id, cell, o")
    return Index(spark.read.schema(SKETCHES).parquet(f"{path}/sketches"), minmers, spark.read.schema(_PROFILE).parquet(f"{path}/profile"), places, bits)
