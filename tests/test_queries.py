"""The engine's queries against DuckDB on the smallest tables."""

import gzip
import math
import subprocess
import sys
import zlib

import duckdb
import pytest

import __spark_entry__
from strandmill.plans import file_queries, oracles, queries

SF = "/root/testdata/sf0.001"


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(shown, r)) for r in cur.fetchall()) == sorted(tuple(map(shown, r)) for r in got.select(names).collect())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sample", "hash", "kmer", "count", "extra_count"] and df.count() == 20_000
    assert set(queries.QUERIES) | set(file_queries.QUERIES) == set(oracles.ORACLES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("blocked", ["strandmill.llm", "xxhash", "corpus_pipeline"])
def test_queries_without_the_subpackage_or_what_it_needs(blocked):
    code = f"""
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as e
from strandmill import api, cli
from strandmill.streaming import sketch_stream
from strandmill.plans import oracles, queries
assert set(queries.QUERIES) <= set(e.queries()) and set(oracles.ORACLES) <= set(e.oracle_sql())
assert "pipeline" not in e.queries() and not ({blocked!r} != "corpus_pipeline" and any(n.startswith("op1_") for n in e.queries()))
print("ok")"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "ok" in done.stdout, done.stderr


@pytest.mark.parametrize("name", ["merge_sized", "compare_matrix", "set_counts", "compare_counts", "merge_sources"])
def test_counts_are_made_once(spark, monkeypatch, name):
    """However often a query reads its counts, the texts are gone through once."""
    made, plain = spark.sparkContext.accumulator(0), queries.counts
    want = []

    def counts(*args):
        rows = plain(*args)
        want.append(rows.count())

        def seen(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return rows.mapInArrow(seen, rows.schema)

    monkeypatch.setattr(queries, "counts", counts)
    assert queries.QUERIES[name](spark, __spark_entry__.SMOKE).count()
    assert len(want) == 1 and made.value == want[0]


def test_fastq_files_are_packed_with_little_effort(spark, tmp_path, monkeypatch):
    """Packing at zlib's usual effort took most of fastq_scan's time."""
    path = tmp_path / "reads"
    monkeypatch.setattr(file_queries, "scratch", lambda _: str(path))
    file_queries.fastq_scan(spark, "/root/testdata/sf0.001")
    files = [f.read_bytes() for f in path.glob("*.gz")]
    usual = sum(len(zlib.compress(gzip.decompress(f), 6)) for f in files)
    assert files and sum(map(len, files)) > 1.03 * usual
