"""Queries with SQL, against DuckDB on the smallest tables."""

import random

import duckdb
import pytest

import __spark_entry__
from strandmill.llm import queries, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, cur.fetchall())) == sorted(tuple(r) for r in got.select(names).collect())


def test_all_are_registered():
    found = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert found == {f"op{n}" for n in range(1, 14)} and "pipeline" in __spark_entry__.queries()


def test_fingerprints_in_sql_of_texts_of_any_length():
    rng = random.Random(4)
    letters = "abcXYZ09é日\U0001f600"
    texts = [None, "", " \t\n", "a", *("".join(rng.choice(letters) for _ in range(n)) for n in (3, 7, 8, 31, 32, 33, 63, 64, 200, 1001))]
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {r[0]: r[1] for r in con.execute(queries.ORACLES["op2_simhash"]).fetchall()}
    assert got == {i: f"{simhash.fingerprint(t or ''):016x}" for i, t in enumerate(texts)}
