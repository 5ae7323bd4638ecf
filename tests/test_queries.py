"""Every registered query runs; those with SQL give the rows DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(n for n in SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
