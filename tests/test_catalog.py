"""Every query against its SQL in DuckDB over the same tables."""

import math

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        if isinstance(v, float):
            return "0.0" if v == 0 else repr(round(v, 9))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    d = QUERIES[name](spark, sf_dir)
    columns = sorted(d.columns)
    got = normal(d.select(*[f"`{c}`" for c in columns]).collect())
    r = db.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    assert got == normal(r.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
