"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans import further, more, queries

ORACLE, QUERIES = queries.ORACLE | more.ORACLE | further.ORACLE, queries.QUERIES | more.QUERIES | further.QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql_says(spark, duck, name):
    df, rel = QUERIES[name](spark, DIR), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)
