"""Every registered query with SQL returns what DuckDB returns on the same tables."""

import math
import os

import duckdb
import pytest
from conftest import SF

from mediasieve.jobs.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    assert got == rows([d[0] for d in result.description], result.fetchall())


def test_all_but_listed_queries_have_sql():
    assert set(QUERIES) - set(SQL) == {"frame_recovery"}


def test_recovery_of_moving_clips(spark):
    got = QUERIES["frame_recovery"](spark, SF).collect()
    assert got and all(r.frames == 12 and r.recovered >= 8 for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(SQL) <= set(e.oracle_sql())
