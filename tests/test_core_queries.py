"""Every query against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 4) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"approx_distinct"}


def test_approximate_count_is_close(spark):
    got = QUERIES["approx_distinct"](spark, DATA).first().parts
    true = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey").distinct().count()
    assert abs(got - true) <= 0.1 * true
