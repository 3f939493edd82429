"""Every query with SQL agrees with DuckDB, row for row."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or (isinstance(v, (float, np.floating)) and math.isnan(v)) or str(v) == "<NA>":
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert entry.entry(spark).count() == 8 * vectors.filter("vec_id % 50 = 0").count()
