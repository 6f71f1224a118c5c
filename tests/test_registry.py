"""Every registered query against its SQL counterpart."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    rows = df.collect()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(rows, df.columns) == ordered(found.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_gives_rows(spark):
    assert driver.entry(spark).columns == driver.queries()["recall"](spark, SF).columns
