"""Every catalogue query against DuckDB on the smallest tables; the driver repeats this at a larger size."""

import datetime
import decimal
import glob
import os

import pytest

from evigraph import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=str)
    if name not in catalog.ORACLES:
        assert rows
        return
    got = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in got.fetchall()), key=str)
    assert rows == want


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["cy_params"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan" in plan
    assert "o_orderpriority" not in plan
