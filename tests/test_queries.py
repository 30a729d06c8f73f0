"""Every registered query against its SQL on DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402
import __spark_entry__ as contract  # noqa: E402
from leakscope.plans import queries as plans  # noqa: E402
from conftest import SMALL  # noqa: E402

SLOW = {"forecast", "forecast_revenue", "training_report"}  # trained in test_jobs


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in ("lineitem", "orders", "supplier", "events"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(plans.registered()) - SLOW))
def test_query(spark, con, name):
    verdict, note = compare.compare(spark, con, SMALL, name)
    assert verdict in ("ok", "rows-only"), note
    assert "TYPES" not in note, note


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
