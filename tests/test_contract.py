"""Driver contract: entry runs, every query has a twin, and all twins agree (sf0.001)."""

import importlib.util
import os

import pytest

from conftest import SF001
from plaint.plans.verify import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _library(m):
    """The library's own queries (those of the optional subpackage have tests of their own)."""
    from plaint.plans.catalog import REGISTRY
    assert set(REGISTRY) <= set(m.queries())
    return REGISTRY


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_returns_four_rows(spark):
    df = _entry_module().entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) >= {"category", "last_7", "prev_7", "change", "direction"}


def test_every_query_has_an_oracle_except_documented():
    m = _entry_module()
    missing = set(_library(m)) - set(m.oracle_sql())
    assert missing == set()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(_library(_entry_module())))
def test_query_matches_duckdb(spark, con, name):
    from plaint.plans.catalog import REGISTRY
    fn, sql = REGISTRY[name]
    res = compare(spark, con, name, fn, sql, SF001)
    assert res["status"] == "ok", res


TIME_SENSITIVE = ["week_over_week_counts", "insights", "ageing_by_status", "kpi_summary", "daily_trend",
                  "stream_daily_counts", "stream_rolling_week", "display_time"]


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_results_do_not_depend_on_the_session_time_zone(spark, con, name):
    from plaint.plans.catalog import REGISTRY
    fn, sql = REGISTRY[name]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        res = compare(spark, con, name, fn, sql, SF001)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert res["status"] == "ok", res
