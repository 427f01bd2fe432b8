"""Registered queries against their SQL on the smallest tables, and the shape of plans."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from sessionlake.operators import filters
from sessionlake.plans import views
from sessionlake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "conversations", "events", "pages", "labels", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    if isinstance(v, dt.datetime):
        return str(v.replace(tzinfo=None))
    return str(int(v)) if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(value(v) for v in row) for row in found.fetchall())
    assert sorted(tuple(value(v) for v in row) for row in df.select(columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.agent for r in rows} <= {"claude", "codex"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_reaches_the_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type as agent", "cast(ts as timestamp) as timestamp", "value")
    shown = plan(filters.apply(e, filters.agent_filter(["click"])).select("agent"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in shown and "value" not in shown.split("ReadSchema")[1]


def test_no_cartesian_products_or_global_windows(spark):
    for name in ("search_score", "plan_refresh", "assemble_sessions", "postings", "latest_snapshot"):
        shown = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in shown and "Window" not in shown, name
    assert "content" not in plan(views.listed(spark, SF))
