"""Every registered query against its SQL, and the shape of its plan."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerline.contract.derived import TABLES
from ledgerline.contract.queries import QUERIES as OWN

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The optional operators have tests of their own.
QUERIES = {name: q for name, q in contract.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in OWN}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module", autouse=True)
def nothing_is_broadcast(spark):
    """Plans as on large data: no side is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    found = duck.execute(ORACLES[name])
    columns = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == columns
    at = [list(columns).index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    # No plan compares every row with every row, or calls Python per row.
    shape = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in shape


def test_contents_are_hashed_once(spark):
    df = QUERIES["dup_groups"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_filters_reach_the_scan(spark):
    def plan(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    trend = plan("daily_trend_range")
    assert "GreaterThanOrEqual(ts," in trend and "LessThan(ts," in trend
    assert "text" not in plan("target_keys").split("ReadSchema:")[1]


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["question_id", "status", "summary", "error", "reply"] and not df.isEmpty()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
