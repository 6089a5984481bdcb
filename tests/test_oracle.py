"""Every registered query against its oracle SQL, on the smallest driver tables."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry
from taskweave import plans
from taskweave.plans.views import BASE_TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = dict(plans.load()), dict(plans.oracles())
# No query plans a cross product, a nested loop or Python per row.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def bag(table, columns):
    return Counter(tuple(map(plain, row)) for row in zip(*[table.column(c).to_pylist() for c in columns]))


@pytest.fixture
def written(monkeypatch):
    """Plans of all that a query writes on its way: stored rows, sinks, batches of streams."""
    plans_seen = []

    def watched(method):
        def write(self, *args, **kwargs):
            plans_seen.append(self._df._jdf.queryExecution().executedPlan().toString())
            return method(self, *args, **kwargs)

        return write

    for kind in ("parquet", "json", "csv", "text"):
        monkeypatch.setattr(DataFrameWriter, kind, watched(getattr(DataFrameWriter, kind)))
    return plans_seen


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, written, name):
    df = QUERIES[name](spark, FOLDER)
    seen = [*written, df._jdf.queryExecution().executedPlan().toString()]
    assert not [word for word in FORBIDDEN for plan in seen if word in plan]
    ours = df.toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    assert bag(ours, columns) == bag(theirs, columns)


def test_queries_without_oracle_return_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
