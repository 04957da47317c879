"""Every registered query against its SQL, on the smallest input."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as app
import check
from episodica.plans.oracle import all_oracles
from episodica.plans.registry import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


def test_every_oracle_has_its_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(app.queries()) and set(ORACLES) <= set(app.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, database, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    mine = check.rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert mine[1]
        return
    found = database.execute(ORACLES[name])
    assert mine == check.rows_of([d[0] for d in found.description], found.fetchall())


def test_entry(spark):
    row = app.entry(spark).head()
    assert (row["total_episodes"], row["eligible_episodes"], row["unplanned_readmissions"]) == (1443, 1036, 54)


def test_plans_have_no_cross_joins(spark, sf_dir):
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
