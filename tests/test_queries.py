"""Every registered query with SQL gives the same rows in DuckDB; plans keep their shape."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert problem is None


@pytest.mark.parametrize("name", ["forest_train_score", "score_batch"])
def test_scored_requests(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.where("mesh between 1 and 50 and gram between 0 and 0.2").count() > 0
    if name == "score_batch":
        assert {r.status for r in rows.select("status").distinct().collect()} == {"ok", "no_model"}


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


CHEAP = [n for n in sorted(SQL) if not n.startswith(("forest", "feature", "model", "kfold", "fold", "confidence"))]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, capsys):
    QUERIES["facts_by_owner_range"](spark, SF).explain("formatted")
    lines = capsys.readouterr().out.splitlines()
    scan = next(i for i, line in enumerate(lines) if line.startswith("PushedFilters") and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate" in lines[scan] and "LessThanOrEqual(l_shipdate" in lines[scan]
    assert "l_quantity" in lines[scan + 1] and "l_tax" not in lines[scan + 1] and "l_discount" not in lines[scan + 1]


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["recent_by_date"](spark, SF))


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["c_custkey", "c_name", "recipe_count"]
