"""Every registered query against its SQL check, and the shape of their plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, rows_of
from dialoom.plans.registry import load_all

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf, con, name):
    query = REGISTRY[name]
    df = query.run(spark, sf)
    got = rows_of(df.columns, df.collect())
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, result.fetchall())


def test_entry_and_contract(spark):
    assert entry_module.entry(spark).count() > 0
    # Other packages may add queries of their own; ours all have their SQL.
    assert set(REGISTRY) <= set(entry_module.queries())
    assert set(REGISTRY) <= set(entry_module.oracle_sql())


def plan_of(spark, sf, name):
    return REGISTRY[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()


# Queries that write tables on the way are left out; their result is a plain scan.
LAZY = sorted(set(REGISTRY) - {n for n, q in REGISTRY.items() if any(i.startswith(("SNK", "SRC", "DDL", "DML", "CTL")) for i in q.ids)})


@pytest.mark.parametrize("name", LAZY)
def test_no_single_task_window_and_no_cross_join(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"windowspecdefinition\((\S+ (ASC|DESC)|specified)", line), line
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(spark, sf, "layered_customer_revenue")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate" in plan
    plan = plan_of(spark, sf, "delete_lines_of_urgent_orders")
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    plan = plan_of(spark, sf, "top_recent_spenders")
    assert "TakeOrderedAndProject" in plan and "GreaterThan" in plan
    plan = plan_of(spark, sf, "top_orders_per_customer")
    assert "WindowGroupLimit" in plan


def test_python_functions_run_once_per_row(spark, sf):
    for name in ("extract_sql_statements", "split_cells", "python_error_classes", "check_sql_statements"):
        assert plan_of(spark, sf, name).count("ArrowEvalPython") == 1, name


def test_tasks_of_large_groupings_follow_the_rows(spark, sf, monkeypatch):
    from dialoom import session

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    for name in ("expand_number_ranges", "gold_sales_summary", "gold_top_city_sales"):
        assert re.search(r"hashpartitioning\(.*, 1[0-9]\), REPARTITION_BY_NUM", plan_of(spark, sf, name)), name


def test_a_level_of_a_union_recursion_is_written_once(spark, monkeypatch):
    from dialoom.operators import relational

    written = []
    monkeypatch.setattr(relational, "materialize", lambda df: written.append(1) or df.localCheckpoint())
    start = spark.range(1).selectExpr("0L AS node")
    got = relational.recursive(start, lambda level: level.selectExpr("(node + 1) % 3 AS node"), "union")
    assert sorted(r.node for r in got.collect()) == [0, 1, 2] and len(written) == 4
