"""Plan shape of every registered query: no cartesian product or nested-loop
join, no Python worker in the plan, scans pruned to the needed columns."""

import re

import pytest

from ledgerlens.registry import QUERIES


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + "\n" + qe.optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_or_python(spark, sf_small, name):
    plan = _plan(QUERIES[name](spark, sf_small))
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{name}: {bad}"


def _read_schemas(df) -> list[str]:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", text)


def test_scans_are_pruned(spark, sf_small):
    schemas = _read_schemas(QUERIES["aging_receivables"](spark, sf_small))
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and all("o_orderpriority" not in s for s in orders)   # product_line is not used by R1
    docs = _read_schemas(QUERIES["pattern_tagging_documents"](spark, sf_small))
    assert docs == ["struct<doc_id:bigint,text:string>"]


def test_year_filter_reaches_the_scan(spark, sf_small):
    df = QUERIES["filter_year_to_date"](spark, sf_small)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)


@pytest.mark.parametrize("name", ["top15_report", "top4_accounts", "top_account_chart_feed"])
def test_top_k_is_take_ordered(spark, sf_small, name):
    plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_first_per_key_uses_group_limit(spark, sf_small):
    plan = QUERIES["dedupe_keep_first"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_freight_lines_are_not_shuffled(spark, sf_small):
    """The rate and rule lookups are broadcast into the line scan: the lines
    meet both rate tables by (carrier, lane, container), the rules by account."""
    plan = QUERIES["freight_exception_report"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert len(re.findall(r"BroadcastHashJoin \[carrier#\d+, lane#\d+, container#\d+\]", plan)) == 2
    assert re.search(r"BroadcastHashJoin \[account_id#\d+L?\]", plan)


@pytest.mark.parametrize("name", ["pattern_tagging_documents", "pattern_tagging"])
def test_texts_are_not_shuffled(spark, sf_small, name):
    plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
