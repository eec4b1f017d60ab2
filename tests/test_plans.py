"""Plan checks: pushdown, pruning, no Python outside the hand-off, no cross joins."""

import pytest

from docvet.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SINK_QUERIES = {
    "q_scan_csv",
    "q_scan_first",
    "q_result_append",
    "q_json_append",
    "q_run_log",
    "q_verify_sample",
    "q_error_rows",
    "q_report_json",
    "q_report_sections",
    "q_report_queue",
    "q_report_from_files",
    "q_reset_append",
    "q_stream_append",
    "q_stream_distribution",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SINK_QUERIES))
def test_plan_shape(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    if name != "q_extract_batch":
        assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "PythonMapInArrow", "MapInPandas", "MapInArrow"))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pushdown_and_pruning(spark):
    from pyspark.sql import functions as F

    from docvet.sources.tables import table

    df = table(spark, SF, "documents").where(F.col("n_chars") < 80).select("doc_id")
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(n_chars), LessThan(n_chars,80)]" in p
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in p


def test_top_docs_uses_group_limit(spark):
    plan = plan_of(QUERIES["q_top_docs"](spark, SF))
    assert "WindowGroupLimit" in plan
