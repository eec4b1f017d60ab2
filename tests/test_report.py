"""Reports (G13, G16, A9): complete sections, one scan, findings, reports from files."""

import json

from docvet.plans import report as RP
from docvet.plans.analysis import as_results, normalised_frame, raw_frame, verified_records
from docvet.session import scratch_path
from docvet.sources.files import write_results
from docvet.sources.records import research_records

SF = "/root/testdata/sf0.001"


def test_raw_report_and_findings(spark):
    raw = RP.raw_frame_of_records(spark, SF)
    rep = RP.raw_summary(raw).collect()[0]
    assert rep["total_rows"] == raw.count()
    assert rep["manual_review_count"] == RP.review_queue(raw).count() == raw.where("review").count()
    f = [r["finding"] for r in RP.findings(raw).orderBy("pos").collect()]
    assert f == rep["findings"]
    assert f[0].startswith("Top auth method is ")
    assert f[-1].endswith("% of rows need manual review.")


def test_reports_scan_the_rows_once(spark):
    """The counts scan documents once; everything after them reads the small written table."""
    for counts, lines in ((RP.report_counts, RP.normalised_lines), (RP.raw_counts, RP.raw_lines)):
        frame = (normalised_frame if lines is RP.normalised_lines else raw_frame)(as_results(research_records(spark, SF)))
        plan = counts(frame)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "documents.parquet" in plan
        plan = lines(frame)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") >= 1 and "documents.parquet" not in plan


def test_open_sections_are_complete(spark):
    """More distinct values than any cut: every one is in the sections, every flagged row in the queue."""
    df = spark.range(3000).selectExpr("id", "concat('app', id) AS name", "concat('blocker ', id) AS blocker", "concat('cat ', id) AS category", "'true' AS manual_review", "'50' AS confidence")
    path = scratch_path(spark, "complete")
    RP.write_raw_report(raw_frame(df), path)
    sections = spark.read.parquet(f"{path}/sections")
    assert sections.where("section = 'top_blockers'").count() == 3000 and sections.where("section = 'top_categories'").count() == 3000
    assert spark.read.parquet(f"{path}/review_queue").count() == 3000


def test_raw_mean_uses_parsed_numbers(spark):
    df = spark.createDataFrame(
        [(1, "a", "12.9", "true"), (2, "b", "x", "false"), (3, "c", "80", "no")],
        "id INT, name STRING, confidence STRING, manual_review STRING",
    )
    rep = RP.raw_summary(raw_frame(df)).collect()[0]
    # (12.9 + 0 + 80) / 3 = 30.97; min and max truncate
    assert rep["average_confidence"] == 30.97
    assert (rep["min_confidence"], rep["max_confidence"]) == (0, 80)
    assert rep["manual_review_rate"] == 33.33


def test_summary_median_from_histogram(spark):
    import statistics

    for values in ([1, 2, 3, 4], [5], [7, 7, 7, 1], [10, 0, 95, 95, 48, 61]):
        rows = [(i, "c", "OAuth2", "REST", "Self Serve", "Yes", "No", "Unknown", v, i % 2 == 0) for i, v in enumerate(values)]
        norm = spark.createDataFrame(
            rows,
            "id INT, category STRING, auth STRING, api_type STRING, self_serve STRING, buildability STRING, mcp STRING, blocker STRING, confidence BIGINT, review BOOLEAN",
        )
        got = {r["label"]: (r["n"], r["x"]) for r in RP.normalised_lines(norm).where("section = 'confidence_summary'").collect()}
        assert got["median"][1] == round(statistics.median(values), 2)
        assert got["lowest"][0] == min(values) and got["highest"][0] == max(values)
        assert got["manual_review_count"][0] == sum(1 for i in range(len(values)) if i % 2 == 0)


def test_report_from_files_missing_and_present(spark):
    root = scratch_path(spark, "report-files")
    RP.report_from_files(spark, [f"{root}/nope", f"{root}/also-nope"], f"{root}/none")
    gone = json.loads(spark.read.text(f"{root}/none/summary").collect()[0][0])
    assert gone == {"total_rows": 0, "message": "No research results found."}
    res = verified_records(research_records(spark, SF))
    write_results(res, f"{root}/data", reset=True)
    RP.report_from_files(spark, [f"{root}/nope", f"{root}/data"], f"{root}/report")
    rep = json.loads(spark.read.text(f"{root}/report/summary").collect()[0][0])
    assert rep["total_rows"] == res.count()
    assert rep["manual_review_count"] == res.where("manual_review").count()
    # ties by first appearance follow the ids, however the files are split
    lines = {(r["section"], r["value"]): r["first_seen"] for r in spark.read.parquet(f"{root}/report/sections").collect()}
    first = min(r["id"] for r in res.where("auth_method = 'OAuth 2.0'").collect()) if res.where("auth_method = 'OAuth 2.0'").count() else None
    assert first is None or int(lines["top_auth_methods", "OAuth 2.0"]) == first


def test_missing_value_tokens_leave_no_blocker(spark):
    """A results file whose blockers are all the word None has no top blocker, as in the published report."""
    df = spark.createDataFrame([(i, f"app{i}", "None", 90, False) for i in range(5)], "id INT, name STRING, blocker STRING, confidence INT, manual_review BOOLEAN")
    path = scratch_path(spark, "tokens")
    write_results(df, path, reset=True)
    raw = RP.raw_frame_from_files(spark, [path])
    assert RP.raw_lines(raw).where("section = 'top_blockers'").collect() == []
    rep = RP.raw_summary(raw).collect()[0]
    assert rep["top_blockers_leader"] == "N/A" and not any("blocker" in f for f in rep["findings"])
