"""Verification (F1-F8) properties and messages."""

from pyspark.sql import functions as F

from docvet.functions.fixed import ALLOWED_VALUES
from docvet.operators.verify import verdict, verify_records
from docvet.plans.analysis import scored_records, verified_records
from docvet.sources.records import research_records

SF = "/root/testdata/sf0.001"


def test_valid_iff_no_issues_and_confidence_range(spark):
    v = verdict(scored_records(research_records(spark, SF)))
    bad = v.where((F.col("verdict.valid") != (F.size("verdict.issues") == 0)) | (F.col("verdict.manual_review") == F.col("verdict.valid")))
    assert bad.count() == 0
    out = verified_records(research_records(spark, SF))
    assert out.where((F.col("confidence") < 0) | (F.col("confidence") > 95)).count() == 0


def _record(spark, **kw):
    base = dict(
        id=1,
        name="Acme",
        category="Payments",
        known_category="Payments",
        document="docs text",
        description="d",
        auth_method="OAuth 2.0",
        self_serve="Self Serve",
        credential_requirement="API key",
        api_type="REST",
        api_scope="Small",
        mcp_support="No",
        buildability="Yes",
        blocker="None",
        evidence_url="u",
        confidence=87,
    )
    base.update(kw)
    cols = list(base)
    schema = ", ".join(f"{c} {'BIGINT' if c == 'id' else 'INT' if c == 'confidence' else 'STRING'}" for c in cols)
    return spark.createDataFrame([tuple(base[c] for c in cols)], schema)


def test_clean_record_is_valid(spark):
    r = verify_records(_record(spark)).collect()[0]
    assert r["issues"] == [] and r["manual_review"] is False and r["confidence"] == 87


def test_blocker_outside_set_costs_two_issues(spark):
    r = verify_records(_record(spark, blocker="Paid plan")).collect()[0]
    assert len(r["issues"]) == 2
    assert r["issues"][0] == "blocker must be one of: None, Unknown"
    assert r["confidence"] == 77 and r["blocker"] == "Unknown"


def test_issue_order_and_messages(spark):
    r = verify_records(_record(spark, category="Other", self_serve="yes", mcp_support="Yes")).collect()[0]
    assert r["issues"][0] == "Category must match known category: Payments"
    assert r["issues"][1] == "self_serve must be one of: " + ", ".join(sorted(ALLOWED_VALUES["self_serve"]))
    assert r["issues"][-1] == "mcp_support should be Unknown unless the docs explicitly mention MCP"
    # repaired value, record still flagged (issues read raw values)
    assert r["self_serve"] == "Self Serve" and r["manual_review"] is True
    assert r["category"] == "Payments"
    assert r["confidence"] == 87 - 15


def test_penalty_cap(spark):
    r = verify_records(
        _record(spark, category="x", self_serve="?", api_type="?", api_scope="?", mcp_support="?", buildability="?", blocker="?", confidence=20)
    ).collect()[0]
    assert len(r["issues"]) > 5 and r["confidence"] == 0


def test_unknown_blocker_becomes_none(spark):
    r = verify_records(_record(spark, blocker="Unknown")).collect()[0]
    assert r["blocker"] == "None" and r["issues"] == []
