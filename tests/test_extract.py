"""Extraction hand-off."""

import json

from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.operators.extract import RECORD_SCHEMA, RETRY_SUFFIX, description_request, extract_batch, parse_record, request_text


def _full(**kw):
    rec = {f.name: "x" for f in RECORD_SCHEMA.fields if f.name != "name"}
    rec["confidence"] = 0
    rec.update(kw)
    return json.dumps(rec)


def test_request_text_cut_and_retry(spark):
    df = spark.createDataFrame([("Acme", "CRM", "acme.com", "d" * 7000)], "name STRING, category STRING, website STRING, doc STRING")
    plain = df.select(request_text("name", "category", "website", "doc").alias("r")).collect()[0]["r"]
    retry = df.select(request_text("name", "category", "website", "doc", retry=True).alias("r")).collect()[0]["r"]
    assert "Acme" in plain and "CRM" in plain and "acme.com" in plain
    assert "d" * 6000 in plain and "d" * 6001 not in plain
    assert retry == plain + RETRY_SUFFIX


def test_parse_record_errors(spark):
    rows = [
        (1, _full(), None),
        (2, json.dumps({"category": "x"}), None),
        (3, _full(auth_method=["OAuth 2.0", "API key"]), None),
        (4, "not json", None),
        (5, None, "timeout"),
        (6, _full(description=""), None),
        (7, _full(api_scope=None), None),
        (8, _full(blocker={"a": 1}, buildability=True), None),
    ]
    df = spark.createDataFrame(rows, "id INT, payload STRING, error STRING")
    out = {r["id"]: r for r in parse_record(df).collect()}
    assert out[1]["error"] is None and out[1]["auth_method"] == "x"
    assert out[2]["error"].startswith("field(s) without text: auth_method") and "category" not in out[2]["error"]
    assert out[3]["error"] == "field(s) without text: auth_method" and out[3]["auth_method"] is None
    assert out[4]["error"] == "answer is not a JSON object"
    assert out[5]["error"] == "timeout"
    assert out[6]["error"] is None and out[6]["description"] is None
    assert out[7]["error"] == "field(s) without text: api_scope"
    assert set(out[8]["error"].removeprefix("field(s) without text: ").split(", ")) == {"blocker", "buildability"}
    filled = {r["id"]: r for r in parse_record(df.withColumn("est", F.lit("Small")), scope_estimate="est").collect()}
    assert filled[7]["error"] is None and filled[7]["api_scope"] == "Small" and filled[1]["api_scope"] == "x"


def test_requests_name_the_allowed_values(spark):
    df = spark.createDataFrame([("Acme", "CRM", "acme.com", "d" * 7000)], "name STRING, category STRING, website STRING, doc STRING")
    text = df.select(request_text("name", "category", "website", "doc").alias("r")).collect()[0]["r"]
    for field, values in fixed.ALLOWED_VALUES.items():
        assert f"- {field}: " in text and all(v in text for v in values)
    about = df.select(description_request("name", "category", "website", "doc").alias("r")).collect()[0]["r"]
    assert "d" * 5000 in about and "d" * 5001 not in about


def test_extract_batch_gets_the_request_and_captures_exceptions(spark):
    def make():
        import json as _json

        def fn(request, row):
            if row["name"] == "bad":
                raise ValueError("boom")
            return _json.dumps({"description": request + row["document"][:3]})

        return fn

    df = spark.createDataFrame([(1, "ok", "w", "c", "hello", "R:"), (2, "bad", "w", "c", None, "R:")], "id INT, name STRING, website STRING, category STRING, document STRING, request STRING")
    out = {r["id"]: r for r in extract_batch(df, make).collect()}
    assert out[2]["payload"] is None and out[2]["error"] == "boom" and out[2]["document"] is None
    assert json.loads(out[1]["payload"])["description"] == "R:hel" and out[1]["document"] == "hello"


def test_extract_batch_hands_on_arrow_columns(spark):
    """Only a few rows' texts are Python objects at a time: no whole batch goes through pandas; other columns pass as they are."""

    def make():
        return lambda request, row: request + row["name"]

    df = spark.range(2000).coalesce(1).selectExpr("id", "concat('n', id) AS name", "'w' AS website", "'c' AS category", "'d' AS document", "'R' AS request", "X'00FF' AS raw")
    asked = extract_batch(df, make)
    out = asked.collect()
    assert [(r["id"], r["payload"]) for r in out] == [(i, f"Rn{i}") for i in range(2000)]
    assert all(r["raw"] == b"\x00\xff" and r["error"] is None for r in out)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
