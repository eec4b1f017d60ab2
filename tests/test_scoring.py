"""Extraction scoring."""

import pytest
from pyspark.sql import functions as F

from docvet.functions.scoring import confidence, description_fallback, endpoint_count, fill_count, scope_bucket, stated_count
from docvet.sources.records import research_records


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v STRING").select(fn(F.col("v")).alias("r")).collect()[0]["r"]


def test_confidence_values(spark):
    df = spark.range(11).select(F.col("id").alias("f"))
    got = [r["c"] for r in df.select(confidence("f").alias("c")).orderBy("f").collect()]
    assert got == [0, 0, 0, 9, 22, 35, 48, 61, 74, 87, 95]
    got = [r["c"] for r in df.select(confidence("f", retry=True).alias("c")).orderBy("f").collect()]
    assert got[-1] == 95 and got[-2] == 82


def test_confidence_counts_on_records(spark):
    # expected counts of E10 over the research records at sf0.01
    rr = research_records(spark, "/root/testdata/sf0.01")
    got = {r["c"]: r["count"] for r in rr.select(confidence(fill_count()).alias("c")).groupBy("c").count().collect()}
    assert got == {9: 3, 22: 3, 35: 23, 48: 82, 61: 139, 74: 290, 87: 254, 95: 206}


@pytest.mark.parametrize(
    "text,endpoints,stated,bucket",
    [
        ("GET /a and post /b/c then DELETE /x", 3, 0, "Small"),
        ("12345 endpoints", 0, 2345, "Very Large"),
        ("about 120 routes", 0, 120, "Medium"),
        ("We have 250 API methods", 0, 250, "Large"),
        ("   ", 0, 0, "Unknown"),
        (None, 0, 0, "Unknown"),
        ("no numbers here", 0, 0, "Unknown"),
        ("FORGET /x", 0, 0, "Unknown"),  # needs a word boundary before the verb
    ],
)
def test_scope(spark, text, endpoints, stated, bucket):
    assert one(spark, endpoint_count, text) == endpoints
    assert one(spark, stated_count, text) == stated
    assert one(spark, scope_bucket, text) == bucket


def test_description_fallback(spark):
    df = spark.createDataFrame(
        [("Acme", "Acme API", "  Acme  builds\n rockets  "), ("Acme", "Real text", "x"), ("Acme", None, "a " * 300)],
        "name STRING, d STRING, sub STRING",
    )
    got = [r["r"] for r in df.select(description_fallback("d", "name", "sub").alias("r")).collect()]
    assert got[0] == "Acme builds rockets"
    assert got[1] == "Real text"
    assert len(got[2]) == 200
