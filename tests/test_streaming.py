"""Incremental use (H1, H2): the stream result equals the batch result."""

from docvet.plans import catalog as C
from docvet.plans.analysis import verified_records
from docvet.sources.records import research_records

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_stream_append_equals_batch(spark):
    streamed = C.QUERIES["q_stream_append"](spark, SF)
    batch = verified_records(research_records(spark, SF))
    assert _rows(streamed.select(*batch.columns)) == _rows(batch)


def test_stream_distribution_equals_batch(spark):
    got = {r["value"]: r["n"] for r in C.QUERIES["q_stream_distribution"](spark, SF).collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet")
    want = {r["event_type"]: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert got == want
