"""Both reports kept current while records arrive (H2 for the whole report).

The state of a report is its counts: per (report, section, key, label) how many records have it and
which one was first.  Counts of any split of the records merge by sum and minimum, so each micro-batch
is counted on its own, its counts are merged into the published state, and the result is published as
the next one.  All figures and sections (shares, confidence summary with its exact median, findings,
leaders, zero-filled crosstabs) are read off the state by the same code as the batch reports, so after
any number of batches the lines equal those of one report over all records.

The state has one row per label that occurs, whatever the number of records; it is a plain table, not a
state store, merged by one small shuffle.  A batch that is run again (a lost driver) starts from the
same published state, so no record counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.plans.analysis import as_results, normalised_frame, raw_frame
from docvet.plans.report import normalised_lines_of, raw_counts, raw_lines_of, raw_summary_of, report_counts
from docvet.sources.records import records_from_documents
from docvet.streaming.incremental import documents_stream
from docvet.streaming.published import publish, read_published

NORMALISED, RAW = "normalised", "raw"
_KEY = ("report", "section", "key", "label")


def batch_counts(results: DataFrame, order: str = "id") -> DataFrame:
    """Counts of one set of result rows for both reports: report, section, key, label, n, first_seen."""
    norm = report_counts(normalised_frame(results, order)).select(F.lit(NORMALISED).alias("report"), "section", "key", "label", "n", "first_seen")
    raw = raw_counts(raw_frame(results, order))
    raw = raw.select(F.lit(RAW).alias("report"), "section", F.lit(None).cast("string").alias("key"), F.col("value").alias("label"), "n", "first_seen")
    return norm.union(raw)


def merge(*states: DataFrame) -> DataFrame:
    """The counts of all records behind any of the states; they must share no record."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def update_state(spark: SparkSession, state_dir: str, batch_id: int, results: DataFrame, order: str = "id") -> None:
    """Merge a batch of result rows into the published state, once."""

    def next_state() -> DataFrame:
        before = read_published(spark, state_dir)
        counts = batch_counts(results, order)
        return merge(counts) if before is None else merge(before, counts)

    publish(spark, state_dir, batch_id, next_state)


def _document_results(docs: DataFrame) -> DataFrame:
    return as_results(records_from_documents(docs))


def stream_report(
    spark: SparkSession,
    source_dir: str,
    state_dir: str,
    checkpoint_dir: str,
    schema,
    to_results: Callable[[DataFrame], DataFrame] = _document_results,
    order: str = "id",
    max_files_per_trigger: int | None = None,
):
    """Count the arriving files into the state (runs until the files present at start are processed)."""
    src = documents_stream(spark, source_dir, schema, max_files_per_trigger)
    q = (
        src.writeStream.foreachBatch(lambda batch, batch_id: update_state(batch.sparkSession, state_dir, batch_id, to_results(batch), order))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def _of(spark: SparkSession, state_dir: str, report: str) -> DataFrame:
    state = read_published(spark, state_dir)
    if state is None:
        raise FileNotFoundError(f"no report state has been published in {state_dir}")
    return state.where(F.col("report") == report).drop("report")


def current_raw_lines(spark: SparkSession, state_dir: str) -> DataFrame:
    """The raw report's counters of all records so far: section, value, n, first_seen, share."""
    return raw_lines_of(_of(spark, state_dir, RAW).drop("key").withColumnRenamed("label", "value"))


def current_raw_summary(spark: SparkSession, state_dir: str) -> DataFrame:
    """The closed part of the raw report, one row."""
    return raw_summary_of(_of(spark, state_dir, RAW).drop("key").withColumnRenamed("label", "value"))


def current_normalised_lines(spark: SparkSession, state_dir: str) -> DataFrame:
    """The normalised report, complete, in long form."""
    return normalised_lines_of(_of(spark, state_dir, NORMALISED))
