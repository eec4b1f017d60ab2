"""Incremental use (H1, H2) with Structured Streaming.

H1: documents arriving as files are turned into verified result records and
appended by the Parquet file sink, whose commit log makes each micro-batch
land exactly once even when a batch is retried after a lost executor or a
restarted driver.

H2: label distributions kept current while records arrive: a streaming
aggregation in complete mode (state is one row per label, bounded by label
cardinality; there is no event time, so no watermark is needed).  Each
micro-batch writes a folder of its own and points to it when it is complete
(``streaming.published``).  The whole report is kept current by
``streaming.report_state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.plans.analysis import verified_records
from docvet.sources.records import records_from_documents
from docvet.streaming.published import publish, read_published


def documents_stream(spark: SparkSession, source_dir: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """The files of a folder as they arrive; a path that is one file is streamed from its folder by its name."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(source_dir)


def stream_results(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, schema, max_files_per_trigger: int | None = None):
    """H1: verify arriving documents and append the results (runs until the
    files present at start are processed: ``availableNow``)."""
    docs = documents_stream(spark, source_dir, schema, max_files_per_trigger)
    results = verified_records(records_from_documents(docs))
    q = (
        results.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def stream_distribution(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    schema,
    field: str,
    max_files_per_trigger: int | None = None,
    state_partitions: int | None = None,
):
    """H2: running counts of ``field`` values; the latest complete table is
    written per micro-batch to ``sink_dir/batch=<id>``.

    The state holds one row per label, so its partition count is sized to
    the labels, not to the input: ``state_partitions`` (default: the
    cluster's default parallelism).  Input files are still read in parallel
    and pre-aggregated before the shuffle.  Spark fixes the number in the
    checkpoint at the first start; the session setting is restored at once.
    """
    src = documents_stream(spark, source_dir, schema, max_files_per_trigger)
    counts = src.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("Unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(spark, sink_dir, batch_id, lambda: batch)

    parts = state_partitions or spark.sparkContext.defaultParallelism
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        q = (
            counts.writeStream.outputMode("complete")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    return q


def latest_distribution(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The table published by the last complete micro-batch of H2."""
    table = read_published(spark, sink_dir)
    if table is None:
        raise FileNotFoundError(f"no distribution has been published in {sink_dir}")
    return table
