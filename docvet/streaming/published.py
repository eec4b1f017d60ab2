"""Tables that a stream rewrites batch by batch, published when they are complete.

Each micro-batch writes a folder of its own; when all its files are there, a pointer, an empty file
named after the batch, is created beside it.  Readers follow the largest pointer and never list the
folders, so a half-written one is not seen.  A batch that is run again after its pointer was set has
nothing left to do: its table is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The folder of pointers below a sink; its name keeps it out of Spark's listings.
POINTERS = "_published"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def batch_folder(sink: str, batch_id: int) -> str:
    return f"{sink}/batch={batch_id:012d}"


def published_batch(spark: SparkSession, sink: str) -> int | None:
    """The batch whose table readers get; None before the first."""
    fs, folder = _folder(spark, f"{sink}/{POINTERS}")
    if not fs.exists(folder):
        return None
    return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=None)


def publish(spark: SparkSession, sink: str, batch_id: int, make: Callable[[], DataFrame]) -> None:
    """Write ``make()`` as the batch's table, point to it, then remove the tables before the previous one.

    The previous table stays for readers that have it open.  Nothing is done for a batch that is
    published already; an older batch than that can only come from another checkpoint.
    """
    current = published_batch(spark, sink)
    if current is not None and batch_id < current:
        raise ValueError(f"batch {batch_id} comes after batch {current}: this sink belongs to another checkpoint")
    if current != batch_id:
        make().write.mode("overwrite").parquet(batch_folder(sink, batch_id))
        fs, pointer = _folder(spark, f"{sink}/{POINTERS}/{batch_id:012d}")
        fs.create(pointer, True).close()
    for folder, number in ((sink, lambda name: name.removeprefix("batch=")), (f"{sink}/{POINTERS}", str)):
        fs, path = _folder(spark, folder)
        for status in fs.listStatus(path):
            name = number(status.getPath().getName())
            if name.isdigit() and int(name) < batch_id and int(name) != current:
                fs.delete(status.getPath(), True)


def read_published(spark: SparkSession, sink: str, schema=None) -> DataFrame | None:
    """The published table; None before the first batch is complete."""
    batch_id = published_batch(spark, sink)
    if batch_id is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(batch_folder(sink, batch_id))
