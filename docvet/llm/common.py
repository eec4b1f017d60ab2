"""What several of the operators share: reading a table, written cuts of the lineage, Arrow row maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.session import scratch_path

#: Code point ranges are spelt on bytes: only A-Z change, UTF-8 continuation bytes stay.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    The copy survives a lost executor, and whatever follows starts from the files instead of
    repeating the work behind ``df``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_below(key, share):
    """Whether the hash of ``key`` (a column or its name) lies in the lowest ``share`` (a column, or a number) of all hashes."""
    return F.xxhash64(key) / F.lit(2.0**64) + 0.5 < share


def smallest_hashes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About the ``n`` rows with the smallest hash of ``key`` (all of them, if they are no more): a stable sample.

    Rows are first cut to the share of hashes that holds about twice as many, so that the sort
    gathers a bounded number of rows from any number of tasks.
    """
    total = rows.count()
    near = rows.filter(hash_below(key, 2 * n / total)) if total > 2 * n else rows
    return near.orderBy(F.xxhash64(key), key).limit(n)


def map_rows(
    df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple]], batch_rows: int = 256
) -> DataFrame:
    """Apply ``make()(*columns) -> tuple`` to every row through Arrow batches.

    ``make`` runs once per task, on the executor.  Batches are cut to ``batch_rows`` rows, so the
    Python objects alive at a time are those of a few hundred rows.
    """
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                rows = [fn(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow_schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, arrow_schema, strict=True)], schema=arrow_schema
                )

    return df.select(*columns).mapInArrow(run, out_schema)
