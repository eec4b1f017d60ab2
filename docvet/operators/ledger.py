"""A ledger of answers: what was asked, in which pass, and what came back.

Asking is the one step of a run that costs money and can fail row by row, so its results are kept by
content.  A question's key is a digest of the pass, the request text and the fields that the extraction
function reads; equal questions are asked once, and a question that has an answer in the ledger is
never asked again, by this run or a later one.  A failed call is kept with its error and no answer, so
the next run asks it again.

The ledger is a folder of Parquet files that only grows.  Its rows stand for themselves: whatever part
of an interrupted pass has been written is used by the next attempt, and a question that two attempts
have answered has the answer that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.operators.extract import ExtractFn, extract_batch
from docvet.sources.files import path_exists

LEDGER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "pass", "payload", "error")])
#: Passes of a run: the first request, the stricter one, and the request for a description alone.
FIRST, STRICT, DESCRIBE = "first", "strict", "describe"
#: What the extraction function reads of a row, besides the request.
FIELDS = ("name", "website", "category", "document")


def question_key(which: str, request: str | Column, fields: Sequence[str | Column]) -> Column:
    """Digest of all that an answer can depend on; a NULL field counts as an empty one, as the function sees it."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (request, *fields)]
    # each part with its length, so that no two lists of parts read the same
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\n", F.lit(which), *(F.concat(F.char_length(t), F.lit(":"), t) for t in texts)), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the ledger; none where the folder is not there yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def answers(ledger: DataFrame, which: str) -> DataFrame:
    """Per question of a pass its answer or, while there is none, its error: key, payload, error."""
    of_pass = ledger.where(F.col("pass") == which)
    per_key = of_pass.groupBy("key").agg(F.min("payload").alias("payload"), F.max("error").alias("error"))
    return per_key.select("key", "payload", F.when(F.col("payload").isNull(), F.col("error")).alias("error"))


def ask(
    asked: DataFrame,
    make_fn: Callable[[], ExtractFn],
    path: str,
    which: str = FIRST,
    request: str = "request",
    fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """``asked`` with ``payload`` and ``error``, asking only what the ledger at ``path`` can't answer.

    ``asked`` is read twice, so it should be a written frame.  Only the request and ``fields`` go to the
    function; the other columns of ``asked`` are joined to the answers by key.
    """
    spark = asked.sparkSession
    keyed = asked.withColumn("__key", question_key(which, request, fields))
    known = answers(read_ledger(spark, path), which).where(F.col("payload").isNotNull())
    narrow = keyed.select(F.col("__key").alias("key"), F.col(request).alias("request"), *fields)
    fresh = narrow.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    answered = extract_batch(fresh, make_fn, "request", fields)
    rows = answered.select("key", F.lit(which).alias("pass"), "payload", F.coalesce("error", F.when(F.col("payload").isNull(), F.lit("empty answer"))).alias("error"))
    rows.write.mode("append").parquet(path)
    # read anew: the folder now holds this pass too
    got = answers(read_ledger(spark, path), which).withColumnRenamed("key", "__key")
    return keyed.drop("payload", "error").join(got, "__key", "left").drop("__key")
