"""Selection operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of, utrim


def named_sample(
    spark: SparkSession,
    df: DataFrame,
    names: Sequence[str] = fixed.SAMPLE_APPS,
    name_col: str = "name",
    order: str = "id",
) -> DataFrame:
    """B1: rows whose trimmed name is in the list, first match per name, list order.

    The name list is a caller literal (a proven size bound), so it is
    broadcast.  "First match" is ``min_by(row, id)``, an aggregate combined
    map-side, so a name with millions of rows is not gathered in one task.
    Adds ``pos`` (the name's place in the list).
    """
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos INT, wanted STRING")
    hits = df.join(F.broadcast(wanted), utrim(F.col(name_col)) == F.col("wanted"), "inner")
    data_cols = [c for c in df.columns]
    first = hits.groupBy("pos").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in data_cols]), F.col(order)).alias("r"))
    return first.select("pos", "r.*")


def first_n(df: DataFrame, n: int | None, order: str = "id") -> DataFrame:
    """B2: the first ``n`` rows in file order; 0 or None keeps all rows."""
    if not n:
        return df
    return df.orderBy(order).limit(n)


def low_confidence(df: DataFrame, confidence: str | Column, flag: str | Column, threshold: int = fixed.LOW_CONFIDENCE) -> DataFrame:
    """``confidence < 80 OR flagged``."""
    return df.where((col_of(confidence) < threshold) | col_of(flag))


def as_cells(cols: Sequence[str | Column | None], names: Sequence[str]) -> list[Column]:
    """Columns as text, NULL -> "" ; a missing column (None) is "" too."""
    out = []
    for c, n in zip(cols, names):
        if c is None:
            out.append(F.lit("").alias(n))
        else:
            out.append(F.coalesce(col_of(c).cast("string"), F.lit("")).alias(n))
    return out


def example_rows(df: DataFrame, cols: Sequence[str | Column | None], names: Sequence[str], n: int = 6, order: str = "id") -> DataFrame:
    """The first ``n`` rows as text cells (a top-n: TakeOrderedAndProject)."""
    return df.orderBy(order).limit(n).select(F.col(order), *as_cells(cols, names))


def full_table(df: DataFrame, cols: Sequence[str | Column | None], names: Sequence[str], order: str = "id") -> DataFrame:
    """Every row as text cells."""
    return df.select(F.col(order), *as_cells(cols, names))


def search_cells(cells: Sequence[str | Column]) -> Column:
    """The text of a row that a search looks at: its cells side by side, lower-cased."""
    return F.lower(F.concat_ws("", *[F.coalesce(col_of(c).cast("string"), F.lit("")) for c in cells]))


def table_search(df: DataFrame, cells: Sequence[str | Column], query: str) -> DataFrame:
    """Rows whose adjacent cell text contains the trimmed, lower-cased query."""
    return df.where(search_cells(cells).contains(query.strip().lower()))
