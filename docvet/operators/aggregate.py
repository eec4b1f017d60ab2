"""Aggregation, ranking and summary operators.

Scale notes
-----------
* Every count is a ``groupBy`` with partial aggregation before the shuffle,
  so a hot label (a third of all rows) is combined map-side and never lands
  in one task as raw rows.
* Totals and min/max that other rows need are scalar subqueries
  (``DataFrame.scalar()``): a one-value job whose result is inlined, not a
  join of a one-row table against the data.
* Zero-filling (crosstabs, histogram) uses the set of observed labels, a
  value bounded by label cardinality, never the rows themselves.
* Ties are broken by first appearance (``min(id)``) and then by the value, so
  results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of, ratio_round, round_half_up, share_tenths, utrim
from docvet.session import written


def distribution(df: DataFrame, value: str | Column, order: str | Column = "id") -> DataFrame:
    """G1: value counts, NULL and "" read as Unknown.  Columns: value, n, first_seen."""
    v = col_of(value).cast("string")
    v = F.when(v.isNull() | (v == ""), F.lit("Unknown")).otherwise(v)
    return df.groupBy(v.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(col_of(order)).alias("first_seen")
    )


def counter(df: DataFrame, value: str | Column, order: str | Column = "id") -> DataFrame:
    """Counts of non-blank values (NULL and whitespace-only dropped)."""
    v = col_of(value).cast("string")
    kept = df.where(v.isNotNull() & (utrim(v) != ""))
    return kept.groupBy(v.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(col_of(order)).alias("first_seen")
    )


def row_total(df: DataFrame) -> Column:
    """G10 as a scalar subquery: ``count(*)`` of the whole frame."""
    return df.select(F.count(F.lit(1))).scalar()


def with_share(counts: DataFrame, total: Column) -> DataFrame:
    """Share of *all* rows in percent, one decimal, half-up."""
    return counts.withColumn("share", share_tenths(F.col("n"), total))


def multi_distribution(
    df: DataFrame,
    fields: Mapping[str, str | Column],
    order: str | Column = "id",
    drop_blank: bool = False,
) -> DataFrame:
    """Distributions of many fields in one pass: unpivot, then one groupBy.

    The unpivot multiplies rows by the number of fields, but labels are few,
    so the partial aggregate collapses them before the exchange.
    Columns: field, value, n, first_seen.
    """
    pairs = [F.struct(F.lit(name).alias("field"), col_of(c).cast("string").alias("value")) for name, c in fields.items()]
    long = df.select(col_of(order).alias("__order"), F.explode(F.array(*pairs)).alias("__p")).select(
        "__order", "__p.field", "__p.value"
    )
    if drop_blank:
        long = long.where(F.col("value").isNotNull() & (utrim("value") != ""))
    else:
        long = long.withColumn(
            "value", F.when(F.col("value").isNull() | (F.col("value") == ""), F.lit("Unknown")).otherwise(F.col("value"))
        )
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("__order").alias("first_seen"))


def top_k(counts: DataFrame, k: int | Mapping[str, int] = fixed.TOP_K, group: str = "field") -> DataFrame:
    """The k largest counts per group, ties by first appearance then value.

    ``row_number() <= k`` is planned as a WindowGroupLimit, which also limits
    each map-side partition before the shuffle.  Adds ``pos`` (1-based).
    """
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc("first_seen"), F.asc("value"))
    ranked = counts.withColumn("pos", F.row_number().over(w))
    if isinstance(k, Mapping):
        limit = F.lit(fixed.TOP_K)
        for g, kk in k.items():
            limit = F.when(F.col(group) == g, F.lit(kk)).otherwise(limit)
        return ranked.where(F.col("pos") <= limit)
    return ranked.where(F.col("pos") <= k)


def leaders(counts: DataFrame, fields: Sequence[str], group: str = "field", missing: str = "N/A") -> DataFrame:
    """The leading value of each of ``fields`` (largest n, then first seen), ``N/A`` for one without values.

    ``min_by`` is an aggregate, so it is combined map-side like a count.  The
    fields are the caller's list, joined to the few rows of leaders.
    """
    best = F.min_by("value", F.struct(-F.col("n"), F.col("first_seen")))
    found = counts.groupBy(group).agg(best.alias("leader"))
    asked = counts.sparkSession.createDataFrame([(f,) for f in fields], f"{group} string")
    return asked.join(found, group, "left").select(group, F.coalesce("leader", F.lit(missing)).alias("leader"))


def crosstab_long(df: DataFrame, row: str | Column, col: str | Column, missing: str = "Unknown") -> DataFrame:
    """Counts of (row label, column label), zero-filled over observed labels.

    A NULL label counts under ``missing``.  The column side is meant for a
    closed set of labels: the observed ones are one array, computed by a
    scalar subquery, over which each row label expands.
    Columns: row_label, col_label, n.
    """
    label = lambda c: F.coalesce(col_of(c).cast("string"), F.lit(missing))
    counts = df.groupBy(label(row).alias("row_label"), label(col).alias("col_label")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "crosstab")
    labels = counts.select(F.array_sort(F.collect_set("col_label"))).scalar()
    per_row = counts.groupBy("row_label").agg(F.map_from_entries(F.collect_list(F.struct("col_label", "n"))).alias("m"))
    expanded = per_row.select("row_label", "m", F.explode(labels).alias("col_label"))
    return expanded.select("row_label", "col_label", F.coalesce(F.col("m")[F.col("col_label")], F.lit(0)).cast("bigint").alias("n"))


#: What a row of a sparse crosstab stands for, by its grouping id: the bits of the labels that are left out.
SPARSE_KINDS = ("cell", "row", "col", "total")


def crosstab_sparse(df: DataFrame, row: str | Column, col: str | Column, missing: str = "Unknown") -> DataFrame:
    """G5 for two open columns: the pairs that occur, and both margins, from one ``GROUPING SETS`` pass.

    Nothing is zero-filled, so the output grows with the pairs that occur and not with the product of the
    labels; no label list is gathered.  Columns: kind (cell, row, col, total), row_label and col_label
    (NULL where the kind sums over them), n.  A NULL label counts under ``missing``.
    """
    label = lambda c: F.coalesce(col_of(c).cast("string"), F.lit(missing))
    pairs = df.select(label(row).alias("row_label"), label(col).alias("col_label"))
    r, c = F.col("row_label"), F.col("col_label")
    sets = pairs.groupingSets([[r, c], [r], [c], []], r, c).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.element_at(F.array(*map(F.lit, SPARSE_KINDS)), (F.col("g") + 1).cast("int"))
    # the total of no rows is a row of its own in SQL; without rows there is nothing to sum
    return sets.where(F.col("n") > 0).select(kind.alias("kind"), "row_label", "col_label", "n")


def zero_filled(sparse: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The cells of a sparse crosstab with a zero for each of ``labels``, a closed list, that a row does not have.

    Columns: row_label, col_label, n.  Cells of other labels stay as they are.
    """
    cells = sparse.where(F.col("kind") == "cell").select("row_label", "col_label", "n")
    zeros = sparse.where(F.col("kind") == "row").select("row_label", F.explode(F.array(*map(F.lit, labels))).alias("col_label"), F.lit(0).alias("n"))
    return cells.union(zeros).groupBy("row_label", "col_label").agg(F.sum("n").alias("n"))


def crosstab_wide(df: DataFrame, row: str | Column, col: str | Column, labels: Sequence[str] | None = None) -> DataFrame:
    """G5 wide: one column per label, zeros for absent pairs.

    With ``labels`` the pivot needs no extra job; without, Spark finds them
    and refuses more than ``spark.sql.pivotMaxValues`` (a size check).
    """
    pairs = df.select(col_of(row).cast("string").alias("row_label"), col_of(col).cast("string").alias("col_label"))
    piv = pairs.groupBy("row_label").pivot("col_label", list(labels) if labels is not None else None)
    wide = piv.agg(F.count(F.lit(1)))
    value_cols = [c for c in wide.columns if c != "row_label"]
    return wide.na.fill(0, subset=value_cols)


def value_at_rank(counts: DataFrame, position: int, value: str = "value", n: str = "n", gather: int = 4096, splitters: int = 63) -> float | None:
    """The value at ``position`` (from 0) of all values in order, given with their counts; NULL and NaN take no place.

    While more than ``gather`` distinct values lie between the bounds, some of them (those with the
    smallest hashes) split the rest into intervals, whose sizes are counted, and the bounds move to the
    interval that holds the position.  Values are only compared, never subtracted or scaled, so infinite
    ones and any range are ordinary; and as every splitter is itself a value, every round leaves fewer.
    At most ``gather`` values are at the driver.
    """
    v = F.col(value).cast("double")
    inside = counts.select(v.alias("v"), F.col(n).alias("n")).where(v.isNotNull() & ~F.isnan(v))
    while True:
        few = inside.limit(gather + 1).collect()
        if len(few) <= gather:
            for known, k in sorted(map(tuple, few)):
                if position < k:
                    return known
                position -= k
            return None
        cuts = sorted(r[0] for r in inside.select("v").orderBy(F.xxhash64("v"), "v").limit(splitters).collect())
        interval = sum((F.when(F.col("v") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        for _, k, low, high in sorted(map(tuple, inside.groupBy(interval.alias("b")).agg(F.sum("n"), F.min("v"), F.max("v")).collect())):
            if position < k:
                inside = inside.where(F.col("v").between(low, high))
                break
            position -= k
        else:
            return None


def median_of_counts(counts: DataFrame, value: str = "value", n: str = "n", gather: int = 4096) -> float | None:
    """Exact median of values given with their counts; None without any.  NULL and NaN are no values; infinite ones are."""
    v = F.col(value).cast("double")
    total = counts.where(v.isNotNull() & ~F.isnan(v)).agg(F.sum(n)).first()[0]
    if not total:
        return None
    low = value_at_rank(counts, (total - 1) // 2, value, n, gather)
    high = low if total % 2 else value_at_rank(counts, total // 2, value, n, gather)
    middle = (low + high) / 2
    return middle if math.isfinite(middle) else low / 2 + high / 2


def numeric_summary(df: DataFrame, value: str | Column, approx: bool = False) -> DataFrame:
    """Mean and median (2 decimals), min and max (truncated to integers); 0 when empty.

    One pass counts the distinct values, written once; all four figures come
    from these counts, the median by ``median_of_counts``.  ``approx=True``
    takes the median by ``percentile_approx`` over the rows instead.

    NaN is a missing value.  Infinite values count like others: they are smallest or largest, and the
    mean follows them.  A minimum or maximum that no long can hold is NULL.
    """
    v = col_of(value).cast("double")
    known = F.col("v").isNotNull() & ~F.isnan("v")
    if approx:
        rows = df.select(v.alias("v"), F.lit(1).alias("n")).where(known)
        return _summary(rows, F.percentile_approx("v", 0.5, 10000).cast("double"))
    counts = written(df.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).where(known), "values")
    return _summary(counts, F.lit(median_of_counts(counts, "v")).cast("double"))


def _summary(counts: DataFrame, median: Column) -> DataFrame:
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    whole = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(c.try_cast("bigint"))
    return counts.agg(
        F.coalesce(_two_places(mean), F.lit(0.0)).alias("average"),
        F.coalesce(_two_places(median), F.lit(0.0)).alias("median"),
        whole(F.min("v")).alias("lowest"),
        whole(F.max("v")).alias("highest"),
    )


def _two_places(c: Column) -> Column:
    """Half-up to two decimals; beyond 1e15 a double has none, and stays as it is."""
    return F.when(F.isnan(c) | (F.abs(c) >= 1e15), c).otherwise(round_half_up(c, 2))


def confidence_stats(df: DataFrame, value: str | Column) -> DataFrame:
    """Mean (2 decimals, half-up by integer arithmetic), min, max of integer scores; 0 when empty."""
    v = col_of(value).cast("bigint")
    return df.agg(
        F.coalesce(ratio_round(F.sum(v), F.count(v), 2), F.lit(0.0)).alias("mean"),
        F.coalesce(F.min(v), F.lit(0)).alias("min"),
        F.coalesce(F.max(v), F.lit(0)).alias("max"),
    )


def flag_count(df: DataFrame, flag: str | Column) -> DataFrame:
    """Number of flagged rows."""
    return df.agg(F.count_if(col_of(flag)).cast("bigint").alias("flagged"))


def review_rate(df: DataFrame, flag: str | Column) -> DataFrame:
    """Mean of the flag x 100, 2 decimals (0 when empty)."""
    f = col_of(flag)
    return df.agg(F.coalesce(ratio_round(F.count_if(f) * F.lit(100), F.count(F.lit(1)), 2), F.lit(0.0)).alias("review_rate"))


def histogram(df: DataFrame, value: str | Column, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """``bins`` equal-width bins from min to max, last bin closed, zero-filled.

    min and max are scalar subqueries; when min = max the range is widened by
    0.5 on each side, so every value lands in the middle bin.
    Columns: bin, lo, hi, n.
    """
    v = col_of(value).cast("double")
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    bounds = vals.agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    lo_c = bounds.select(F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn"))).scalar()
    hi_c = bounds.select(F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))).scalar()
    idx = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo_c) * F.lit(float(bins)) / (hi_c - lo_c))).cast("int")
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    # one row (the bounded bin map) expands to the bin domain; no join needed
    bin_col = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    out = per.select(bin_col, "m")
    width = (hi_c - lo_c) / F.lit(float(bins))
    return out.select(
        F.col("bin"),
        (lo_c + F.col("bin") * width).alias("lo"),
        (lo_c + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).cast("bigint").alias("n"),
    ).where(lo_c.isNotNull())


def by_category(df: DataFrame, category: str | Column) -> DataFrame:
    """Rows per category."""
    return df.groupBy(col_of(category).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
