"""Top values of open columns without counting every value (G2 + G11 at scale).

A column with as many values as rows makes its counter a shuffle of the whole column, although a top k
list needs a handful of them.  Here each partition first sums up its values in a bounded summary
(Misra-Gries, a chunk of values at a time: the largest counters, and how much has been taken off all of them).  Summaries merge by
addition and bound every value's count from below and above.  Where the k-th largest lower bound is
above all that was taken off, no value outside the summaries can be among the first k: then only the
values whose upper bound reaches that far are counted, exactly.  Where the bound proves nothing (counts
are too even) the field is counted in full, so the result is that of ``top_k`` over ``counter`` always.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of, utrim
from docvet.operators.aggregate import top_k
from docvet.session import written

#: Counters of one field that a partition keeps.
CAPACITY = 1024
#: Values of one field that are counted together before they enter its counters.
CHUNK = 1 << 17
#: Candidates that are broadcast to the second pass; more are joined by a shuffle.
BROADCAST_CANDIDATES = 100_000


def shrink(counters: dict[str, int], capacity: int) -> int:
    """Cut ``counters`` to ``capacity``: take the largest count that does not fit off all; returns that count."""
    if len(counters) <= capacity:
        return 0
    off = sorted(counters.values(), reverse=True)[capacity]
    for value in [v for v, n in counters.items() if n <= off]:
        del counters[value]
    for value in counters:
        counters[value] -= off
    return off


def chunk_counts(values: list[pa.Array], capacity: int) -> tuple[list[tuple[str, int]], int]:
    """The ``capacity`` largest counts of the values less the next one, as ``shrink`` cuts them; and what was taken off."""
    counted = pa.chunked_array(values, pa.string()).value_counts()
    counts = counted.field("counts").to_numpy()
    off = 0
    if len(counts) > capacity:
        off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        counted, counts = counted.filter(pa.array(counts > off)), counts[counts > off]
    return list(zip(counted.field("values").to_pylist(), (counts - off).tolist(), strict=True)), off


def summaries(long: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """(field, value) rows -> per partition and field at most ``capacity`` rows (field, value, low), and one
    without a value whose ``low`` is what has been taken off: a value's count lies between its low and low + that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, dict[str, int]] = {}
        taken: dict[str, int] = {}
        waiting: dict[str, list[pa.Array]] = {}

        def enter(field: str):
            counts, off = chunk_counts(waiting.pop(field), capacity)
            mine = counters.setdefault(field, {})
            for value, n in counts:
                mine[value] = mine.get(value, 0) + n
            taken[field] = taken.get(field, 0) + off + shrink(mine, capacity)

        for batch in batches:
            fields = batch.column(0)
            for field in pc.unique(fields).to_pylist():
                values = waiting.setdefault(field, [])
                values.append(batch.column(1).filter(pc.equal(fields, field)).cast(pa.string()))
                if sum(map(len, values)) >= chunk:
                    enter(field)
        for field in list(waiting):
            enter(field)
        rows = [(f, v, n) for f, c in counters.items() for v, n in c.items()] + [(f, None, n) for f, n in taken.items()]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["field", "value", "low"])

    return long.select("field", "value").mapInArrow(run, "field string, value string, low long")


def _filled() -> Column:
    return F.col("value").isNotNull() & (utrim("value") != "")


def candidates(long: DataFrame, k: int | Mapping[str, int], capacity: int = CAPACITY) -> DataFrame:
    """(field, value) of every value that may be among the first k of its field, ``value`` NULL for a field where
    the bounds prove nothing."""
    merged = written(summaries(long, capacity).groupBy("field", "value").agg(F.sum("low").alias("low")), "summaries")
    taken = merged.where(F.col("value").isNull()).select("field", F.col("low").alias("taken"))
    counted = merged.where(_filled())  # a blank value is summed up like others, and is no candidate
    limit = F.lit(fixed.TOP_K if isinstance(k, Mapping) else k)
    for field, n in k.items() if isinstance(k, Mapping) else ():
        limit = F.when(F.col("field") == field, F.lit(n)).otherwise(limit)
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("low"), "value")))
    # one row per field: the least of its first k lower bounds, 0 if it has fewer than k values
    kth = ranked.where(F.col("at") <= limit).groupBy("field").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    kth = kth.select("field", F.when(F.col("n") == limit, F.col("least")).otherwise(0).alias("kth"))
    fields = written(taken.join(kth, "field", "left").select("field", "taken", F.coalesce("kth", F.lit(0)).alias("kth")), "bounds")
    proven = (F.col("taken") == 0) | (F.col("kth") > F.col("taken"))
    reach = counted.join(fields.where(proven), "field").where(F.col("low") + F.col("taken") >= F.col("kth")).select("field", "value")
    return written(reach.union(fields.where(~proven).select("field", F.lit(None).cast("string"))), "candidates")


def top_values(
    df: DataFrame,
    fields: Mapping[str, str | Column],
    k: int | Mapping[str, int] = fixed.TOP_K,
    order: str | Column = "id",
    capacity: int = CAPACITY,
) -> DataFrame:
    """G2 + G11: the k largest counts of the non-blank values of each field, ties by first appearance, then value.

    Equal to ``top_k`` over the fields' counters: field, value, n, first_seen, pos.
    """

    def long(names) -> DataFrame:
        pairs = [c for name in names for c in (F.lit(name), col_of(fields[name]).cast("string"))]
        rows = df.select(col_of(order).alias("__order"), F.stack(F.lit(len(names)), *pairs).alias("field", "value"))
        return rows.where(F.col("value").isNotNull())

    found = candidates(long(list(fields)), k, capacity)
    named = found.where(F.col("value").isNotNull())
    open_fields = [r["field"] for r in found.where(F.col("value").isNull()).collect()]  # some of the caller's fields
    proven = [name for name in fields if name not in open_fields]
    parts = [long(open_fields)] if open_fields else []
    if proven:
        few = F.broadcast(named) if named.count() <= BROADCAST_CANDIDATES else named
        parts.append(long(proven).join(few, ["field", "value"], "left_semi").select("__order", "field", "value"))
    counted = reduce(DataFrame.union, parts)
    counts = counted.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("__order").alias("first_seen"))
    return top_k(counts.where(_filled()), k)
