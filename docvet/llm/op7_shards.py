"""Sharding by minimax contiguous partition.

Equal texts are an atomic group.  Groups are ordered by the hash of their text, and that sequence
is cut into at most ``shards`` runs so that the largest run's bytes are as few as possible: the
capacity is binary-searched, a greedy walk checks whether it is feasible, and the final walk cuts.

The driver never holds the groups.  It sees cells: sums over all groups that share a hash prefix.
A greedy walk over cells knows each cut only to within a cell, so it answers feasible, infeasible
or open; the cells an open answer depends on are split (their groups are summed by a longer
prefix, one aggregation per step), until every cut is exact.  At most 16**4 cells are gathered first, then
those a step splits, which are near the cuts only; a step narrows them 256-fold.

Slots are numbered without a global sort: rows of a shard are dealt into buckets of about
``bucket_rows`` rows by the hash of their id and text, numbered there, and offset by the counts of
the buckets before.

Defined results: a null text has no bytes and is a group apart from the empty text; repeated rows
are rows; an empty table gives no rows; fewer groups than shards leave shards empty; a group
larger than the mean shard is a shard's capacity; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvet.llm.common import materialise

_FIRST, _STEP, _KEY = 4, 2, 32  # hex digits: of the first cells, of each split, of a whole key


class _Cells:
    """Consecutive cells in key order: prefix, bytes, number of groups."""

    def __init__(self, cells: list[tuple[str, int, int]]):
        self.cells = sorted(cells)
        self.ends = []
        total = 0
        for _, size, _ in self.cells:
            total += size
            self.ends.append(total)
        self.total = total

    def walk(self, capacity: int, shards: int, largest: int) -> list[tuple[int, int]]:
        """Greedy cuts at ``capacity``, each as (least, most) bytes before it; exact if equal."""
        cuts, low, high = [], 0, 0
        for _ in range(shards):
            low, high = self._reach(low + capacity, largest)[0], self._reach(high + capacity, largest)[1]
            cuts.append((low, high))
        return cuts

    def _reach(self, limit: int, largest: int) -> tuple[int, int]:
        """Bounds of the furthest group boundary at or before ``limit``."""
        if limit >= self.total:
            return self.total, self.total
        i = bisect.bisect_right(self.ends, limit)  # the cell that holds `limit`
        start = self.ends[i - 1] if i else 0
        if self.cells[i][2] == 1 or limit == start:
            return start, start
        return max(start, limit - largest + 1), limit

    def unsure(self, cuts: list[tuple[int, int]]) -> list[str]:
        """Prefixes of the cells of many groups that any uncertain cut may fall into."""
        out = set()
        for low, high in cuts:
            if low < high:
                i = bisect.bisect_right(self.ends, low)
                while i < len(self.cells) and (self.ends[i - 1] if i else 0) <= high:
                    if self.cells[i][2] > 1:
                        out.add(self.cells[i][0])
                    i += 1
        return sorted(out)


def _search(low: int, high: int, good) -> int:
    """The smallest number in [low, high] for which ``good`` holds (it holds at ``high``)."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(key, bytes) of atomic groups, key a 32-digit hex string -> the smallest capacity, the cut keys.

    A group belongs to the shard numbered by how many cut keys are at or below its key's prefix.
    """
    def cells(frame, digits):
        prefix = F.substring("key", 1, digits)
        return [tuple(r) for r in frame.groupBy(prefix.alias("p")).agg(F.sum("bytes"), F.count("*")).collect()]

    known = cells(groups, _FIRST)
    if not known:
        return 0, []
    largest = groups.agg(F.max("bytes")).first()[0]
    digits = {p: _FIRST for p, _, _ in known}
    while True:
        state = _Cells(known)
        least = max(-(-state.total // shards), largest, 1)
        most = least + largest * 2 + state.total // shards
        sure = _search(least, max(most, state.total), lambda c: state.walk(c, shards, largest)[-1][0] >= state.total)
        maybe = _search(least, sure, lambda c: state.walk(c, shards, largest)[-1][1] >= state.total)
        low_walk, high_walk = state.walk(maybe, shards, largest), state.walk(sure, shards, largest)
        split = state.unsure([(a[0], b[1]) for a, b in zip(low_walk, high_walk, strict=True)] if maybe < sure else high_walk)
        if not split:
            keys = []
            for _, at in high_walk:
                i = bisect.bisect_right(state.ends, at)
                if i < len(state.cells):
                    keys.append(state.cells[i][0])
            return sure, sorted(set(keys))
        by_length: dict[int, list[str]] = {}
        for p in split:
            by_length.setdefault(digits.pop(p), []).append(p)
        known = [c for c in known if c[0] not in set(split)]
        spark = groups.sparkSession
        for length, prefixes in by_length.items():
            chosen = F.broadcast(spark.createDataFrame([(p,) for p in prefixes], "p string"))
            part = groups.join(chosen, F.substring("key", 1, length) == F.col("p"), "left_semi")
            found = cells(part, min(length + _STEP, _KEY))
            known += found
            digits |= {c[0]: min(length + _STEP, _KEY) for c in found}


def minimax_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, bucket_rows: int = 50_000
) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``shard`` (0 to shards - 1), ``slot`` (gapless within the shard)."""
    text = F.col(text_col)
    # null texts hash apart from empty ones
    key = F.md5(F.concat(F.when(text.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(text, F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )
    rows = materialise(rows, "sizes")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    shard = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    n = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n // (shards * bucket_rows)))
    placed = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("id", "key"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "id")
    numbered = placed.withColumn("i", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("i")).alias("slot")
    )
