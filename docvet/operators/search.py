"""Text search over a table by an index of trigrams (B8 at scale).

``table_search`` reads every row for every query.  The index is built once: postings (trigram, key) of
each row's searched text, clustered by trigram, how many rows have each trigram, and the rows clustered
by key.  A query reads the postings of its rarest trigrams, takes the keys that have them all, fetches
those rows and verifies each by the very test of ``table_search``; so the result is the same, whatever
the trigrams let through.  Files and row groups of other trigrams and keys are pruned by their bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions.text import col_of
from docvet.operators.select import search_cells, table_search

#: Trigrams of a query whose postings are read, rarest first.
RAREST = 4
#: Keys that go to the scan of the rows as a pushed-down list; more are joined.
LISTED_KEYS = 1000


@dataclass(frozen=True)
class SearchIndex:
    """An index below ``path`` over ``cells`` of rows named by ``key``."""

    spark: SparkSession
    path: str
    key: str
    cells: tuple[str, ...]

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def candidates(self, query: str, rarest: int = RAREST) -> DataFrame | None:
        """Keys of the rows that have the query's rarest trigrams; None if it is too short to have one."""
        q = query.strip().lower()
        grams = list(dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2)))
        if not grams:
            return None
        known = {r["gram"]: r["n"] for r in self._read("grams").where(F.col("gram").isin(grams)).collect()}
        chosen = sorted(grams, key=lambda g: (known.get(g, 0), g))[:rarest]
        if known.get(chosen[0], 0) == 0:
            return self._read("postings").select(self.key).limit(0)
        hits = self._read("postings").where(F.col("gram").isin(chosen))
        # a row has a trigram once in the postings; a repeated key may reach the number by two rows, and is verified
        return hits.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col("n") >= len(chosen)).select(self.key)

    def search(self, query: str, rarest: int = RAREST) -> DataFrame:
        """The rows that ``table_search`` gives."""
        rows, keys = self._read("rows"), self.candidates(query, rarest)
        if keys is not None:
            some = keys.limit(LISTED_KEYS + 1).collect()
            named = F.col(self.key).isin([r[0] for r in some]) if len(some) <= LISTED_KEYS else None
            found = rows.where(named) if named is not None else rows.join(keys, self.key, "left_semi")
            # rows without a key can't be posted: they are few, or all are read
            rows = found.select(*rows.columns).union(rows.where(F.col(self.key).isNull()))
        return table_search(rows, self.cells, query)


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    last = F.char_length(text) - 2
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))
    return F.when(F.coalesce(last < 1, F.lit(True)), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def build_index(df: DataFrame, key: str, cells: Sequence[str], path: str) -> SearchIndex:
    """Write the index of ``df`` below ``path``.  A key may repeat; rows without one are read by every query.

    A trigram that every row has is split over partitions by key, so no task holds all of its postings.
    """
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    named = df.where(col_of(key).isNotNull())
    postings = named.select(key, F.explode(trigrams(search_cells(cells))).alias("gram"))
    postings.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").parquet(f"{path}/postings")
    grams = df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    return SearchIndex(df.sparkSession, path, key, tuple(cells))
