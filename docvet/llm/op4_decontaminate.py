"""Benchmark decontamination: training words inside any benchmark n-gram are hits.

A window is ``window`` consecutive words of a benchmark item (a shorter item, if it has words, is
one window).  A document word inside any occurrence of a window is hit; a document is contaminated
if it has a hit and hits are at least ``1 / ratio`` of its words.

Main path: the set of benchmark windows goes to every task as a broadcast hash set, once its size in
memory, reckoned from the number of windows and words, is known to be within ``broadcast_bytes``; every document is scanned in place, no text is shuffled.
A larger benchmark takes the second path: windows of documents and of the benchmark meet on their
hash in a shuffle join, windows found are verified word by word, and hits are gathered per document.
Both give the same rows, and judge each row for itself, whatever its id.

Words: A-Z lower-cased, then runs of a-z, 0-9 and everything beyond ASCII.

Defined results: a null or wordless text has no words, no hits, and is not contaminated; items
without words are ignored; an item id that is null takes part as the empty string; repeated rows
each get a row; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.common import map_rows

#: A-Z to lower case; every ASCII byte outside a-z and 0-9 to a blank.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


#: Bytes that a window (besides its words' numbers) and a word take in a WindowSet at most, as measured with some room.
_WINDOW_BYTES, _WORD_BYTES = 300, 250


class WindowSet:
    """Every window of the benchmark: over numbered words, a hash set from window to its items."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, frozenset[str]]] = {}
        for item_id, text in items:
            alone = frozenset(("" if item_id is None else str(item_id),))  # shared by the item's windows
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                table, key = self.windows.setdefault(size, {}), ids[at : at + size].tobytes()
                found = table.setdefault(key, alone)
                if not alone <= found:
                    table[key] = found | alone

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """The number of words, the hit runs as [start, end) in words, the sorted item ids."""
        words = words_of(text)
        number = self.vocabulary.get
        ids = np.fromiter((number(w, -1) for w in words), np.int32, len(words))
        outside = np.flatnonzero(ids < 0)
        hit = np.zeros(len(words) + 1, np.int32)
        items: set[str] = set()
        # only stretches of benchmark words can hold a window
        lows = np.concatenate(([0], outside + 1))
        highs = np.concatenate((outside, [len(words)]))
        for size, table in self.windows.items():
            wide = highs - lows >= size
            for low, high in zip(lows[wide].tolist(), highs[wide].tolist(), strict=True):
                stretch = ids[low:high].tobytes()
                for at in range(high - low - size + 1):
                    found = table.get(stretch[4 * at : 4 * (at + size)])
                    if found is not None:
                        hit[low + at] += 1
                        hit[low + at + size] -= 1
                        items |= found
        covered = np.cumsum(hit[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        return len(words), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), sorted(items)


_SCHEMA = "n_words long, hit_runs array<struct<start:long,stop:long>>, item_ids array<string>"


def _by_broadcast(docs, benchmark, id_col, text_col, item_col, item_text, window):
    windows = docs.sparkSession.sparkContext.broadcast(
        WindowSet([tuple(r) for r in benchmark.select(item_col, item_text).collect()], window)
    )

    def make():
        scan = windows.value.scan

        def one(key, text):
            n, runs, items = scan(text)
            return key, n, [{"start": a, "stop": b} for a, b in runs], items

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, {_SCHEMA}", make)


def _word_array(text):
    """The words of a text as an array, by built-in functions."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    blank = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.coalesce(blank, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(blank, " "))


def _windows(words, size):
    """Array of (start, words) of every window of ``size`` words."""
    last = F.size(words) - size
    return F.when(last < 0, F.array().cast("array<struct<start:int,gram:string>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(i.alias("start"), F.concat_ws(" ", F.slice(words, i + 1, size)).alias("gram")),
        )
    )


def _by_shuffle(docs, benchmark, id_col, text_col, item_col, item_text, window):
    from docvet.llm.common import materialise

    spark = docs.sparkSession
    item_words = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), _word_array(F.col(item_text)).alias("w"))
    item_words = item_words.filter(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    grams = item_words.select("item", "size", F.explode(_windows(F.col("w"), F.col("size"))).alias("g")).select("item", "size", F.col("g.gram").alias("gram")).distinct()
    grams = materialise(grams, "grams")
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most `window` values
    numbered = materialise(docs.select(F.expr("uuid()").alias("row"), F.col(id_col).alias("id"), _word_array(F.col(text_col)).alias("w")), "words")
    hits = spark.createDataFrame([], "row string, start int, size int, item string")
    for size in sizes:
        mine = grams.filter(F.col("size") == size)
        # the words of a gram travel once per document window, its items once per gram
        found = (
            numbered.select("row", F.explode(_windows(F.col("w"), F.lit(size))).alias("g"))
            .select("row", "g.start", "g.gram", F.xxhash64("g.gram").alias("h"))
            .join(mine.select(F.xxhash64("gram").alias("h"), F.col("gram").alias("known"), "item"), "h")
            .filter("gram = known")
            .select("row", "start", F.lit(size).alias("size"), "item")
        )
        hits = hits.union(found)
    hits = materialise(hits, "hits")
    spans = hits.select("row", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:long,stop:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"].cast("long")).alias("stop"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))))),
    )
    runs = per_row.select("row", merged.alias("hit_runs"))
    items = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return (
        numbered.select("row", F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"))
        .join(runs, "row", "left")
        .join(items, "row", "left")
        .select(
            id_col,
            "n_words",
            F.coalesce("hit_runs", F.array().cast("array<struct<start:long,stop:long>>")).alias("hit_runs"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def window_set_bytes(benchmark: DataFrame, item_text: str = "text", window: int = 13) -> int:
    """What the WindowSet of the benchmark takes in memory at most: its windows, its words and its text."""
    words = F.size(_word_array(F.col(item_text))).cast("long")
    windows = F.when(words > 0, F.greatest(words - window + 1, F.lit(1))).otherwise(0)
    cost = windows * (_WINDOW_BYTES + 4 * window) + words * _WORD_BYTES + F.coalesce(F.octet_length(item_text), F.lit(0))
    return benchmark.agg(F.sum(cost)).first()[0] or 0


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Per document: id, ``n_words``, ``hit_runs`` ([start, stop) in words), ``item_ids`` (sorted as strings)."""
    path = _by_broadcast if window_set_bytes(benchmark, item_text, window) <= broadcast_bytes else _by_shuffle
    return path(docs, benchmark, id_col, text_col, item_col, item_text, window)


def contamination(hits: DataFrame, ratio: int = 20) -> DataFrame:
    """``hits`` with ``n_hit`` and ``contaminated`` (n_hit > 0 and ratio * n_hit >= n_words)."""
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words"))
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, ratio: int = 20, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay as they are.

    Within the broadcast bound a document is judged and passed on in one scan; beyond it the
    contaminated rows, found by the shuffle path, are taken out by an anti join on a row key.
    """
    if window_set_bytes(benchmark, "text", window) > broadcast_bytes:
        from docvet.llm.common import materialise

        keyed = materialise(docs.withColumn("__row", F.expr("uuid()")), "rows")
        bad = contamination(_by_shuffle(keyed, benchmark, "__row", "text", "item_id", "text", window), ratio)
        return keyed.join(bad.filter("contaminated").select("__row"), "__row", "left_anti").select(*docs.columns)
    windows = docs.sparkSession.sparkContext.broadcast(
        WindowSet([tuple(r) for r in benchmark.select("item_id", "text").collect()], window)
    )
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        scan = windows.value.scan
        for batch in batches:
            keep = []
            for value in batch.column(at):
                n, runs, _ = scan(value.as_py())
                n_hit = sum(b - a for a, b in runs)
                keep.append(not (n_hit and ratio * n_hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def oracle(window: int = 13, ratio: int = 20) -> str:
    """DuckDB SQL for the rows of the query over ``documents`` and ``benchmark``."""
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
ig AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM (SELECT item, w, least({window}, len(w)) AS n FROM iw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dg.n, item FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
        FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {ratio} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
