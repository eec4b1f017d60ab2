"""Line dedup by site-relative frequency.

A host's boilerplate lines are those that stand on more than ``max_ratio`` of the host's pages, and
on ``min_pages`` pages or more; every occurrence of them is dropped on that host's pages.  A line
is the text between line feeds without blanks at either end; blank lines are never boilerplate.

Counts go through map-side partial aggregation on (host, line), so a host with a third of all pages
or a line on all of them is no hot key.  The distinct lines of a page are counted once per page.
A host has fewer boilerplate lines than its mean number of lines per page divided by ``max_ratio``;
the whole set is broadcast if it has at most ``broadcast_lines`` lines, else the lines to drop are
found by a shuffle join of (host, line) and handed to the pages by id.

Lines are compared by a 96-bit hash (xxhash64 and murmur3 of the line).

A document of which every line is boilerplate is emptied.  Copies count as pages by definition, so
a document whose copies are over ``max_ratio`` of its host loses its whole text.  With
``distinct_texts`` each distinct page text of a host counts once on both sides of the ratio (texts
compared by such a hash too), so exact copies are no evidence.  With ``groups``, which names the pages
that are near copies of each other, each group of a host counts once: a line is on it if it is on any
of its pages, so neither are near copies.

Defined results: a null host is a host of its own; a null text stays null; an empty text stays
empty; repeated rows count as pages (unless ``distinct_texts``); empty tables give no rows; other columns pass through
untouched (helper columns carry a prefix no table here uses).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.common import materialise


def _hashes(text):
    return F.struct(F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))


def _key(line):
    return _hashes(F.trim(line))


def page_key(text):
    """What tells a page's text from others: the ``page`` of ``groups``."""
    return _hashes(text)


def _page_lines(text):
    """The distinct lines of a page, as keys."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, _key))


def boilerplate_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.05,
    min_pages: int = 3,
    distinct_texts: bool = False,
    groups: DataFrame | None = None,
) -> DataFrame:
    """(host, key, pages, total): the lines above the ratio, by hash.  ``groups``: (page, group) of every text, see ``page_key``."""
    pages = docs.select(F.col(host_col).alias("host"), page_key(F.col(text_col)).alias("page"), _page_lines(F.col(text_col)).alias("keys"))
    if distinct_texts or groups is not None:
        # copies combine map-side; a page travels as the hashes of its lines
        pages = materialise(pages.groupBy("host", "page").agg(F.first("keys").alias("keys")), "pages")
    lines = pages.select("host", F.explode("keys").alias("key"))
    if groups is not None:
        grouped = pages.join(groups.select("page", "group"), "page")
        lines = grouped.select("host", "group", F.explode("keys").alias("key")).distinct()
        pages = grouped.select("host", "group").distinct()
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("pages"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return (
        counts.filter(F.col("pages") >= min_pages)
        .join(totals.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2")))
        .filter(F.col("pages") > F.col("total") * max_ratio)
        .select("host", "key", "pages", "total")
    )


def drop_boilerplate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.05,
    min_pages: int = 3,
    broadcast_lines: int = 200_000,
    distinct_texts: bool = False,
    groups: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with cleaned ``text_col``, plus ``n_lines`` and ``n_dropped`` (lines before, lines dropped)."""
    found = materialise(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages, distinct_texts, groups), "lines")
    if found.count() <= broadcast_lines:
        per_host = found.groupBy("host").agg(F.collect_set("key").alias("__drop")).withColumnRenamed("host", "__host")
        marked = docs.join(F.broadcast(per_host), docs[host_col].eqNullSafe(F.col("__host")), "left").drop("__host")
    else:
        lines = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.explode(_page_lines(F.col(text_col))).alias("key"))
        on = F.col("__host").eqNullSafe(F.col("host")) & (lines["key"] == found["key"])
        hit = lines.join(found, on).select("__id", "__host", lines["key"].alias("key"))
        # a page's own lines: bounded by the page (rows that share id and host drop the same lines)
        per_page = hit.groupBy("__id", "__host").agg(F.collect_set("key").alias("__drop"))
        on = docs[id_col].eqNullSafe(F.col("__id")) & docs[host_col].eqNullSafe(F.col("__host"))
        marked = docs.join(per_page, on, "left").drop("__id", "__host")
    lines = F.split(F.col(text_col), "\n")
    kept = F.when(
        F.col("__drop").isNotNull(),
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), _key(x))),
    ).otherwise(lines)
    out = marked.withColumn("__kept", kept)
    n, k = F.size(lines).cast("long"), F.size("__kept").cast("long")
    null = F.col(text_col).isNull()
    return out.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(null, F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        F.when(null, F.lit(0)).otherwise(n - k).cast("long").alias("n_dropped"),
    )


def oracle(max_ratio: float = 0.05, min_pages: int = 3) -> str:
    """DuckDB SQL for the rows of the query over ``documents``."""
    return f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                      unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
counts AS (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS pages FROM lines
           WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
bad AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.pages >= {min_pages} AND c.pages > t.total * {max_ratio}),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL) AS text,
                count(*) AS n_lines, count(b.line) AS n_dropped
         FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line
         GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)"""
