"""Document collection (D1-D8): choose pages per app and assemble their text.

Scale notes: pages are cut to 1500 characters and the top 3 per app chosen
(``row_number() <= 3``, a WindowGroupLimit that also runs map-side) *before*
anything is collected, so a group never holds more than 3 short entries.
Text assembly sorts that 3-element array by rank, so shuffle order does not
matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of
from docvet.session import written


def search_text(name: str | Column, template: str = fixed.SEARCH_TEXT) -> Column:
    """The search query text for an app."""
    before, after = template.split("{name}")
    return F.concat(F.lit(before), col_of(name).cast("string"), F.lit(after))


def top_docs(hits: DataFrame, k: int = fixed.PAGES_PER_APP, app: str = "app", rank: str = "rank", official: str = "official") -> DataFrame:
    """D3: per app, official hits if any exist, else the others; the first k by rank.

    Give it ids, or texts already cut: every row of ``hits`` is sorted and shuffled
    as it is.  Sorting by (official desc, rank) and keeping k rows puts the official hits
    first; the rows whose flag differs from the first row's are then dropped
    by a second, k-bounded window.  Adds ``pos`` (1..k).
    """
    w = Window.partitionBy(app).orderBy(F.desc(official), F.asc(rank))
    top = hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    lead = F.first(F.col(official)).over(Window.partitionBy(app).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("__lead", lead).where(F.col(official) == F.col("__lead")).drop("__lead")


def combine_pages(
    pages: DataFrame,
    app: str = "app",
    rank: str = "rank",
    url: str = "url",
    text: str = "text",
    failed: str | None = "failed",
    chars: int = fixed.CHARS_PER_PAGE,
    header: str = fixed.PAGE_HEADER,
    k: int = fixed.PAGES_PER_APP,
) -> DataFrame:
    """D4 + D5 + D6: per app, the combined document and the evidence URLs, in rank order.

    Input is normally ``top_docs`` output (with ``pos``); otherwise the first
    ``k`` pages by rank are taken, so no group ever holds more than k entries.

    * A page whose scrape failed keeps its URL in the evidence but adds no
      header and no text.
    * A page with NULL content adds its header only.
    * Text is cut to ``chars`` characters before it is sorted, shuffled or collected.
    Columns: app, document, evidence_url, n_pages.
    """
    before, after = header.split("{url}")
    cut = F.substring(F.col(text), 1, chars)
    pages = pages.select(*dict.fromkeys((app, rank, url)), cut.alias(text), *(c for c in ("pos", failed) if c and c in pages.columns))
    if "pos" not in pages.columns:
        # keep the group bounded whatever the caller passes: first k by rank
        w = Window.partitionBy(app).orderBy(F.asc(rank))
        pages = pages.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    is_failed = F.coalesce(F.col(failed), F.lit(False)) if failed and failed in pages.columns else F.lit(False)
    piece = F.when(
        is_failed, F.lit("")
    ).otherwise(F.concat(F.lit(before), F.col(url), F.lit(after), F.coalesce(F.col(text), F.lit(""))))
    entries = pages.select(F.col(app).alias("app"), F.struct(F.col(rank).alias("r"), F.col(url).alias("u"), piece.alias("p")).alias("e"))
    grouped = entries.groupBy("app").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return grouped.select(
        "app",
        F.array_join(F.transform("es", lambda e: e["p"]), "").alias("document"),
        F.array_join(F.transform("es", lambda e: e["u"]), fixed.EVIDENCE_SEPARATOR).alias("evidence_url"),
        F.size("es").alias("n_pages"),
    )


def chosen_texts(chosen: DataFrame, pages: DataFrame, chars: int = fixed.CHARS_PER_PAGE, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """D3 -> D4: the text of the chosen pages, cut before anything is shuffled: ``chosen`` with ``text`` and ``failed``.

    ``chosen`` is ``top_docs`` output over ids: it is written and read back under its own limit, which
    makes it a small filtered scan.  So where the pages are large, Spark puts a runtime filter of the
    chosen ids on their scan, and the html of other pages is neither turned into text nor exchanged.
    A page that is not there counts as failed.
    """
    few = written(chosen, "chosen").where(F.col("pos") <= fixed.PAGES_PER_APP)
    cut = F.substring(page_text(html), 1, chars)
    texts = pages.select(page_id, cut.alias("text"), F.col(html).isNull().alias("failed"))
    joined = few.join(texts, page_id, "left")
    return joined.withColumn("failed", F.coalesce("failed", F.lit(True)))


def no_hits(apps: DataFrame, hits: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Apps without any hit (anti join; the hit side is shuffled or broadcast by AQE)."""
    return apps.join(hits.select(key).distinct() if isinstance(key, str) else hits.select(*key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- FIXED VALUES
# HTML to text (D8): script/style blocks, comments, tags, entities, whitespace.
_SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
_STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"<[^>]+>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_SPACES = r"[ \t\n\r\f\x0B]+"
# ------------------------------------------------------------ END FIXED VALUES


def page_text(html: str | Column) -> Column:
    """Plain text of an HTML page, entirely with ``regexp_replace``."""
    t = col_of(html)
    t = F.regexp_replace(t, _SCRIPT, " ")
    t = F.regexp_replace(t, _STYLE, " ")
    t = F.regexp_replace(t, _COMMENT, " ")
    t = F.regexp_replace(t, _TAG, " ")
    for ent, rep in _ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(rep))
    t = F.regexp_replace(t, _SPACES, " ")
    return F.trim(t)
