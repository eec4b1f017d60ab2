"""The research run end to end.

catalogue (A1, B1, B2) -> hits per app (D2) -> first 3 ids per app, official
first (D3) -> their pages only, as text cut to length (D8) -> combined
document and evidence URLs (D4-D6) -> extraction request (E1) -> caller's
extraction function (E2) -> parsed record (E3) -> if wanted, a stricter second
pass over unreadable and thin answers -> if wanted, a description from a call
of its own (E4) -> fallbacks and fill-rate confidence (E4/E5/E9/E10) ->
verification and merge (F1-F8) -> result records.  Apps without hits (D7), failed calls and unreadable answers become error rows
(A6), and every app gets a log entry (A7).

Scale: pages are ranked by id; no page text takes part in the ranking's sort
and shuffle.  The chosen ids (at most 3 per app) are written and joined back to
the pages, whose text is cut before the join; Spark's runtime filter keeps the
html of other pages out of it.  All answers go to a ledger in the
shared folder (``operators.ledger``): results, errors and log read them from
there, and neither a second pass nor a run that is started again asks what has
an answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.checks import official_url
from docvet.functions.scoring import is_description_missing, scope_bucket
from docvet.functions.text import canon_category
from docvet.operators.collect import chosen_texts, combine_pages, no_hits, top_docs
from docvet.operators.extract import ExtractFn, better_answer, description_request, is_thin, keyword_extractor, parse_record, request_text
from docvet.operators.ledger import DESCRIBE, FIRST, STRICT, ask
from docvet.operators.select import first_n, named_sample
from docvet.operators.verify import score, verify_records
from docvet.session import scratch_path, written
from docvet.sources import records as REC
from docvet.sources.files import error_rows, log_entry, write_run
from docvet.sources.tables import table


@dataclass
class ResearchRun:
    """What one run gives: result records, error rows (app, error, notes), log entries (name, entry)."""

    results: DataFrame
    errors: DataFrame
    log: DataFrame

    def write(self, root: str, reset: bool = False, run_id: str | None = None) -> str:
        """Commit all outputs below ``root`` (``sources.files.write_run``); started again under its id it replaces itself."""
        return write_run(self.results, self.errors, self.log, root, reset, run_id)


def research(
    apps: DataFrame,
    hits: DataFrame,
    pages: DataFrame,
    make_extractor: Callable[[], ExtractFn],
    sample: Sequence[str] | None = None,
    limit: int | None = None,
    ledger: str | None = None,
    retry_below: int | None = None,
    make_describer: Callable[[], ExtractFn] | None = None,
) -> ResearchRun:
    """Run over a catalogue (id, name, website, category).

    ``hits``: app, rank, url, official, page_id; ``pages``: page_id, html (NULL: the scrape failed).
    ``ledger``: the folder that keeps the answers; without one this run's own.  ``retry_below``: ask
    again, stricter, what could not be read or has fewer fields filled; a readable strict answer takes
    the place of the first, at the retry's penalty.  ``make_describer``: the function that is asked for a
    description where the answer has none; without it the document's first words stand in.
    """
    ledger = ledger or scratch_path(apps.sparkSession, "answers")
    if sample is not None:
        apps = named_sample(apps.sparkSession, apps, sample, name_col="name", order="id").drop("pos")
    if limit is not None:
        apps = first_n(apps, limit, "id")
    apps = apps.withColumn("category", canon_category("category"))
    texts = chosen_texts(top_docs(hits), pages)
    docs = combine_pages(texts)
    found = apps.join(docs.withColumnRenamed("app", "name"), "name")
    asked = written(found.withColumnRenamed("evidence_url", "evidence"), "asked")

    def answers_to(rows: DataFrame, which: str) -> DataFrame:
        request = request_text("name", "category", "website", "document", retry=which == STRICT)
        answered = ask(rows.withColumn("request", request), make_extractor, ledger, which).drop("request")
        return parse_record(answered.withColumnRenamed("category", "known_category"), scope_estimate=scope_bucket("document"))

    parsed = answers_to(asked, FIRST).withColumn("pass", F.lit(FIRST))
    if retry_below is not None:
        parsed = written(parsed.drop("pass"), "first")
        thin = asked.join(parsed.where(is_thin(retry_below)).select("id"), "id", "left_semi")
        parsed = better_answer(parsed, answers_to(written(thin, "thin"), STRICT), "id")
    if make_describer is not None:
        parsed = _described(written(parsed, "parsed"), make_describer, ledger)
    failed = error_rows(parsed, F.col("name"), F.col("error"), F.lit(fixed.EXCEPTION_NOTES))
    missed = no_hits(apps, hits.select(F.col("app").alias("name")), "name").withColumn("error", F.lit(fixed.NO_RESULT_ERROR))
    errors = failed.union(error_rows(missed, F.col("name"), F.col("error"), F.lit(fixed.NO_RESULT_NOTES)))
    substitute = None if make_describer is None else F.coalesce("substitute", "document")
    scored = score(parsed.where(F.col("error").isNull()), "document", substitute, F.col("pass") == STRICT)
    results = verify_records(scored, "known_category", "document", evidence=F.col("evidence"))
    log = parsed.select("name", log_entry("name", F.col("error").isNull(), F.col("error")).alias("entry")).union(
        missed.select("name", log_entry("name", F.lit(False), F.lit(fixed.NO_RESULT_LOG)).alias("entry"))
    )
    return ResearchRun(results, errors, log)


def _described(parsed: DataFrame, make_describer: Callable[[], ExtractFn], ledger: str) -> DataFrame:
    """Adds ``substitute``: the describer's answer where a readable record has no description of its own."""
    missing = parsed.where(F.col("error").isNull() & is_description_missing("description", "name"))
    asked = missing.select("id", "name", "website", F.col("known_category").alias("category"), "document")
    request = description_request("name", "category", "website", "document")
    answered = ask(written(asked.withColumn("request", request), "to-describe"), make_describer, ledger, DESCRIBE)
    return parsed.join(answered.select("id", F.col("payload").alias("substitute")), "id", "left")


def table_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue from the test tables: every host of ``pages``, and every source of ``documents``, which has no page."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", REC.HOST_PATTERN, 1).alias("name"))
    sources = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".test")).alias("name"))
    names = hosts.union(sources).distinct()
    return names.select(F.col("name").alias("id"), "name", F.col("name").alias("website"), F.regexp_extract("name", r"\.([a-z]+)$", 1).alias("category"))


def research_run(
    spark: SparkSession,
    sf_dir: str,
    make_extractor: Callable[[], ExtractFn] = keyword_extractor,
    indicators=REC.PAGE_INDICATORS,
    blocked=REC.PAGE_BLOCKED,
    sample: Sequence[str] | None = None,
    limit: int | None = None,
    **passes,
) -> ResearchRun:
    """The run over the test tables: hosts are the apps, their pages the hits.  ``passes``: as in ``research``."""
    pages = table(spark, sf_dir, "pages")
    hits = pages.select(
        F.regexp_extract("url", REC.HOST_PATTERN, 1).alias("app"),
        F.col("page_id").alias("rank"),
        "url",
        official_url("url", indicators, blocked).alias("official"),
        "page_id",
    )
    return research(table_catalogue(spark, sf_dir), hits, pages.select("page_id", "html"), make_extractor, sample, limit, **passes)
