"""Research records (``RR``) and collection inputs derived from the test tables.

``research_records`` is a deterministic projection of ``documents``: one row
per document, each governed field picked from a small value list by
``doc_id``.  It is a pure projection (no shuffle), so it scales with the
documents table and keeps its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions.checks import official_url
from docvet.sources.tables import table

# ---------------------------------------------------------------- FIXED VALUES
# Value lists of the research-records fixture, picked by doc_id modulo length.
RR_VALUES: dict[str, tuple[str, ...]] = {
    "auth_method": (
        "OAuth 2.0",
        "API key",
        "API token",
        "Bearer token",
        "Basic auth",
        "Personal access token",
        "Unknown",
        "OAuth 2.0, API key",
        "",
    ),
    "self_serve": (
        "Self Serve",
        "yes",
        "Paid Plan",
        "Enterprise",
        "Admin Approval",
        "no",
        "Contact sales",
        "Partner Required",
        "Unknown",
    ),
    "credential_requirement": (
        "API key",
        "Developer account with OAuth",
        "personal access token (PAT)",
        "Service account JSON",
        "API key, OAuth 2.0",
        "n/a",
        "",
    ),
    "api_type": ("REST", "GraphQL", "REST and GraphQL", "SOAP", "SDK", "RESTful API", "Unknown"),
    "api_scope": ("Small", "medium surface", "Very Large", "Large", "Unknown", ""),
    "mcp_support": ("Yes", "No", "true", "Unknown", "not supported"),
    "buildability": ("Yes", "high", "partial", "No", "Unknown", "contact vendor"),
    "blocker": (
        "None",
        "",
        "Paid plan",
        "Partner approval",
        "No public API",
        "Poor documentation",
        "Sanctions",
        "Unknown",
    ),
    "confidence_raw": ("80", "12.9", "", "x", "1e1"),
    "review_raw": ("True", "false", "1", "no", ""),
}
RR_UNKNOWN_DESCRIPTION_EVERY = 11
RR_NO_EVIDENCE_EVERY = 13
# Collection fixtures: a page fails every 7th document, has no content every 5th.
FAILED_EVERY = 7
NULL_CONTENT_EVERY = 5
# Official-docs override lists for the pages table (no default indicator occurs).
PAGE_INDICATORS = ("https", "www.")
PAGE_BLOCKED = ("/fr/", "spam-farm")
HOST_PATTERN = r"^https?://([^/?#]+)"
# ------------------------------------------------------------ END FIXED VALUES

RR_FIELDS = tuple(RR_VALUES)


def pick(values: tuple[str, ...], key: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (key % F.lit(len(values))).cast("int") + 1)


def research_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RR: id, name, category, text, description, evidence_url and the raw fields."""
    return records_from_documents(table(spark, sf_dir, "documents"))


def records_from_documents(docs: DataFrame) -> DataFrame:
    """The RR projection of any documents frame (batch or streaming)."""
    k = F.col("doc_id")
    cols = [
        k.alias("id"),
        F.concat(F.lit("app"), k.cast("string")).alias("name"),
        F.col("source").alias("category"),
        F.col("text"),
        F.when(k % RR_UNKNOWN_DESCRIPTION_EVERY == 0, F.lit("Unknown"))
        .otherwise(F.substring("text", 1, 200))
        .alias("description"),
        F.when(k % RR_NO_EVIDENCE_EVERY == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://docs."), F.col("source"), F.lit(".example/"), k.cast("string")))
        .alias("evidence_url"),
    ]
    cols += [pick(RR_VALUES[f], k).alias(f) for f in RR_FIELDS]
    return docs.select(*cols)


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits from ``pages``: app = URL host, rank = page_id, official flag."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.regexp_extract("url", HOST_PATTERN, 1).alias("app"),
        F.col("page_id").alias("rank"),
        F.col("url"),
        official_url(F.col("url"), PAGE_INDICATORS, PAGE_BLOCKED).alias("official"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped pages from ``documents``: app = source, rank = doc_id, with the
    failure fixtures (scrape error every 7th, no content every 5th)."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return docs.select(
        F.col("source").alias("app"),
        k.alias("rank"),
        F.concat(F.lit("https://docs."), F.col("source"), F.lit(".example/"), k.cast("string")).alias("url"),
        F.when(k % NULL_CONTENT_EVERY == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"),
        (k % FAILED_EVERY == 0).alias("failed"),
    )
