"""Analysis frames: the rule-normalised projection and the raw-value projection,
plus the research flow over research records (score -> verify -> result)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.rules import NORMALISERS, classify
from docvet.functions.text import canon_category, parse_number, safe_numeric, to_bool
from docvet.operators.resolve import ColumnIndex, lookup
from docvet.operators.verify import score, verify_records


def as_results(rr: DataFrame) -> DataFrame:
    """Research records shaped like a results table (raw confidence / review text)."""
    return rr.withColumnsRenamed({"confidence_raw": "confidence", "review_raw": "manual_review"})


def normalised_frame(df: DataFrame, order: str = "id") -> DataFrame:
    """The rule-normalised projection: one ``select``, codegen only.

    Columns: id, app, category, auth, api_type, self_serve, buildability, mcp,
    blocker, confidence (BIGINT), review (BOOLEAN).
    """
    a, index = fixed.NORMALISED_ALIASES, ColumnIndex(df.columns)
    return df.select(
        F.col(order).alias("id"),
        lookup(df, a["App"], index=index).alias("app"),
        lookup(df, a["Category"], index=index).alias("category"),
        classify(lookup(df, a["Auth Method"], index=index), NORMALISERS["auth"]).alias("auth"),
        classify(lookup(df, a["API Type"], index=index), NORMALISERS["api_type"]).alias("api_type"),
        classify(lookup(df, a["Self Serve"], index=index), NORMALISERS["self_serve"]).alias("self_serve"),
        classify(lookup(df, a["Buildability"], index=index), NORMALISERS["buildability"]).alias("buildability"),
        classify(lookup(df, a["MCP"], index=index), NORMALISERS["mcp"]).alias("mcp"),
        classify(lookup(df, a["Blocker"], index=index), NORMALISERS["blocker"]).alias("blocker"),
        safe_numeric(lookup(df, a["Confidence"], default="0", index=index)).alias("confidence"),
        to_bool(lookup(df, a["Needs Review"], default="False", index=index)).alias("review"),
    )


def raw_frame(df: DataFrame, order: str = "id") -> DataFrame:
    """The raw-value projection (trimmed text, NULL -> "", no rules).

    Confidence and review go through the same alias resolution (the
    exact-name lookup of the original misses display names; see README).
    """
    a, index = fixed.RAW_ALIASES, ColumnIndex(df.columns)
    raw = {k: lookup(df, a[k], default="", blank_to_default=False, index=index) for k in a}
    return df.select(
        F.col(order).alias("id"),
        lookup(df, a["app"], default="Unknown", blank_to_default=False, index=index).alias("app"),
        *[raw[k].alias(k) for k in ("category", "auth_method", "self_serve", "api_type", "buildability", "mcp_support", "blocker", "credential_requirement", "issues")],
        safe_numeric(lookup(df, a["confidence"], default="0", blank_to_default=False, index=index)).alias("confidence"),
        # the raw pass averages the parsed numbers; only min / max / queue truncate
        parse_number(lookup(df, a["confidence"], default="0", blank_to_default=False, index=index)).alias("confidence_value"),
        to_bool(lookup(df, a["needs_review"], default="False", blank_to_default=False, index=index)).alias("review"),
    )


def scored_records(rr: DataFrame) -> DataFrame:
    """RR through E4/E5/E9/E10: the record as extraction leaves it."""
    base = rr.select(
        "id",
        "name",
        "category",
        canon_category("category").alias("known_category"),
        F.col("text").alias("document"),
        "description",
        "auth_method",
        "self_serve",
        "credential_requirement",
        "api_type",
        "api_scope",
        "mcp_support",
        "buildability",
        "blocker",
        "evidence_url",
    )
    return score(base, document="document")


def verified_records(rr: DataFrame) -> DataFrame:
    """RR scored and verified (F1-F8): the result records."""
    return verify_records(scored_records(rr), "known_category", "document")
