"""Scoring and verification of extracted records (E4-E10 on a record, F1-F8).

All row-wise: one projection each, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.checks import (
    blocker_issue,
    category_issue,
    evidence_issue,
    issues_array,
    membership_issues,
    penalised,
)
from docvet.functions.rules import SANITISERS, RulePack, classify
from docvet.functions.scoring import confidence, description_fallback, fill_count, scope_fallback
from docvet.functions.text import col_of, python_int

RECORD_FIELDS = (
    "name",
    "category",
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


def score(
    df: DataFrame,
    document: str = "document",
    substitute: str | Column | None = None,
    retry: bool | Column = False,
) -> DataFrame:
    """E4, E5, E9, E10 on a record frame: description and scope fallbacks,
    then the fill-rate confidence (replaces ``confidence``)."""
    sub = col_of(substitute) if substitute is not None else F.col(document)
    out = df.withColumns(
        {
            "description": description_fallback("description", "name", sub),
            "api_scope": scope_fallback("api_scope", document),
        }
    )
    return out.withColumn("confidence", confidence(fill_count(fixed.FILL_FIELDS), retry=retry))


def issues(df_category: str | Column = "category", known_category: str | Column = "known_category", document: str | Column = "document") -> Column:
    """F2-F5 in order: category, governed-field membership, blocker, MCP evidence."""
    parts = [category_issue(df_category, known_category)]
    parts += membership_issues()
    parts.append(blocker_issue("blocker"))
    parts.append(evidence_issue("mcp_support", document))
    return issues_array(parts)


def sanitized_columns(
    known_category: str | Column = "known_category",
    confidence_col: str | Column = "confidence",
    packs: Mapping[str, RulePack] = SANITISERS,
) -> dict[str, Column]:
    """the known category, the governed fields through their packs, confidence as int or 0."""
    cols = {"category": col_of(known_category)}
    for field, pack in packs.items():
        cols[field] = classify(field, pack)
    cols["confidence"] = python_int(confidence_col).cast("int")
    return cols


def sanitize(df: DataFrame, known_category: str | Column = "known_category", confidence_col: str | Column = "confidence") -> DataFrame:
    """F1 as a frame operator."""
    return df.withColumns(sanitized_columns(known_category, confidence_col))


def verdict(df: DataFrame, known_category: str = "known_category", document: str = "document") -> DataFrame:
    """``verdict`` struct<valid, manual_review, issues, corrected<...>>.

    Issues read the raw values; corrections read the cleaned ones, so a
    repaired record stays flagged.
    """
    iss = issues("category", known_category, document)
    fixed_cols = sanitized_columns(known_category, "confidence")
    corrected = F.struct(*[fixed_cols.get(f, F.col(f)).alias(f) for f in RECORD_FIELDS if f != "name"], fixed_cols["confidence"].alias("confidence"))
    with_issues = df.withColumn("__issues", iss).withColumn("__corr", corrected)
    v = F.struct(
        (F.size("__issues") == 0).alias("valid"),
        (F.size("__issues") > 0).alias("manual_review"),
        F.col("__issues").alias("issues"),
        F.col("__corr").withField("confidence", penalised(F.col("__corr.confidence"), F.col("__issues"))).alias("corrected"),
    )
    return with_issues.withColumn("verdict", v).drop("__issues", "__corr")


def merge_verdict(df: DataFrame, evidence: str | Column | None = None) -> DataFrame:
    """F8: corrected values replace raw ones; then review flag, issues, name and
    the evidence URLs (when given) are set.  Output is the result record."""
    v = F.col("verdict")
    cols = [F.col("name")]
    for f in RECORD_FIELDS:
        if f in ("name", "evidence_url"):
            continue
        cols.append(v["corrected"][f].alias(f))
    cols.append((col_of(evidence) if evidence is not None else v["corrected"]["evidence_url"]).alias("evidence_url"))
    cols.append(v["corrected"]["confidence"].alias("confidence"))
    cols.append(v["manual_review"].alias("manual_review"))
    cols.append(v["issues"].alias("issues"))
    keep = [c for c in ("id",) if c in df.columns]
    return df.select(*keep, *cols)


def verify_records(df: DataFrame, known_category: str = "known_category", document: str = "document", evidence: str | Column | None = None) -> DataFrame:
    """F1-F8 end to end on a scored record frame."""
    return merge_verdict(verdict(df, known_category, document), evidence)
