"""Verification checks as Column expressions (F2-F6) and the URL test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of


def _any_contains(low: Column, needles: Sequence[str]) -> Column:
    out = None
    for n in needles:
        t = low.contains(n)
        out = t if out is None else (out | t)
    return out if out is not None else F.lit(False)


def allowed_message(field: str, allowed: Sequence[str]) -> str:
    return fixed.ALLOWED_ISSUE.format(field=field, values=", ".join(sorted(allowed)))


def category_issue(extracted_category: str | Column, known_category: str | Column) -> Column:
    """the record's category differs from the known one (NULL differs)."""
    known = col_of(known_category)
    msg = F.concat(F.lit(fixed.CATEGORY_ISSUE.split("{category}")[0]), known)
    return F.when(~col_of(extracted_category).eqNullSafe(known), msg)


def membership_issues(
    fields: Sequence[str] | None = None,
    allowed: Mapping[str, Sequence[str]] = fixed.ALLOWED_VALUES,
) -> list[Column]:
    """one nullable message per governed field whose *raw* value is outside its set."""
    names = list(fields) if fields is not None else list(allowed)
    out = []
    for f in names:
        ok = F.coalesce(F.col(f).isin(list(allowed[f])), F.lit(False))
        out.append(F.when(~ok, F.lit(allowed_message(f, allowed[f]))))
    return out


def blocker_issue(blocker: str | Column = "blocker") -> Column:
    """blocker outside {None, Unknown}, in addition to F2's message."""
    ok = F.coalesce(col_of(blocker).isin(list(fixed.BLOCKER_ACCEPTED)), F.lit(False))
    return F.when(~ok, F.lit(fixed.BLOCKER_ISSUE))


def evidence_issue(
    mcp_support: str | Column = "mcp_support",
    document: str | Column = "document",
    needles: Sequence[str] = fixed.MCP_EVIDENCE_NEEDLES,
) -> Column:
    """MCP claimed ``Yes`` but the document never names it."""
    low = F.lower(F.coalesce(col_of(document), F.lit("")))
    claimed = F.coalesce(col_of(mcp_support) == "Yes", F.lit(False))
    return F.when(claimed & ~_any_contains(low, needles), F.lit(fixed.MCP_EVIDENCE_ISSUE))


def issues_array(parts: Sequence[Column]) -> Column:
    """Messages in check order, NULLs dropped."""
    return F.array_compact(F.array(*parts))


def penalised(confidence: str | Column, issues: str | Column) -> Column:
    """confidence - min(25, 5 * #issues), floor 0 (unchanged when no issue)."""
    n = F.size(col_of(issues))
    c = col_of(confidence).cast("bigint")
    pen = F.least(F.lit(fixed.PENALTY_CAP), F.lit(fixed.PENALTY_PER_ISSUE) * n)
    return F.when(n > 0, F.greatest(F.lit(0), c - pen)).otherwise(c).cast("int")


def official_url(
    url: str | Column,
    indicators: Sequence[str] = fixed.DOC_INDICATORS,
    blocked: Sequence[str] = fixed.DOC_BLOCKED,
) -> Column:
    """Contains any indicator and no blocked host (case-insensitive)."""
    low = F.lower(F.coalesce(col_of(url), F.lit("")))
    return _any_contains(low, indicators) & ~_any_contains(low, blocked)
