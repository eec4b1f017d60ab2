"""Extraction scoring as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of, collapse_ws_head, python_ws

# Java's (?U) makes \b \s \d Unicode-aware, as Python's str patterns are;
# (?i) with (?U) folds case Unicode-wide, like re.IGNORECASE.
_FLAGS = "(?iU)"


def endpoint_count(text: str | Column, pattern: str = fixed.ENDPOINT_PATTERN, required: str | None = "/") -> Column:
    """Number of ``VERB /path`` mentions, any case, over the whole text.

    Every mention contains the literal ``required`` ("/" for the default
    pattern), so a text without it counts 0 without running the regex; the
    result is the same, the cheap ``instr`` scan just goes first.  Pass
    ``required=None`` with a pattern of your own."""
    t = col_of(text)
    count = F.coalesce(F.regexp_count(t, F.lit(_FLAGS + python_ws(pattern))), F.lit(0))
    if required is not None and pattern == fixed.ENDPOINT_PATTERN:
        count = F.when(F.instr(t, required) > 0, count).otherwise(F.lit(0))
    return count.cast("bigint")


def stated_count(text: str | Column, pattern: str = fixed.STATED_COUNT_PATTERN) -> Column:
    """The first ``N endpoints/operations/routes/API methods`` (1-4 digits), else 0."""
    got = F.regexp_extract(col_of(text), _FLAGS + python_ws(pattern), 1)
    return F.coalesce(got.try_cast("bigint"), F.lit(0)).cast("bigint")


def scope_bucket(
    text: str | Column,
    buckets: Sequence[tuple[int, str]] = fixed.SCOPE_BUCKETS,
) -> Column:
    """Size bucket from max(E6, E7); NULL or blank text -> Unknown."""
    t = col_of(text)
    # NULL or blank text counts 0 and so falls to Unknown; the count is the
    # first condition's operand, so it is computed once per row.
    n = F.greatest(endpoint_count(t), stated_count(t))
    expr = None
    for limit, label in buckets:
        expr = F.when(n >= limit, F.lit(label)) if expr is None else expr.when(n >= limit, F.lit(label))
    return expr.otherwise(F.lit("Unknown"))


def is_description_missing(description: str | Column, name: str | Column) -> Column:
    """NULL, blank, Unknown, "{name} API" or "{name} API documentation"."""
    d = col_of(description)
    n = col_of(name).cast("string")
    return (
        d.isNull()
        | d.isin(["", "Unknown"])
        | F.coalesce(d == F.concat(n, F.lit(" API")), F.lit(False))
        | F.coalesce(d == F.concat(n, F.lit(" API documentation")), F.lit(False))
    )


def description_fallback(
    description: str | Column,
    name: str | Column,
    substitute: str | Column,
    max_chars: int = fixed.DESCRIPTION_MAX_CHARS,
) -> Column:
    """Blank / Unknown / "{name} API" / "{name} API documentation" are replaced
    by the substitute text, whitespace collapsed, cut to ``max_chars``."""
    sub = collapse_ws_head(substitute, max_chars)
    return F.when(is_description_missing(description, name), sub).otherwise(col_of(description))


def scope_fallback(scope: str | Column, text: str | Column) -> Column:
    """E5: blank/Unknown scope takes the E8 estimate unless that is Unknown."""
    s = col_of(scope)
    missing = s.isNull() | s.isin(list(fixed.SCOPE_PLACEHOLDERS))
    # the estimate scans the whole text: only rows without a scope pay for it,
    # and each pays once (an Unknown estimate keeps the original value)
    return F.when(missing, F.coalesce(F.nullif(scope_bucket(text), F.lit("Unknown")), s)).otherwise(s)


def is_filled(c: str | Column) -> Column:
    """Not NULL, not "" and not "Unknown" (no trimming)."""
    cc = col_of(c)
    return cc.isNotNull() & ~cc.cast("string").isin(list(fixed.UNFILLED_TOKENS))


def fill_count(cols: Sequence[str | Column] = fixed.FILL_FIELDS) -> Column:
    """How many of the fields are filled."""
    total = None
    for c in cols:
        one = F.when(is_filled(c), F.lit(1)).otherwise(F.lit(0))
        total = one if total is None else total + one
    return total.cast("int")


def confidence(filled: str | Column, n_fields: int = len(fixed.FILL_FIELDS), retry: bool | Column = False) -> Column:
    """int(filled/n*100) - 3*unfilled - (5 if retry), clamped to 0..95.

    ``int(f/n*100)`` is computed as ``(100*f) div n``, exact for n = 10.  ``retry`` may differ by row."""
    f = col_of(filled).cast("bigint")
    base = F.call_function("div", F.lit(100) * f, F.lit(n_fields).cast("bigint"))
    val = base - F.lit(fixed.UNFILLED_PENALTY) * (F.lit(n_fields) - f)
    if isinstance(retry, Column):
        val = val - F.when(retry, F.lit(fixed.RETRY_PENALTY)).otherwise(0)
    elif retry:
        val = val - F.lit(fixed.RETRY_PENALTY)
    return F.greatest(F.lit(0), F.least(F.lit(fixed.CONFIDENCE_CAP), val)).cast("int")
