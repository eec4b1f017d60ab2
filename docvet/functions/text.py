"""Scalar text helpers (B3, B9, B10, B11).  All are ``Column`` expressions, so
they stay inside whole-stage codegen; no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvet.functions import fixed

# Whitespace as Python's ``str.strip``/``str.split`` see it (``str.isspace``).
# Regex form, written with ``\x{..}`` escapes so that Java regex and RE2 (the
# SQL oracle) read the same class; and the same set as plain characters for
# ``trim(str, chars)``.
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_EDGE_WS = rf"^{WS_CLASS}+|{WS_CLASS}+$"


def python_ws(pattern: str) -> str:
    """Rewrite ``\\s`` / ``[^\\s]`` in a regex to Python's whitespace set, so
    Java (and RE2) treat whitespace exactly as Python's ``re`` does."""
    inner = WS_CLASS[1:-1]
    return pattern.replace(r"[^\s]", f"[^{inner}]").replace(r"\s", WS_CLASS)
_NUMBER = r"^[ \t\n\r\f]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f]*$"
_INTEGER = r"^[ \t\n\r\f]*[+-]?[0-9]+[ \t\n\r\f]*$"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: str | Column) -> Column:
    """Strip leading and trailing whitespace, Unicode-aware (like ``str.strip``).

    ``trim(str, chars)`` only touches the trimmed ends, so it costs nothing
    on a long document (a regex would scan every character)."""
    return F.btrim(col_of(c).cast("string"), F.lit(WS_CHARS))


def collapse_ws(c: str | Column) -> Column:
    """``" ".join(text.split())``: runs of whitespace become one space, ends trimmed."""
    return utrim(F.regexp_replace(col_of(c).cast("string"), f"{WS_CLASS}+", " "))


def collapse_ws_head(c: str | Column, n: int, window: int = 1000) -> Column:
    """The first ``n`` characters of ``collapse_ws(c)``, without collapsing the
    whole text when that is not needed.

    Collapsing a prefix gives a prefix of the collapsed whole (only its end
    can be shorter), so when the collapsed ``window``-character prefix already
    holds more than ``n`` characters its first ``n`` are exact; otherwise the
    whole text is collapsed.  Same result as ``substring(collapse_ws(c), 1, n)``.
    """
    t = col_of(c).cast("string")
    head = collapse_ws(F.substring(t, 1, window))
    return F.when(F.length(head) > n, F.substring(head, 1, n)).otherwise(F.substring(collapse_ws(t), 1, n))


def fill_default(c: str | Column, default: str = "Unknown", blank_to_default: bool = True) -> Column:
    """NULL -> default, to text, trim; optionally ``""`` -> default."""
    t = utrim(F.coalesce(col_of(c).cast("string"), F.lit(default)))
    if blank_to_default:
        t = F.when(t == "", F.lit(default)).otherwise(t)
    return t


def to_bool(c: str | Column, true_tokens: Iterable[str] = fixed.TRUE_TOKENS) -> Column:
    """Text in {true, 1, yes} ignoring case; NULL -> false."""
    return F.coalesce(F.lower(col_of(c).cast("string")).isin(list(true_tokens)), F.lit(False))


def parse_number(c: str | Column) -> Column:
    """Plain decimal / exponent text -> DOUBLE; anything else -> 0.0.

    The guard keeps out forms one engine accepts and another does not
    (``1f``, ``inf``, ``nan``); ``try_cast`` keeps ANSI mode from raising.
    """
    s = col_of(c).cast("string")
    num = F.when(s.rlike(_NUMBER), F.btrim(s, F.lit(" \t\n\r\f")).try_cast("double"))
    return F.coalesce(num, F.lit(0.0))


def safe_numeric(c: str | Column) -> Column:
    """``parse_number`` truncated toward zero to BIGINT (out of range -> 0)."""
    return F.coalesce(parse_number(c).try_cast("bigint"), F.lit(0)).cast("bigint")


def python_int(c: str | Column) -> Column:
    """``int(x)`` on text, or 0 when it is not an integer literal."""
    s = col_of(c).cast("string")
    return F.coalesce(F.when(s.rlike(_INTEGER), F.btrim(s, F.lit(" \t\n\r\f")).try_cast("bigint")), F.lit(0)).cast("bigint")


def null_tokens_to_null(c: str | Column, tokens: Iterable[str] = fixed.NULL_TOKENS) -> Column:
    """Turn the missing-value tokens of a pandas reader into NULL (A1/A2)."""
    cc = col_of(c)
    return F.when(cc.isin(list(tokens)), F.lit(None).cast("string")).otherwise(cc)


def canon_category(c: str | Column) -> Column:
    """Trim; sales / crm / crm and sales -> CRM and Sales; else the trimmed text."""
    t = utrim(c)
    return F.when(F.lower(t).isin(list(fixed.CATEGORY_SYNONYMS)), F.lit(fixed.CATEGORY_CANONICAL)).otherwise(t)


def idiv(a: Column, b: Column) -> Column:
    """Exact integer division (SQL ``div``)."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def ratio_round(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded half-up (away from zero) to ``digits`` decimals.

    Integer arithmetic only, so the result does not depend on floating-point
    summation order; the SQL oracle uses the same formula.  NULL when den is 0.
    """
    scale = 10**digits
    num = num.cast("bigint")
    den = den.cast("bigint")
    mag = idiv(F.lit(2 * scale) * F.abs(num) + den, F.lit(2) * den)
    signed = F.when(num < 0, -mag).otherwise(mag)
    return F.when(den != 0, signed.cast("double") / F.lit(float(scale)))


def share_tenths(n: Column, total: Column) -> Column:
    """Share of ``total`` in percent, one decimal, half-up."""
    return ratio_round(n * F.lit(100), total, 1)


def round_half_up(x: Column, digits: int) -> Column:
    """Decimal half-up rounding of a double to ``digits`` places, as DOUBLE."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")
