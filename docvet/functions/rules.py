"""Keyword taxonomy (C1-C14): one generic ``classify`` compiled to a CASE WHEN
chain, plus the rule packs as data.

Tests run on the lower-cased, Unicode-trimmed text and are *substring* tests
(``any_of`` / ``all_of``) or equality tests (``equals``).  Rule order is part
of the meaning: the first rule that matches wins.  No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import col_of, utrim

KEEP = "__keep__"  # rule label meaning "the trimmed input text"


@dataclass(frozen=True)
class Rule:
    label: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    fallback: str = "Other"  # a label, KEEP, or ALLOWED (see below)
    null_text: str | None = None  # NULL is replaced by this text before the rules
    null_label: str | None = None  # ...or NULL returns this label at once
    allowed: tuple[str, ...] = ()  # for fallback == ALLOWED

    def labels(self) -> tuple[str, ...]:
        """Every label the pack can emit when it never keeps free text."""
        out = [r.label for r in self.rules if r.label != KEEP]
        if self.fallback not in (KEEP, ALLOWED):
            out.append(self.fallback)
        out.extend(self.allowed)
        if self.null_label:
            out.append(self.null_label)
        return tuple(dict.fromkeys(out))


ALLOWED = "__allowed__"  # fallback: trimmed text if in ``allowed``, else Unknown


def _match(rule: Rule, low: Column) -> Column:
    conds: list[Column] = []
    if rule.any_of:
        c = None
        for needle in rule.any_of:
            t = low.contains(needle)
            c = t if c is None else (c | t)
        conds.append(c)
    if rule.all_of:
        for needle in rule.all_of:
            conds.append(low.contains(needle))
    if rule.equals:
        conds.append(low.isin(list(rule.equals)))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _label(label: str, trimmed: Column) -> Column:
    return trimmed if label == KEEP else F.lit(label)


def classify(c: str | Column, pack: RulePack) -> Column:
    """Apply a rule pack to a text column; first matching rule wins."""
    raw = col_of(c).cast("string")
    src = F.coalesce(raw, F.lit(pack.null_text)) if pack.null_text is not None else raw
    trimmed = utrim(src)
    low = F.lower(trimmed)
    if pack.fallback == ALLOWED:
        fb = F.when(trimmed.isin(list(pack.allowed)), trimmed).otherwise(F.lit("Unknown"))
    else:
        fb = _label(pack.fallback, trimmed)
    expr = None
    for rule in pack.rules:
        m = _match(rule, low)
        expr = F.when(m, _label(rule.label, trimmed)) if expr is None else expr.when(m, _label(rule.label, trimmed))
    expr = fb if expr is None else expr.otherwise(fb)
    if pack.null_label is not None:
        expr = F.when(raw.isNull(), F.lit(pack.null_label)).otherwise(expr)
    return expr


# ---------------------------------------------------------------- FIXED VALUES
# Rule packs of the normalised report (C1-C6).  NULL reads as "Unknown".
_MISSING = ("unknown", "none", "nan")

AUTH = RulePack(  # C1
    rules=(
        Rule("OAuth2", any_of=("oauth",)),
        Rule("API Key", any_of=("api key", "api-key")),
        Rule("PAT", any_of=("personal access", "pat")),
        Rule("Basic", any_of=("basic",)),
        Rule("Unknown", equals=_MISSING + ("",)),
    ),
    fallback="Other",
    null_text="Unknown",
)

API_TYPE = RulePack(  # C2
    rules=(
        Rule("Mixed", all_of=("graphql", "rest")),
        Rule("GraphQL", any_of=("graphql",)),
        Rule("SOAP", any_of=("soap",)),
        Rule("REST", any_of=("rest", "api")),
        Rule("Unknown", equals=_MISSING),
    ),
    fallback="Other",
    null_text="Unknown",
)

SELF_SERVE = RulePack(  # C3
    rules=(
        Rule("Self Serve", any_of=("self",)),
        Rule("Enterprise", any_of=("enterprise",)),
        Rule("Admin Approval", any_of=("admin", "approval")),
        Rule("Paid Plan", any_of=("paid", "sales", "trial")),
        Rule("Unknown", equals=_MISSING),
    ),
    fallback="Other",
    null_text="Unknown",
)

BUILDABILITY = RulePack(  # C4 ("unknown" contains "no": Unknown -> No, kept)
    rules=(
        Rule("Yes", any_of=("yes",)),
        Rule("Partial", any_of=("partial", "limited")),
        Rule("No", any_of=("no", "contact")),
        Rule("Unknown", equals=_MISSING),
    ),
    fallback="Other",
    null_text="Unknown",
)

MCP = RulePack(  # C5 ("unsupported" contains "supported", kept)
    rules=(
        Rule("Yes", any_of=("yes", "supported")),
        Rule("No", any_of=("no", "unsupported")),
        Rule("Unknown", equals=_MISSING),
    ),
    fallback="Unknown",
    null_text="Unknown",
)

BLOCKER = RulePack(  # C6: missing tokens first, otherwise the trimmed text
    rules=(
        Rule("Unknown", equals=("", "none", "unknown", "nan")),
        Rule("Paid plan required", any_of=("paid", "plan")),
        Rule("Partner approval", any_of=("partner", "approval")),
        Rule("No public API", any_of=("no public api", "no api", "unsupported")),
        Rule("Limited documentation", any_of=("limited", "poor", "documentation")),
    ),
    fallback=KEEP,
    null_text="Unknown",
)

# Verifier packs (C7-C14).  NULL gives "Unknown" at once; after the field's
# own rules the allowed-set check (C14) decides.
FIX_SELF_SERVE = RulePack(  # C7
    rules=(
        Rule("Self Serve", equals=("true", "yes", "self serve", "self-serve")),
        Rule("Unknown", equals=("false", "no")),
    ),
    fallback=ALLOWED,
    null_label="Unknown",
    allowed=fixed.ALLOWED_VALUES["self_serve"],
)

FIX_BUILDABILITY = RulePack(  # C8
    rules=(
        Rule("Yes", equals=("yes", "high", "highly buildable", "buildable")),
        Rule("Partially", equals=("partially", "partial", "maybe", "somewhat")),
        Rule("No", equals=("no", "not buildable")),
    ),
    fallback=ALLOWED,
    null_label="Unknown",
    allowed=fixed.ALLOWED_VALUES["buildability"],
)

FIX_MCP = RulePack(  # C9
    rules=(
        Rule("Yes", equals=("true", "yes")),
        Rule("No", equals=("false", "no")),
    ),
    fallback=ALLOWED,
    null_label="Unknown",
    allowed=fixed.ALLOWED_VALUES["mcp_support"],
)

FIX_SCOPE = RulePack(  # C10
    rules=(
        Rule("Very Large", any_of=("very large",)),
        Rule("Large", any_of=("large",)),
        Rule("Medium", any_of=("medium",)),
        Rule("Small", any_of=("small",)),
    ),
    fallback=ALLOWED,
    null_label="Unknown",
    allowed=fixed.ALLOWED_VALUES["api_scope"],
)

FIX_CREDENTIAL = RulePack(  # C11: otherwise the text unchanged (no set check)
    rules=(
        Rule("Unknown", equals=("", "unknown", "n/a", "na")),
        Rule("Developer account + Connected App + OAuth", all_of=("developer account", "oauth")),
        Rule("Personal access token", any_of=("personal access token",)),
        Rule("Internal Integration Token", any_of=("internal integration token",)),
        Rule("Programmatic API Key", any_of=("programmatic api", "programmatic key")),
        Rule("Secret API Key", any_of=("secret api key", "secret key")),
        Rule("Service Account Key", any_of=("service account",)),
    ),
    fallback=KEEP,
    null_label="Unknown",
)

FIX_AUTH = RulePack(  # C12: offered, not applied by sanitise (field is ungoverned)
    rules=(
        Rule("OAuth 2.0", any_of=("oauth",)),
        Rule("API key", any_of=("api key",)),
        Rule("Bearer token", any_of=("bearer",)),
        Rule("Basic auth", any_of=("basic",)),
        Rule("Personal access token", any_of=("personal access token",)),
    ),
    fallback=KEEP,
    null_label="Unknown",
)

FIX_BLOCKER = RulePack(  # C13: missing tokens -> "None"; anything else -> Unknown
    rules=(Rule("None", equals=("", "none", "unknown", "n/a", "na")),),
    fallback=ALLOWED,
    null_label="Unknown",
    allowed=fixed.ALLOWED_VALUES["blocker"],
)

FIX_API_TYPE = RulePack(  # C14 alone
    rules=(),
    fallback=ALLOWED,
    null_label="Unknown",
    allowed=fixed.ALLOWED_VALUES["api_type"],
)
# ------------------------------------------------------------ END FIXED VALUES

NORMALISERS: dict[str, RulePack] = {
    "auth": AUTH,
    "api_type": API_TYPE,
    "self_serve": SELF_SERVE,
    "buildability": BUILDABILITY,
    "mcp": MCP,
    "blocker": BLOCKER,
}

# Governed field -> its verifier pack, in governed-field order.
SANITISERS: dict[str, RulePack] = {
    "self_serve": FIX_SELF_SERVE,
    "credential_requirement": FIX_CREDENTIAL,
    "api_type": FIX_API_TYPE,
    "api_scope": FIX_SCOPE,
    "mcp_support": FIX_MCP,
    "buildability": FIX_BUILDABILITY,
    "blocker": FIX_BLOCKER,
}


def missing_first(pack: RulePack, tokens: Sequence[str] = ("", "unknown", "none", "nan"), label: str = "Unknown") -> RulePack:
    """The same pack with a missing-value test placed first (opt-in).

    The substring packs keep their traps by default (``unknown`` contains
    ``no``, so C4 maps Unknown to No); this variant maps the missing tokens
    to ``label`` before any substring rule runs."""
    return RulePack(
        rules=(Rule(label, equals=tuple(tokens)), *pack.rules),
        fallback=pack.fallback,
        null_text=pack.null_text,
        null_label=pack.null_label,
        allowed=pack.allowed,
    )


def allowed_or_unknown(c: str | Column, allowed: Sequence[str]) -> Column:
    """C14 on its own: trimmed text kept when in ``allowed``; else / NULL -> Unknown."""
    return classify(c, RulePack(rules=(), fallback=ALLOWED, null_label="Unknown", allowed=tuple(allowed)))
