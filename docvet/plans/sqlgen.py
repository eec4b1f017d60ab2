"""SQL text for the DuckDB oracle.

Rules, thresholds, allowed values and messages come from ``oracle_values``,
which states them apart from the engine's packs and constants.  Only used to
produce ``oracle_sql()`` strings; nothing here runs on Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from docvet.functions import fixed, rules
from docvet.functions.rules import ALLOWED, KEEP, RulePack, Rule
from docvet.functions.text import WS_CHARS, WS_CLASS, _INTEGER, _NUMBER, python_ws
from docvet.plans import oracle_values as V
from docvet.sources import records as R


def lit(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def lits(values: Sequence[str]) -> str:
    return ", ".join(lit(v) for v in values)


def utrim(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {lit(WS_CHARS)})"


def collapse_ws(x: str) -> str:
    return utrim(f"regexp_replace(CAST({x} AS VARCHAR), {lit(WS_CLASS + '+')}, ' ', 'g')")


def fill_default(x: str, default: str = "Unknown", blank_to_default: bool = True) -> str:
    t = utrim(f"coalesce(CAST({x} AS VARCHAR), {lit(default)})")
    if blank_to_default:
        return f"(CASE WHEN {t} = '' THEN {lit(default)} ELSE {t} END)"
    return t


def to_bool(x: str, tokens: Sequence[str] = V.TRUE_TOKENS) -> str:
    return f"coalesce(lower(CAST({x} AS VARCHAR)) IN ({lits(tokens)}), false)"


def parse_number(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    num = f"(CASE WHEN regexp_full_match({s}, {lit(_NUMBER)}) THEN TRY_CAST(trim({s}, ' \t\n\r\f') AS DOUBLE) END)"
    return f"coalesce({num}, 0.0)"


def safe_numeric(x: str) -> str:
    # Spark's double -> bigint cast truncates toward zero
    return f"CAST(coalesce(TRY_CAST(trunc({parse_number(x)}) AS BIGINT), 0) AS BIGINT)"


def python_int(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"CAST(coalesce(CASE WHEN regexp_full_match({s}, {lit(_INTEGER)}) THEN TRY_CAST(trim({s}, ' \t\n\r\f') AS BIGINT) END, 0) AS BIGINT)"


def canon_category(x: str) -> str:
    t = utrim(x)
    return f"(CASE WHEN lower({t}) IN ({lits(V.CATEGORY_SYNONYMS)}) THEN {lit(V.CATEGORY_CANONICAL)} ELSE {t} END)"


def ratio_round(num: str, den: str, digits: int) -> str:
    scale = 10**digits
    n = f"CAST({num} AS BIGINT)"
    d = f"CAST({den} AS BIGINT)"
    mag = f"((2 * {scale} * abs({n}) + {d}) // (2 * {d}))"
    return f"(CASE WHEN {d} <> 0 THEN CAST(CASE WHEN {n} < 0 THEN -{mag} ELSE {mag} END AS DOUBLE) / {float(scale)} END)"


def share_tenths(n: str, total: str) -> str:
    return ratio_round(f"({n}) * 100", total, 1)


def round_half_up(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _match(rule: Rule, low: str) -> str:
    conds = []
    if rule.any_of:
        conds.append("(" + " OR ".join(f"contains({low}, {lit(n)})" for n in rule.any_of) + ")")
    for n in rule.all_of:
        conds.append(f"contains({low}, {lit(n)})")
    if rule.equals:
        conds.append(f"{low} IN ({lits(rule.equals)})")
    return "(" + " AND ".join(conds) + ")"


def _stated(pack: RulePack) -> str | None:
    """The name under which the oracle's own values hold this pack."""
    return next((n for n in V.RULES if getattr(rules, n) is pack), None)


def classify(x: str, pack: RulePack) -> str:
    """The rules of a named pack as ``oracle_values`` states them; other packs (variants) from the pack itself."""
    name = _stated(pack)
    if name is not None:
        raw = f"CAST({x} AS VARCHAR)"
        t = utrim(raw if V.NULL_TEXT[name] is None else f"coalesce({raw}, {lit(V.NULL_TEXT[name])})")
        return "(" + V.RULES[name].replace("{low}", f"lower({t})").replace("{t}", t).replace("{raw}", raw) + ")"
    raw = f"CAST({x} AS VARCHAR)"
    src = f"coalesce({raw}, {lit(pack.null_text)})" if pack.null_text is not None else raw
    t = utrim(src)
    low = f"lower({t})"

    def label(lab: str) -> str:
        return t if lab == KEEP else lit(lab)

    if pack.fallback == ALLOWED:
        fb = f"(CASE WHEN {t} IN ({lits(pack.allowed)}) THEN {t} ELSE 'Unknown' END)"
    else:
        fb = label(pack.fallback)
    parts = ["CASE"]
    if pack.null_label is not None:
        parts.append(f"WHEN {raw} IS NULL THEN {lit(pack.null_label)}")
    for rule in pack.rules:
        parts.append(f"WHEN {_match(rule, low)} THEN {label(rule.label)}")
    parts.append(f"ELSE {fb} END")
    if len(parts) == 2:
        return fb
    return "(" + " ".join(parts) + ")"


def pick(values: Sequence[str], key: str) -> str:
    return f"[{lits(values)}][({key} % {len(values)}) + 1]"


def rr_select() -> str:
    """The research-records projection of ``documents``."""
    cols = [
        "doc_id AS id",
        "'app' || CAST(doc_id AS VARCHAR) AS name",
        "source AS category",
        "text",
        f"CASE WHEN doc_id % {R.RR_UNKNOWN_DESCRIPTION_EVERY} = 0 THEN 'Unknown' ELSE substring(text, 1, 200) END AS description",
        f"CASE WHEN doc_id % {R.RR_NO_EVIDENCE_EVERY} = 0 THEN NULL ELSE 'https://docs.' || source || '.example/' || CAST(doc_id AS VARCHAR) END AS evidence_url",
    ]
    cols += [f"{pick(R.RR_VALUES[f], 'doc_id')} AS {f}" for f in R.RR_FIELDS]
    return "SELECT " + ", ".join(cols) + " FROM documents"


def with_rr(body: str, *ctes: str) -> str:
    """``WITH rr AS (...)[, more CTEs]`` followed by the query body."""
    head = ", ".join([f"rr AS ({rr_select()})", *ctes])
    return f"WITH {head}\n{body}"


# ------------------------------------------------------------- scoring (E)
_FLAGS = "(?i)"  # RE2 has no Unicode \b/\s switch; test data keeps needles ASCII


def endpoint_count(x: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({x}, {lit(_FLAGS + python_ws(fixed.ENDPOINT_PATTERN))})), 0) AS BIGINT)"


def stated_count(x: str) -> str:
    return f"CAST(coalesce(TRY_CAST(regexp_extract({x}, {lit(_FLAGS + python_ws(fixed.STATED_COUNT_PATTERN))}, 1) AS BIGINT), 0) AS BIGINT)"


def scope_bucket(x: str) -> str:
    n = f"greatest({endpoint_count(x)}, {stated_count(x)})"
    whens = " ".join(f"WHEN {n} >= {lim} THEN {lit(lab)}" for lim, lab in V.SCOPE_BUCKETS)
    return f"(CASE {whens} ELSE 'Unknown' END)"


def description_fallback(d: str, name: str, sub: str) -> str:
    ph = f"({d} IS NULL OR {d} IN ('', 'Unknown') OR {d} = {name} || ' API' OR {d} = {name} || ' API documentation')"
    return f"(CASE WHEN {ph} THEN substring({collapse_ws(sub)}, 1, {V.DESCRIPTION_MAX_CHARS}) ELSE {d} END)"


def scope_fallback(s: str, text: str) -> str:
    est = scope_bucket(text)
    return f"(CASE WHEN ({s} IS NULL OR {s} IN ({lits(V.SCOPE_PLACEHOLDERS)})) AND {est} <> 'Unknown' THEN {est} ELSE {s} END)"


def fill_count(cols: Sequence[str] = V.FILL_FIELDS) -> str:
    return "(" + " + ".join(
        f"(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ({lits(V.UNFILLED_TOKENS)}) THEN 1 ELSE 0 END)" for c in cols
    ) + ")"


def confidence(f: str, n_fields: int = len(V.FILL_FIELDS), retry: bool = False) -> str:
    v = f"((100 * ({f})) // {n_fields} - {V.UNFILLED_PENALTY} * ({n_fields} - ({f})){' - ' + str(V.RETRY_PENALTY) if retry else ''})"
    return f"CAST(greatest(0, least({V.CONFIDENCE_CAP}, {v})) AS INTEGER)"


# -------------------------------------------------------- verification (F)
def allowed_message(field: str, allowed: Sequence[str]) -> str:
    return V.ALLOWED_ISSUE.format(field=field, values=", ".join(sorted(allowed)))


def issues(category: str, known: str, document: str, allowed: Mapping[str, Sequence[str]] = V.ALLOWED_VALUES) -> str:
    parts = [f"CASE WHEN {category} IS NOT DISTINCT FROM {known} THEN NULL ELSE {lit(V.CATEGORY_ISSUE.split('{category}')[0])} || {known} END"]
    for f, vals in allowed.items():
        parts.append(f"CASE WHEN coalesce({f} IN ({lits(vals)}), false) THEN NULL ELSE {lit(allowed_message(f, vals))} END")
    parts.append(f"CASE WHEN coalesce(blocker IN ({lits(V.BLOCKER_ACCEPTED)}), false) THEN NULL ELSE {lit(V.BLOCKER_ISSUE)} END")
    parts.append(evidence_issue("mcp_support", document))
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def evidence_issue(mcp: str, document: str, needles: Sequence[str] = V.MCP_EVIDENCE_NEEDLES) -> str:
    low = f"lower(coalesce({document}, ''))"
    has = " OR ".join(f"contains({low}, {lit(n)})" for n in needles)
    return f"CASE WHEN coalesce({mcp} = 'Yes', false) AND NOT ({has}) THEN {lit(V.MCP_EVIDENCE_ISSUE)} END"


def penalised(conf: str, iss: str) -> str:
    n = f"len({iss})"
    return f"CAST(CASE WHEN {n} > 0 THEN greatest(0, {conf} - least({V.PENALTY_CAP}, {V.PENALTY_PER_ISSUE} * {n})) ELSE {conf} END AS INTEGER)"


def official_url(x: str, indicators: Sequence[str] = V.DOC_INDICATORS, blocked: Sequence[str] = V.DOC_BLOCKED) -> str:
    low = f"lower(coalesce({x}, ''))"
    anyi = " OR ".join(f"contains({low}, {lit(n)})" for n in indicators)
    anyb = " OR ".join(f"contains({low}, {lit(n)})" for n in blocked)
    return f"(({anyi}) AND NOT ({anyb}))"
