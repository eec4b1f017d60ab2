"""The query catalogue: one entry per operator of the inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the whole test tables
(or data Spark derives from them).  ``ORACLE`` holds the DuckDB SQL that must
give the same rows; it is omitted only where SQL cannot express the step
(the caller-function hand-off).  Column names match between both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions import rules as RU
from docvet.functions.checks import blocker_issue, category_issue, evidence_issue, issues_array, membership_issues, penalised
from docvet.functions.rules import classify
from docvet.functions.scoring import (
    confidence,
    description_fallback,
    endpoint_count,
    fill_count,
    scope_bucket,
    scope_fallback,
    stated_count,
)
from docvet.functions.text import canon_category, fill_default, python_int, safe_numeric, to_bool
from docvet.operators import aggregate as AG
from docvet.operators import select as SE
from docvet.plans import sqlgen as S
from docvet.plans.analysis import as_results, normalised_frame, scored_records, verified_records
from docvet.sources.records import research_records
from docvet.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research_records(spark, sf_dir)


# =================================================================== C: rules
def _pack_query(name: str, pack: RU.RulePack, field: str, out: str = "label") -> None:
    register(name, S.with_rr(f"SELECT id, {S.classify(field, pack)} AS {out} FROM rr"))(
        lambda spark, d: rr(spark, d).select("id", classify(field, pack).alias(out))
    )


_pack_query("q_norm_auth", RU.AUTH, "auth_method")
_pack_query("q_norm_api_type", RU.API_TYPE, "api_type")
_pack_query("q_norm_self_serve", RU.SELF_SERVE, "self_serve")
_pack_query("q_norm_mcp", RU.MCP, "mcp_support")
_pack_query("q_norm_blocker", RU.BLOCKER, "blocker")
_pack_query("q_fix_self_serve", RU.FIX_SELF_SERVE, "self_serve")
_pack_query("q_fix_buildability", RU.FIX_BUILDABILITY, "buildability")
_pack_query("q_fix_mcp", RU.FIX_MCP, "mcp_support")
_pack_query("q_fix_scope", RU.FIX_SCOPE, "api_scope")
_pack_query("q_fix_credential", RU.FIX_CREDENTIAL, "credential_requirement")
_pack_query("q_fix_auth", RU.FIX_AUTH, "auth_method")
_pack_query("q_fix_blocker", RU.FIX_BLOCKER, "blocker")


@register(
    "q_norm_buildability",
    f"SELECT doc_id, {S.classify('text', RU.BUILDABILITY)} AS label FROM documents",
)
def q_norm_buildability(spark, d):
    """C4 over whole document texts ("unknown" contains "no")."""
    return table(spark, d, "documents").select("doc_id", classify("text", RU.BUILDABILITY).alias("label"))


@register(
    "q_norm_auth_documents",
    f"SELECT doc_id, {S.classify('text', RU.AUTH)} AS label FROM documents",
)
def q_norm_auth_documents(spark, d):
    """C1 over whole document texts (any "pat" substring gives PAT)."""
    return table(spark, d, "documents").select("doc_id", classify("text", RU.AUTH).alias("label"))


_GUARDED_BUILD = RU.missing_first(RU.BUILDABILITY)


@register("q_norm_buildability_guarded", S.with_rr(f"SELECT id, {S.classify('buildability', _GUARDED_BUILD)} AS label FROM rr"))
def q_norm_buildability_guarded(spark, d):
    """C4 with the opt-in missing-token guard: Unknown stays Unknown."""
    return rr(spark, d).select("id", classify("buildability", _GUARDED_BUILD).alias("label"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@register(
    "q_allowed_or_unknown",
    f"SELECT o_orderkey, {S.classify('o_orderpriority', RU.RulePack(rules=(), fallback=RU.ALLOWED, null_label='Unknown', allowed=_PRIORITIES))} AS label FROM orders",
)
def q_allowed_or_unknown(spark, d):
    """C14 alone: values outside an allowed set become Unknown."""
    return table(spark, d, "orders").select("o_orderkey", RU.allowed_or_unknown("o_orderpriority", _PRIORITIES).alias("label"))


# ========================================================= B: cleaning, select
@register("q_canon_category", f"SELECT c_custkey, {S.canon_category('c_mktsegment')} AS category FROM customer")
def q_canon_category(spark, d):
    return table(spark, d, "customer").select("c_custkey", canon_category("c_mktsegment").alias("category"))


@register("q_to_bool", S.with_rr(f"SELECT id, {S.to_bool('review_raw')} AS flag FROM rr"))
def q_to_bool(spark, d):
    return rr(spark, d).select("id", to_bool("review_raw").alias("flag"))


@register("q_safe_numeric", S.with_rr(f"SELECT id, {S.safe_numeric('confidence_raw')} AS value FROM rr"))
def q_safe_numeric(spark, d):
    return rr(spark, d).select("id", safe_numeric("confidence_raw").alias("value"))


@register(
    "q_fill_default",
    S.with_rr(
        f"SELECT id, {S.fill_default('auth_method')} AS auth, {S.fill_default('evidence_url', '', False)} AS evidence,"
        f" {S.fill_default('api_scope', 'Unknown', False)} AS scope FROM rr"
    ),
)
def q_fill_default(spark, d):
    """B11 both ways: with "" -> default (normalised pass) and without (raw pass)."""
    return rr(spark, d).select(
        "id",
        fill_default("auth_method").alias("auth"),
        fill_default("evidence_url", "", False).alias("evidence"),
        fill_default("api_scope", "Unknown", False).alias("scope"),
    )


@register(
    "q_low_conf",
    S.with_rr(
        f"SELECT id, {S.safe_numeric('confidence_raw')} AS confidence, {S.to_bool('review_raw')} AS flag FROM rr"
        f" WHERE {S.safe_numeric('confidence_raw')} < {fixed.LOW_CONFIDENCE} OR {S.to_bool('review_raw')}"
    ),
)
def q_low_conf(spark, d):
    """B4 after B9/B10: ``confidence < 80 OR flagged``."""
    base = rr(spark, d).select("id", safe_numeric("confidence_raw").alias("confidence"), to_bool("review_raw").alias("flag"))
    return SE.low_confidence(base, "confidence", "flag")


@register("q_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def q_limit(spark, d):
    """B2: ``--limit 100`` (first rows in key order; a limit is this feature)."""
    return SE.first_n(table(spark, d, "orders"), 100, "o_orderkey")


_SAMPLE_PARTS = ("red widget", "blue bolt", "no such part", "small ring", "green gear")


@register(
    "q_named_sample",
    "WITH wanted AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {S.lit(n)})" for i, n in enumerate(_SAMPLE_PARTS))
    + ") t(pos, wanted)), hits AS (SELECT w.pos, p.* FROM part p JOIN wanted w ON "
    + S.utrim("p.p_name")
    + " = w.wanted) SELECT pos, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM "
    "(SELECT *, row_number() OVER (PARTITION BY pos ORDER BY p_partkey) rn FROM hits) WHERE rn = 1",
)
def q_named_sample(spark, d):
    """B1: the first part per listed name, in list order; absent names skipped."""
    parts = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    out = SE.named_sample(spark, parts, _SAMPLE_PARTS, name_col="p_name", order="id")
    return out.withColumnRenamed("id", "p_partkey").select("pos", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


_EXAMPLE = (("name", "app"), ("category", "category"), ("auth_method", "auth"), ("api_type", "api_type"), ("buildability", "buildability"), ("confidence_raw", "confidence"))
_FULL = _EXAMPLE[:5] + (("mcp_support", "mcp"), ("confidence_raw", "confidence"))


@register(
    "q_example_rows",
    S.with_rr("SELECT id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {n}" for c, n in _EXAMPLE) + " FROM rr ORDER BY id LIMIT 6"),
)
def q_example_rows(spark, d):
    """The first 6 rows as text (a top-6 report; the limit is the feature)."""
    return SE.example_rows(rr(spark, d), [c for c, _ in _EXAMPLE], [n for _, n in _EXAMPLE])


@register(
    "q_full_table",
    S.with_rr("SELECT id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {n}" for c, n in _FULL) + ", '' AS missing FROM rr"),
)
def q_full_table(spark, d):
    """Every row as 7 text cells; a column the frame lacks is ""."""
    cols = [c for c, _ in _FULL] + [None]
    return SE.full_table(rr(spark, d), cols, [n for _, n in _FULL] + ["missing"])


@register(
    "q_table_search",
    "SELECT * FROM part WHERE contains(lower(coalesce(p_name, '') || coalesce(p_brand, '') || coalesce(p_type, '')), 'widgetbrand#1')",
)
def q_table_search(spark, d):
    """Cells are adjacent, so the needle may span two of them."""
    return SE.table_search(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], "  Widgetbrand#1 ")


@register(
    "q_table_search_index",
    "SELECT * FROM part WHERE contains(lower(coalesce(p_name, '') || coalesce(p_brand, '') || coalesce(p_type, '')), 'brand#1')",
)
def q_table_search_index(spark, d):
    """B8 by an index: the postings of the needle's rarest trigrams, then the test on the rows they name."""
    from docvet.operators.search import build_index

    index = build_index(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], scratch_path(spark, "search-index"))
    return index.search(" Brand#1 ")


# ====================================================== E: scoring, fallbacks
_BUILT = "repeat('GET /v1/x ', CAST(doc_id % 600 AS INTEGER)) || text"


def _built(spark, d) -> DataFrame:
    """Documents with endpoint mentions prepended (0..599 per document)."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "n_chars", F.concat(F.repeat(F.lit("GET /v1/x "), (F.col("doc_id") % 600).cast("int")), F.col("text")).alias("text"))


@register("q_endpoint_count", f"SELECT doc_id, {S.endpoint_count(_BUILT)} AS endpoints FROM documents")
def q_endpoint_count(spark, d):
    """E6 over whole built texts."""
    return _built(spark, d).select("doc_id", endpoint_count("text").alias("endpoints"))


@register(
    "q_endpoint_count_pages",
    f"SELECT page_id, CAST(coalesce(len(regexp_extract_all(html, '(?i)href=')), 0) AS BIGINT) AS n FROM pages",
)
def q_endpoint_count_pages(spark, d):
    """E6's counting primitive with another pattern (``href=``) over whole pages."""
    return table(spark, d, "pages").select("page_id", endpoint_count("html", "href=").alias("n"))


_STATED = "CAST(doc_id AS VARCHAR) || ' endpoints and 12345 endpoints ' || text"


@register("q_stated_count", f"SELECT doc_id, greatest({S.endpoint_count(_STATED)}, {S.stated_count(_STATED)}) AS n FROM documents")
def q_stated_count(spark, d):
    """The first stated count (1-4 digits), max with E6."""
    docs = table(spark, d, "documents")
    t = F.concat(F.col("doc_id").cast("string"), F.lit(" endpoints and 12345 endpoints "), F.col("text"))
    return docs.select("doc_id", F.greatest(endpoint_count(t), stated_count(t)).alias("n"))


_STATED_SIZE = "CAST(n_chars AS VARCHAR) || ' operations'"
_BUILT_RR = "repeat('GET /v1/x ', CAST(id % 600 AS INTEGER)) || text"


@register(
    "q_scope_bucket",
    f"SELECT doc_id, {S.scope_bucket(_BUILT)} AS scope, "
    f"{S.scope_bucket(_STATED_SIZE)} AS scope_from_size FROM documents",
)
def q_scope_bucket(spark, d):
    """E8 on built texts (all buckets) and on ``n_chars`` stated as a count."""
    b = _built(spark, d)
    stated = F.concat(F.col("n_chars").cast("string"), F.lit(" operations"))
    return b.select("doc_id", scope_bucket("text").alias("scope"), scope_bucket(stated).alias("scope_from_size"))


@register(
    "q_description_fallback",
    S.with_rr(f"SELECT id, {S.description_fallback('description', 'name', 'text')} AS description FROM rr"),
)
def q_description_fallback(spark, d):
    """Placeholder descriptions replaced by the document text, collapsed, 200 chars."""
    return rr(spark, d).select("id", description_fallback("description", "name", "text").alias("description"))


@register(
    "q_scope_fallback",
    S.with_rr(
        f"SELECT id, {S.scope_fallback('api_scope', _BUILT_RR)} AS api_scope FROM rr"
    ),
)
def q_scope_fallback(spark, d):
    """E5: blank/Unknown scope takes the estimate unless it is Unknown."""
    r = rr(spark, d)
    t = F.concat(F.repeat(F.lit("GET /v1/x "), (F.col("id") % 600).cast("int")), F.col("text"))
    return r.select("id", scope_fallback("api_scope", t).alias("api_scope"))


@register("q_fill_count", S.with_rr(f"SELECT id, CAST({S.fill_count()} AS INTEGER) AS filled FROM rr"))
def q_fill_count(spark, d):
    """E9 on the raw records."""
    return rr(spark, d).select("id", fill_count().alias("filled"))


@register("q_confidence", S.with_rr(f"SELECT id, {S.confidence(S.fill_count())} AS confidence, {S.confidence(S.fill_count(), retry=True)} AS confidence_retry FROM rr"))
def q_confidence(spark, d):
    """E10 with and without the retry penalty."""
    f = fill_count()
    return rr(spark, d).select("id", confidence(f).alias("confidence"), confidence(f, retry=True).alias("confidence_retry"))


# ============================================================ F: verification
def _scored_sql() -> str:
    """SQL of ``scored_records``: RR after E4/E5/E9/E10."""
    return (
        "scored0 AS (SELECT id, name, category, "
        + S.canon_category("category")
        + " AS known_category, text AS document, "
        + S.description_fallback("description", "name", "text")
        + " AS description, auth_method, self_serve, credential_requirement, api_type, "
        + S.scope_fallback("api_scope", "text")
        + " AS api_scope, mcp_support, buildability, blocker, evidence_url FROM rr), "
        + "scored AS (SELECT *, "
        + S.confidence(S.fill_count())
        + " AS confidence FROM scored0)"
    )


def _with_scored(body: str) -> str:
    return f"WITH rr AS ({S.rr_select()}), {_scored_sql()}\n{body}"


_SAN = {f: S.classify(f, p) for f, p in RU.SANITISERS.items()}


@register("q_sanitize", S.with_rr(
    "SELECT id, " + S.canon_category("category") + " AS category, "
    + ", ".join(f"{v} AS {f}" for f, v in _SAN.items())
    + f", CAST({S.python_int('confidence_raw')} AS INTEGER) AS confidence FROM rr"
))
def q_sanitize(spark, d):
    """F1 on the raw records: known category, governed fields, confidence int-or-0."""
    r = rr(spark, d)
    cols = [F.col("id"), canon_category("category").alias("category")]
    cols += [classify(f, p).alias(f) for f, p in RU.SANITISERS.items()]
    cols.append(python_int("confidence_raw").cast("int").alias("confidence"))
    return r.select(*cols)


@register("q_issues", _with_scored(f"SELECT id, {S.issues('category', 'known_category', 'document')} AS issues FROM scored"))
def q_issues(spark, d):
    """F2-F5 in order on the scored records (raw values)."""
    from docvet.operators.verify import issues

    return scored_records(rr(spark, d)).select("id", issues("category", "known_category", "document").alias("issues"))


@register(
    "q_issue_category",
    S.with_rr(
        "SELECT id, CASE WHEN category IS NOT DISTINCT FROM upper(category) THEN NULL ELSE "
        + S.lit(fixed.CATEGORY_ISSUE.split("{category}")[0])
        + " || upper(category) END AS issue FROM rr"
    ),
)
def q_issue_category(spark, d):
    """F3 against a known category that differs (upper case)."""
    return rr(spark, d).select("id", category_issue("category", F.upper("category")).alias("issue"))


@register(
    "q_issue_blocker",
    S.with_rr(
        "SELECT id, list_filter(["
        + f"CASE WHEN coalesce(blocker IN ({S.lits(fixed.ALLOWED_VALUES['blocker'])}), false) THEN NULL ELSE {S.lit(S.allowed_message('blocker', fixed.ALLOWED_VALUES['blocker']))} END, "
        + f"CASE WHEN coalesce(blocker IN ({S.lits(fixed.BLOCKER_ACCEPTED)}), false) THEN NULL ELSE {S.lit(fixed.BLOCKER_ISSUE)} END"
        + "], lambda x: x IS NOT NULL) AS issues FROM rr"
    ),
)
def q_issue_blocker(spark, d):
    """F4 with F2's blocker message: a raw blocker outside the set gives two issues."""
    r = rr(spark, d)
    return r.select("id", issues_array(membership_issues(["blocker"]) + [blocker_issue("blocker")]).alias("issues"))


_MCP_DOC = "(CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE 'No' END)"


@register(
    "q_issue_evidence",
    f"SELECT doc_id, {S.evidence_issue(_MCP_DOC, 'text', ('pat',))} AS issue FROM documents",
)
def q_issue_evidence(spark, d):
    """F5 over whole document texts, needle overridden to ``pat`` so both outcomes occur."""
    docs = table(spark, d, "documents")
    claim = F.when(F.col("doc_id") % 3 == 0, F.lit("Yes")).otherwise(F.lit("No"))
    return docs.select("doc_id", evidence_issue(claim, "text", ("pat",)).alias("issue"))


@register(
    "q_penalty",
    _with_scored(
        f"SELECT id, confidence, {S.penalised('confidence', S.issues('category', 'known_category', 'document'))} AS penalised FROM scored"
    ),
)
def q_penalty(spark, d):
    """confidence - min(25, 5 x issues), floor 0."""
    from docvet.operators.verify import issues

    s = scored_records(rr(spark, d)).withColumn("iss", issues("category", "known_category", "document"))
    return s.select("id", "confidence", penalised("confidence", "iss").alias("penalised"))


def _verdict_sql() -> str:
    iss = S.issues("category", "known_category", "document")
    return _with_scored(
        f", v AS (SELECT *, {iss} AS issues_arr FROM scored)\n"
        f"SELECT id, len(issues_arr) = 0 AS valid, len(issues_arr) > 0 AS manual_review, issues_arr AS issues, "
        f"{S.penalised('CAST(' + S.python_int('confidence') + ' AS INTEGER)', 'issues_arr')} AS confidence FROM v"
    )


@register("q_verdict", _verdict_sql())
def q_verdict(spark, d):
    """verdict flags, issues and the penalised corrected confidence."""
    from docvet.operators.verify import verdict

    v = verdict(scored_records(rr(spark, d)))
    return v.select(
        "id",
        F.col("verdict.valid").alias("valid"),
        F.col("verdict.manual_review").alias("manual_review"),
        F.col("verdict.issues").alias("issues"),
        F.col("verdict.corrected.confidence").alias("confidence"),
    )


def _merged_sql() -> str:
    iss = S.issues("category", "known_category", "document")
    body = (
        f", v AS (SELECT *, {iss} AS issues_arr FROM scored)\n"
        "SELECT id, name, known_category AS category, description, auth_method, "
        + ", ".join(f"{S.classify(f, p)} AS {f}" for f, p in RU.SANITISERS.items())
        + ", evidence_url, "
        + S.penalised("CAST(" + S.python_int("confidence") + " AS INTEGER)", "issues_arr")
        + " AS confidence, len(issues_arr) > 0 AS manual_review, issues_arr AS issues FROM v"
    )
    return _with_scored(body)


MERGED_SQL = _merged_sql()


@register("q_merge_verdict", MERGED_SQL)
def q_merge_verdict(spark, d):
    """F8 (and F1-F7 under it): the result records."""
    return verified_records(rr(spark, d))


# ========================================================== G: aggregation
@register(
    "q_distribution",
    "SELECT CASE WHEN o_orderpriority IS NULL OR o_orderpriority = '' THEN 'Unknown' ELSE o_orderpriority END AS value, "
    "count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1",
)
def q_distribution(spark, d):
    return AG.distribution(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


_COUNTER_SQL = (
    "SELECT auth_method AS value, count(*) AS n, min(id) AS first_seen FROM rr "
    f"WHERE auth_method IS NOT NULL AND {S.utrim('auth_method')} <> '' GROUP BY 1"
)


@register("q_counter", S.with_rr(_COUNTER_SQL))
def q_counter(spark, d):
    """Non-blank raw auth values, with first appearance."""
    return AG.counter(rr(spark, d), "auth_method")


@register(
    "q_share",
    S.with_rr(f"SELECT value, n, {S.share_tenths('n', '(SELECT count(*) FROM rr)')} AS share FROM ({_COUNTER_SQL})"),
)
def q_share(spark, d):
    """Share of all rows (blanks stay in the denominator)."""
    r = rr(spark, d)
    return AG.with_share(AG.counter(r, "auth_method"), AG.row_total(r)).select("value", "n", "share")


_MULTI = ("auth_method", "self_serve", "api_type", "buildability", "mcp_support", "blocker")
_RANKED = (*_MULTI, "category")


def _multi_sql(drop_blank: bool, fields: tuple[str, ...] = _MULTI) -> str:
    parts = []
    for f in fields:
        if drop_blank:
            parts.append(f"SELECT '{f}' AS field, {f} AS value, id FROM rr WHERE {f} IS NOT NULL AND {S.utrim(f)} <> ''")
        else:
            parts.append(f"SELECT '{f}' AS field, CASE WHEN {f} IS NULL OR {f} = '' THEN 'Unknown' ELSE {f} END AS value, id FROM rr")
    return "SELECT field, value, count(*) AS n, min(id) AS first_seen FROM (" + " UNION ALL ".join(parts) + ") GROUP BY field, value"


@register("q_multi_distribution", S.with_rr(_multi_sql(False)))
def q_multi_distribution(spark, d):
    """Six distributions in one pass."""
    return AG.multi_distribution(rr(spark, d), {f: f for f in _MULTI})


@register(
    "q_topk_section",
    S.with_rr(
        "SELECT field, value, n, first_seen, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, first_seen, value) AS INTEGER) AS pos FROM ("
        + _multi_sql(True, _RANKED)
        + ")) WHERE pos <= CASE field WHEN 'category' THEN 6 ELSE 5 END"
    ),
)
def q_topk_section(spark, d):
    """Top 5 per field, top 6 categories (a top-k report)."""
    counts = AG.multi_distribution(rr(spark, d), {f: f for f in _RANKED}, drop_blank=True)
    return AG.top_k(counts, {f: fixed.TOP_K_CATEGORIES if f == "category" else fixed.TOP_K for f in _RANKED})


_OPEN_VALUES = {
    "flag": "l_returnflag",
    "supplier": "CAST(l_suppkey AS STRING)",
    "part": "CAST(l_partkey AS STRING)",
    "order": "CASE WHEN l_orderkey % 3 = 0 THEN 'hot' WHEN l_orderkey % 5 = 0 THEN 'warm' ELSE CAST(l_orderkey AS STRING) END",
}


@register(
    "q_topk_open",
    "SELECT field, value, n, first_seen, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, first_seen, value) AS INTEGER) AS pos FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {e} AS value, count(*) AS n, min(l_orderkey) AS first_seen FROM lineitem WHERE {e} IS NOT NULL AND trim({e}) <> '' GROUP BY ALL"
        for f, e in _OPEN_VALUES.items()
    )
    + ")) WHERE pos <= CASE field WHEN 'order' THEN 2 ELSE 5 END",
)
def q_topk_open(spark, d):
    """G2 + G11 over open values: bounded summaries, then only candidates are counted; even counts are counted in full."""
    from docvet.operators.heavy import top_values

    fields = {f: F.expr(e) for f, e in _OPEN_VALUES.items()}
    return top_values(table(spark, d, "lineitem"), fields, {"order": 2}, "l_orderkey")


@register(
    "q_leaders",
    S.with_rr(
        "SELECT f.field, coalesce((SELECT m.value FROM ("
        + _multi_sql(True)
        + ") m WHERE m.field = f.field ORDER BY m.n DESC, m.first_seen LIMIT 1), 'N/A') AS leader FROM (VALUES "
        + ", ".join(f"('{f}')" for f in (*_MULTI, "empty"))
        + ") f(field)"
    ),
)
def q_leaders(spark, d):
    """The leading value per field; a field that is blank in every row has ``N/A``."""
    fields = {**{f: f for f in _MULTI}, "empty": F.lit(" ")}
    return AG.leaders(AG.multi_distribution(rr(spark, d), fields, drop_blank=True), list(fields))


@register(
    "q_crosstab",
    "WITH c AS (SELECT o_orderstatus AS row_label, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE o_orderpriority END AS col_label, count(*) AS n FROM orders GROUP BY 1, 2) "
    "SELECT r.row_label, k.col_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT row_label FROM c) r "
    "CROSS JOIN (SELECT DISTINCT col_label FROM c) k LEFT JOIN c ON c.row_label = r.row_label AND c.col_label = k.col_label",
)
def q_crosstab(spark, d):
    """G5 long form, zero-filled over observed labels; every fifth order has a NULL label."""
    label = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return AG.crosstab_long(table(spark, d, "orders"), "o_orderstatus", label)


_PRIO_ALL = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register(
    "q_crosstab_wide",
    "SELECT o_orderstatus AS row_label, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE o_orderpriority = {S.lit(p)}) AS BIGINT) AS \"{p}\"" for p in _PRIO_ALL)
    + " FROM orders GROUP BY 1",
)
def q_crosstab_wide(spark, d):
    """G5 wide: one column per priority."""
    return AG.crosstab_wide(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", _PRIO_ALL)


@register(
    "q_numeric_summary",
    "SELECT coalesce(" + S.round_half_up("avg(l_quantity)", 2) + ", 0.0) AS average, coalesce("
    + S.round_half_up("median(l_quantity)", 2)
    + ", 0.0) AS median, coalesce(CAST(trunc(min(l_quantity)) AS BIGINT), 0) AS lowest, "
    "coalesce(CAST(trunc(max(l_quantity)) AS BIGINT), 0) AS highest FROM lineitem",
)
def q_numeric_summary(spark, d):
    """G6 on lineitem quantities: mean 25.40 -> 25.4, median 25, 1..50 at sf0.01."""
    return AG.numeric_summary(table(spark, d, "lineitem"), "l_quantity")


_ANY_NUMBER = (
    ("l_orderkey % 97 = 0", "'Infinity'"),
    ("l_orderkey % 89 = 0", "'-Infinity'"),
    ("l_orderkey % 83 = 0", "'NaN'"),
    ("l_orderkey % 5 = 0", "l_extendedprice * 1e300"),
)
_ANY_NUMBER_SQL = "CASE " + " ".join(f"WHEN {c} THEN CAST({v} AS DOUBLE)" for c, v in _ANY_NUMBER) + " ELSE l_extendedprice END"


@register(
    "q_numeric_summary_any",
    f"SELECT {S.round_half_up('median(v)', 2)} AS median, CAST(NULL AS BIGINT) AS highest FROM (SELECT {_ANY_NUMBER_SQL} AS v FROM lineitem) WHERE NOT isnan(v)",
)
def q_numeric_summary_any(spark, d):
    """G6 on any numbers: many distinct ones, both infinities, NaN and a range beyond a double's."""
    v = table(spark, d, "lineitem").select(F.expr(_ANY_NUMBER_SQL).alias("v"))
    return AG.numeric_summary(v, "v").select("median", "highest")


@register(
    "q_crosstab_sparse",
    "SELECT CASE grouping_id(p, s) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'col' ELSE 'total' END AS kind, "
    "p AS row_label, s AS col_label, count(*) AS n FROM (SELECT coalesce(CAST(l_partkey AS VARCHAR), 'Unknown') AS p, "
    "coalesce(CAST(l_suppkey AS VARCHAR), 'Unknown') AS s FROM lineitem) GROUP BY GROUPING SETS ((p, s), (p), (s), ())",
)
def q_crosstab_sparse(spark, d):
    """G5 for two open columns: part x supplier, pairs that occur and both margins."""
    return AG.crosstab_sparse(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@register(
    "q_conf_stats",
    _with_scored(
        "SELECT coalesce(" + S.ratio_round("sum(confidence)", "count(confidence)", 2) + ", 0.0) AS mean, "
        "CAST(coalesce(min(confidence), 0) AS BIGINT) AS min, CAST(coalesce(max(confidence), 0) AS BIGINT) AS max FROM scored"
    ),
)
def q_conf_stats(spark, d):
    """G7 on the scored confidences."""
    return AG.confidence_stats(scored_records(rr(spark, d)), "confidence")


@register("q_flag_count", "SELECT CAST(count_if(toxic = 1) AS BIGINT) AS flagged FROM labels")
def q_flag_count(spark, d):
    return AG.flag_count(table(spark, d, "labels"), F.col("toxic") == 1)


@register(
    "q_review_rate",
    "SELECT coalesce(" + S.ratio_round("count_if(quality = 0) * 100", "count(*)", 2) + ", 0.0) AS review_rate FROM labels",
)
def q_review_rate(spark, d):
    return AG.review_rate(table(spark, d, "labels"), F.col("quality") == 0)


@register("q_total", "SELECT count(*) AS total FROM lineitem")
def q_total(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("total"))


@register(
    "q_histogram",
    "WITH b AS (SELECT CASE WHEN min(l_quantity) = max(l_quantity) THEN min(l_quantity) - 0.5 ELSE min(l_quantity) END AS lo, "
    "CASE WHEN min(l_quantity) = max(l_quantity) THEN max(l_quantity) + 0.5 ELSE max(l_quantity) END AS hi FROM lineitem WHERE l_quantity IS NOT NULL), "
    "c AS (SELECT CAST(least(9, floor((l_quantity - b.lo) * 10.0 / (b.hi - b.lo))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b "
    "WHERE l_quantity IS NOT NULL GROUP BY 1), r AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) "
    "SELECT r.bin, b.lo + r.bin * ((b.hi - b.lo) / 10.0) AS lo, b.lo + (r.bin + 1) * ((b.hi - b.lo) / 10.0) AS hi, "
    "CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM r CROSS JOIN b LEFT JOIN c ON c.bin = r.bin WHERE b.lo IS NOT NULL",
)
def q_histogram(spark, d):
    """10 bins of lineitem quantities (6016, 6163, ... at sf0.01)."""
    return AG.histogram(table(spark, d, "lineitem"), "l_quantity")


@register(
    "q_by_category",
    "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1",
)
def q_by_category(spark, d):
    return AG.by_category(table(spark, d, "customer"), "c_mktsegment")


# ================================================================ D: collection
from docvet.functions.checks import official_url  # noqa: E402
from docvet.operators import collect as CO  # noqa: E402
from docvet.sources import records as REC  # noqa: E402


@register("q_search_text", f"SELECT p_partkey, {S.lit(fixed.SEARCH_TEXT.split('{name}')[0])} || p_name || {S.lit(fixed.SEARCH_TEXT.split('{name}')[1])} AS query FROM part")
def q_search_text(spark, d):
    """The search text per app (part names stand in for apps)."""
    return table(spark, d, "part").select("p_partkey", CO.search_text("p_name").alias("query"))


@register(
    "q_official_url",
    f"SELECT page_id, {S.official_url('url', REC.PAGE_INDICATORS, REC.PAGE_BLOCKED)} AS official, {S.official_url('url')} AS official_default FROM pages",
)
def q_official_url(spark, d):
    """D2 with the override lists and with the default lists."""
    p = table(spark, d, "pages")
    return p.select(
        "page_id",
        official_url("url", REC.PAGE_INDICATORS, REC.PAGE_BLOCKED).alias("official"),
        official_url("url").alias("official_default"),
    )


_HITS_SQL = (
    f"hits AS (SELECT regexp_extract(url, {S.lit(REC.HOST_PATTERN)}, 1) AS app, page_id AS rank, url, "
    f"{S.official_url('url', REC.PAGE_INDICATORS, REC.PAGE_BLOCKED)} AS official FROM pages)"
)
_TOP_SQL = (
    "top AS (SELECT app, rank, url, official, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app ORDER BY official DESC, rank) AS INTEGER) AS pos, "
    "max(CAST(official AS INTEGER)) OVER (PARTITION BY app) AS any_official FROM hits) "
    f"WHERE pos <= {fixed.PAGES_PER_APP} AND CAST(official AS INTEGER) = any_official)"
)


@register("q_top_docs", f"WITH {_HITS_SQL}, {_TOP_SQL} SELECT * FROM top")
def q_top_docs(spark, d):
    """D3: per host, official pages if any, else the rest; first 3 by page id."""
    return CO.top_docs(REC.page_hits(spark, d)).select("app", "rank", "url", "official", "pos")


@register(
    "q_evidence_urls",
    f"WITH {_HITS_SQL}, {_TOP_SQL} SELECT app, string_agg(url, {S.lit(fixed.EVIDENCE_SEPARATOR)} ORDER BY rank) AS evidence_url, "
    "CAST(count(*) AS INTEGER) AS n_pages FROM top GROUP BY app",
)
def q_evidence_urls(spark, d):
    """Evidence URLs of the chosen pages, in rank order."""
    top = CO.top_docs(REC.page_hits(spark, d)).withColumn("text", F.lit(None).cast("string"))
    return CO.combine_pages(top, failed=None).select("app", "evidence_url", "n_pages")


def _combine_sql(with_failures: bool) -> str:
    failed = "doc_id % 7 = 0" if with_failures else "false"
    text = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END" if with_failures else "text"
    h0, h1 = fixed.PAGE_HEADER.split("{url}")
    return (
        "WITH pages0 AS (SELECT source AS app, doc_id AS rank, 'https://docs.' || source || '.example/' || CAST(doc_id AS VARCHAR) AS url, "
        f"{text} AS text, {failed} AS failed FROM documents), "
        f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY rank) AS pos FROM pages0) WHERE pos <= {fixed.PAGES_PER_APP}) "
        f"SELECT app, string_agg(CASE WHEN failed THEN '' ELSE {S.lit(h0)} || url || {S.lit(h1)} || coalesce(substring(text, 1, {fixed.CHARS_PER_PAGE}), '') END, '' ORDER BY rank) AS document, "
        f"string_agg(url, {S.lit(fixed.EVIDENCE_SEPARATOR)} ORDER BY rank) AS evidence_url, CAST(count(*) AS INTEGER) AS n_pages FROM top GROUP BY app"
    )


def _doc_pages(spark, d, failures: bool) -> DataFrame:
    pages = REC.document_pages(spark, d)
    if not failures:
        pages = table(spark, d, "documents").select(
            F.col("source").alias("app"),
            F.col("doc_id").alias("rank"),
            F.concat(F.lit("https://docs."), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
            F.col("text"),
            F.lit(False).alias("failed"),
        )
    # the text is cut before it takes part in the ranking's sort and shuffle
    pages = pages.withColumn("text", F.substring("text", 1, fixed.CHARS_PER_PAGE))
    return CO.top_docs(pages.withColumn("official", F.lit(False)))


@register("q_combine_pages", _combine_sql(False))
def q_combine_pages(spark, d):
    """Per source, the first 3 documents as one text (headers, 1500 chars each)."""
    return CO.combine_pages(_doc_pages(spark, d, False))


@register("q_failed_pages", _combine_sql(True))
def q_failed_pages(spark, d):
    """Failed pages keep their URL only; NULL content keeps its header only."""
    return CO.combine_pages(_doc_pages(spark, d, True))


@register("q_no_hits", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_no_hits(spark, d):
    """Documents ("apps") without any label row ("hit")."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return CO.no_hits(docs, table(spark, d, "labels"), "doc_id")


def _page_text_sql(x: str) -> str:
    t = x
    t = f"regexp_replace({t}, {S.lit(CO._SCRIPT)}, ' ', 'g')"
    t = f"regexp_replace({t}, {S.lit(CO._STYLE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {S.lit(CO._COMMENT)}, ' ', 'g')"
    t = f"regexp_replace({t}, {S.lit(CO._TAG)}, ' ', 'g')"
    for ent, rep in CO._ENTITIES:
        t = f"replace({t}, {S.lit(ent)}, {S.lit(rep)})"
    t = f"regexp_replace({t}, {S.lit(CO._SPACES)}, ' ', 'g')"
    return f"trim({t})"


@register("q_page_text", f"SELECT page_id, {_page_text_sql('html')} AS text FROM pages")
def q_page_text(spark, d):
    """HTML pages to plain text (whole pages)."""
    return table(spark, d, "pages").select("page_id", CO.page_text("html").alias("text"))


# ============================================================ E1-E3: extraction
from docvet.operators import extract as EX  # noqa: E402


def _request_sql() -> str:
    tpl = EX.REQUEST_TEMPLATE
    values = {
        "name": "'app' || CAST(doc_id AS VARCHAR)",
        "category": "source",
        "website": "source || '.example'",
        "documentation": f"substring(coalesce(text, ''), 1, {fixed.REQUEST_DOC_CHARS})",
    }
    parts = []
    rest = tpl
    while True:
        cut = min(((rest.find("{" + k + "}"), k) for k in values if rest.find("{" + k + "}") >= 0), default=None)
        if cut is None:
            parts.append(S.lit(rest))
            break
        pos, key = cut
        parts.append(S.lit(rest[:pos]))
        parts.append(f"coalesce({values[key]}, 'None')")
        rest = rest[pos + len(key) + 2 :]
    return " || ".join(parts)


@register("q_request_text", f"SELECT doc_id, {_request_sql()} AS request FROM documents")
def q_request_text(spark, d):
    """One extraction request per document (first 6000 characters)."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("app"), F.col("doc_id").cast("string"))
    web = F.concat(F.col("source"), F.lit(".example"))
    return docs.select("doc_id", EX.request_text(name, F.col("source"), web, F.col("text")).alias("request"))


_STUB_SQL = {
    "auth_method": "CASE WHEN contains({t}, 'oauth') THEN 'OAuth 2.0' WHEN contains({t}, 'key') THEN 'API key' ELSE 'Unknown' END",
    "self_serve": "CASE WHEN contains({t}, 'free') THEN 'Self Serve' ELSE 'Unknown' END",
    "credential_requirement": "CASE WHEN contains({t}, 'key') THEN 'API key' ELSE 'Unknown' END",
    "api_type": "CASE WHEN contains({t}, 'rest') THEN 'REST' ELSE 'Unknown' END",
    "api_scope": "'Unknown'",
    "mcp_support": "CASE WHEN contains({t}, 'mcp') THEN 'Yes' ELSE 'Unknown' END",
    "buildability": "CASE WHEN contains({t}, 'api') THEN 'Yes' ELSE 'Unknown' END",
    "blocker": "'None'",
}


def _stub_sql(field: str, text: str) -> str:
    return _STUB_SQL[field].replace("{t}", f"lower({text})")


def _first_words_sql(text: str) -> str:
    return f"array_to_string(list_slice(string_split({S.utrim(S.collapse_ws(text))}, ' '), 1, 12), ' ')"


#: The keyword function's answer to a document, field by field; a blank description is none.
_ANSWER_SQL = (
    "SELECT doc_id AS id, coalesce(source, '') AS category, "
    + f"nullif({_first_words_sql('text')}, '') AS description, coalesce(source || '.example', '') AS evidence_url, "
    + ", ".join(f"{_stub_sql(f, 'text')} AS {f}" for f in _STUB_SQL)
    + " FROM documents"
)


def _document_apps(spark, d):
    """Every document as the documentation of an app of its own."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("app"), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.col("source"), F.lit(".example")).alias("website"),
        F.col("source").alias("category"),
        F.col("text").alias("document"),
    )


@register("q_extract_batch", f"SELECT a.*, CAST(NULL AS VARCHAR) AS error FROM ({_ANSWER_SQL}) a")
def q_extract_batch(spark, d):
    """E1 -> E2 -> E3: a keyword function over every document's request, in Arrow batches; all fields of the answers."""
    docs = _document_apps(spark, d)
    asked = docs.withColumn("request", EX.request_text("name", "category", "website", "document"))
    answered = EX.extract_batch(asked, EX.keyword_extractor).select("id", "payload", "error")
    return EX.parse_record(answered).select("id", *EX.REQUIRED, "description", "api_scope", "error")


def _clearer_when_strict() -> EX.ExtractFn:
    """The keyword function, but some calls fail, some answers are no JSON, and a strict answer names no blocker."""
    import json

    answer = EX.keyword_extractor()

    def fn(request: str, row) -> str:
        number, strict = int(row["name"].removeprefix("app")), request.endswith(EX.RETRY_SUFFIX)
        if number % 7 == 0 and not (strict and number % 2):
            raise RuntimeError("no answer")
        if number % 11 == 0 and not strict:
            return "not json"
        record = json.loads(answer(request, row))
        return json.dumps(record | {"blocker": "Unknown"} if strict else record)

    return fn


_THIN = 7
_FILLED_SQL = " + ".join(f"CAST(coalesce({f}, '') NOT IN ('', 'Unknown') AS INTEGER)" for f in fixed.FILL_FIELDS)


@register(
    "q_extract_retry",
    f"WITH a AS ({_ANSWER_SQL}), f AS (SELECT a.*, {_FILLED_SQL} AS filled, "
    "CASE WHEN id % 7 = 0 THEN 'no answer' WHEN id % 11 = 0 THEN 'answer is not a JSON object' END AS e1, "
    "CASE WHEN id % 7 = 0 AND id % 2 = 0 THEN 'no answer' END AS e2 FROM a), "
    f"p AS (SELECT *, (e1 IS NOT NULL OR filled < {_THIN}) AND (e1 IS NOT NULL OR e2 IS NULL) AS again FROM f), "
    "r AS (SELECT *, CASE WHEN again THEN e2 ELSE e1 END AS error FROM p) "
    "SELECT id, CASE WHEN again THEN 'strict' ELSE 'first' END AS pass, error, "
    + ", ".join(f"CASE WHEN error IS NULL THEN {f} END AS {f}" for f in ("category", "description", "auth_method", "api_type", "credential_requirement", "evidence_url"))
    + ", CASE WHEN error IS NULL THEN CASE WHEN again THEN 'Unknown' ELSE blocker END END AS blocker FROM r",
)
def q_extract_retry(spark, d):
    """E1 -> E2 -> E3 twice: what could not be read, or has few fields filled, is asked again with the strict request.

    Answers go through a ledger, so another run over it asks only the calls that failed.
    """
    from docvet.operators import ledger as LE

    path = scratch_path(spark, "ledger")
    docs = written(_document_apps(spark, d), "apps")

    def parsed(rows, which):
        request = EX.request_text("name", "category", "website", "document", retry=which == LE.STRICT)
        got = LE.ask(rows.withColumn("request", request), _clearer_when_strict, path, which)
        return written(EX.parse_record(got.select("id", "payload", "error")), which)

    first = parsed(docs, LE.FIRST)
    thin = written(docs.join(first.where(EX.is_thin(_THIN)).select("id"), "id", "left_semi"), "thin")
    best = EX.better_answer(first, parsed(thin, LE.STRICT), "id")
    return best.select("id", "pass", "error", "category", "description", "auth_method", "api_type", "credential_requirement", "evidence_url", "blocker")


@register(
    "q_parse_record",
    "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k, "
    "CASE WHEN props IS NULL THEN 'empty answer' WHEN json_extract(props, '$.k') IS NULL THEN 'missing required field(s): k' END AS error FROM events",
)
def q_parse_record(spark, d):
    """E3's general form: parse JSON payloads with a schema; missing required fields become error rows."""
    from pyspark.sql import types as T

    ev = table(spark, d, "events").select("event_id", "props")
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return EX.parse_payload(ev, "props", schema, ("k",)).select("event_id", "k", "error")


def _answer(**changes: str | None) -> str:
    """An answer of 12 fields as JSON text; a change is a field's JSON text, None leaves the field out."""
    given = {f: '"v"' for f in (*EX.REQUIRED, "description", "api_scope")} | {"confidence": "7"} | changes
    return "{" + ",".join(f'"{k}":{v}' for k, v in given.items() if v is not None) + "}"


# payload, then what must come of it, stated by hand: auth_method, description, api_scope ("=": the
# estimate where it is known), error.
_WITHOUT = "field(s) without text: "
_ANSWERS: tuple[tuple[str | None, str | None, str | None, str | None, str | None], ...] = (
    (_answer(), "v", "v", "v", None),
    (_answer(confidence=None), "v", "v", "v", None),
    (_answer(description=None), "v", None, "v", None),
    (_answer(description="null"), "v", None, "v", None),
    (_answer(description='""'), "v", None, "v", None),
    (_answer(description="5"), "v", None, "v", _WITHOUT + "description"),
    (_answer(api_scope=None), "v", "v", "=", _WITHOUT + "api_scope"),
    (_answer(api_scope="null"), "v", "v", "=", _WITHOUT + "api_scope"),
    (_answer(api_scope='"Unknown"'), "v", "v", "=Unknown", None),
    (_answer(api_scope="[1]"), "v", "v", None, _WITHOUT + "api_scope"),
    (_answer(auth_method="null"), None, "v", "v", _WITHOUT + "auth_method"),
    (_answer(auth_method="5", mcp_support="true"), None, "v", "v", _WITHOUT + "auth_method, mcp_support"),
    (_answer(auth_method='["a"]'), None, "v", "v", _WITHOUT + "auth_method"),
    (_answer(auth_method='""'), "", "v", "v", None),
    ('{"auth_method":"v"', None, None, None, "answer is not a JSON object"),
    ("[1,2]", None, None, None, "answer is not a JSON object"),
    (None, None, None, None, "empty answer"),
)


def _parse_full_sql() -> str:
    est = S.scope_bucket(_BUILT)

    def by_case(values: list[str]) -> str:
        return f"CASE doc_id % {len(_ANSWERS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    def scope(v: str | None) -> str:
        if v is None or not v.startswith("="):
            return S.lit(v)
        return f"CASE WHEN {est} <> 'Unknown' THEN {est} ELSE {S.lit(v[1:] or None)} END"

    def error(v: str | None, e: str | None) -> str:
        return f"CASE WHEN {est} = 'Unknown' THEN {S.lit(e)} END" if v == "=" else S.lit(e)

    return (
        f"SELECT doc_id, CAST({by_case([S.lit(a[1]) for a in _ANSWERS])} AS VARCHAR) AS auth_method, "
        f"CAST({by_case([S.lit(a[2]) for a in _ANSWERS])} AS VARCHAR) AS description, "
        f"CAST({by_case([scope(a[3]) for a in _ANSWERS])} AS VARCHAR) AS api_scope, "
        f"CAST({by_case([error(a[3], a[4]) for a in _ANSWERS])} AS VARCHAR) AS error FROM documents"
    )


@register("q_parse_record_full", _parse_full_sql())
def q_parse_record_full(spark, d):
    """E3 on 12-field answers: whole, with a field missing, null, empty, a number, a boolean or a list, broken, absent."""
    answers = F.array(*[F.lit(a[0]).cast("string") for a in _ANSWERS])
    built = _built(spark, d).withColumn("payload", F.element_at(answers, (F.col("doc_id") % len(_ANSWERS)).cast("int") + 1))
    return EX.parse_record(built, scope_estimate=scope_bucket("text")).select("doc_id", "auth_method", "description", "api_scope", "error")


# ====================================================== G13, G16: reports
from docvet.plans import report as RP  # noqa: E402


def _raw_sql() -> str:
    """SQL of the raw frame over RR as a results table."""

    def raw(c: str) -> str:
        return S.fill_default(c, "", False)

    return (
        "raw AS (SELECT id, "
        + S.fill_default("name", "Unknown", False)
        + " AS app, "
        + ", ".join(f"{raw(c)} AS {c}" for c in ("category", "auth_method", "self_serve", "api_type", "buildability", "mcp_support", "blocker", "credential_requirement"))
        + ", '' AS issues, "
        + S.safe_numeric(S.fill_default("confidence_raw", "0", False))
        + " AS confidence, "
        + S.parse_number(S.fill_default("confidence_raw", "0", False))
        + " AS confidence_value, "
        + S.to_bool(S.fill_default("review_raw", "False", False))
        + " AS review FROM rr)"
    )


def _raw_lines_sql() -> str:
    parts = [
        f"SELECT '{sec}' AS section, {col} AS value, id FROM raw WHERE {col} IS NOT NULL AND {S.utrim(col)} <> ''"
        for sec, col in RP.RAW_SECTIONS.items()
    ]
    return (
        "lines AS (SELECT section, value, count(*) AS n, min(id) AS first_seen, "
        + S.share_tenths("count(*)", "(SELECT count(*) FROM raw)")
        + " AS share FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY section, value)"
    )


@register("q_report_raw", S.with_rr("SELECT section, value, n, first_seen, share FROM lines", _raw_sql(), _raw_lines_sql()))
def q_report_raw(spark, d):
    """G2/G3/G4 as the raw report's eight counters with shares (long form)."""
    return RP.raw_lines(RP.raw_frame_of_records(spark, d)).select("section", "value", "n", "first_seen", "share")


def _findings_sql() -> str:
    a0, a1 = fixed.FINDING_AUTH.split("{value}")
    a1a, a1b = a1.split("{share}")
    s0, s1 = fixed.FINDING_SELF_SERVE.split("{value}")
    s1a, s1b = s1.split("{share}")
    b0, b1 = fixed.FINDING_BLOCKER.split("{value}")
    r0, r1 = fixed.FINDING_REVIEW.split("{rate}")
    rate = S.ratio_round("count_if(review) * 100", "count(*)", 2)
    return S.with_rr(
        "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS pos, finding FROM items, st WHERE st.total > 0",
        _raw_sql(),
        _raw_lines_sql(),
        "lead AS (SELECT section, arg_max(value, n * 1000000000 - first_seen) AS value, arg_max(share, n * 1000000000 - first_seen) AS share FROM lines GROUP BY section)",
        f"st AS (SELECT count(*) AS total, coalesce({rate}, 0.0) AS rate FROM raw)",
        "items AS ("
        f"SELECT 1 AS o, {S.lit(a0)} || value || {S.lit(a1a)} || CAST(share AS VARCHAR) || {S.lit(a1b)} AS finding FROM lead WHERE section = 'top_auth_methods' "
        f"UNION ALL SELECT 2, {S.lit(s0)} || value || {S.lit(s1a)} || CAST(share AS VARCHAR) || {S.lit(s1b)} FROM lead WHERE section = 'top_self_serve' "
        f"UNION ALL SELECT 3, {S.lit(b0)} || value || {S.lit(b1)} FROM lead WHERE section = 'top_blockers' "
        f"UNION ALL SELECT 4, {S.lit(r0)} || CAST(rate AS VARCHAR) || {S.lit(r1)} FROM st WHERE rate >= {fixed.REVIEW_RATE_FINDING})",
    )


@register("q_findings", _findings_sql())
def q_findings(spark, d):
    """The findings sentences."""
    return RP.findings(RP.raw_frame_of_records(spark, d))


def _norm_sql() -> str:
    cols = {
        "app": S.fill_default("name"),
        "category": S.fill_default("category"),
        "auth": S.classify(S.fill_default("auth_method"), RU.AUTH),
        "api_type": S.classify(S.fill_default("api_type"), RU.API_TYPE),
        "self_serve": S.classify(S.fill_default("self_serve"), RU.SELF_SERVE),
        "buildability": S.classify(S.fill_default("buildability"), RU.BUILDABILITY),
        "mcp": S.classify(S.fill_default("mcp_support"), RU.MCP),
        "blocker": S.classify(S.fill_default("blocker"), RU.BLOCKER),
        "confidence": S.safe_numeric(S.fill_default("confidence_raw", "0")),
        "review": S.to_bool(S.fill_default("review_raw", "False")),
    }
    return "norm AS (SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM rr)"


def _report_lines_sql() -> str:
    parts = []
    for sec, col in RP.NORMALISED_DISTRIBUTIONS.items():
        parts.append(f"SELECT '{sec}' AS section, CAST(NULL AS VARCHAR) AS key, {col} AS label, count(*) AS n, CAST(NULL AS DOUBLE) AS x FROM norm GROUP BY {col}")
    parts.append("SELECT 'blocker_distribution', NULL, CASE WHEN blocker IS NULL OR blocker = '' THEN 'Unknown' ELSE blocker END, count(*), NULL FROM norm GROUP BY 3")
    parts.append("SELECT 'counts_by_category', NULL, category, count(*), NULL FROM norm GROUP BY category")
    for sec, col in RP.CROSSTABS.items():
        parts.append(
            f"SELECT '{sec}', r.category, k.lab, coalesce(c.n, 0), NULL FROM (SELECT DISTINCT category FROM norm) r "
            f"CROSS JOIN (SELECT DISTINCT {col} AS lab FROM norm) k LEFT JOIN (SELECT category, {col} AS lab, count(*) AS n FROM norm GROUP BY 1, 2) c "
            "ON c.category = r.category AND c.lab = k.lab"
        )
    parts.append(f"SELECT 'confidence_summary', NULL, 'average', NULL, coalesce({S.round_half_up('avg(confidence)', 2)}, 0.0) FROM norm")
    parts.append(f"SELECT 'confidence_summary', NULL, 'median', NULL, coalesce({S.round_half_up('median(confidence)', 2)}, 0.0) FROM norm")
    parts.append("SELECT 'confidence_summary', NULL, 'lowest', coalesce(min(confidence), 0), NULL FROM norm")
    parts.append("SELECT 'confidence_summary', NULL, 'highest', coalesce(max(confidence), 0), NULL FROM norm")
    parts.append("SELECT 'confidence_summary', NULL, 'manual_review_count', count_if(review), NULL FROM norm")
    return "SELECT section, key, label, CAST(n AS BIGINT) AS n, x FROM (" + " UNION ALL ".join(parts) + ")"


@register("q_report", f"WITH rr AS ({S.rr_select()}), {_norm_sql()}\n{_report_lines_sql()}")
def q_report(spark, d):
    """The normalised report in long form (section, key, label, n, x)."""
    return RP.normalised_lines(normalised_frame(as_results(rr(spark, d))))


def _summary_sql() -> str:
    parts = ", ".join(
        f"coalesce((SELECT value FROM lines WHERE section = '{sec}' ORDER BY n DESC, first_seen LIMIT 1), 'N/A') AS {sec}_leader" for sec in RP.RAW_SECTIONS
    )
    return S.with_rr(
        "SELECT count(*) AS total_rows, CAST(count_if(review) AS BIGINT) AS manual_review_count, "
        f"coalesce({S.ratio_round('count_if(review) * 100', 'count(*)', 2)}, 0.0) AS manual_review_rate, "
        f"coalesce({S.round_half_up('avg(confidence_value)', 2)}, 0.0) AS average_confidence, "
        "CAST(coalesce(min(confidence), 0) AS BIGINT) AS min_confidence, CAST(coalesce(max(confidence), 0) AS BIGINT) AS max_confidence, "
        + parts
        + " FROM raw",
        _raw_sql(),
        _raw_lines_sql(),
    )


@register("q_report_summary", _summary_sql())
def q_report_summary(spark, d):
    """The closed part of the raw report, one row of figures and leaders."""
    return RP.raw_summary(RP.raw_frame_of_records(spark, d)).drop("findings")


@register(
    "q_review_queue",
    f"WITH rr AS ({S.rr_select()}), {_raw_sql()} SELECT id, app AS name, confidence, issues FROM raw WHERE review",
)
def q_review_queue(spark, d):
    """Flagged rows as name, confidence, issues."""
    return RP.review_queue(RP.raw_frame_of_records(spark, d))


# ============================================================ A: sources, sinks
from pyspark.sql import types as T  # noqa: E402

from docvet.operators.resolve import resolve  # noqa: E402
from docvet.session import scratch_path, written  # noqa: E402
from docvet.sources import files as FI  # noqa: E402

_DRIFT_LAYOUTS = (("key", "status", "priority"), ("key", "customer", "status", "priority", "note"))
_DRIFT_NOTE = 'He said "no, never"'


@register(
    "q_scan_drift",
    "SELECT CASE WHEN o_orderkey % 15 = 2 THEN 'reject' ELSE 'row' END AS kind, CAST(o_orderkey AS VARCHAR) AS key, "
    "CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 15 <> 2 THEN CAST(o_custkey AS VARCHAR) END AS customer, "
    "o_orderstatus AS status, CASE WHEN o_orderkey % 15 <> 2 THEN o_orderpriority END AS priority, "
    f"CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 15 <> 2 THEN {S.lit(_DRIFT_NOTE)} END AS note FROM orders",
)
def q_scan_drift(spark, d):
    """A1/A2 on drifted files: orders written as records of two widths, some too narrow for either, with a header
    before some records and another one glued to some; every record read by its own layout."""
    from docvet.sources.drift import read_drifted

    path = scratch_path(spark, "drift")
    key = F.col("o_orderkey")
    text = lambda c: F.col(c).cast("string")
    line = lambda *cols: F.to_csv(F.struct(*cols), {"escape": '"'})
    narrow = line(text("o_orderkey"), text("o_orderstatus"), text("o_orderpriority"))
    wide = line(text("o_orderkey"), text("o_custkey"), text("o_orderstatus"), text("o_orderpriority"), F.lit(_DRIFT_NOTE).alias("note"))
    record = F.when(key % 15 == 2, line(text("o_orderkey"), text("o_orderstatus"))).when(key % 3 == 0, narrow).otherwise(wide)
    header = ",".join(_DRIFT_LAYOUTS[1])
    before = F.when(key % 97 == 0, F.lit(header + "\n")).when(key % 101 == 0, F.lit(header)).otherwise(F.lit(""))
    table(spark, d, "orders").select(F.concat(before, record)).write.text(path)
    read = read_drifted(spark, path, _DRIFT_LAYOUTS, headers=[_DRIFT_LAYOUTS[1]], multi_line=False)
    field = lambda i: F.get("fields", F.lit(i))
    none = F.lit(None).cast("string")
    rejects = read.rejects.select(F.lit("reject").alias("kind"), field(0).alias("key"), none.alias("customer"), field(1).alias("status"), none.alias("priority"), none.alias("note"))
    return read.rows.select(F.lit("row").alias("kind"), "key", "customer", "status", "priority", "note").union(rejects)


_NATION_SCHEMA = T.StructType(
    [T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())]
)


@register("q_scan_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_scan_csv(spark, d):
    """A1: write nation as CSV (shared scratch folder), read it back with a schema and the NULL tokens."""
    path = scratch_path(spark, "scan-csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.options(**FI.CSV_WRITE).csv(path)
    return FI.read_csv(spark, path, _NATION_SCHEMA)


_REGION_SCHEMA = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())])


@register("q_scan_first", "SELECT r_regionkey, r_name FROM region")
def q_scan_first(spark, d):
    """A2: the first existing path among three candidates."""
    root = scratch_path(spark, "scan-first")
    table(spark, d, "region").select("r_regionkey", "r_name").write.options(**FI.CSV_WRITE).csv(f"{root}/data")
    return FI.read_first(spark, [f"{root}/outputs", f"{root}/data", f"{root}/root"], _REGION_SCHEMA)


_ALIASES = {
    "app": ("App", "C_NAME", "name"),
    "segment": ("Segment", "c_mktsegment"),
    "nation": ("nation", "C_NationKey"),
    "missing": ("nope", "also_nope"),
}


@register(
    "q_alias_resolve",
    "SELECT c_custkey, "
    + S.fill_default("c_name")
    + " AS app, "
    + S.fill_default("c_mktsegment")
    + " AS segment, "
    + S.fill_default("c_nationkey")
    + " AS nation, 'Unknown' AS missing FROM customer",
)
def q_alias_resolve(spark, d):
    """A3: first alias wins, exact then case-insensitive; missing -> default."""
    return resolve(table(spark, d, "customer"), _ALIASES, keep=["c_custkey"])


_DISPLAY_SQL = (
    "name AS \"App\", category AS \"Category\", description AS \"Description\", auth_method AS \"Auth Method\", "
    "credential_requirement AS \"Credential Requirement\", self_serve AS \"Self Serve\", api_type AS \"API Type\", "
    "api_scope AS \"API Surface\", mcp_support AS \"MCP\", buildability AS \"Buildability\", blocker AS \"Blocker\", "
    "evidence_url AS \"Evidence URL\", confidence AS \"Confidence\", manual_review AS \"Needs Review\", "
    "CAST(to_json(issues) AS VARCHAR) AS \"Issues\", lpad(CAST(id AS VARCHAR), 20, '0') AS \"Row\""
)


def _merged_cte() -> str:
    body = MERGED_SQL
    head, select = body.split("\nSELECT id, name,", 1)
    return head + ", merged AS (SELECT id, name," + select + ")"


@register("q_result_append", _merged_cte() + f"\nSELECT {_DISPLAY_SQL} FROM merged UNION ALL SELECT {_DISPLAY_SQL} FROM merged")
def q_result_append(spark, d):
    """A4 + A10: reset-write then append the result records as CSV; read back (twice each)."""
    path = scratch_path(spark, "results-csv")
    res = written(verified_records(rr(spark, d)), "results")
    FI.write_results(res, path, reset=True)
    FI.write_results(res, path)
    return FI.read_results(spark, path)


@register("q_json_append", _merged_cte() + "\nSELECT * FROM merged UNION ALL SELECT * FROM merged")
def q_json_append(spark, d):
    """A5: the result records as JSON lines, written after a reset and appended once; read back."""
    path = scratch_path(spark, "results-json")
    recs = written(verified_records(rr(spark, d)), "results")
    FI.write_json(recs, path, reset=True)
    FI.write_json(recs, path)
    return spark.read.schema(recs.schema).json(path)


_MISSING_SQL = (
    f"SELECT 'app' || CAST(doc_id AS VARCHAR) AS app, {S.lit(fixed.NO_RESULT_ERROR)} AS error, {S.lit(fixed.NO_RESULT_NOTES)} AS notes "
    "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
)


@register("q_error_rows", f"{_MISSING_SQL} UNION ALL {_MISSING_SQL}")
def q_error_rows(spark, d):
    """A6 over D7: apps without hits become error rows, written after a reset and appended once; read back."""
    path = scratch_path(spark, "errors")
    _, errors, _ = _run_frames(spark, d)
    FI.write_errors(errors, path, reset=True)
    FI.write_errors(errors, path)
    return FI.read_errors(spark, path)


@register(
    "q_run_log",
    "SELECT unnest(string_split(rtrim(entry, chr(10)), chr(10))) AS value FROM (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'app' || CAST(d.doc_id AS VARCHAR) || "
    + S.lit(" " + fixed.LOG_OK + "\n")
    + " ELSE 'app' || CAST(d.doc_id AS VARCHAR) || "
    + S.lit(" " + fixed.LOG_FAIL + "\n" + fixed.NO_RESULT_LOG + "\n")
    + " END AS entry FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)",
)
def q_run_log(spark, d):
    """The run log (``name ✔`` or ``name ❌`` + a reason line per app), written as text; its lines read back."""
    docs = table(spark, d, "documents").select("doc_id")
    hit = table(spark, d, "labels").select("doc_id").distinct().withColumn("ok", F.lit(True))
    j = docs.join(hit, "doc_id", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    entries = j.select("doc_id", FI.log_entry(F.concat(F.lit("app"), F.col("doc_id").cast("string")), ok, F.when(~ok, F.lit(fixed.NO_RESULT_LOG))).alias("entry"))
    path = scratch_path(spark, "run-log")
    FI.write_log(entries, path, reset=True)
    return spark.read.text(path)


@register(
    "q_verify_sample",
    _merged_cte() + f"\nSELECT {_DISPLAY_SQL} FROM merged WHERE confidence < {fixed.LOW_CONFIDENCE} OR manual_review",
)
def q_verify_sample(spark, d):
    """Low-confidence or flagged results, written only when there is one."""
    path = scratch_path(spark, "verification")
    res = verified_records(rr(spark, d))
    sample = SE.low_confidence(res, "confidence", "manual_review")
    if not FI.write_verification_sample(sample, path):
        return FI.to_display(sample)
    return FI.read_results(spark, path)


def _written_report(spark, d) -> str:
    path = scratch_path(spark, "report")
    RP.write_raw_report(RP.raw_frame_of_records(spark, d), path)
    return path


@register("q_report_json", _summary_sql())
def q_report_json(spark, d):
    """The report's JSON document, written and read back."""
    schema = RP.raw_summary(RP.raw_frame_of_records(spark, d)).schema
    return spark.read.schema(schema).json(f"{_written_report(spark, d)}/summary").drop("findings")


@register("q_report_sections", S.with_rr("SELECT section, value, n, first_seen, share FROM lines", _raw_sql(), _raw_lines_sql()))
def q_report_sections(spark, d):
    """Every entry of every section, written partitioned by section and read back."""
    return spark.read.parquet(f"{_written_report(spark, d)}/sections").select("section", "value", "n", "first_seen", "share")


@register("q_report_queue", f"WITH rr AS ({S.rr_select()}), {_raw_sql()} SELECT id, app AS name, confidence, issues FROM raw WHERE review")
def q_report_queue(spark, d):
    """The whole review queue, written and read back."""
    return spark.read.parquet(f"{_written_report(spark, d)}/review_queue")


def _files_report_sql() -> str:
    token = "('" + "', '".join(t.replace("'", "''") for t in fixed.NULL_TOKENS) + "')"
    kept = {"top_auth_methods": "auth_method", "top_blockers": "blocker", "top_self_serve": "self_serve"}
    parts = [f"SELECT '{sec}' AS section, trim({c}) AS value FROM merged WHERE {c} IS NOT NULL AND {c} NOT IN {token} AND trim({c}) <> ''" for sec, c in kept.items()]
    return _merged_cte() + "\nSELECT section, value, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@register("q_report_from_files", _files_report_sql())
def q_report_from_files(spark, d):
    """A2 + G16: results written as CSV, read from the first path there is with the missing-value tokens (such as ``None``) as NULL."""
    root = scratch_path(spark, "report-files")
    FI.write_results(verified_records(rr(spark, d)), f"{root}/data", reset=True)
    lines = RP.raw_lines(RP.raw_frame_from_files(spark, [f"{root}/outputs", f"{root}/data"]))
    return lines.where(F.col("section").isin("top_auth_methods", "top_blockers", "top_self_serve")).select("section", "value", "n")


def _run_frames(spark, d):
    """Results, errors and log of a run whose apps are the documents; those without a label have no hit."""
    from docvet.operators.collect import no_hits

    results = verified_records(rr(spark, d))
    docs = table(spark, d, "documents").select("doc_id")
    missing = no_hits(docs, table(spark, d, "labels"), "doc_id").select(F.concat(F.lit("app"), F.col("doc_id").cast("string")).alias("name"))
    errors = FI.error_rows(missing.withColumn("err", F.lit(fixed.NO_RESULT_ERROR)), "name", "err", F.lit(fixed.NO_RESULT_NOTES))
    return results, errors, missing.select("name", FI.log_entry("name", F.lit(False), F.lit(fixed.NO_RESULT_LOG)).alias("entry"))


@register(
    "q_reset_append",
    _merged_cte()
    + ", m AS (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))"
    + "\nSELECT 'results' AS output, CAST(2 * count(*) AS BIGINT) AS n FROM merged UNION ALL SELECT 'json', 2 * count(*) FROM merged "
    "UNION ALL SELECT 'errors', 2 * n FROM m UNION ALL SELECT 'log', 4 * n FROM m "
    f"UNION ALL SELECT 'verification', count(*) FROM merged WHERE confidence < {fixed.LOW_CONFIDENCE} OR manual_review",
)
def q_reset_append(spark, d):
    """A10: a run, a second that resets the four outputs, a third that appends; rows (or lines) of each output."""
    root = scratch_path(spark, "run")
    frames = _run_frames(spark, d)
    for reset in (False, True, False):
        FI.write_run(*frames, root, reset=reset)
    read = {
        "results": FI.read_results(spark, f"{root}/results"),
        "json": spark.read.schema(frames[0].schema).json(f"{root}/json"),
        "errors": FI.read_errors(spark, f"{root}/errors"),
        "log": spark.read.text(f"{root}/log"),
        "verification": FI.read_results(spark, f"{root}/verification"),
    }
    counts = [df.agg(F.lit(k).alias("output"), F.count(F.lit(1)).alias("n")) for k, df in read.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@register(
    "q_union_rows",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F' "
    "UNION ALL SELECT o_orderkey, NULL, NULL, o_totalprice FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'",
)
def q_union_rows(spark, d):
    """Existing rows and new rows with other columns, combined by name."""
    o = table(spark, d, "orders")
    old_rows = F.col("o_orderstatus").eqNullSafe("F")  # the two halves cover every row, NULLs included
    existing = o.where(old_rows).select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where(~old_rows).select("o_orderkey", "o_totalprice")
    return FI.union_rows(existing, new)


# ================================================================ H: streaming
from docvet.streaming import incremental as INC  # noqa: E402


@register("q_stream_append", MERGED_SQL)
def q_stream_append(spark, d):
    """H1: the files of the documents table arrive; results are verified and appended (equals the batch result)."""
    root = scratch_path(spark, "stream-append")
    docs = table(spark, d, "documents")
    INC.stream_results(spark, f"{d}/documents.parquet", f"{root}/out", f"{root}/ckpt", docs.schema)
    return spark.read.parquet(f"{root}/out")


@register("q_stream_distribution", "SELECT coalesce(CAST(event_type AS VARCHAR), 'Unknown') AS value, count(*) AS n FROM events GROUP BY 1")
def q_stream_distribution(spark, d):
    """H2: the event-type distribution kept current over micro-batches."""
    root = scratch_path(spark, "stream-dist")
    ev = table(spark, d, "events")
    INC.stream_distribution(spark, f"{d}/events.parquet", f"{root}/out", f"{root}/ckpt", ev.schema, "event_type")
    return INC.latest_distribution(spark, f"{root}/out")


def _streamed_state(spark, d) -> str:
    from docvet.streaming.report_state import stream_report

    root = scratch_path(spark, "stream-report")
    stream_report(spark, f"{d}/documents.parquet", f"{root}/state", f"{root}/ckpt", table(spark, d, "documents").schema)
    return f"{root}/state"


@register("q_stream_report", ORACLE["q_report_raw"])
def q_stream_report(spark, d):
    """H2 for the raw report: all counters kept current over micro-batches (equals the batch report)."""
    from docvet.streaming.report_state import current_raw_lines

    return current_raw_lines(spark, _streamed_state(spark, d)).select("section", "value", "n", "first_seen", "share")


@register("q_stream_report_normalised", ORACLE["q_report"])
def q_stream_report_normalised(spark, d):
    """H2 for the normalised report: distributions, crosstabs and the confidence summary from the merged state."""
    from docvet.streaming.report_state import current_normalised_lines

    return current_normalised_lines(spark, _streamed_state(spark, d))


# ============================================================ end-to-end run
from docvet.plans.research import research_run  # noqa: E402


def _fails_at_times() -> EX.ExtractFn:
    """The keyword function, but for apps whose call fails or whose answer is no JSON."""
    answer = EX.keyword_extractor()

    def fn(request: str, row) -> str:
        if row["name"].endswith(".org"):
            raise RuntimeError("no answer")
        return "not json" if row["name"].startswith("m.") else answer(request, row)

    return fn


def _run_ctes() -> str:
    h0, h1 = fixed.PAGE_HEADER.split("{url}")
    piece = f"{S.lit(h0)} || t.url || {S.lit(h1)} || coalesce(substring({_page_text_sql('p.html')}, 1, {fixed.CHARS_PER_PAGE}), '')"
    return (
        f"{_HITS_SQL}, {_TOP_SQL}, docs AS (SELECT t.app, string_agg({piece}, '' ORDER BY t.rank) AS document, "
        f"string_agg(t.url, {S.lit(fixed.EVIDENCE_SEPARATOR)} ORDER BY t.rank) AS evidence FROM top t JOIN pages p ON p.page_id = t.rank GROUP BY t.app), "
        "named AS (SELECT DISTINCT app AS name FROM hits UNION SELECT DISTINCT source || '.test' FROM documents)"
    )


def _run_sql() -> str:
    category = S.canon_category(r"regexp_extract(app, '\.([a-z]+)$', 1)")
    words = _first_words_sql("document")
    records = (
        f"SELECT app AS id, app AS name, {category} AS category, document AS text, {words} AS description, app AS evidence_url, "
        + ", ".join(f"{_stub_sql(f, 'document')} AS {f}" for f in _STUB_SQL)
        + " FROM docs WHERE NOT app LIKE '%.org' AND NOT app LIKE 'm.%'"
    )
    merged = _merged_cte().replace(S.rr_select(), records)
    return merged.replace("WITH ", f"WITH {_run_ctes()}, ", 1) + "\nSELECT m.* REPLACE (d.evidence AS evidence_url) FROM merged m JOIN docs d ON d.app = m.name"


@register("q_research_run", _run_sql())
def q_research_run(spark, d):
    """A1, D2-D8, E1-E10, F1-F8 end to end: the result records of a run over the pages table."""
    return research_run(spark, d, _fails_at_times).results


@register(
    "q_research_errors",
    f"WITH {_run_ctes()} SELECT app, 'no answer' AS error, {S.lit(fixed.EXCEPTION_NOTES)} AS notes FROM docs WHERE app LIKE '%.org' "
    f"UNION ALL SELECT app, 'answer is not a JSON object', {S.lit(fixed.EXCEPTION_NOTES)} FROM docs WHERE app LIKE 'm.%' AND NOT app LIKE '%.org' "
    f"UNION ALL SELECT name, {S.lit(fixed.NO_RESULT_ERROR)}, {S.lit(fixed.NO_RESULT_NOTES)} FROM named WHERE name NOT IN (SELECT app FROM docs)",
)
def q_research_errors(spark, d):
    """A6 from the same run: failed calls, unreadable answers, apps without pages."""
    return research_run(spark, d, _fails_at_times).errors
