"""Reports: findings (G13) and the assembled reports.

Two reports exist, as in the original: the rule-normalised report
(distributions, confidence summary, category counts, three crosstabs) and
the raw-value report (counters with shares, review queue, findings,
verification stats).

Plan shape: every row emits its (section, key, label) entries and one
aggregation counts them, so the rows are scanned once and shuffled as partial
counts.  That small table is written to the shared folder; all sections,
shares, the exact median, leaders and findings read it.  No section is cut;
what is open-ended stays in rows, and only closed label sets and figures share
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import ratio_round, round_half_up, utrim
from docvet.operators import aggregate as AG
from docvet.plans.analysis import as_results, normalised_frame, raw_frame
from docvet.session import written
from docvet.sources.files import ROW_ID, first_existing, missing_report, read_results, write_json_document
from docvet.sources.records import research_records

NORMALISED_DISTRIBUTIONS = {
    "authentication_distribution": "auth",
    "api_type_distribution": "api_type",
    "self_serve_distribution": "self_serve",
    "buildability_distribution": "buildability",
    "mcp_distribution": "mcp",
}
CROSSTABS = {
    "auth_by_category": "auth",
    "self_serve_by_category": "self_serve",
    "buildability_by_category": "buildability",
}
RAW_SECTIONS = {
    "top_auth_methods": "auth_method",
    "top_self_serve": "self_serve",
    "top_api_types": "api_type",
    "top_buildability": "buildability",
    "top_mcp_support": "mcp_support",
    "top_blockers": "blocker",
    "top_categories": "category",
    "top_credential_requirements": "credential_requirement",
}

def auth_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: normalised auth label, count and share of all records."""
    n = normalised_frame(as_results(research_records(spark, sf_dir)))
    counts = AG.distribution(n, "auth")
    return AG.with_share(counts, AG.row_total(n)).select("value", "n", "share")


def _line(section: str | Column, key: Column | None, label: Column, n: Column | None, x: Column | None = None) -> list[Column]:
    return [
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        (key if key is not None else F.lit(None)).cast("string").alias("key"),
        label.cast("string").alias("label"),
        (n if n is not None else F.lit(None)).cast("bigint").alias("n"),
        (x if x is not None else F.lit(None)).cast("double").alias("x"),
    ]


_CONF = "__confidence"
_REVIEW = "__review"


def _entry(section: str, key: Column | None, label: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        (key if key is not None else F.lit(None)).cast("string").alias("key"),
        label.cast("string").alias("label"),
    )


def report_counts(norm: DataFrame) -> DataFrame:
    """One pass over the normalised rows: every row emits its entries (five
    distributions, blocker, category, three crosstab pairs, its confidence
    value and its review flag) and a single aggregation counts them.

    Partial aggregation runs before the only shuffle, so the exchange carries
    at most (sections x labels) rows per task, whatever the input size.
    Columns: section, key, label, n.
    """
    blocker = F.when(F.col("blocker").isNull() | (F.col("blocker") == ""), F.lit("Unknown")).otherwise(F.col("blocker"))
    entries = [_entry(sec, None, F.col(c)) for sec, c in NORMALISED_DISTRIBUTIONS.items()]
    entries.append(_entry("blocker_distribution", None, blocker))
    entries.append(_entry("counts_by_category", None, F.col("category")))
    entries += [_entry(sec, F.col("category"), F.col(c)) for sec, c in CROSSTABS.items()]
    entries.append(_entry(_CONF, None, F.col("confidence")))
    entries.append(_entry(_REVIEW, None, F.col("review")))
    exploded = norm.select("id", F.explode(F.array(*entries)).alias("e")).select("id", "e.section", "e.key", "e.label")
    return exploded.groupBy("section", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_seen"))


def _summary_lines(counts: DataFrame) -> DataFrame:
    """Mean, exact median, min, max of the counted confidence values, and the review count."""
    sec = F.col("section")
    v = F.col("label").cast("bigint")
    median = AG.median_of_counts(counts.where(sec == _CONF).select(v.alias("value"), "n"))
    g = counts.agg(
        F.sum(F.when(sec == _CONF, v * F.col("n"))).alias("sv"),
        F.sum(F.when(sec == _CONF, F.col("n"))).alias("cnt"),
        F.min(F.when(sec == _CONF, v)).alias("mn"),
        F.max(F.when(sec == _CONF, v)).alias("mx"),
        F.coalesce(F.sum(F.when((sec == _REVIEW) & (F.col("label") == "true"), F.col("n"))), F.lit(0)).alias("flagged"),
    )
    none = F.lit(None)

    def stat(name: str, n: Column, x: Column) -> Column:
        return F.struct(F.lit(name).alias("k"), n.cast("bigint").alias("n"), x.cast("double").alias("x"))

    rows = F.array(
        stat("average", none, F.coalesce(round_half_up(F.col("sv") / F.col("cnt"), 2), F.lit(0.0))),
        stat("median", none, F.coalesce(round_half_up(F.lit(median).cast("double"), 2), F.lit(0.0))),
        stat("lowest", F.coalesce("mn", F.lit(0)), none),
        stat("highest", F.coalesce("mx", F.lit(0)), none),
        stat("manual_review_count", F.col("flagged"), none),
    )
    return g.select(F.explode(rows).alias("s")).select(*_line("confidence_summary", None, F.col("s.k"), F.col("s.n"), F.col("s.x")))


def normalised_lines(norm: DataFrame) -> DataFrame:
    """The normalised report, complete, in long form: (section, key, label, n, x).

    ``report_counts`` is written once (one scan of the rows, one shuffle of
    partial counts); every section reads that small table.  Crosstabs are
    zero-filled over the column labels observed in their section, which come
    from the closed sets of the rule packs.
    """
    return normalised_lines_of(written(report_counts(norm), "report-counts"))


def normalised_lines_of(counts: DataFrame) -> DataFrame:
    """The same from the counts alone, a small written table."""
    plain = counts.where(F.col("key").isNull() & ~F.col("section").isin(_CONF, _REVIEW))
    parts = [plain.select(*_line(F.col("section"), None, F.col("label"), F.col("n")))]
    xt = counts.where(F.col("key").isNotNull())
    labels = xt.groupBy("section").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    per_row = xt.groupBy("section", "key").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    # ``labels`` has one row per crosstab section (three), each a closed label set: a proven bound
    grid = per_row.join(F.broadcast(labels), "section").select("section", "key", "m", F.explode("labels").alias("lab"))
    parts.append(grid.select(*_line(F.col("section"), F.col("key"), F.col("lab"), F.coalesce(F.col("m")[F.col("lab")], F.lit(0)))))
    parts.append(_summary_lines(counts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ROWS = "__rows"


def raw_counts(raw: DataFrame) -> DataFrame:
    """One pass over the raw rows: each row emits its non-blank value of every
    counted field, one row marker, its review flag and its confidence; a
    single aggregation (partial before the shuffle) counts them.
    Columns: section, value, n, first_seen."""
    entries = [F.struct(F.lit(sec).alias("section"), F.col(c).cast("string").alias("value")) for sec, c in RAW_SECTIONS.items()]
    entries.append(F.struct(F.lit(_ROWS).alias("section"), F.lit("").alias("value")))
    entries.append(F.struct(F.lit(_REVIEW).alias("section"), F.col("review").cast("string").alias("value")))
    entries.append(F.struct(F.lit(_CONF).alias("section"), F.col("confidence_value").cast("string").alias("value")))
    kept = F.filter(F.array(*entries), lambda e: e["section"].startswith("__") | (e["value"].isNotNull() & (utrim(e["value"]) != "")))
    long = raw.select(F.col("id"), F.explode(kept).alias("e")).select("id", "e.section", "e.value")
    return long.groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_seen"))


def _raw_summary(counts: DataFrame) -> DataFrame:
    """One row from the small counts table: totals, review count, confidence
    sums, distinct values per section and the leader of each section."""
    sec = F.col("section")
    v = F.col("value").cast("double")
    aggs = [
        F.coalesce(F.sum(F.when(sec == _ROWS, F.col("n"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when((sec == _REVIEW) & (F.col("value") == "true"), F.col("n"))), F.lit(0)).alias("flagged"),
        F.sum(F.when(sec == _CONF, v * F.col("n"))).alias("conf_sum"),
        F.sum(F.when(sec == _CONF, F.col("n"))).alias("conf_n"),
        F.min(F.when(sec == _CONF, v)).try_cast("bigint").alias("conf_min"),
        F.max(F.when(sec == _CONF, v)).try_cast("bigint").alias("conf_max"),
    ]
    for s, _ in RAW_SECTIONS.items():
        aggs.append(F.count_if(sec == s).alias(f"{s}_values"))
        aggs.append(F.min_by(F.when(sec == s, F.struct("value", "n")), F.when(sec == s, F.struct(-F.col("n"), F.col("first_seen")))).alias(f"{s}_leader"))
    return counts.agg(*aggs)


def raw_lines(raw: DataFrame) -> DataFrame:
    """Counters of the raw report with shares of all rows: section, value, n, first_seen, share."""
    return raw_lines_of(written(raw_counts(raw), "raw-counts"))


def raw_lines_of(counts: DataFrame) -> DataFrame:
    """The same from the counts alone, a small written table."""
    total = counts.where(F.col("section") == _ROWS).select(F.sum("n")).scalar()
    return AG.with_share(counts.where(~F.col("section").startswith("__")), total)


def _findings_array(g: DataFrame) -> Column:
    """The findings sentences from the one-row summary (leaders, rate)."""
    total = F.col("total_rows")
    rate = F.coalesce(ratio_round(F.col("flagged") * F.lit(100), total, 2), F.lit(0.0))

    def fill(template: str, value: Column, share: Column | None = None) -> Column:
        head, rest = template.split("{value}")
        if share is None:
            return F.concat(F.lit(head), value, F.lit(rest))
        mid, tail = rest.split("{share}")
        return F.concat(F.lit(head), value, F.lit(mid), share.cast("string"), F.lit(tail))

    def share(leader: Column) -> Column:
        return ratio_round(leader["n"] * F.lit(100), total, 1)

    auth = F.col("top_auth_methods_leader")
    ss = F.col("top_self_serve_leader")
    blk = F.col("top_blockers_leader")
    rh, rt = fixed.FINDING_REVIEW.split("{rate}")
    items = F.array(
        F.when(auth.isNotNull(), fill(fixed.FINDING_AUTH, auth["value"], share(auth))),
        F.when(ss.isNotNull(), fill(fixed.FINDING_SELF_SERVE, ss["value"], share(ss))),
        F.when(blk.isNotNull(), fill(fixed.FINDING_BLOCKER, blk["value"])),
        F.when(rate >= fixed.REVIEW_RATE_FINDING, F.concat(F.lit(rh), rate.cast("string"), F.lit(rt))),
    )
    return F.when(total > 0, F.array_compact(items)).otherwise(F.array().cast("array<string>"))


def findings(raw: DataFrame) -> DataFrame:
    """Templated sentences from the leaders of auth, self-serve and
    blocker, and the review line when the rate is at least 10.  Columns: pos, finding.

    One scan and one aggregation of the raw rows, then one global aggregate
    of the (small) counts; no subquery re-reads the base data."""
    g = _raw_summary(raw_counts(raw))
    return g.select(F.posexplode(_findings_array(g)).alias("pos", "finding")).select((F.col("pos") + 1).alias("pos"), "finding")


def raw_summary_of(counts: DataFrame) -> DataFrame:
    """The closed part of the raw report, one row: totals, rate, confidence, findings, leaders."""
    g = _raw_summary(counts)
    leader = lambda s: F.coalesce(F.col(f"{s}_leader")["value"], F.lit("N/A")).alias(f"{s}_leader")
    return g.select(
        "total_rows",
        F.col("flagged").alias("manual_review_count"),
        F.coalesce(ratio_round(F.col("flagged") * F.lit(100), F.col("total_rows"), 2), F.lit(0.0)).alias("manual_review_rate"),
        F.coalesce(round_half_up(F.col("conf_sum") / F.col("conf_n"), 2), F.lit(0.0)).alias("average_confidence"),
        F.coalesce("conf_min", F.lit(0)).alias("min_confidence"),
        F.coalesce("conf_max", F.lit(0)).alias("max_confidence"),
        _findings_array(g).alias("findings"),
        *map(leader, RAW_SECTIONS),
    )


def raw_summary(raw: DataFrame) -> DataFrame:
    return raw_summary_of(written(raw_counts(raw), "raw-counts"))


def write_raw_report(raw: DataFrame, path: str) -> None:
    """A9, complete at any size: the raw-value report as three outputs below ``path``.

    ``sections``: one row per section entry, partitioned by section; ``review_queue``: every flagged
    row; ``summary``: the closed part, one JSON document.  Entries of a section are in the order of
    the report when read by n descending, then first_seen.
    """
    counts = written(raw_counts(raw), "raw-counts")
    raw_lines_of(counts).write.mode("overwrite").partitionBy("section").parquet(f"{path}/sections")
    review_queue(raw).write.mode("overwrite").parquet(f"{path}/review_queue")
    write_json_document(raw_summary_of(counts), f"{path}/summary")


def review_queue(raw: DataFrame) -> DataFrame:
    """B5 on the raw frame: flagged rows as name, confidence, issues."""
    return raw.where("review").select("id", F.col("app").alias("name"), F.col("confidence").cast("bigint").alias("confidence"), F.col("issues").alias("issues"))


def raw_frame_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_frame(as_results(research_records(spark, sf_dir)))


def raw_frame_from_files(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """A2: the raw frame of the first results file that exists, its missing-value tokens as NULL.

    Rows keep the id that the sink wrote with them, so ties by first appearance do not depend on
    how the files are split.
    """
    return raw_frame(read_results(spark, first_existing(spark, candidates), fixed.NULL_TOKENS), order=ROW_ID)


def report_from_files(spark: SparkSession, candidates: list[str], path: str) -> None:
    """A2 + A9: write the raw report of the first results file that exists; without one the summary
    is ``{total_rows: 0, message}``."""
    try:
        raw = raw_frame_from_files(spark, candidates)
    except FileNotFoundError:
        write_json_document(missing_report(spark), f"{path}/summary")
    else:
        write_raw_report(raw, path)
