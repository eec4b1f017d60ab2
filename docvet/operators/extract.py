"""Structured extraction.

E1 builds the request text as a Column; E2 hands batches to a caller's
extraction function with ``mapInArrow`` (Arrow batches, the function is set
up once per partition); E3 reads the JSON answer as a variant and routes records
whose required fields don't hold text to an error column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.functions import fixed
from docvet.functions.scoring import fill_count
from docvet.functions.text import col_of

def _value_lists() -> str:
    return "\n".join(f"- {field}: {' | '.join(values)}" for field, values in fixed.ALLOWED_VALUES.items())


# Request template: {name} {category} {website} {documentation}.  Wording is
# free (it does not change any computed value); pass your own.  The allowed
# values are those that verification checks.
REQUEST_TEMPLATE = (
    "Extract structured facts about a software product from its developer documentation.\n"
    "Return one JSON object and nothing else; use \"Unknown\" for anything the text does not state.\n\n"
    "Known category: {category}\nApplication: {name}\nWebsite: {website}\n\n"
    "Documentation:\n{documentation}\n\n"
    "Fields: category, description, auth_method, self_serve, credential_requirement, api_type, "
    "api_scope, mcp_support, buildability, blocker, evidence_url, confidence.\n"
    "Every value is text.  Allowed values:\n" + _value_lists() + "\n"
    "mcp_support is Unknown unless the documentation itself mentions MCP or the Model Context Protocol.\n"
)
#: Request for a description alone, over the first characters of the document.
DESCRIPTION_TEMPLATE = (
    "Describe in one or two sentences what this product is and what its API offers, from its documentation only.\n\n"
    "Application: {name}\nWebsite: {website}\nCategory: {category}\n\nDocumentation:\n{documentation}\n"
)
DESCRIPTION_DOC_CHARS = 5000
RETRY_SUFFIX = "\n\nStricter pass: keep only values the documentation states; otherwise \"Unknown\". Keep the known category.\n"

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("self_serve", T.StringType()),
        T.StructField("credential_requirement", T.StringType()),
        T.StructField("api_type", T.StringType()),
        T.StructField("api_scope", T.StringType()),
        T.StructField("mcp_support", T.StringType()),
        T.StructField("buildability", T.StringType()),
        T.StructField("blocker", T.StringType()),
        T.StructField("evidence_url", T.StringType()),
        # text first: a quoted number would be NULL as INT; B10 converts later
        T.StructField("confidence", T.StringType()),
    ]
)
#: Fields an answer must hold as text.  The name is the catalogue's, the confidence is computed, a
#: missing description and scope are filled from the document.
REQUIRED = tuple(f.name for f in RECORD_SCHEMA.fields if f.name not in ("name", "description", "api_scope", "confidence"))


def request_text(
    name: str | Column,
    category: str | Column,
    website: str | Column,
    document: str | Column,
    template: str = REQUEST_TEMPLATE,
    retry: bool = False,
    doc_chars: int = fixed.REQUEST_DOC_CHARS,
) -> Column:
    """The template filled with the app fields and the first ``doc_chars`` characters."""
    values = {
        "name": col_of(name).cast("string"),
        "category": col_of(category).cast("string"),
        "website": col_of(website).cast("string"),
        "documentation": F.substring(F.coalesce(col_of(document), F.lit("")), 1, doc_chars),
    }
    parts: list[Column] = []
    rest = template
    while True:
        cut = min(((rest.find("{" + k + "}"), k) for k in values if rest.find("{" + k + "}") >= 0), default=None)
        if cut is None:
            parts.append(F.lit(rest))
            break
        pos, key = cut
        parts.append(F.lit(rest[:pos]))
        parts.append(F.coalesce(values[key], F.lit("None")))
        rest = rest[pos + len(key) + 2 :]
    if retry:
        parts.append(F.lit(RETRY_SUFFIX))
    return F.concat(*parts)


def description_request(name: str | Column, category: str | Column, website: str | Column, document: str | Column) -> Column:
    """The request for E4's substitute: whoever answers it passes the answer to ``score(substitute=...)``."""
    return request_text(name, category, website, document, DESCRIPTION_TEMPLATE, doc_chars=DESCRIPTION_DOC_CHARS)


#: Rows whose texts are Python objects at a time, and that are handed back at a time.
ROWS_AT_ONCE = 128

#: From the request text and the row's fields to the answer (JSON text), or an exception.
ExtractFn = Callable[[str, Mapping[str, str]], str]


def extract_batch(
    df: DataFrame, make_fn: Callable[[], ExtractFn], request: str = "request", fields: Sequence[str] = ("name", "website", "category", "document")
) -> DataFrame:
    """The caller's extraction function on every row, in Arrow batches.

    ``make_fn`` runs once per partition on the executor (open clients there).  All columns of ``df``
    pass through, so the answers need no join; added: payload (NULL on failure), error (the
    exception's text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_fn()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                payloads, errors = [], []
                for ask, *values in zip(*(part.column(f).to_pylist() for f in (request, *fields))):
                    row = {f: v if isinstance(v, str) else "" for f, v in zip(fields, values)}
                    try:
                        payloads.append(fn(ask, row))
                        errors.append(None)
                    except Exception as exc:  # noqa: BLE001 - one record's failure is data
                        payloads.append(None)
                        errors.append(str(exc))
                added = [pa.array(payloads, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "payload", "error"])

    schema = T.StructType([*df.schema.fields, T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])
    return df.mapInArrow(run, schema)


def keyword_extractor() -> ExtractFn:
    """A deterministic stand-in for a model: reads a few facts off the text.

    Used by tests and the catalogue; a real deployment passes its own client.
    """

    def fn(request: str, row: Mapping[str, str]) -> str:
        website, category, document = row["website"], row["category"], row["document"]
        low = document.lower()
        rec = {
            "category": category,
            "description": " ".join(document.split()[:12]),
            "auth_method": "OAuth 2.0" if "oauth" in low else ("API key" if "key" in low else "Unknown"),
            "self_serve": "Self Serve" if "free" in low else "Unknown",
            "credential_requirement": "API key" if "key" in low else "Unknown",
            "api_type": "REST" if "rest" in low else "Unknown",
            "api_scope": "Unknown",
            "mcp_support": "Yes" if "mcp" in low else "Unknown",
            "buildability": "Yes" if "api" in low else "Unknown",
            "blocker": "None",
            "evidence_url": website,
            "confidence": 0,
        }
        return json.dumps(rec)

    return fn


def is_thin(least: int, error: str | Column = "error") -> Column:
    """Whether a parsed answer is worth asking again: unreadable, or with fewer than ``least`` fields filled."""
    return col_of(error).isNotNull() | (fill_count(fixed.FILL_FIELDS) < least)


def better_answer(first: DataFrame, strict: DataFrame, key: str) -> DataFrame:
    """Parsed answers of the first pass, where the strict pass has a readable one that one instead.

    ``strict`` holds the rows asked again (a subset by ``key``, which names a row).  Adds ``pass``, the
    pass that the answer is from; an answer that neither pass could read keeps its strict error.
    """
    columns = [c for c in first.columns if c != key]
    again = strict.select(key, F.struct(*columns).alias("__strict"))
    both = first.join(again, key, "left")
    asked, read = F.col("__strict").isNotNull(), F.col("__strict.error").isNull()
    take = asked & (read | F.col("error").isNotNull())
    chosen = [F.when(take, F.col(f"__strict.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return both.select(key, *chosen, F.when(take, F.lit("strict")).otherwise(F.lit("first")).alias("pass"))


def parse_payload(df: DataFrame, payload: str, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """Parse JSON with a schema (PERMISSIVE); a missing required field makes the row an error row.

    Adds the parsed fields and ``error`` (NULL for good rows).
    """
    keys = F.json_object_keys(F.col(payload))
    missing = F.filter(F.array(*map(F.lit, required)), lambda r: ~F.coalesce(F.array_contains(keys, r), F.lit(False)))
    err = (
        F.when(F.col(payload).isNull(), F.lit("empty answer"))
        .when(keys.isNull(), F.lit("answer is not a JSON object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing required field(s): "), F.array_join(missing, ", ")))
    )
    parsed = F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"})
    return df.select(*df.columns, parsed.alias("__r"), err.alias("error")).select(*df.columns, "__r.*", "error")


def parse_record(df: DataFrame, payload: str = "payload", scope_estimate: str | Column = "Unknown") -> DataFrame:
    """The answer's text fields, from one variant parse, and ``error`` (NULL for good rows).

    A required field must be there and hold text: a missing one, a null, a number, a boolean, a
    list or an object makes an error row.  An empty description (missing, null, "", 0, false, an
    empty list or object) is left NULL for E4; another one must be text.  An empty or Unknown scope takes
    ``scope_estimate`` if that is known (a column, or the word "Unknown" for none), else it must be
    text too.  ``name`` and ``confidence`` of an answer are not read.
    """
    estimate = F.lit("Unknown") if isinstance(scope_estimate, str) and scope_estimate == "Unknown" else col_of(scope_estimate)
    fields = (*REQUIRED, "description", "api_scope")
    base = [c for c in df.columns if c not in ("error", *fields)]
    at = lambda f: F.variant_get("__v", f"$.{f}", "variant")
    raw = df.withColumn("__v", F.try_parse_json(F.col(payload))).withColumn("__estimate", estimate)
    of_kind = [F.schema_of_variant(at(f)).alias(f) for f in fields]
    of_text = [F.try_variant_get("__v", f"$.{f}", "string").alias(f) for f in fields]
    is_object = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    # a path into a JSON value that is no object is an error, so only objects are looked into
    staged = raw.withColumn("__v", F.when(is_object, F.col("__v"))).withColumn("__object", is_object)
    staged = staged.withColumn("__kind", F.struct(*of_kind)).withColumn("__text", F.struct(*of_text))

    is_text = lambda f: F.coalesce(F.col(f"__kind.{f}") == "STRING", F.lit(False))
    empty = lambda f: F.coalesce(F.col(f"__text.{f}").isin("", "0", "0.0", "false", "[]", "{}"), F.lit(True))
    value = lambda f: F.when(is_text(f), F.col(f"__text.{f}"))
    take_estimate = (empty("api_scope") | (is_text("api_scope") & (F.col("__text.api_scope") == "Unknown"))) & (F.col("__estimate") != "Unknown") & F.col("__object")
    wrong = [F.when(~is_text(f), F.lit(f)) for f in REQUIRED]
    wrong.append(F.when(~is_text("description") & ~empty("description"), F.lit("description")))
    wrong.append(F.when(~is_text("api_scope") & ~take_estimate, F.lit("api_scope")))
    bad = F.array_compact(F.array(*wrong))
    failed = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    err = (
        F.when(F.col(payload).isNull(), F.coalesce(failed, F.lit("empty answer")))
        .when(~F.col("__object"), F.lit("answer is not a JSON object"))
        .when(F.size(bad) > 0, F.concat(F.lit("field(s) without text: "), F.array_join(bad, ", ")))
    )
    return staged.select(
        *base,
        *[value(f).alias(f) for f in REQUIRED],
        F.when(~(empty("description") & is_text("description")), value("description")).alias("description"),
        F.when(take_estimate, F.col("__estimate")).otherwise(value("api_scope")).alias("api_scope"),
        err.alias("error"),
    )
