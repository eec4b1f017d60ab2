"""CSV files whose records do not all have the layout of their header (A1, A2 on drifted files).

A results file that several versions of a writer appended to holds records of several widths, repeated
headers, and a header without its line break, with the first record glued to its last name.  Read by
one schema, such records shift their values into the wrong columns.  Here every record finds its own
layout: by its number of fields, after headers are recognised by their names and taken off.  All
records come out under one list of columns; what fits no layout is a side output, never a shifted row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.text import null_tokens_to_null
from docvet.sources.files import CSV_READ

#: A quoted field: its commas and line breaks separate nothing.
_QUOTED = r'(^|,)\s*"(?:[^"]|"")*"'


@dataclass
class Drifted:
    """``rows``: the records under one list of columns; ``rejects``: ``fields`` (as read), ``width`` and ``reason``."""

    rows: DataFrame
    rejects: DataFrame


def _same(field: Column, name: str) -> Column:
    return F.lower(F.trim(field)) == name.lower()


def _without_header(fields: Column, header: Sequence[str]) -> Column:
    """The record's own fields: none of a header alone, and of a header with a record glued to it that record's."""
    last = len(header) - 1
    begins = F.size(fields) >= len(header)
    for i, name in enumerate(header[:-1]):
        begins = begins & _same(F.get(fields, F.lit(i)), name)
    tail = F.ltrim(F.get(fields, F.lit(last)))
    begins = begins & F.lower(tail).startswith(header[-1].lower())
    glued = F.substring(tail, len(header[-1]) + 1, 2**31 - 1)
    rest = F.concat(F.array(glued), F.slice(fields, len(header) + 1, F.greatest(F.size(fields) - len(header), F.lit(0))))
    alone = (F.size(fields) == len(header)) & (F.trim(glued) == "")
    return F.when(~F.coalesce(begins, F.lit(False)), fields).when(alone, F.array().cast("array<string>")).otherwise(rest)


def read_drifted(
    spark: SparkSession,
    path: str | Sequence[str],
    layouts: Sequence[Sequence[str]],
    headers: Sequence[Sequence[str]] = (),
    columns: Sequence[str] | None = None,
    null_tokens: Sequence[str] | None = fixed.NULL_TOKENS,
    multi_line: bool = True,
) -> Drifted:
    """The records of the files at ``path``, each by the layout of its width.

    ``layouts``: the columns of each kind of record, all of different lengths; ``headers``: the names of
    header records, wherever they stand in a file; ``columns``: the columns of the result (default: all of
    the layouts', in order of appearance), NULL where a record's layout has them not.  With
    ``multi_line=False`` a file is split among tasks, which needs records without line breaks in fields.

    Defined results: an empty line is no record; quotes are doubled; a record wider than any layout (and
    a header glued to it) is rejected with the fields that were read; missing-value tokens are NULL.
    """
    widths = [len(c) for c in layouts]
    if not layouts or len(set(widths)) != len(widths):
        raise ValueError("layouts must differ in their number of columns")
    columns = list(dict.fromkeys(c for names in layouts for c in names)) if columns is None else list(columns)
    most = max(widths) + max(map(len, headers), default=0)
    # one column more than any record may fill, so that the reader keeps the text of every one that does not
    names = [f"f{i}" for i in range(most + 1)]
    options = CSV_READ | {"header": "false", "nullValue": "", "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE"}
    schema = ", ".join([f"{n} STRING" for n in names] + ["whole STRING"])
    raw = spark.read.schema(schema).options(**options, columnNameOfCorruptRecord="whole").csv(path)
    # an empty field and one that is not there are both NULL: the text says how many there are
    width = F.when(F.col("whole").isNull(), F.lit(most + 1)).otherwise(1 + F.regexp_count(F.regexp_replace("whole", _QUOTED, "$1"), F.lit(",")))
    fields = F.transform(F.slice(F.array(*names), F.lit(1), F.least(width, F.lit(most + 1))), lambda f: F.coalesce(f, F.lit("")))
    staged = raw.select(fields.alias("fields"), (width > most).alias("cut"))
    for header in headers:
        staged = staged.withColumn("fields", F.when(F.col("cut"), F.col("fields")).otherwise(_without_header(F.col("fields"), header)))
    staged = staged.where(F.size("fields") > 0).withColumn("width", F.size("fields"))
    fits = ~F.col("cut") & F.col("width").isin(widths)

    def value(column: str) -> Column:
        out = F.lit(None).cast("string")
        for layout in layouts:
            if column in layout:
                out = F.when(F.col("width") == len(layout), F.get("fields", F.lit(list(layout).index(column)))).otherwise(out)
        return out if null_tokens is None else null_tokens_to_null(out, null_tokens)

    rows = staged.where(fits).select(*[value(c).alias(c) for c in columns])
    reason = F.when(F.col("cut"), F.lit("more fields than any layout")).otherwise(F.concat(F.lit("no layout of "), F.col("width").cast("string"), F.lit(" field(s)")))
    return Drifted(rows, staged.where(~fits).select("fields", "width", reason.alias("reason")))
