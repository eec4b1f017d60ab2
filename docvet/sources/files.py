"""File sources and sinks.

Every write is a distributed DataFrame write (part files per task), never a
driver-side file append; "append" adds part files, so re-runs keep
duplicates, as the original appends did.  A run's outputs count together, by a
manifest (``write_run``).  Paths must be shared storage (the catalogue writes
below ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.functions import fixed
from docvet.functions.text import null_tokens_to_null
from docvet.operators.select import low_confidence
from docvet.session import written

# CSV options that round-trip text exactly: RFC-4180 quote doubling, an
# explicit NULL marker so "" stays "", no whitespace trimming, multi-line cells.
CSV_WRITE = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_READ = dict(CSV_WRITE, multiLine="true")

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null_tokens: Sequence[str] | None = fixed.NULL_TOKENS) -> DataFrame:
    """A1: CSV with an explicit schema; the missing-value tokens of a pandas
    reader become NULL in text columns (``None``, ``NA``, ``nan``, ...)."""
    df = spark.read.schema(schema).options(**CSV_READ).csv(path)
    return _without_tokens(df, schema, null_tokens)


def _without_tokens(df: DataFrame, schema: T.StructType, null_tokens: Sequence[str] | None) -> DataFrame:
    if null_tokens is None:
        return df
    return df.select(
        *[
            null_tokens_to_null(F.col(f"`{f.name}`"), null_tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in schema.fields
        ]
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A1 for the app catalogue (id, name, website, category)."""
    return read_csv(spark, path, CATALOGUE_SCHEMA)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """A2: the first candidate path that exists, else FileNotFoundError."""
    for c in candidates:
        if path_exists(spark, c):
            return c
    raise FileNotFoundError("no input found in: " + ", ".join(candidates))


def read_first(spark: SparkSession, candidates: Sequence[str], schema: T.StructType) -> DataFrame:
    """A2: read the results from the first candidate that exists."""
    return read_csv(spark, first_existing(spark, candidates), schema)


#: The sink's column for a record's id; it keeps the order of rows through files.
ROW_ID = "Row"


def to_display(df: DataFrame, names: Sequence[tuple[str, str]] = fixed.DISPLAY_NAMES, array_as_json: bool = True) -> DataFrame:
    """A4's projection: snake_case -> display names, fixed order, absent columns dropped, then the id if there is one."""
    cols = []
    for src, dst in names:
        if src not in df.columns:
            continue
        c = F.col(src)
        if array_as_json and isinstance(df.schema[src].dataType, T.ArrayType):
            c = F.to_json(c)
        cols.append(c.alias(dst))
    if "id" in df.columns:
        cols.append(F.col("id").cast("string").alias(ROW_ID))
    return df.select(*cols)


def write_results(df: DataFrame, path: str, reset: bool = False) -> None:
    """A4 / A10: append the result records as CSV (overwrite when ``reset``).

    Several writes of one frame should be given a written frame, as ``write_run`` does."""
    to_display(df).write.mode("overwrite" if reset else "append").options(**CSV_WRITE).csv(path)


def results_schema() -> T.StructType:
    types = {"confidence": T.IntegerType(), "manual_review": T.BooleanType()}
    fields = [T.StructField(dst, types.get(src, T.StringType())) for src, dst in fixed.DISPLAY_NAMES]
    return T.StructType([*fields, T.StructField(ROW_ID, T.StringType())])


def read_results(spark: SparkSession, path: str, null_tokens: Sequence[str] | None = None) -> DataFrame:
    """Result records as written; with ``null_tokens`` as the reports read them.  Numeric ids order as numbers.

    Below the root of committed runs, their rows alone.
    """
    schema = results_schema()
    raw = spark.read.schema(schema).options(**CSV_READ)
    paths = _input_paths(spark, path)
    df = _without_tokens(raw.csv(paths) if path_exists(spark, paths[0]) else spark.createDataFrame([], schema), schema, null_tokens)
    return df.withColumn(ROW_ID, F.coalesce(F.lpad(F.expr(f"try_cast({ROW_ID} AS BIGINT)").cast("string"), 20, "0"), F.col(ROW_ID)))


def write_json(df: DataFrame, path: str, reset: bool = False) -> None:
    """A5: append records as JSON lines (one object per line, not one array)."""
    df.write.mode("overwrite" if reset else "append").option("ignoreNullFields", "false").json(path)


def error_rows(df: DataFrame, app: str | Column, error: str | Column, notes: str | Column) -> DataFrame:
    """``app, error, notes`` for the rows that carry an error."""
    a = F.col(app) if isinstance(app, str) else app
    e = F.col(error) if isinstance(error, str) else error
    n = F.col(notes) if isinstance(notes, str) else notes
    return df.where(e.isNotNull()).select(a.cast("string").alias("app"), e.cast("string").alias("error"), n.cast("string").alias("notes"))


def write_errors(errors: DataFrame, path: str, reset: bool = False) -> None:
    """A6 sink: append ``app, error, notes`` as CSV."""
    errors.select("app", "error", "notes").write.mode("overwrite" if reset else "append").options(**CSV_WRITE).csv(path)


ERRORS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("app", "error", "notes")])


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    paths = _input_paths(spark, path)
    if not path_exists(spark, paths[0]):
        return spark.createDataFrame([], ERRORS_SCHEMA)
    return spark.read.schema(ERRORS_SCHEMA).options(**CSV_READ).csv(paths)


def log_entry(name: str | Column, ok: str | Column, reason: str | Column | None = None) -> Column:
    """``name ✔`` or ``name ❌``, then the reason line when there is one."""
    n = F.col(name) if isinstance(name, str) else name
    good = F.col(ok) if isinstance(ok, str) else ok
    status = F.when(good, F.lit(fixed.LOG_OK)).otherwise(F.lit(fixed.LOG_FAIL))
    head = F.concat(n.cast("string"), F.lit(" "), status)
    if reason is None:
        return F.concat(head, F.lit("\n"))
    r = F.col(reason) if isinstance(reason, str) else reason
    return F.when((r.isNull()) | (r == ""), F.concat(head, F.lit("\n"))).otherwise(F.concat(head, F.lit("\n"), r, F.lit("\n")))


def write_log(entries: DataFrame, path: str, column: str = "entry", reset: bool = False) -> None:
    """A7 sink: one text record per entry."""
    # each entry ends with a newline; the text sink adds it back as the line separator
    body = F.regexp_replace(F.col(column), "\n$", "")
    entries.select(body.alias("value")).write.mode("overwrite" if reset else "append").text(path)


def write_verification_sample(df: DataFrame, path: str) -> bool:
    """Write the sample only when it has a row.  The rows are computed once, then looked at and written."""
    sample = written(to_display(df), "sample")
    if sample.isEmpty():
        return False
    sample.write.mode("overwrite").options(**CSV_WRITE).csv(path)
    return True


RUN_OUTPUTS = ("results", "json", "errors", "log")
#: What only the latest run that has it gives.
SAMPLE_OUTPUT = "verification"
#: The folder of manifests below a run root; its name keeps it out of Spark's listings.
MANIFESTS = "_runs"


@dataclass(frozen=True)
class Manifest:
    """One committed run: its number in the order of commits, the outputs it wrote, and whether it replaced earlier runs."""

    number: int
    run_id: str
    attempt: str
    outputs: tuple[str, ...]
    reset: bool


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_small(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifests(spark: SparkSession, root: str) -> list[Manifest]:
    """Every manifest below ``root``, oldest first: small files, numbered in the order of commits."""
    fs, folder = _file_system(spark, f"{root}/{MANIFESTS}")
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.endswith(".json"):
            m = json.loads(_read_small(fs, status.getPath()))
            found.append(Manifest(int(name.removesuffix(".json")), m["run_id"], m["attempt"], tuple(m["outputs"]), m["reset"]))
    return sorted(found, key=lambda m: m.number)


def committed_runs(spark: SparkSession, root: str) -> list[Manifest]:
    """The runs that count: those since the last one that replaced what was there, each by its last commit."""
    runs = manifests(spark, root)
    last = max((i for i, m in enumerate(runs) if m.reset), default=0)
    return list({m.run_id: m for m in runs[last:]}.values())


def _commit(spark: SparkSession, root: str, run_id: str, attempt: str, outputs: Sequence[str], reset: bool) -> None:
    """Write the manifest under the next free number.

    The text is written beside and moved there, so a manifest is there as a whole or not at all; the move
    fails if another run has just taken the number, then the next one is tried.
    """
    fs, folder = _file_system(spark, f"{root}/{MANIFESTS}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(folder)
    draft = path(f"{root}/{MANIFESTS}/.{run_id}.{attempt}")
    stream = fs.create(draft, False)
    try:
        stream.write(json.dumps({"run_id": run_id, "attempt": attempt, "outputs": list(outputs), "reset": reset}).encode())
    finally:
        stream.close()
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    number = 1 + max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
    while fs.exists(target := path(f"{root}/{MANIFESTS}/{number:012d}.json")) or not fs.rename(draft, target):
        if not fs.exists(draft):
            raise OSError(f"the manifest of run {run_id} could not be moved into place")
        number += 1


def run_folder(root: str, output: str, run_id: str, attempt: str) -> str:
    return f"{root}/{output}/run={run_id}/attempt={attempt}"


def committed_folders(spark: SparkSession, root: str, output: str) -> list[str]:
    """The folders of an output that committed runs wrote; of the verification sample only the latest, which outlives a reset."""
    runs = manifests(spark, root)[::-1] if output == SAMPLE_OUTPUT else committed_runs(spark, root)
    folders = [run_folder(root, output, m.run_id, m.attempt) for m in runs if output in m.outputs]
    return folders[:1] if output == SAMPLE_OUTPUT else folders


def _input_paths(spark: SparkSession, path: str) -> list[str]:
    """``path``, or where it is an output below a run root the folders of the committed runs."""
    root, _, output = path.rstrip("/").rpartition("/")
    if not path_exists(spark, f"{root}/{MANIFESTS}"):
        return [path]
    return committed_folders(spark, root, output) or [f"{root}/{MANIFESTS}/none"]


def read_committed(spark: SparkSession, root: str, output: str, schema: T.StructType, fmt: str, **options: str) -> DataFrame:
    """An output of all committed runs below ``root``; no rows where no run has it."""
    folders = committed_folders(spark, root, output)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(folders)


def _remove_but(spark: SparkSession, folder: str, keep: str) -> None:
    fs, path = _file_system(spark, folder)
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if status.getPath().getName() != keep:
            fs.delete(status.getPath(), True)


def write_run(results: DataFrame, errors: DataFrame, log: DataFrame, root: str, reset: bool = False, run_id: str | None = None) -> str:
    """A run's results (CSV and JSON), errors, log and verification sample, committed together.

    Each attempt writes its outputs to folders of its own; one manifest, written last, makes all of them
    count.  Readers (``read_results``, ``read_errors``, ``read_committed``) see committed rows alone.  A
    run that broke off is started again under its ``run_id``: the new attempt takes the place of the
    old, committed or not, so each row is there once; a new id (the default) appends.  ``reset`` takes
    the place of all earlier runs but their verification sample.  What is replaced counts until the
    manifest is there, and is removed after that.  Returns the run id.
    """
    spark = results.sparkSession
    run_id, attempt = run_id or uuid.uuid4().hex, uuid.uuid4().hex[:12]
    at = lambda name: run_folder(root, name, run_id, attempt)
    results = written(results, "run-results")
    write_results(results, at("results"), reset=True)
    write_json(results, at("json"), reset=True)
    write_errors(errors, at("errors"), reset=True)
    write_log(log, at("log"), reset=True)
    sampled = write_verification_sample(low_confidence(results, "confidence", "manual_review"), at(SAMPLE_OUTPUT))
    _commit(spark, root, run_id, attempt, (*RUN_OUTPUTS, *([SAMPLE_OUTPUT] if sampled else [])), reset)
    for name in RUN_OUTPUTS:
        if reset:
            _remove_but(spark, f"{root}/{name}", f"run={run_id}")
        _remove_but(spark, f"{root}/{name}/run={run_id}", f"attempt={attempt}")
    return run_id


def write_json_document(report: DataFrame, path: str) -> None:
    """A one-row frame as a single JSON document."""
    report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def missing_report(spark: SparkSession) -> DataFrame:
    """A9 when there is no input: ``{total_rows: 0, message}``."""
    return spark.createDataFrame([(0, fixed.NO_RESULTS_MESSAGE)], "total_rows BIGINT, message STRING")


def union_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Combine by column name; columns missing on one side are NULL."""
    return existing.unionByName(new, allowMissingColumns=True)
