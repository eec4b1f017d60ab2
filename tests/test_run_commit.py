"""A run's outputs count together: crashes between outputs, retries, resets, two writers."""

import pytest
from pyspark.sql import types as T

from docvet.functions import fixed
from docvet.session import scratch_path
from docvet.sources import files as FI

LOG = T.StructType([T.StructField("value", T.StringType())])


def frames(spark, names):
    columns = [f"{c} {'INT' if c == 'confidence' else 'BOOLEAN' if c == 'manual_review' else 'STRING'}" for c, _ in fixed.DISPLAY_NAMES]
    rows = [tuple(n if c == "name" else 50 if c == "confidence" else False if c == "manual_review" else "x" for c, _ in fixed.DISPLAY_NAMES) for n in names]
    results = spark.createDataFrame(rows, ", ".join(columns))
    errors = spark.createDataFrame([(f"{n}-failed", "e", "n") for n in names], "app STRING, error STRING, notes STRING")
    log = spark.createDataFrame([(f"{n} ok\n",) for n in names], "entry STRING")
    return results, errors, log


def read(spark, root):
    return {
        "results": sorted(r["App"] for r in FI.read_results(spark, f"{root}/results").collect()),
        "json": sorted(r["name"] for r in FI.read_committed(spark, root, "json", T.StructType([T.StructField("name", T.StringType())]), "json").collect()),
        "errors": sorted(r["app"].removesuffix("-failed") for r in FI.read_errors(spark, f"{root}/errors").collect()),
        "log": sorted(r["value"].removesuffix(" ok") for r in FI.read_committed(spark, root, "log", LOG, "text").collect()),
    }


def all_have(spark, root, names):
    assert read(spark, root) == dict.fromkeys(("results", "json", "errors", "log"), sorted(names))


@pytest.mark.parametrize("dies_in", ["write_json", "write_errors", "write_log", "_commit"])
def test_a_crash_between_outputs_leaves_nothing_and_the_retry_each_row_once(spark, monkeypatch, dies_in):
    root = scratch_path(spark, "commit")
    FI.write_run(*frames(spark, ["a"]), root, run_id="one")
    with monkeypatch.context() as m:
        m.setattr(FI, dies_in, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            FI.write_run(*frames(spark, ["b", "c"]), root, run_id="two")
    all_have(spark, root, ["a"])
    FI.write_run(*frames(spark, ["b", "c"]), root, run_id="two")
    all_have(spark, root, ["a", "b", "c"])
    # the attempt that broke off is gone, also for who lists the folder itself
    assert spark.read.schema(FI.results_schema()).options(**FI.CSV_READ).csv(f"{root}/results").count() == 3


def test_a_run_committed_twice_counts_once(spark):
    root = scratch_path(spark, "commit")
    for _ in range(2):
        FI.write_run(*frames(spark, ["a", "b"]), root, run_id="same")
    all_have(spark, root, ["a", "b"])
    FI.write_run(*frames(spark, ["a"]), root)  # another id appends, as ever
    all_have(spark, root, ["a", "a", "b"])


def test_a_reset_replaces_earlier_runs_at_the_commit(spark, monkeypatch):
    root = scratch_path(spark, "commit")
    FI.write_run(*frames(spark, ["a"]), root)
    with monkeypatch.context() as m:
        m.setattr(FI, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            FI.write_run(*frames(spark, ["b"]), root, reset=True, run_id="r")
    all_have(spark, root, ["a"])
    with monkeypatch.context() as m:  # committed, but the files of the earlier runs could not be removed yet
        m.setattr(FI, "_remove_but", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            FI.write_run(*frames(spark, ["b"]), root, reset=True, run_id="r")
    all_have(spark, root, ["b"])
    FI.write_run(*frames(spark, ["c"]), root)
    all_have(spark, root, ["b", "c"])


def test_the_sample_is_the_latest_and_outlives_a_reset(spark):
    root = scratch_path(spark, "commit")
    sample = lambda: sorted(r["App"] for r in FI.read_results(spark, f"{root}/verification").collect())
    FI.write_run(*frames(spark, ["a", "b"]), root)
    FI.write_run(*frames(spark, ["c"]), root)
    assert sample() == ["c"]
    results, errors, log = frames(spark, ["d"])
    FI.write_run(results.replace(50, 90, ["confidence"]), errors, log, root, reset=True)  # nothing to verify: no new sample
    assert sample() == ["c"] and read(spark, root)["results"] == ["d"]


def test_two_writers_get_two_numbers(spark, monkeypatch):
    root = scratch_path(spark, "commit")
    FI.write_run(*frames(spark, ["a"]), root, run_id="first")
    listed, late = FI._file_system, []
    # another run commits while this one is on its way

    def between(spark_, path):
        out = listed(spark_, path)
        if not late and path.endswith(FI.MANIFESTS):
            late.append(1)
            FI._commit(spark, root, "other", "x", ("results",), False)
        return out

    monkeypatch.setattr(FI, "_file_system", between)
    FI._commit(spark, root, "second", "y", ("results",), False)
    monkeypatch.undo()
    assert [(m.number, m.run_id) for m in FI.manifests(spark, root)] == [(1, "first"), (2, "other"), (3, "second")]


def test_no_run_yet(spark):
    root = scratch_path(spark, "commit")
    assert FI.committed_runs(spark, root) == [] and FI.read_errors(spark, f"{root}/errors").count() == 0
    assert FI.read_committed(spark, root, "log", LOG, "text").count() == 0
