"""The report kept current: merged states equal one report over all rows; publication is all or nothing."""

import pytest
from pyspark.sql import functions as F

from docvet.plans.analysis import as_results, normalised_frame, raw_frame
from docvet.plans.report import normalised_lines, raw_lines, raw_summary
from docvet.session import scratch_path
from docvet.sources.records import records_from_documents
from docvet.streaming import published as PB
from docvet.streaming import report_state as RS
from docvet.streaming.incremental import latest_distribution, stream_distribution

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def arrived(spark):
    """The documents as files that come one per micro-batch, first ids not first."""
    root = scratch_path(spark, "report-state")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k in (2, 0, 1):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(f"{root}/in/part={k}")
    return docs, root


def state_equals_batch(spark, docs, state):
    results = as_results(records_from_documents(docs))
    assert rows(RS.current_raw_lines(spark, state)) == rows(raw_lines(raw_frame(results)))
    assert rows(RS.current_raw_summary(spark, state)) == rows(raw_summary(raw_frame(results)))
    assert rows(RS.current_normalised_lines(spark, state)) == rows(normalised_lines(normalised_frame(results)))


def test_state_after_batches_equals_one_report(spark, arrived):
    docs, root = arrived
    RS.stream_report(spark, f"{root}/in", f"{root}/state", f"{root}/ckpt", docs.schema, max_files_per_trigger=1)
    assert PB.published_batch(spark, f"{root}/state") == 2
    state_equals_batch(spark, docs, f"{root}/state")


def test_a_batch_that_broke_off_counts_once(spark, arrived, monkeypatch):
    docs, root = arrived
    state, more = f"{root}/retried", [docs.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    RS.update_state(spark, state, 0, as_results(records_from_documents(more[0])))
    with monkeypatch.context() as m:  # the table is written, the pointer is not
        real = PB._folder
        m.setattr(PB, "_folder", lambda s, p: real(s, p) if not p.endswith("1") else (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            RS.update_state(spark, state, 1, as_results(records_from_documents(more[1])))
    state_equals_batch(spark, more[0], state)
    for _ in range(2):  # the second call: the pointer was set, the stream's own commit was not
        RS.update_state(spark, state, 1, as_results(records_from_documents(more[1])))
        state_equals_batch(spark, docs, state)


def test_merge_is_a_sum_over_any_split(spark, arrived):
    docs, _ = arrived
    results = as_results(records_from_documents(docs))
    parts = [RS.batch_counts(results.where(F.pmod(F.hash("id"), F.lit(4)) == k)) for k in range(4)]
    assert rows(RS.merge(*parts)) == rows(RS.merge(RS.merge(parts[3], parts[1]), RS.merge(parts[0]), parts[2])) == rows(RS.batch_counts(results))


def test_a_half_written_batch_is_never_read(spark):
    root = scratch_path(spark, "pointer")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    stream_distribution(spark, f"{SF}/events.parquet", f"{root}/out", f"{root}/ckpt", ev.schema, "event_type")
    want = rows(latest_distribution(spark, f"{root}/out"))
    # a later batch has written some of its files
    spark.createDataFrame([("wrong", 1)], "value STRING, n LONG").write.parquet(PB.batch_folder(f"{root}/out", 7))
    assert rows(latest_distribution(spark, f"{root}/out")) == want
    with pytest.raises(FileNotFoundError):
        latest_distribution(spark, f"{root}/none")


def test_publish_keeps_the_previous_table_and_refuses_another_checkpoint(spark):
    root = scratch_path(spark, "publish")
    for b in (0, 1, 2, 5):
        PB.publish(spark, root, b, lambda b=b: spark.range(b, b + 1))
        assert [r[0] for r in PB.read_published(spark, root).collect()] == [b]
    fs, folder = PB._folder(spark, root)
    assert sorted(s.getPath().getName() for s in fs.listStatus(folder)) == ["_published", "batch=000000000002", "batch=000000000005"]
    PB.publish(spark, root, 5, lambda: 1 / 0)  # published: nothing is computed
    with pytest.raises(ValueError):
        PB.publish(spark, root, 0, lambda: spark.range(1))
