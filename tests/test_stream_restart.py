"""H1 restarted on the same checkpoint: every input file lands exactly once."""

from docvet.session import scratch_path
from docvet.streaming.incremental import stream_results


def test_restart_processes_new_files_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    root = scratch_path(spark, "restart")
    first = docs.where("doc_id % 2 = 0")
    second = docs.where("doc_id % 2 = 1")
    first.write.parquet(f"{root}/in/part=a")
    stream_results(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", docs.schema)
    n1 = spark.read.parquet(f"{root}/out").count()
    second.write.parquet(f"{root}/in/part=b")
    stream_results(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", docs.schema)  # restart
    out = spark.read.parquet(f"{root}/out")
    assert n1 == first.count()
    assert out.count() == docs.count()
    assert out.select("id").distinct().count() == docs.count()
    stream_results(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", docs.schema)  # nothing new
    assert spark.read.parquet(f"{root}/out").count() == docs.count()
