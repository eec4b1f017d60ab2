"""Pages joined back by id: their html never reaches an exchange, and only chosen pages do."""

import re

from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.operators.collect import chosen_texts, combine_pages, top_docs
from docvet.session import scratch_path

#: Spark adds the filter where the scan is large; here it may be small.
FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0b",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def inputs(spark, apps=40, each=25):
    root = scratch_path(spark, "chosen-test")
    ids = spark.range(apps * each).select(F.col("id").alias("page_id"), (F.col("id") % apps).cast("string").alias("app"))
    body = F.concat(F.lit("<p>page "), F.col("page_id").cast("string"), F.lit(" "), F.repeat(F.lit("word "), 2000), F.lit("</p>"))
    ids.select("page_id", F.when(F.col("page_id") % 7 != 0, body).alias("html")).where("page_id % 11 <> 0").write.parquet(f"{root}/pages")
    hits = ids.select("app", F.col("page_id").alias("rank"), F.lit("http://u").alias("url"), F.lit(False).alias("official"), "page_id")
    return hits, spark.read.parquet(f"{root}/pages")


def test_only_chosen_text_is_exchanged(spark):
    hits, pages = inputs(spark)
    before = {k: spark.conf.get(k) for k in FILTER}
    try:
        for k, v in FILTER.items():
            spark.conf.set(k, v)
        texts = chosen_texts(top_docs(hits), pages)
        rows = texts.collect()
        plan = texts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "might_contain" in plan  # Spark's own filter, on the scan of the pages
    final = plan.split("== Initial Plan ==")[0]
    # html is read by the scan and the projection above it, and by nothing further up
    assert all("html" not in line for line in final.splitlines() if re.search(r"Exchange|Join|Sort\b|AQEShuffleRead|ShuffleQueryStage", line))
    assert len(rows) == 40 * 3 and max(len(r["text"] or "") for r in rows) == fixed.CHARS_PER_PAGE
    for r in rows:
        gone = r["page_id"] % 11 == 0 or r["page_id"] % 7 == 0
        assert r["failed"] == gone and (r["text"] is None) == gone
        assert gone or r["text"].startswith(f"page {r['page_id']} word")


def test_combine_cuts_before_its_own_window(spark):
    df = spark.createDataFrame([("a", 1, "u", "x" * 5000, False)], "app STRING, rank INT, url STRING, text STRING, failed BOOLEAN")
    out = combine_pages(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the cut stands below the window (further down in the plan)
    assert plan.index("Window") < plan.index("substring(")
    assert out.collect()[0]["document"].endswith("x" * 1500) and out.collect()[0]["document"].count("x") == 1500
