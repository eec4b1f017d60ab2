"""A key holding a third of all rows: results stay exact and the plans
combine map-side before the shuffle."""

from pyspark.sql import functions as F

from docvet.operators import aggregate as AG
from docvet.operators.collect import combine_pages, top_docs
from docvet.operators.select import named_sample


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=30000):
    # a third of all rows share app / label "hot"; the rest spread over 1000 keys
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("app"),
        (F.col("id") % 2 == 0).alias("official"),
        F.col("id").alias("rank"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.lit("text").alias("text"),
    )


def test_distribution_on_hot_label(spark):
    df = skewed(spark)
    d = AG.distribution(df, "app")
    assert {r["value"]: r["n"] for r in d.where(F.col("value") == "hot").collect()} == {"hot": 10000}
    p = plan_of(d)
    assert "partial_count" in p and p.index("partial_count") > p.index("Exchange")  # partial below the exchange


def test_top_docs_on_hot_app(spark):
    df = skewed(spark).repartition(8)
    t = top_docs(df)
    hot = t.where(F.col("app") == "hot").orderBy("pos").collect()
    assert [r["rank"] for r in hot] == [0, 6, 12]  # official ones first, by rank
    assert "WindowGroupLimit" in plan_of(t) and "Partial" in plan_of(t)
    c = combine_pages(t).where(F.col("app") == "hot").collect()[0]
    assert c["n_pages"] == 3


def test_named_sample_on_hot_name(spark):
    df = skewed(spark).withColumnRenamed("app", "name")
    out = named_sample(spark, df, ["hot", "k1", "absent"]).collect()
    assert [(r["pos"], r["id"]) for r in out] == [(0, 0), (1, 1)]
    p = plan_of(named_sample(spark, df, ["hot"]))
    assert "BroadcastHashJoin" in p and "partial_min_by" in p
