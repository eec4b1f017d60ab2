"""Aggregates (G1-G12, G14, G15): values and properties."""

from pyspark.sql import functions as F

from docvet.operators import aggregate as AG
from docvet.plans.analysis import as_results, normalised_frame
from docvet.sources.records import research_records
from docvet.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_histogram_and_summary_on_lineitem(spark):
    li = table(spark, SF, "lineitem")
    h = [r["n"] for r in AG.histogram(li, "l_quantity").orderBy("bin").collect()]
    assert h == [6016, 6163, 6020, 5976, 5929, 6082, 6004, 5892, 5951, 5967]
    s = AG.numeric_summary(li, "l_quantity").collect()[0]
    assert (s["average"], s["median"], s["lowest"], s["highest"]) == (25.4, 25.0, 1, 50)


def test_histogram_single_value_goes_to_middle_bin(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "v DOUBLE")
    rows = {r["bin"]: r["n"] for r in AG.histogram(df, "v").collect()}
    assert rows[5] == 2 and sum(rows.values()) == 2


def test_empty_summaries_are_zero(spark):
    df = spark.createDataFrame([], "v DOUBLE, f BOOLEAN")
    s = AG.numeric_summary(df, "v").collect()[0]
    assert (s["average"], s["median"], s["lowest"], s["highest"]) == (0.0, 0.0, 0, 0)
    assert AG.review_rate(df, "f").collect()[0]["review_rate"] == 0.0
    assert AG.histogram(df, "v").count() == 0


def test_distribution_sums_to_total_and_crosstab_margins(spark):
    n = normalised_frame(as_results(research_records(spark, "/root/testdata/sf0.001")))
    total = n.count()
    d = AG.distribution(n, "auth")
    assert d.agg(F.sum("n")).collect()[0][0] == total
    xt = AG.crosstab_long(n, "category", "auth")
    margins = {r["col_label"]: r["s"] for r in xt.groupBy("col_label").agg(F.sum("n").alias("s")).collect()}
    assert margins == {r["value"]: r["n"] for r in d.collect()}
    # zero-filled: every row label has every observed column label
    assert xt.count() == n.select("category").distinct().count() * len(margins)


def test_counter_ties_by_first_appearance(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, " "), (5, None)], "id INT, v STRING")
    c = AG.counter(df, "v")
    top = AG.top_k(c.withColumn("field", F.lit("f")), 1).collect()[0]
    assert top["value"] == "b"  # tie 2-2, b seen first
    lead = AG.leaders(c.withColumn("field", F.lit("f")), ["f"]).collect()[0]["leader"]
    assert lead == "b"
    assert c.count() == 2  # blanks dropped


def test_share_counts_blanks_in_denominator(spark):
    df = spark.createDataFrame([(0, "x"), (1, ""), (2, "x"), (3, "y")], "id INT, v STRING")
    s = {r["value"]: r["share"] for r in AG.with_share(AG.counter(df, "v"), AG.row_total(df)).collect()}
    assert s == {"x": 50.0, "y": 25.0}


def test_crosstab_wide_matches_long(spark):
    o = table(spark, SF, "orders")
    wide = AG.crosstab_wide(o, "o_orderstatus", "o_orderpriority")
    long = AG.crosstab_long(o, "o_orderstatus", "o_orderpriority")
    w = {(r["row_label"], c): r[c] for r in wide.collect() for c in wide.columns if c != "row_label"}
    l = {(r["row_label"], r["col_label"]): r["n"] for r in long.collect()}
    assert w == l


def test_median_of_many_distinct_values(spark):
    import random
    import statistics

    rng = random.Random(3)
    for n in (1, 2, 301, 900):
        values = [round(rng.gauss(0, 50), 3) if i % 3 else 7.25 for i in range(n)]
        counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").count()
        assert AG.median_of_counts(counts, "v", "count", gather=20) == statistics.median(values)
    assert AG.median_of_counts(counts.where("false"), "v", "count") is None


def test_crosstab_counts_null_labels(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), ("a", None)], "r string, c string")
    got = {(r["row_label"], r["col_label"]): r["n"] for r in AG.crosstab_long(df, "r", "c").collect()}
    assert got == {("a", "Unknown"): 2, ("a", "x"): 1, ("Unknown", "x"): 1, ("Unknown", "Unknown"): 0}


def test_leader_of_a_blank_field(spark):
    counts = AG.multi_distribution(spark.createDataFrame([(1, "x", " "), (2, "x", None)], "id int, f string, g string"), {"f": "f", "g": "g"}, drop_blank=True)
    assert {r["field"]: r["leader"] for r in AG.leaders(counts, ["f", "g"]).collect()} == {"f": "x", "g": "N/A"}
