"""Summaries of any numbers (G6) and crosstabs of open columns."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from docvet.operators import aggregate as AG

INF, NAN = math.inf, math.nan


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v DOUBLE")


def summary(spark, values):
    return AG.numeric_summary(frame(spark, values), "v").collect()[0]


@pytest.mark.parametrize(
    "extra",
    [[-INF, -INF, INF, None, 3.5], [NAN] * 50 + [1e308, -1e308, 1.7e308, -1.7e308, 5e-324, -5e-324, 0.0], [INF] * 7000],
    ids=["both", "nan-and-huge", "mostly-inf"],
)
def test_median_of_many_distinct_values(spark, extra):
    rng = random.Random(len(extra))
    values = [rng.choice([rng.random(), rng.expovariate(1e-3), -rng.expovariate(1e-300)]) for _ in range(6000)] + extra
    rng.shuffle(values)
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    counts = frame(spark, values).groupBy("v").agg(F.count("*").alias("n"))
    got = AG.median_of_counts(counts, "v", gather=64)
    assert got == pytest.approx(statistics.median(known), rel=1e-15)
    for at in (0, len(known) // 3, len(known) - 1):
        assert AG.value_at_rank(counts, at, "v", gather=64) == known[at]
    assert AG.value_at_rank(counts, len(known), "v", gather=64) is None


def test_summary_of_awkward_numbers(spark):
    s = summary(spark, [1.0, 2.0, INF, NAN, None])
    assert (s["average"], s["median"], s["lowest"], s["highest"]) == (INF, 2.0, 1, None)
    s = summary(spark, [-INF, INF])
    assert math.isnan(s["average"]) and math.isnan(s["median"]) and s["lowest"] is None
    s = summary(spark, [1e308, 1e308])
    assert s["median"] == 1e308 and s["highest"] is None
    s = summary(spark, [NAN, None])
    assert (s["average"], s["median"], s["lowest"], s["highest"]) == (0.0, 0.0, 0, 0)
    s = summary(spark, [-1.7, 2.345])
    assert (s["median"], s["lowest"], s["highest"]) == (0.32, -1, 2)
    assert AG.numeric_summary(frame(spark, [1.0, 3.0, NAN, 9.0]), "v", approx=True).collect()[0]["median"] == 3.0


def test_sparse_crosstab(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "Unknown", *map(str, range(40))]), rng.choice(["x", None, *map(str, range(30))])) for _ in range(400)]
    df = spark.createDataFrame(rows, "r STRING, c STRING")
    got = {(x["kind"], x["row_label"], x["col_label"]): x["n"] for x in AG.crosstab_sparse(df, "r", "c").collect()}
    want = {}
    for r, c in rows:
        r, c = r or "Unknown", c or "Unknown"
        for key in (("cell", r, c), ("row", r, None), ("col", None, c), ("total", None, None)):
            want[key] = want.get(key, 0) + 1
    assert got == want
    # zeros over a closed list only, equal to the dense form where the list is all labels
    labels = sorted({c or "Unknown" for _, c in rows})
    sparse = AG.crosstab_sparse(df, "r", "c")
    filled = sorted(map(tuple, AG.zero_filled(sparse, labels).collect()))
    assert filled == sorted(map(tuple, AG.crosstab_long(df, "r", "c").collect()))
    some = {(r, c): n for r, c, n in AG.zero_filled(sparse, ["x", "never"]).collect()}
    assert some[("a", "never")] == 0 and sum(some.values()) == len(rows)
    assert AG.crosstab_sparse(df.where("false"), "r", "c").count() == 0


def test_sparse_crosstab_is_one_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("r"), (F.col("id") % 7).alias("c"))
    plan = AG.crosstab_sparse(df, "r", "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
