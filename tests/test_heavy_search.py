"""Top values by bounded summaries, and the trigram index, against the plain operators."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docvet.operators import heavy as HE
from docvet.operators.aggregate import counter, top_k
from docvet.operators.search import build_index, trigrams
from docvet.operators.select import table_search
from docvet.session import scratch_path


def plain(df, fields, k):
    counts = None
    for f in fields:
        c = counter(df, f).withColumn("field", F.lit(f))
        counts = c if counts is None else counts.unionByName(c)
    return sorted(map(tuple, top_k(counts, k).select("field", "value", "n", "first_seen", "pos").collect()))


def rows(spark, n=6000):
    rng = random.Random(4)
    out = []
    for i in range(n):
        hot = rng.choice(["a", "a", "b", "c", "d", "e", "f", None, " ", f"x{rng.randrange(10**6)}"])
        out.append((i, hot, str(rng.randrange(3000)), rng.choice(["p", "q"]), None))
    return spark.createDataFrame(out, "id LONG, skewed STRING, even STRING, closed STRING, empty STRING").repartition(6)


@pytest.mark.parametrize("k", [1, 3, 6, 50])
def test_top_values_equal_the_counters(spark, k):
    df, fields = rows(spark), ["skewed", "even", "closed", "empty"]
    got = HE.top_values(df, {f: f for f in fields}, k, capacity=20)
    assert sorted(map(tuple, got.select("field", "value", "n", "first_seen", "pos").collect())) == plain(df, fields, k)


def test_only_candidates_are_counted(spark):
    df = rows(spark)
    long = df.select(F.lit("skewed").alias("field"), F.col("skewed").alias("value")).where("trim(value) <> ''")
    found = [r["value"] for r in HE.candidates(long, 3, capacity=100).collect()]
    first = {v for _, v, *_ in plain(df, ["skewed"], 3)}
    assert first <= set(found) and len(found) <= 8  # of over 500 values
    even = df.select(F.lit("even").alias("field"), F.col("even").alias("value"))
    assert [r["value"] for r in HE.candidates(even, 3, capacity=100).collect()] == [None]  # proves nothing: counted in full


def test_summary_bounds(spark):
    rng = random.Random(6)
    for _ in range(200):
        true, kept, taken = {}, {}, 0
        for _ in range(rng.randint(1, 30)):
            for _ in range(rng.randint(1, 20)):
                v = str(int(rng.paretovariate(0.7)))
                true[v] = true.get(v, 0) + 1
                kept[v] = kept.get(v, 0) + 1
            taken += HE.shrink(kept, 5)
            assert len(kept) <= 5 and all(n > 0 for n in kept.values())
        assert all(kept.get(v, 0) <= n <= kept.get(v, 0) + taken for v, n in true.items())


def test_chunks_are_cut_like_counters():
    rng = random.Random(9)
    for capacity in (1, 5, 40, 1000):
        values = [str(int(rng.paretovariate(0.5))) for _ in range(3000)]
        counts = {v: values.count(v) for v in set(values)}
        got, off = HE.chunk_counts([pa.array(values[:1000]), pa.array(values[1000:])], capacity)
        assert off == HE.shrink(counts, capacity) and dict(got) == counts and len(got) <= capacity


def test_summaries_hold_in_small_chunks(spark):
    """Fields and blanks mixed in every batch, chunks shorter and longer than a partition: the bounds hold."""
    long = rows(spark).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("skewed", "even")])).alias("p"))
    long = long.select("p.*").where("value IS NOT NULL")
    true = {(r["field"], r["value"]): r["count"] for r in long.groupBy("field", "value").count().collect()}
    for chunk in (1, 700, 10**6):
        low = {(r["field"], r["value"]): r["low"] for r in HE.summaries(long, 15, chunk).groupBy("field", "value").agg(F.sum("low").alias("low")).collect()}
        for (f, v), n in true.items():
            assert low.get((f, v), 0) <= n <= low.get((f, v), 0) + low[f, None]


def test_values_are_read_once_per_use(spark):
    """No row builds an array to filter, and a field that is counted in full is not looked up among candidates."""
    path = scratch_path(spark, "heavy-test")
    rows(spark).write.parquet(path)
    top = HE.top_values(spark.read.parquet(path), {f: f for f in ("closed", "even")}, 3, capacity=20)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "filter(array" not in plan
    reads = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert [r for r in reads if "id:" in r] == ["id:bigint,closed:string", "id:bigint,even:string"]


def test_index_search_equals_the_scan(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé İ") for _ in range(rng.randint(0, 9)))
    data = [(rng.choice([None, *range(300)]), word(), rng.choice([None, word()]), i) for i in range(800)]
    df = spark.createDataFrame(data, "k LONG, a STRING, b STRING, n LONG")
    index = build_index(df, "k", ["a", "b"], scratch_path(spark, "index-test"))
    queries = ["", "a", " AB ", "abc", "bcd", "zzz", "aé", "é a", "dea b", word() + word()]
    for listed in (1000, 2):
        monkeypatch.setattr("docvet.operators.search.LISTED_KEYS", listed)
        for q in queries if listed == 1000 else queries[3:6]:
            want = sorted(map(str, table_search(df, ["a", "b"], q).collect()))
            assert sorted(map(str, index.search(q).collect())) == want, q
    # few keys are fetched for a rare text
    text = next(a + (b or "") for k, a, b, _ in data if k is not None and len(a) >= 8).lower()
    assert 1 <= index.candidates(text[:8]).count() < 15
    assert build_index(df.where("false"), "k", ["a", "b"], scratch_path(spark, "index-test")).search("abc").count() == 0


def test_search_prunes_files(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("name "), F.hex("id")).alias("a"))
    index = build_index(df, "k", ["a"], scratch_path(spark, "index-test"))
    assert [r["k"] for r in index.search("name 1234").collect()] == [0x1234]
    plan = index.search("name 1234")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(k" in plan or "PushedFilters: [IsNotNull(k), EqualTo(k" in plan or "EqualTo(k" in plan


def test_trigrams(spark):
    df = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,), ("aaaa",), ("é😀x",)], "t STRING")
    got = [r[0] for r in df.select(trigrams(F.col("t"))).collect()]
    assert got == [["abc", "bca", "cab"], [], [], [], ["aaa"], ["é😀x"]]
