"""The answer ledger and the passes of a run: what is asked, how often, and which answer counts."""

import json
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.operators import ledger as LE
from docvet.operators.extract import REQUIRED, RETRY_SUFFIX, better_answer, is_thin
from docvet.plans.research import research
from docvet.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions go to workers, this module doesn't

ASKED = "id LONG, name STRING, website STRING, category STRING, document STRING, request STRING"


def counting(folder: Path, answer):
    """``answer(request, row)``, with a line per call in a file of its own task."""

    def make():
        import uuid

        log = folder / uuid.uuid4().hex

        def fn(request, row):
            with log.open("a") as f:
                f.write(json.dumps([row["name"], RETRY_SUFFIX in request]) + "\n")
            return answer(request, row)

        return fn

    return make


def calls(folder: Path) -> Counter:
    return Counter(tuple(json.loads(line)) for f in folder.iterdir() for line in f.read_text().splitlines())


def record(**changes):
    return json.dumps({f: "x" for f in REQUIRED} | {"description": "d", "api_scope": "Small"} | changes)


def test_only_open_questions_are_asked(spark, tmp_path):
    rows = [(i, f"a{i % 5}", "w", "c", "text", f"R{i % 5}") for i in range(40)] + [(40, "bad", None, None, None, "R")]
    asked = spark.createDataFrame(rows, ASKED)

    def answer(request, row):
        if row["name"] == "bad":
            raise ValueError("boom")
        return request + row["document"]

    path = scratch_path(spark, "ledger")
    for run in (1, 2, 3):
        got = {r["id"]: r for r in LE.ask(asked, counting(tmp_path, answer), path).collect()}
        assert len(got) == 41 and got[40]["payload"] is None and got[40]["error"] == "boom"
        assert all(got[i]["payload"] == f"R{i % 5}text" and got[i]["error"] is None for i in range(40))
        # equal questions are asked once, answered ones never again, the failed one by every run
        assert calls(tmp_path) == Counter({(f"a{i}", False): 1 for i in range(5)} | {("bad", False): run})
    # another pass, request or field is another question
    more = asked.where("id = 0")
    LE.ask(more, counting(tmp_path, answer), path, LE.STRICT).collect()
    LE.ask(more.withColumn("document", F.lit("new")), counting(tmp_path, answer), path).collect()
    assert calls(tmp_path)[("a0", False)] == 3
    # an interrupted pass that left two answers of a question: one counts, on every read
    spark.createDataFrame([(k, "first", p, None) for k, p in [("k", "b"), ("k", "a")]], LE.LEDGER_SCHEMA).write.mode("append").parquet(path)
    assert LE.answers(LE.read_ledger(spark, path), "first").where("key = 'k'").collect() == [("k", "a", None)]


def test_question_keys_do_not_run_together(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab\n1:c", ""), ("ab", None), ("ab", "")], "r STRING, f STRING")
    keys = [r[0] for r in df.select(LE.question_key("first", "r", ["f"])).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]


def test_better_answer(spark):
    fields = "auth_method STRING, error STRING"
    first = spark.createDataFrame([(1, "a", None), (2, None, "e"), (3, "thin", None), (4, "thin", None), (5, None, "e")], f"id LONG, {fields}")
    strict = spark.createDataFrame([(2, "s", None), (3, "s", None), (4, None, "e2"), (5, None, "e2")], f"id LONG, {fields}")
    got = {r["id"]: (r["auth_method"], r["error"], r["pass"]) for r in better_answer(first, strict, "id").collect()}
    assert got == {1: ("a", None, "first"), 2: ("s", None, "strict"), 3: ("s", None, "strict"), 4: ("thin", None, "first"), 5: (None, "e2", "strict")}


def test_is_thin(spark):
    cols = ", ".join(f"{f} STRING" for f in fixed.FILL_FIELDS)
    rows = [(*["x"] * n, *["Unknown"] * (10 - n), None) for n in (4, 5, 6)] + [(*["x"] * 10, "bad")]
    got = [r[0] for r in spark.createDataFrame(rows, f"{cols}, error STRING").select(is_thin(5)).collect()]
    assert got == [True, False, False, True]


@pytest.mark.parametrize("again", [False, True])
def test_passes_of_a_run(spark, tmp_path, again):
    """A fine, a thin, a failing and an undescribed app: who is asked what, and what it does to the results."""
    names = ["fine", "thin", "fails", "plain"]
    apps = spark.createDataFrame([(i, n, f"{n}.com", "CRM") for i, n in enumerate(names)], "id LONG, name STRING, website STRING, category STRING")
    hits = spark.createDataFrame([(n, 1, f"http://docs.{n}.com", True, i) for i, n in enumerate(names)], "app STRING, rank LONG, url STRING, official BOOLEAN, page_id LONG")
    pages = spark.createDataFrame([(i, f"<p>{n} text</p>") for i, n in enumerate(names)], "page_id LONG, html STRING")

    def answer(request, row):
        strict = RETRY_SUFFIX in request
        if row["name"] == "fails" and not strict:
            raise RuntimeError("timeout")
        if row["name"] == "thin":
            return record(**dict.fromkeys(["auth_method", "blocker", "api_type"] if strict else REQUIRED[1:], "Unknown"))
        return record(description="plain API" if row["name"] == "plain" else "d")

    ledger = scratch_path(spark, "answers")
    extract, describe = tmp_path / "extract", tmp_path / "describe"
    extract.mkdir()
    describe.mkdir()
    for _ in range(2 if again else 1):
        run = research(
            apps, hits, pages, counting(extract, answer), ledger=ledger, retry_below=6, make_describer=counting(describe, lambda q, row: f"about  {row['name']}")
        )
        got = {r["name"]: r for r in run.results.collect()}
    assert set(got) == set(names) and run.errors.count() == 0
    asked = {("fine", False): 1, ("thin", False): 1, ("plain", False): 1, ("thin", True): 1, ("fails", True): 1}
    # a second run asks the failed call again, and nothing else
    assert calls(extract) == Counter(asked | {("fails", False): 2 if again else 1})
    assert calls(describe) == Counter({("plain", False): 1})
    assert got["plain"]["description"] == "about plain" and got["fine"]["description"] == "d"
    # same fields filled, the strict pass costs its penalty
    assert got["fine"]["confidence"] - got["fails"]["confidence"] >= 0 and got["thin"]["confidence"] < got["fine"]["confidence"]


def test_without_passes_nothing_is_asked_twice(spark, tmp_path):
    apps = spark.createDataFrame([(1, "thin", "w", "c")], "id LONG, name STRING, website STRING, category STRING")
    hits = spark.createDataFrame([("thin", 1, "http://docs.x", True, 7)], "app STRING, rank LONG, url STRING, official BOOLEAN, page_id LONG")
    pages = spark.createDataFrame([(7, "<p>words of the page</p>")], "page_id LONG, html STRING")
    run = research(apps, hits, pages, counting(tmp_path, lambda q, row: record(**dict.fromkeys(REQUIRED, "Unknown"), description="")))
    (row,) = run.results.collect()
    assert "words of the page" in row["description"] and calls(tmp_path) == Counter({("thin", False): 1})
