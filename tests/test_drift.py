"""Drifted CSV files: widths, headers in the way, glued headers, rejects."""

import csv
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.plans.analysis import raw_frame
from docvet.plans.report import raw_lines
from docvet.session import scratch_path
from docvet.sources.drift import read_drifted

OLD = ("category", "auth_method", "confidence")
NEW = ("name", "category", "auth_method", "confidence", "issues")
HEADER = ("id", "name", "evidence_url")


def text_of(records):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records)
    return out.getvalue()


def file_of(spark, *texts):
    folder = Path(scratch_path(spark, "drift-test"))
    folder.mkdir(parents=True)
    for i, text in enumerate(texts):
        (folder / f"{i}.csv").write_text(text, newline="")
    return str(folder)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("header", [text_of([HEADER]), text_of([HEADER]).rstrip("\n"), " ID , Name , Evidence_URL"])
def test_the_shipped_kind_of_file(spark, header):
    """A header of neither layout, glued or not, then records of two widths."""
    body = text_of([("CRM", "OAuth, 2.0", "80")] * 2 + [("Acme", 'He said "x"', "a\nb", "", "None")])
    path = file_of(spark, header + body)
    read = read_drifted(spark, path, [OLD, NEW], headers=[HEADER], columns=["name", "category", "auth_method", "confidence", "issues"])
    want = [(None, "CRM", "OAuth, 2.0", "80", None)] * 2 + [("Acme", 'He said "x"', "a\nb", None, None)]
    assert got(read.rows) == sorted(want, key=str) and read.rejects.count() == 0


def test_rejects(spark):
    records = [("a", "b", "c"), ("only",), ("x", "y"), tuple("12345678"), tuple("0123456789abc"), ("1", "2", "3", "4", "5")]
    path = file_of(spark, text_of(records) + "\n\n")
    read = read_drifted(spark, path, [OLD, NEW], headers=[HEADER], null_tokens=None)
    assert got(read.rows) == sorted([("a", "b", "c", None, None), ("2", "3", "4", "1", "5")], key=str)
    rejects = {r["width"]: (r["fields"], r["reason"]) for r in read.rejects.collect()}
    assert rejects[1] == (["only"], "no layout of 1 field(s)") and rejects[2][1] == "no layout of 2 field(s)"
    assert rejects[8] == (list("12345678"), "no layout of 8 field(s)") and rejects[9][1] == "more fields than any layout"
    # wider still: the fields that any layout and a header before it could have
    assert read.rejects.count() == 4 and max(rejects) == 9


def test_random_files_equal_a_plain_reader(spark):
    rng = random.Random(5)
    value = lambda: rng.choice(["x", "", "a,b", 'q"q', "two\nlines", " pad ", "Unknown", "id"])
    texts, rows, rejects = [], [], 0
    for _ in range(12):
        text = ""
        for _ in range(rng.randint(0, 25)):
            n = rng.choice([1, 2, 3, 3, 5, 5, 6])
            record = [value() or ("-" if n == 1 else "") for _ in range(n)]
            head = rng.random()
            if head < 0.1:
                text += text_of([HEADER])
            elif head < 0.2 and not record[0].startswith((" ", "a,", 'q"', "two")) and record[0]:
                text += text_of([HEADER]).rstrip("\n")
            text += text_of([record])
            if n in (3, 5):
                by = dict(zip(OLD if n == 3 else NEW, record, strict=True))
                rows.append(tuple(by.get(c) for c in NEW))
            else:
                rejects += 1
        texts.append(text)
    read = read_drifted(spark, file_of(spark, *texts), [OLD, NEW], headers=[HEADER], columns=NEW, null_tokens=None)
    assert got(read.rows) == sorted(rows, key=str) and read.rejects.count() == rejects


def test_layouts_must_differ_in_width(spark):
    with pytest.raises(ValueError):
        read_drifted(spark, "x", [("a", "b"), ("c", "d")])


def test_a_report_over_a_drifted_file(spark):
    old, new = [("CRM", "OAuth 2.0", "80")] * 3, [("n", "CRM", "API key", "90", "None")] * 2
    read = read_drifted(spark, file_of(spark, text_of([HEADER]).rstrip("\n") + text_of([*old, *new])), [OLD, NEW], [HEADER])
    lines = raw_lines(raw_frame(read.rows.withColumn("id", F.monotonically_increasing_id())))
    found = {(r["section"], r["value"]): r["n"] for r in lines.collect()}
    assert found[("top_auth_methods", "OAuth 2.0")] == 3 and found[("top_auth_methods", "API key")] == 2 and found[("top_categories", "CRM")] == 5
    assert "None" in fixed.NULL_TOKENS
