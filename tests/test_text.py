"""Cleaning and coercion (B3, B9, B10, B11) including the engine traps."""

import pytest
from pyspark.sql import functions as F

from docvet.functions.text import canon_category, collapse_ws, fill_default, python_int, ratio_round, safe_numeric, to_bool, utrim


def one(spark, col_fn, value, dtype="STRING"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col_fn(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(
    "value,expected",
    [("80", 80), ("12.9", 12), ("", 0), ("x", 0), ("1e1", 10), (" 7 ", 7), ("-3.7", -3), ("inf", 0), ("nan", 0), ("1f", 0), (None, 0), ("1e300", 0)],
)
def test_safe_numeric(spark, value, expected):
    assert one(spark, safe_numeric, value) == expected


@pytest.mark.parametrize("value,expected", [("80", 80), ("12.9", 0), ("1e1", 0), (" 42 ", 42), ("x", 0), (None, 0)])
def test_python_int(spark, value, expected):
    assert one(spark, python_int, value) == expected


@pytest.mark.parametrize("value,expected", [("True", True), ("1", True), ("yes", True), ("no", False), ("", False), (None, False), (" true", False)])
def test_to_bool(spark, value, expected):
    assert one(spark, to_bool, value) == expected


def test_unicode_trim_and_collapse(spark):
    assert one(spark, utrim, "  a b\t　") == "a b"
    assert one(spark, collapse_ws, "  a \n\n b c ") == "a b c"


def test_fill_default(spark):
    assert one(spark, lambda c: fill_default(c), None) == "Unknown"
    assert one(spark, lambda c: fill_default(c), "  ") == "Unknown"
    assert one(spark, lambda c: fill_default(c, "", False), None) == ""
    assert one(spark, lambda c: fill_default(c, "Unknown", False), " ") == ""


@pytest.mark.parametrize("value,expected", [(" sales", "CRM and Sales"), ("CRM", "CRM and Sales"), ("crm and sales", "CRM and Sales"), ("Payments ", "Payments")])
def test_canon_category(spark, value, expected):
    assert one(spark, canon_category, value) == expected


def test_ratio_round_half_up(spark):
    df = spark.createDataFrame([(1, 8), (36, 99), (5, 1000), (-5, 1000), (0, 0)], "n BIGINT, t BIGINT")
    got = [r["r"] for r in df.select(ratio_round(F.col("n") * 100, F.col("t"), 1).alias("r")).collect()]
    assert got == [12.5, 36.4, 0.5, -0.5, None]


def test_column_index():
    from docvet.operators.resolve import ColumnIndex

    cols = ["App", "auth_METHOD", "Auth_Method", "x"]
    assert ColumnIndex(cols).first(["Auth Method", "auth_method"]) == "Auth_Method"  # case-folded, later column
    assert ColumnIndex(cols).first(["name", "APP"]) == "App"
    assert ColumnIndex(cols).first(["x", "App"]) == "x"
    assert ColumnIndex(cols).first(["nope"]) is None
