"""Rule packs: golden raw -> normalised pairs and the documented traps."""

import pytest
from conftest import expand
from pyspark.sql import functions as F

from docvet.functions import rules as RU
from docvet.functions.rules import classify

# Golden pairs: raw value counts of the raw report and the normalised counts
# the normalising pass produced from them.
AUTH_RAW = [
    ("OAuth 2.0", 36),
    ("API key", 23),
    ("API token", 13),
    ("Unknown", 5),
    ("Bearer token", 4),
    ("Basic auth", 3),
    ("Personal access token", 3),
    ("OAuth 2.0, API key", 2),
    ("OAuth 2.0, API key, API token, Bearer token, Basic auth, Personal access token", 2),
    ("OAuth 2.0, API token, OAuth access token", 1),
    ("OAuth 2.0, API token", 1),
    ("OAuth 2.0, API key, Bearer token, Basic auth", 1),
    ("API key, API token, Basic auth, JWT Bearer", 1),
    ("OAuth 1.0a, tokens, login credentials", 1),
    ("API key or OAuth access token", 1),
    ("OAuth 2.0, API token, Bearer token, Personal access token", 1),
    ("API key, OAuth 2.0, API token, Personal access token", 1),
]
AUTH_NORM = {"OAuth2": 47, "API Key": 24, "Other": 17, "Unknown": 5, "Basic": 3, "PAT": 3}
SELF_RAW = [("Self Serve", 72), ("Paid Plan", 13), ("Unknown", 8), ("Admin Approval", 3), ("Enterprise", 3)]
SELF_NORM = {"Self Serve": 72, "Paid Plan": 13, "Unknown": 8, "Admin Approval": 3, "Enterprise": 3}
API_RAW = [("REST", 93), ("Unknown", 5), ("GraphQL", 1)]
API_NORM = {"REST": 93, "Unknown": 5, "GraphQL": 1}
BUILD_RAW = [("Yes", 88), ("Unknown", 11)]
BUILD_NORM = {"Yes": 88, "No": 11}
MCP_RAW = [("Unknown", 91), ("Yes", 8)]
MCP_NORM = {"No": 91, "Yes": 8}


def _counts(spark, pairs, pack):
    df = spark.createDataFrame(expand(pairs), "id INT, v STRING")
    rows = df.groupBy(classify("v", pack).alias("k")).count().collect()
    return {r["k"]: r["count"] for r in rows}


@pytest.mark.parametrize(
    "pairs,pack,expected",
    [
        (AUTH_RAW, RU.AUTH, AUTH_NORM),
        (SELF_RAW, RU.SELF_SERVE, SELF_NORM),
        (API_RAW, RU.API_TYPE, API_NORM),
        (BUILD_RAW, RU.BUILDABILITY, BUILD_NORM),
        (MCP_RAW, RU.MCP, MCP_NORM),
    ],
)
def test_golden_pairs(spark, pairs, pack, expected):
    assert _counts(spark, pairs, pack) == expected


def test_blocker_null_is_unknown(spark):
    # the reader turned the usual blocker "None" into NULL: 99 -> Unknown 99
    df = spark.createDataFrame([(i, None) for i in range(99)], "id INT, v STRING")
    assert df.select(classify("v", RU.BLOCKER).alias("k")).distinct().collect()[0]["k"] == "Unknown"


def _one(spark, value, pack):
    df = spark.createDataFrame([(value,)], "v STRING")
    return df.select(classify("v", pack).alias("k")).collect()[0]["k"]


@pytest.mark.parametrize(
    "value,pack,expected",
    [
        ("Unknown", RU.BUILDABILITY, "No"),  # "unknown" contains "no"
        ("unsupported", RU.MCP, "Yes"),  # contains "supported"
        ("Compatible", RU.AUTH, "PAT"),  # any "pat"
        ("Explanation needed", RU.BLOCKER, "Paid plan required"),  # "plan" in "explanation"
        ("  Sanctions ", RU.BLOCKER, "Sanctions"),  # else: the trimmed text
        (" none ", RU.BLOCKER, "Unknown"),  # Unicode trim
        ("SDK", RU.API_TYPE, "Other"),  # no "rest" / "api" in it
        ("Partner Required", RU.SELF_SERVE, "Other"),
    ],
)
def test_traps(spark, value, pack, expected):
    assert _one(spark, value, pack) == expected


@pytest.mark.parametrize(
    "value,pack,expected",
    [
        ("yes", RU.FIX_SELF_SERVE, "Self Serve"),
        ("no", RU.FIX_SELF_SERVE, "Unknown"),
        ("Partner Required", RU.FIX_SELF_SERVE, "Partner Required"),
        ("Contact sales", RU.FIX_SELF_SERVE, "Unknown"),
        ("high", RU.FIX_BUILDABILITY, "Yes"),
        ("somewhat", RU.FIX_BUILDABILITY, "Partially"),
        ("true", RU.FIX_MCP, "Yes"),
        ("medium surface", RU.FIX_SCOPE, "Medium"),
        ("very large", RU.FIX_SCOPE, "Very Large"),
        ("", RU.FIX_SCOPE, "Unknown"),
        ("Developer account with OAuth", RU.FIX_CREDENTIAL, "Developer account + Connected App + OAuth"),
        ("personal access token (PAT)", RU.FIX_CREDENTIAL, "Personal access token"),
        ("Service account JSON", RU.FIX_CREDENTIAL, "Service Account Key"),
        ("API key, OAuth 2.0", RU.FIX_CREDENTIAL, "API key, OAuth 2.0"),  # unchanged, not set-checked
        ("n/a", RU.FIX_CREDENTIAL, "Unknown"),
        ("Unknown", RU.FIX_BLOCKER, "None"),
        ("Paid plan", RU.FIX_BLOCKER, "Unknown"),
        (None, RU.FIX_BLOCKER, "Unknown"),
        ("GraphQL", RU.FIX_API_TYPE, "GraphQL"),
        ("RESTful API", RU.FIX_API_TYPE, "Unknown"),
        ("Bearer token", RU.FIX_AUTH, "Bearer token"),
    ],
)
def test_verifier_packs(spark, value, pack, expected):
    assert _one(spark, value, pack) == expected


def test_sanitise_twice_equals_once_except_blocker(spark):
    from docvet.sources.records import research_records

    rr = research_records(spark, "/root/testdata/sf0.001")
    for field, pack in RU.SANITISERS.items():
        once = rr.select(classify(field, pack).alias("a"))
        twice = once.select(F.col("a"), classify("a", pack).alias("b"))
        diff = twice.where(F.col("a") != F.col("b")).collect()
        if field == "blocker":
            assert {(r["a"], r["b"]) for r in diff} <= {("Unknown", "None")}
        else:
            assert diff == []


def test_missing_first_guard(spark):
    guarded = RU.missing_first(RU.BUILDABILITY)
    assert _one(spark, "Unknown", RU.BUILDABILITY) == "No"
    assert _one(spark, "Unknown", guarded) == "Unknown"
    assert _one(spark, None, guarded) == "Unknown"
    assert _one(spark, "contact vendor", guarded) == "No"
    assert _one(spark, "unsupported", RU.missing_first(RU.MCP)) == "Yes"  # only missing tokens move
