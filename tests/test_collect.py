"""Document collection (D2-D8) on literal rows."""

from docvet.functions.checks import official_url
from docvet.operators.collect import combine_pages, no_hits, page_text, top_docs
from pyspark.sql import functions as F


def test_official_url(spark):
    df = spark.createDataFrame([("https://developers.acme.com/x",), ("https://blog.acme.dev/y",), ("https://acme.com",)], "u STRING")
    assert [r[0] for r in df.select(official_url("u")).collect()] == [True, False, False]


def test_top_docs_prefers_official(spark):
    rows = [("a", 1, "u1", False), ("a", 2, "u2", True), ("a", 3, "u3", False), ("a", 4, "u4", True), ("b", 1, "v1", False), ("b", 2, "v2", False), ("b", 3, "v3", False), ("b", 4, "v4", False)]
    hits = spark.createDataFrame(rows, "app STRING, rank INT, url STRING, official BOOLEAN")
    got = {(r["app"], r["url"]) for r in top_docs(hits).collect()}
    assert got == {("a", "u2"), ("a", "u4"), ("b", "v1"), ("b", "v2"), ("b", "v3")}


def test_combine_pages_failures(spark):
    rows = [("a", 2, "u2", "x" * 2000, False), ("a", 1, "u1", "hello", False), ("a", 3, "u3", None, False), ("a", 4, "u4", "zzz", True)]
    pages = spark.createDataFrame(rows, "app STRING, rank INT, url STRING, text STRING, failed BOOLEAN")
    r = combine_pages(pages, k=4).collect()[0]
    assert r["document"] == "\n\n--- PAGE: u1 ---\n\nhello" + "\n\n--- PAGE: u2 ---\n\n" + "x" * 1500 + "\n\n--- PAGE: u3 ---\n\n"
    assert r["evidence_url"] == "u1, u2, u3, u4"


def test_no_hits(spark):
    apps = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    hits = spark.createDataFrame([(2,), (2,)], "k INT")
    assert sorted(r["k"] for r in no_hits(apps, hits, "k").collect()) == [1, 3]


def test_page_text(spark):
    html = "<html><head><style>p{x}</style><script>var a='<p>';</script></head><body><!-- c --><p>A &amp; B</p>\n<p>C&nbsp;D</p></body></html>"
    df = spark.createDataFrame([(html,)], "h STRING")
    assert df.select(page_text("h")).collect()[0][0] == "A & B C D"


def test_combine_pages_bounds_groups_without_pos(spark):
    rows = [("a", r, f"u{r}", "t", False) for r in range(10)]
    pages = spark.createDataFrame(rows, "app STRING, rank INT, url STRING, text STRING, failed BOOLEAN")
    r = combine_pages(pages).collect()[0]
    assert r["n_pages"] == 3 and r["evidence_url"] == "u0, u1, u2"


def test_read_catalogue_null_tokens_and_quotes(spark):
    from docvet.session import scratch_path
    from docvet.sources.files import read_catalogue

    root = scratch_path(spark, "catalogue")
    import os

    os.makedirs(root, exist_ok=True)
    with open(f"{root}/apps.csv", "w", newline="") as f:
        f.write('id,name,website,category\r\n1,"Acme, Inc.",acme.com,sales\r\n2,None,NA, crm\r\n3,"Say ""hi""",x.io,\r\n')
    rows = {r["id"]: r for r in read_catalogue(spark, root).collect()}
    assert rows[1]["name"] == "Acme, Inc." and rows[1]["category"] == "sales"
    assert rows[2]["name"] is None and rows[2]["website"] is None and rows[2]["category"] == " crm"
    assert rows[3]["name"] == 'Say "hi"' and rows[3]["category"] is None
