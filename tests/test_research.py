"""The end-to-end research run."""

from pyspark.sql import functions as F

from docvet.plans.research import research_run, table_catalogue
from docvet.session import scratch_path
from docvet.sources.files import ERRORS_SCHEMA, read_errors, read_results

SF = "/root/testdata/sf0.001"


def test_research_run(spark):
    run = research_run(spark, SF)
    apps = table_catalogue(spark, SF).count()
    missed = spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()
    assert run.errors.count() == missed > 0
    assert run.results.count() + missed == apps == run.log.count()
    assert run.results.where((F.size("issues") > 0) != F.col("manual_review")).count() == 0
    # every evidence list holds at most three URLs
    assert run.results.where(F.size(F.split("evidence_url", ", ")) > 3).count() == 0


def test_research_run_routes_failures(spark):
    def make():
        def fn(request, row):
            assert row["name"] in request and row["category"] in request
            if row["name"].startswith("m."):
                raise RuntimeError("model unavailable")
            return '{"category": "x"}'  # required fields are missing

        return fn

    run = research_run(spark, SF, make)
    e = run.errors.collect()
    assert run.results.count() == 0
    assert {r["error"].split(":")[0] for r in e} == {"model unavailable", "field(s) without text", "No result returned"}


def test_sample_limit_and_outputs(spark):
    names = [r["name"] for r in table_catalogue(spark, SF).orderBy("name").limit(5).collect()]
    run = research_run(spark, SF, sample=names, limit=3)
    assert run.log.count() == 3
    root = scratch_path(spark, "outputs")
    run.write(root, reset=True)
    run.write(root)
    assert read_results(spark, f"{root}/results").count() == 2 * run.results.count()
    assert read_errors(spark, f"{root}/errors").schema == ERRORS_SCHEMA
    run.write(root, reset=True)
    assert read_results(spark, f"{root}/results").count() == run.results.count()


def test_pages_are_ranked_by_id(spark):
    """No page text goes through the ranking's window: it reads the ids and URLs only."""
    from docvet.operators.collect import top_docs
    from docvet.sources.records import page_hits

    plan = top_docs(page_hits(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
