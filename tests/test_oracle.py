"""Every catalogue query against its DuckDB SQL (small scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from docvet.sources.tables import TABLES
from scripts.oracle_check import digest, duck_type, spark_type

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {c[0]: duck_type(c[1]) for c in res.description}
    assert {f.name: spark_type(f.dataType) for f in df.schema.fields} == dtypes
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["value", "n", "share"]
    assert df.count() > 0
