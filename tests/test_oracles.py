"""Every query of the library's own operators against its DuckDB oracle on the smallest test tables.

The training-data queries are checked in ``tests/llm``."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import codetrail.plans  # noqa: F401  (registers the queries)
from codetrail.plans.registry import ORACLES, QUERIES
from codetrail.sources.carriers import TABLES
from tools.oracle_check import digest

SF = os.environ.get("CODETRAIL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    got, want = digest(df.columns, rows), digest(ocols, orows)
    if got[0] != want[0]:
        extra, missing = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
        raise AssertionError(f"{name}: spark-only {extra} oracle-only {missing}")
