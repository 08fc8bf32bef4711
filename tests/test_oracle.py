"""Every registered query against its DuckDB oracle on the small fixture."""

import pytest

from tools.oracle_check import duck, rows_of

import __spark_entry__ as E
from alphaloom.plans.catalog import all_queries

from .conftest import SF_SMALL

QUERIES = {n: q.spark for n, q in all_queries().items()}
ORACLE = {n: s for n, s in E.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows is not None
        return
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, rows) == rows_of(ocols, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "overall_alpha_score" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(E.queries())
