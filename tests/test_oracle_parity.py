"""Every registered query against its DuckDB oracle (row count, columns, values)."""
import pytest

import __spark_entry__ as E
import oracle_queries
from cagetrace.plans.registry import QUERIES
from check_oracle import canon, duck

from conftest import SF_SMALL

ORACLE = dict(oracle_queries.ORACLE)
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, rows) == canon(dcols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["session", "id", "window_min"]
    assert df.count() > 0
