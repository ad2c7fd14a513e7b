"""The queries that SQL can express against their DuckDB texts."""
import pytest

from cagetrace.llm import queries
from check_oracle import canon, duck

from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck(SF_SMALL).execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, rows) == canon(cols, res.fetchall())
