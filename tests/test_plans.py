"""Physical plan shape: chunk-keyed shuffles, no Python, pruned scans."""
import re

import pytest

from cagetrace.params import FIXTURE_CLEAN
from cagetrace.plans import clean_derive as P
from cagetrace.plans.registry import QUERIES
from cagetrace.sources import fixture as FX

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(p):
    return len(re.findall(r"Exchange hashpartitioning", p))


def test_clean_and_derive_exchanges(static):
    """Frames are shuffled three times (dedup, time chunks, index chunks); the rest are chunk summaries."""
    b = P.behavior(FX.frames(static, SF_SMALL), FIXTURE_CLEAN)
    assert exchanges(plan(b.motion)) <= 6
    # a recording is never one task: frames are keyed by a chunk beside the session
    p = plan(b.motion)
    assert re.search(r"hashpartitioning\(session#\d+L, _tc#", p) and re.search(r"hashpartitioning\(session#\d+L, _ic#", p)
    # per-frame pairs, pair lag and events reuse the chunk partitioning
    assert exchanges(plan(b.neighbours)) == exchanges(p)
    p = plan(b.events([20.0, 40.0]))
    assert exchanges(p) <= 6
    assert re.search(r"Window \[lag\(_d_1_2", p)                        # lag on the frame rows
    assert not re.search(r"Window \[lag\([^\n]*\], \[[^\]]*ida#", p)  # never over directed pairs


def test_scan_reads_one_column(static):
    p = plan(P.behavior(FX.frames(static, SF_SMALL), FIXTURE_CLEAN).motion)
    assert "ReadSchema: struct<event_id:bigint>" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plans(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "EvalPython" not in p and "InPandas" not in p and "PythonUDF" not in p


def test_lineitem_filter_pushed(spark):
    p = plan(QUERIES["lineitem_group_ttest"](spark, SF_SMALL))
    assert "PushedFilters: [In(l_returnflag, [A,N])" in p or "l_returnflag IN (A,N)" in p
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in p


def test_stored_frames_are_pruned(static):
    """A measure family reads only its own columns of the stored per-frame table."""
    from cagetrace.operators import measures as ME
    static.conf.set("spark.sql.maxMetadataStringLength", "10000")
    b = P.behavior(FX.frames(static, SF_SMALL), FIXTURE_CLEAN).materialized()
    p = plan(ME.total_activity(b.rows(("move",)), [2.0, 4.0]))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert "id_1_move" in schema and "roll_r" not in schema and "id_1_x" not in schema


def shape(df):
    p = plan(df)
    return len(re.findall(r"\bWindow \[", p)), len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", p))


def test_no_window_runs_twice(static):
    """The chunk summary and the frames it joins read one exchange; bouts are stitched without a join."""
    windows, moved = shape(QUERIES["contact_bouts"](static, SF_SMALL))
    assert windows <= 10 and moved <= 7
    assert "ReusedExchange" in plan(QUERIES["contact_bouts"](static, SF_SMALL))


def test_sweep_tables_come_from_cells(static):
    """Once cells are stored, each family is dealt by recording once, totals and bins alike."""
    windows, moved = shape(QUERIES["sweep_long"](static, SF_SMALL))
    assert windows == 1 and moved <= 7
