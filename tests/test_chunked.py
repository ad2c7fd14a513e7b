"""Chunk sizes change the tasks, not the result."""
import pytest
from pyspark.sql import functions as F

from cagetrace.params import FIXTURE_CLEAN
from cagetrace.plans import clean_derive as P
from cagetrace.plans.registry import CLEAN_ALL, ragged_frames
from cagetrace.sources import fixture as FX

from conftest import SF_SMALL

DBL = ("x", "y", "move", "roll_r", "roll_f", "time0", "dist", "duration", "mean_dist", "closest_dist")
SMALL = dict(chunk_ms=7_000, chunk_rows=37)   # many boundaries per recording
MOTION = ["session", "time", "id", "time0", "x", "y", "move", "roll_r", "roll_f"]


def rounded(df, cols):
    return df.select(*[F.round(c, 9).alias(c) if c in DBL else c for c in cols])


def assert_same(a, b, cols):
    a, b = rounded(a, cols), rounded(b, cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def plans(spark):
    fr = FX.frames(spark, SF_SMALL)
    return P.behavior(fr, FIXTURE_CLEAN), P.behavior(fr, FIXTURE_CLEAN, **SMALL)


def test_motion_equal(plans):
    assert_same(plans[0].motion, plans[1].motion, MOTION)


def test_ragged_equal(spark):
    fr = ragged_frames(spark, SF_SMALL)
    a, b = P.behavior(fr, CLEAN_ALL), P.behavior(fr, CLEAN_ALL, **SMALL)
    assert_same(a.motion, b.motion, MOTION)
    assert_same(a.neighbours, b.neighbours, ["session", "time", "id", "mean_dist", "closest_dist"])


def test_bouts_equal(plans):
    cols = ["session", "threshold", "time", "ida", "idb", "nearing_event", "moving_r_id", "moving_f_id",
            "approach_id", "depart_id", "duration"]
    assert_same(plans[0].bouts([20.0, 40.0]), plans[1].bouts([20.0, 40.0]), cols)


def test_neighbours_equal(plans):
    assert_same(plans[0].neighbours, plans[1].neighbours, ["session", "time", "id", "mean_dist", "closest_dist"])


def test_one_session_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # no coalescing of the tiny shuffle
    try:
        b = P.behavior(FX.frames(spark, SF_SMALL), FIXTURE_CLEAN, **SMALL)
        one = b.motion.filter(F.col("session") == 0)
        assert one.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        plan = b.motion._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(session#" in plan and "_ic#" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
