"""Moments of long frames from block prefixes and suffixes equal the plain row frames."""
import math

import pytest

from cagetrace.functions.rolling import Frame, centred, frame_moments, leading, trailing


def test_equals_row_frames(spark):
    rows = [(k, i, None if (i * 7 + k) % 5 == 0 or 20 <= i < 31 else 1e9 + math.sin(i * k) * 3) for k in (1, 2) for i in range(1, 48)]
    rows += [(3, 1, 4.0)]
    d = spark.createDataFrame(rows, "k int, i long, v double")
    for fr in (centred(1), centred(2), centred(5), centred(10), trailing(7), leading(4), Frame(-3, 6), centred(60)):
        got = {(r.k, r.i): (r.m, r.s) for r in frame_moments(d, ["k"], "i", "v", fr, "m", "s").collect()}
        assert len(got) == len(rows)
        for k, i, _ in rows:
            span = {j: v for kk, j, v in rows if kk == k and i + fr.lo <= j <= i + fr.hi}
            known = [v for v in span.values() if v is not None]
            m, s = got[k, i]
            if len(span) < fr.rows or not known:
                assert m is None and s is None, (fr, k, i)
                continue
            mean = math.fsum(known) / len(known)
            assert m == pytest.approx(mean, rel=1e-14)
            if len(known) < 2:
                assert s is None
            else:
                assert s == pytest.approx(math.sqrt(math.fsum((v - mean) ** 2 for v in known) / (len(known) - 1)), abs=1e-6)


def test_plan_has_no_long_row_frame(spark):
    d = spark.createDataFrame([(1, 1, 1.0)], "k int, i long, v double")
    plan = frame_moments(d.repartition("k"), ["k"], "i", "v", centred(2000), "m", "s")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "RowFrame, -999, 1000" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
