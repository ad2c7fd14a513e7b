"""p values of Student's t against the closed forms for whole degrees of freedom."""
import math

import pytest
from pyspark.sql import functions as F

from cagetrace.functions.stats import t_two_sided_p


def closed(t: float, df: int) -> float:
    """1 - A(t | df) by the finite sums over powers of cos(theta), theta = atan(t / sqrt(df))."""
    th = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(th), math.sin(th)
    if df == 1:
        return 1 - 2 * th / math.pi
    term, total = (c, c) if df % 2 else (1.0, 1.0)
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 1 - 2 / math.pi * (th + s * total) if df % 2 else 1 - s * total


def test_closed_forms(spark):
    cases = [(t, df) for df in (1, 2, 3, 4, 7, 10, 29, 30, 101, 1000) for t in (0.0, 1e-6, 0.01, -0.5, 1.0, 1.7, 2.5, 4.0)]
    d = spark.createDataFrame([(t, float(df)) for t, df in cases], "t double, df double")
    got = {(r.t, int(r.df)): r.p for r in d.select("t", "df", t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()}
    for t, df in cases:
        assert got[t, df] == pytest.approx(closed(t, df), abs=2e-12), (t, df)


def test_tails_and_nulls(spark):
    # df = 2 has p = 1 - t / sqrt(2 + t^2), whose digits survive as 2 / (r (r + t)), r = sqrt(2 + t^2)
    rows = [(t, 2.0) for t in (1e2, 1e5, 1e8)] + [(None, 3.0), (1.0, None), (1.0, 0.0), (1.0, 0.3), (1.959963984540054, 1e7)]
    d = spark.createDataFrame(rows, "t double, df double")
    got = [r.p for r in d.select(t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()]
    for (t, _), p in zip(rows[:3], got):
        r = math.sqrt(2 + t * t)
        assert p == pytest.approx(2 / (r * (r + t)), rel=1e-11)
    assert got[3:6] == [None, None, None] and 0.5 < got[6] < 1
    assert got[7] == pytest.approx(0.05, abs=1e-7)        # the normal limit
