"""Cells of a time lattice against direct window and bin sums, and bouts stitched over chunks."""
import random
from math import floor

import pytest
from pyspark.sql import functions as F

from cagetrace.operators import contacts as CT
from cagetrace.operators import measures as ME
from cagetrace.params import FIXTURE_CLEAN, SweepParams
from cagetrace.plans import clean_derive as P
from cagetrace.sources import fixture as FX

from conftest import SF_SMALL


def rows(seed, n=300, horizon=100):
    """Times at, just before and just after whole and broken minutes, in microseconds."""
    rng = random.Random(seed)
    us = [rng.choice([0, -1, 1]) + rng.randrange(0, horizon * 10) * 6_000_000 for _ in range(n)]
    return [(rng.randrange(3), rng.choice([1, 2]), max(0, u) / 6e7, None if rng.random() < .1 else rng.uniform(0, 50)) for u in us]


@pytest.mark.parametrize("windows,within,widths", [((30, 60, 90), 90, (5, 10, 15, 30)), ((2.5, 7), 12, (3, 4)), ((0.1, 0.3, 33.3), 50, (7,)), ((1 / 3,), 1, (1,))])
def test_windows_and_bins(spark, windows, within, widths):
    data = rows(1)
    df = spark.createDataFrame(data, "session int, id int, time0 double, move double")
    got = {(r.session, r.id, r.window_min): r.total_activity for r in ME.total_activity(df, windows).collect()}
    for s, i in {r[:2] for r in data}:
        for w in windows:
            assert got[s, i, float(w)] == pytest.approx(sum(m or 0 for a, b, t, m in data if (a, b) == (s, i) and t < w) / 1000)
    bins = {(r.session, r.id, r.bin_min, r.bin): r.bin_activity for r in ME.bin_activity(df, within, widths).collect()}
    want = {}
    for s, i, t, m in data:
        if t < within:
            for w in widths:
                k = (s, i, w, floor(t / w) * w)
                want[k] = want.get(k, 0) + (m or 0) / 1000
    assert {k: v for k, v in bins.items() if k in want} == pytest.approx(want)
    assert all(v == 0 for k, v in bins.items() if k not in want)


def test_cells_are_bounded_by_the_parameters(spark):
    lattice = ME.Lattice.of((30, 60), 60, (5, 15))
    assert lattice == ME.Lattice(5 * ME.US_PER_MIN, 12)
    df = spark.createDataFrame([(float(t),) for t in range(0, 30_000, 3)], "time0 double")
    assert [r.cell for r in df.select(lattice.cell).distinct().orderBy("cell").collect()] == list(range(13))


def test_fractional_bin_widths_are_refused():
    for bad in ((2, 2.5), (0,), (0.5,)):
        with pytest.raises(ValueError):
            SweepParams(bin_widths=bad)


def test_bouts_over_chunks_without_events(spark):
    """Chunks with none, one or many events of a pair; neighbours are found over any gap."""
    rng = random.Random(4)
    ev = []
    for pair in ((1, 2), (2, 1), (1, 3)):
        t = 0
        for chunk in range(30):
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                t += rng.randrange(1, 9)
                ev.append((1, chunk, 20.0, t, *pair, 1.0, 1, rng.choice([-1, 1]), rng.choice([1, 2, 3, None]), rng.choice([1, 2, 3, None])))
            t += 10
    df = spark.createDataFrame(ev, "session int, _ic int, threshold double, s int, ida int, idb int, dist double, nearing int, nearing_event int, moving_r_id int, moving_f_id int")
    df = df.withColumn("time", F.timestamp_seconds("s")).withColumn("time0", F.lit(0.0)).drop("s")
    cols = ["time", "ida", "idb", "nearing_event", "duration", "depart_id", "approach_id"]
    got = P.chunked_bouts(df).select(*cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, CT.contact_bouts(df).select(*cols).collect()))


def test_stored_crossings_give_the_same_events(spark):
    b = P.behavior(FX.frames(spark, SF_SMALL), FIXTURE_CLEAN, chunk_ms=60_000, chunk_rows=150)
    cols = ["session", "threshold", "time", "ida", "idb", "dist", "nearing", "nearing_event", "moving_r_id", "moving_f_id"]
    kept = b.materialized((20.0, 40.0))
    want = sorted(map(repr, b.events((20.0, 40.0)).select(*cols).collect()))
    assert sorted(map(repr, kept.events((20.0, 40.0)).select(*cols).collect())) == want
    assert sorted(map(repr, kept.events((40.0,)).select(*cols).collect())) == [r for r in want if "threshold=40.0" in r]
