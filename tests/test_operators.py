"""Hand-computed edge cases and invariants of the operators."""
import datetime as dt
import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.functions import rolling as R
from cagetrace.functions import stats as ST
from cagetrace.operators import clean as C
from cagetrace.operators import contacts as CT
from cagetrace.operators import measures as ME
from cagetrace.operators import series as SR
from cagetrace.params import CleanParams, StudyDesign, SweepParams
from cagetrace.plans import compare as CP
from cagetrace.plans import clean_derive as P

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session long, frame_no long, time timestamp, id int, x double, y double"


def frames_df(spark, series: dict, session=1, step_ms=500, times=None):
    """series: id -> list of (x, y); one frame per index."""
    rows = []
    n = len(next(iter(series.values())))
    for i in range(n):
        t = T0 + dt.timedelta(milliseconds=(times[i] if times else i * step_ms))
        for k, pts in series.items():
            x, y = pts[i]
            rows.append((session, i, t, k, x, y))
    return spark.createDataFrame(rows, SCHEMA)


def test_gap_fill_by_index(spark):
    df = spark.createDataFrame(
        [(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] +
        [(2, i, v) for i, v in enumerate([None, 5.0, None])] +
        [(3, i, v) for i, v in enumerate([2.0, None, 8.0])],
        "g int, t int, v double")
    out = {(r.g, r.t): r.v for r in C.gap_fill(df, ["g"], "t", ["v"]).collect()}
    assert [out[(1, i)] for i in range(6)] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert [out[(2, i)] for i in range(3)] == [None, 5.0, None]    # < 2 known values: gaps stay
    assert out[(3, 1)] == 5.0


def test_centred_frame_bounds():
    assert R.centred(20) == R.Frame(-9, 10)
    assert R.centred(5) == R.Frame(-2, 2)
    assert R.trailing(10) == R.Frame(-9, 0) and R.leading(10) == R.Frame(0, 9)


def test_strict_sum_nulls_and_edges(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])],
                               "g int, t int, v double")
    w = W.partitionBy("g").orderBy("t")
    out = df.select("t", R.strict_sum("v", w, R.trailing(2)).alias("r"),
                    R.strict_sum("v", w, R.leading(2)).alias("f")).orderBy("t").collect()
    assert [r.r for r in out] == [None, 3.0, None, None, 9.0, 11.0]
    assert [r.f for r in out] == [3.0, None, None, 9.0, 11.0, None]


def test_dedup_keeps_first_frame(spark):
    pts = {k: [(float(i), float(i)) for i in range(4)] for k in (1, 2)}
    df = frames_df(spark, pts, times=[0, 500, 500, 1000])
    kept = sorted({r.frame_no for r in C.dedup_time(df).collect()})
    assert kept == [0, 1, 3]
    cleaned = P.clean(df, CleanParams(fps=1, ids=(1, 2)))
    assert sorted({r.frame_no for r in cleaned.collect()}) == [0, 1, 3]


def test_common_start_and_never_seen(spark):
    a = {1: [(None, None), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)],
         2: [(5.0, 5.0), (None, 6.0), (7.0, 7.0), (8.0, 8.0)]}
    cleaned = P.clean(frames_df(spark, a), CleanParams(fps=1, ids=(1, 2)))
    rows = sorted((r.frame_no, r.id, r.x, r.y) for r in cleaned.collect())
    assert rows[0] == (1, 1, 1.0, 1.0)
    assert (1, 2, 6.0, 6.0) in rows          # x filled between 5 and 7
    b = {1: [(1.0, 1.0)] * 3, 2: [(None, 1.0)] * 3}
    assert P.clean(frames_df(spark, b, session=2), CleanParams(fps=1, ids=(1, 2))).count() == 0


def test_move_time0_and_rolls(spark):
    pts = {1: [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (6.0, 8.0)], 2: [(0.0, 0.0)] * 4}
    m = P.behavior(frames_df(spark, pts, step_ms=30000), CleanParams(fps=2, ids=(1, 2))).motion
    r = sorted((x.id, x.time0, x.move, x.roll_r, x.roll_f) for x in m.collect())
    one = [x for x in r if x[0] == 1]
    assert [x[1] for x in one] == [0.0, 0.5, 1.0, 1.5]
    assert [x[2] for x in one] == [None, 5.0, 0.0, 5.0]
    assert [x[3] for x in one] == [None, None, 5.0, 5.0]
    assert [x[4] for x in one] == [None, 5.0, 5.0, None]


def test_z_mask_nulls_whole_frame(spark):
    base = [(100.0 + (i % 3), 50.0 + (i % 2)) for i in range(30)]
    spike = list(base)
    spike[15] = (5000.0, 50.0)
    df = frames_df(spark, {1: spike, 2: base})
    p = CleanParams(fps=6, rm_z_outlier=True, z_threshold=3.0, ids=(1, 2))    # window of 12 frames
    out = P.long_rows(P.deduped(df, p), p.ids, ["session", "frame_no"])
    assert {(r.id, r.x, r.y) for r in out.filter(F.col("frame_no") == 15).collect()} == {(1, None, None), (2, None, None)}
    assert out.filter(F.col("x").isNull()).count() == 2


def test_cage_centre_is_optimal(spark):
    import random
    rnd = random.Random(3)
    xs = [rnd.uniform(0, 500) for _ in range(300)] + [rnd.uniform(800, 900) for _ in range(40)]
    df = spark.createDataFrame([(1, x) for x in xs], "s int, x double")
    best = C.densest_interval(df, ["s"], "x", 100).first()
    brute = max(sum(1 for v in xs if lo <= v <= lo + 100) for lo in xs)
    assert best.cover == brute
    assert sum(1 for v in xs if best.center - 50 <= v <= best.center + 50) == brute
    med = C.axis_summary(spark.createDataFrame([(1, v) for v in [1.0, 5.0, 2.0, 8.0]], "session int, x double"),
                         {"x": 3}).first()
    assert med.median == 3.5


def _toy_pairs(spark):
    # two subjects that meet twice; rolls make 1 the mover on approach
    d = [50, 10, 10, 50, 50, 10, 50]
    rows = []
    for i, v in enumerate(d):
        t = T0 + dt.timedelta(seconds=i)
        for a, b in ((1, 2), (2, 1)):
            rows.append((1, t, i / 60.0, a, b, float(v), float(3 if a == 1 else 1), float(1 if a == 1 else 3),
                         float(2), float(2)))
    return spark.createDataFrame(rows, "session long, time timestamp, time0 double, ida int, idb int, "
                                 "dist double, roll_r_a double, roll_r_b double, roll_f_a double, roll_f_b double")


def test_contacts_alternate_and_bouts(spark):
    ev = CT.contact_events(_toy_pairs(spark), [20.0])
    bo = CT.contact_bouts(ev).orderBy("ida", "time").collect()
    one = [r for r in bo if r.ida == 1]
    assert [r.nearing_event for r in one] == [-1, 1, -1, 1]
    assert [r.duration for r in one] == [2.0, 2.0, 1.0, None]
    assert [r.moving_r_id for r in one if r.nearing_event == -1] == [1, 1]
    assert one[0].depart_id == 2 and one[1].approach_id == 1        # tie on roll_f goes to idb
    counts = {r.ida: 0 for r in bo}
    for r in bo:
        counts[r.ida] += r.nearing_event == -1
    assert counts[1] == counts[2]


def test_total_interaction_counts(spark):
    bo = CT.contact_bouts(CT.contact_events(_toy_pairs(spark), [20.0]))
    t = {(r.id, r.window_min): r for r in ME.total_interaction(bo, [1.0]).collect()}
    assert t[(1, 1.0)].total_event_count == 2 and t[(1, 1.0)].total_approach_count == 2
    assert t[(1, 1.0)].total_approach_duration == 3.0
    assert t[(2, 1.0)].total_receive_count == 2 and t[(2, 1.0)].total_receive_duration == 3.0


def test_bin_sums_equal_totals(spark):
    from cagetrace.sources import fixture as FX
    b = P.behavior(FX.frames(spark, "/root/testdata/sf0.001"), CleanParams(fps=10))
    tot = {(r.session, r.id): r.total_activity for r in ME.total_activity(b.motion, [4]).collect()}
    bins = ME.bin_activity(b.motion, 4, [1, 2])
    for w in (1, 2):
        s = {}
        for r in bins.filter(F.col("bin_min") == w).collect():
            s[(r.session, r.id)] = s.get((r.session, r.id), 0.0) + r.bin_activity
        assert s.keys() == tot.keys()
        for k in tot:
            assert math.isclose(s[k], tot[k], rel_tol=1e-9)


def test_bin_completion_fills_regular_bins(spark):
    agg = spark.createDataFrame([(1, 5, 1, 0, 2.0), (1, 5, 2, 10, 3.0)],
                                "session long, bin_min int, id int, bin int, v double")
    out = sorted((r.id, r.bin, r.v) for r in
                 ME.complete_bins(agg, ["session", "bin_min"], "id", {5: [0, 5]}, {"v": 0.0}).collect())
    assert out == [(1, 0, 2.0), (1, 5, 0.0), (1, 10, 0.0), (2, 0, 0.0), (2, 5, 0.0), (2, 10, 3.0)]
    with pytest.raises(ValueError):
        SweepParams(bin_within=4, bin_widths=(5,))


@pytest.mark.parametrize("t,df,p", [(12.7062047, 1, 0.05), (2.2281389, 10, 0.05), (2.0422725, 30, 0.05),
                                    (3.2905, 1e5, 0.00100044), (1.959964, 1e6, 0.05000028), (0.0, 5, 1.0)])
def test_t_p_values(spark, t, df, p):
    got = spark.range(1).select(ST.t_two_sided_p(F.lit(t), F.lit(float(df))).alias("p")).first().p
    assert abs(got - p) < 5e-8


def test_signif_labels(spark):
    ps = [0.0005, 0.005, 0.03, 0.2, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert [r.l for r in df.select(ST.signif_label(F.col("p")).alias("l")).collect()] == \
        ["***", "**", "*", "NS.", None]


def test_paired_by_key_not_position(spark):
    rows = [("m1", "CNO", 5.0), ("m1", "SAL", 3.0), ("m2", "SAL", 1.0), ("m2", "CNO", 4.0),
            ("m3", "CNO", 9.0), ("m4", "SAL", 1.0), ("m4", "SAL", 2.0), ("m4", "CNO", 0.0),
            ("m5", "CNO", 7.0), ("m5", "SAL", 6.0)]
    df = spark.createDataFrame(rows, "mouse string, drug string, value double")
    out = CP.paired(df, StudyDesign("drug", ("CNO", "SAL"), "mouse"), []).first()
    assert (out.n, out.n_unpaired, out.n_duplicate) == (3, 1, 1)
    assert out.mean_diff == pytest.approx(2.0)      # diffs 2, 3, 1
    assert out.t == pytest.approx(2.0 / (1.0 / math.sqrt(3)))


def test_paired_values_ordered(spark):
    rows = [("m2", "CNO", 4.0), ("m1", "SAL", 3.0), ("m2", "SAL", 1.0), ("m1", "CNO", 5.0)]
    df = spark.createDataFrame(rows, "mouse string, drug string, value double")
    out = CP.paired_values(df, StudyDesign("drug", ("CNO", "SAL"), "mouse"), []).collect()
    assert [(r.mouse, r.value_CNO, r.value_SAL) for r in out] == [("m1", 5.0, 3.0), ("m2", 4.0, 1.0)]


def test_unpaired_welch(spark):
    rows = [("A", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("B", v) for v in (2.0, 4.0, 6.0, None)]
    df = spark.createDataFrame(rows, "g string, value double")
    out = CP.unpaired(df, StudyDesign("g", ("A", "B")), []).first()
    assert (out.n_a, out.n_b) == (4, 3)
    va, vb = 5 / 3, 4.0
    se2 = va / 4 + vb / 3
    assert out.t == pytest.approx((2.5 - 4.0) / math.sqrt(se2))
    assert out.df == pytest.approx(se2 ** 2 / ((va / 4) ** 2 / 3 + (vb / 3) ** 2 / 2))


def test_generic_zscore_and_domain_fill(spark):
    df = spark.createDataFrame([(1, i, 10.0 if i != 5 else 100.0) for i in range(11)], "g int, t int, v double")
    z = {r.t: r.z_flag for r in SR.rolling_zscore(df, ["g"], "t", "v", 11, 2.0).collect()}
    assert z[5] is True and sum(z.values()) == 1
    agg = spark.createDataFrame([(1, 3, 2.0)], "u int, h int, total double")
    out = SR.complete_domain(agg, ["u"], "h", list(range(4)), {"total": 0.0})
    assert sorted((r.h, r.total) for r in out.collect()) == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 2.0)]


def test_position_report(spark):
    from cagetrace.operators import checks as CK
    pts = {1: [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)],
           2: [(None, 1.0), (5.0, None), (None, None)],
           3: [(None, None)] * 3}
    df = frames_df(spark, pts, times=[0, 500, 500])
    rep = {(r.check_name, r.detail, r.n) for r in CK.position_report(df).collect()}
    assert ("duplicate_time", "", 3) in rep                     # frame 2 repeats frame 1's time
    assert ("sparse_series", "id=2 axis=x", 1) in rep           # one known x after dedup
    assert ("sparse_series", "id=2 axis=y", 1) in rep
    assert ("sparse_series", "id=3 axis=x", 0) in rep and ("sparse_series", "id=3 axis=y", 0) in rep
    assert ("subject_never_seen", "id=2", 0) in rep and ("subject_never_seen", "id=3", 0) in rep
    with pytest.raises(ValueError):
        CK.raise_if_any(CK.position_report(df))
    bad = df.withColumn("time", F.when(F.col("frame_no") == 0, F.lit(None)).otherwise(F.col("time")))
    assert ("unparsed_time", "", 3) in {(r.check_name, r.detail, r.n) for r in CK.position_report(bad).collect()}


def test_trajectory_slice_and_last(spark):
    from cagetrace.plans import inspect as IN
    pts = {1: [(float(i), 10.0) for i in range(6)], 2: [(100.0, float(i)) for i in range(6)]}
    m = P.behavior(frames_df(spark, pts, step_ms=30000), CleanParams(fps=1, ids=(1, 2))).motion
    t = IN.trajectory(m, time_point=2.0, duration=1.0, ids=[1], width=4, height=4)
    rows = sorted((r.time0, r.x, r.x_last) for r in t.collect())
    assert rows == [(1.5, 3.0, 4.0), (2.0, 4.0, 4.0)]          # (1.0, 2.0] minutes, id 1 only
    last = IN.last_points(m, 2.0, 1.0, [1, 2]).orderBy("id").collect()
    assert [(r.id, r.x_last, r.y_last, r.n_points) for r in last] == [(1, 4.0, 10.0, 2), (2, 100.0, 4.0, 2)]


def test_dedup_hot_copies_spread(spark):
    """Every frame repeats one timestamp: still exact, and the semi-join shuffles
    on (session, time, frame_no), so the copies do not meet in one task."""
    rows = [(7, i, T0, k, float(i), float(k)) for i in range(3000) for k in (1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.dedup_time(df)
    assert sorted((r.frame_no, r.id) for r in out.collect()) == [(0, 1), (0, 2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    import re
    assert re.search(r"hashpartitioning\(session#\d+L?, time#\d+, frame_no#\d+L?", plan)


def test_chunked_series_forms_equal_plain(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for g in ("a", "b", "c"):
        for t in range(400):
            v = None if (rnd.random() < 0.3 or (g == "a" and 90 <= t < 130)) else rnd.uniform(0, 100)
            if t == 200 and g == "b":
                v = 5000.0
            rows.append((g, t, t // 37, v))
    rows += [("d", t, t // 37, 1.0 if t == 50 else None) for t in range(120)]   # < 2 known values
    df = spark.createDataFrame(rows, "g string, t int, day int, v double")
    plain = SR.rolling_zscore(df, ["g"], "t", "v", 10, 2.0).select("g", "t", "roll_mean", "roll_sd", "z_flag")
    chunk = SR.rolling_zscore_chunked(df, ["g"], "t", "v", 10, 2.0, chunk="day", k_rows=23) \
        .select("g", "t", "roll_mean", "roll_sd", "z_flag")
    r = lambda d: d.select("g", "t", F.round("roll_mean", 9), F.round("roll_sd", 9), "z_flag")
    assert r(plain).exceptAll(r(chunk)).count() == 0 and r(chunk).exceptAll(r(plain)).count() == 0
    a = C.gap_fill(df, ["g"], "t", ["v"]).select("g", "t", F.round("v", 9).alias("v"))
    b = SR.gap_fill_chunked(df, ["g"], "t", ["v"], chunk="day").select("g", "t", F.round("v", 9).alias("v"))
    assert a.count() == b.count() == len(rows)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert b.filter("g = 'd'").filter(F.col("v").isNotNull()).count() == 1
