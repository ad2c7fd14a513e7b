"""Registered queries: one per operator of the inventory, on the driver tables.

Each callable takes (spark, sf_dir) and returns a DataFrame.  Position
data comes from the fixture view over ``events`` (whole table, every
session); generic operators run on ``events``, ``lineitem``, ``orders``.
Doubles are rounded to 6 places, integers cast to fixed widths, time is
reported as epoch milliseconds (``t_ms``) so both engines agree on types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.operators import checks as CK
from cagetrace.operators import clean as C
from cagetrace.operators import measures as ME
from cagetrace.operators import motion as M
from cagetrace.operators import reshape as RS
from cagetrace.operators import series as SR
from cagetrace.params import (FIXTURE_CLEAN, FIXTURE_PAIRED, FIXTURE_SWEEP, FIXTURE_UNPAIRED,
                              CleanParams, StudyDesign)
from cagetrace.plans import clean_derive as P
from cagetrace.plans import compare as CP
from cagetrace.plans import inspect as IN
from cagetrace.plans import sweep as SW
from cagetrace.plans.clean_derive import Behavior, behavior
from cagetrace.session import stage
from cagetrace.sources import fixture as FX
from cagetrace.sources import logs as L
from cagetrace.sources import subjects as SJ

S = "session"
INFO = ("marker_id", "line", "drug", "mouse")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(c: str | Column, alias: str | None = None) -> Column:
    """Double rounded to 6 places, named ``alias`` or the column's own name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(alias or c)


def t_ms(c: str = "time") -> Column:
    return F.unix_millis(F.col(c)).alias("t_ms")


# Small chunks for the ``*_chunked`` queries: every fixture recording spans
# many, so boundaries are exercised.  The others run with the defaults.
CHUNKS = dict(chunk_ms=60_000, chunk_rows=150)


def fixture_behavior(spark: SparkSession, sf: str, p: CleanParams = FIXTURE_CLEAN, **chunks) -> Behavior:
    return behavior(FX.frames(spark, sf), p, **chunks)


def info(spark: SparkSession, sf: str) -> DataFrame:
    return FX.subjects(spark, sf).select(S, "id", *INFO)


# --------------------------------------------------------------- measures
@query
def q_total_activity(spark, sf):
    b = fixture_behavior(spark, sf)
    t = ME.join_info(ME.total_activity(b.rows(("move",)), FIXTURE_SWEEP.windows), info(spark, sf))
    return t.select(S, "id", r6("window_min"), r6("total_activity"), *INFO)


def windows_info(df: DataFrame, spark, sf) -> DataFrame:
    return ME.join_info(df, info(spark, sf))


# ------------------------------------------------------------ cleaning
def _dedup(spark, sf, p: CleanParams = FIXTURE_CLEAN) -> DataFrame:
    return P.long_rows(P.deduped(FX.frames(spark, sf), p), p.ids, [S, "frame_no", "time"])


@query
def q_frames_dedup(spark, sf):
    return _dedup(spark, sf).select(S, "frame_no", t_ms(), "id", "x", "y")


@query
def q_common_start(spark, sf):
    d = P.starts(FX.frames(spark, sf), FIXTURE_CLEAN)
    return d.select(S, "id", F.unix_millis("first_seen").alias("first_seen_ms"), F.unix_millis("start").alias("start_ms"), "kept_rows")


@query
def q_lerp(spark, sf):
    c = P.clean(FX.frames(spark, sf), FIXTURE_CLEAN)
    return c.select(S, "frame_no", t_ms(), "id", r6("x"), r6("y"))


@query
def q_motion(spark, sf):
    m = fixture_behavior(spark, sf).motion
    return m.select(S, t_ms(), "id", r6("time0"), r6("x"), r6("y"))


@query
def q_step_distance(spark, sf):
    m = fixture_behavior(spark, sf).rows(("move",))
    return m.select(S, t_ms(), "id", r6("move"))


@query
def q_roll_move(spark, sf):
    m = fixture_behavior(spark, sf).motion
    return m.select(S, t_ms(), "id", r6("roll_r"), r6("roll_f"))


@query
def q_pair_distance(spark, sf):
    p = M.pair_rows(fixture_behavior(spark, sf).wide, FIXTURE_CLEAN.ids, with_rolls=False)
    return p.select(S, t_ms(), "ida", "idb", r6("time0"), r6("dist"))


def _z_rows(spark, sf, *cols) -> DataFrame:
    z = P.z_scores(FX.frames(spark, sf), FIXTURE_CLEAN.ids, FIXTURE_CLEAN.z_rows, FIXTURE_CLEAN.z_threshold)
    return P.long_rows(z, FIXTURE_CLEAN.ids, [S, "frame_no"], cols)


@query
def q_roll_zscore(spark, sf):
    z = _z_rows(spark, sf, "x_mean", "x_sd", "y_mean", "y_sd", "z")
    return z.select(S, "frame_no", "id", r6("x_mean", "mean_x"), r6("x_sd", "sd_x"), r6("y_mean", "mean_y"),
                    r6("y_sd", "sd_y"), F.col("z").alias("z_flag"))


@query
def q_z_mask(spark, sf):
    z = _z_rows(spark, sf, "x", "z")
    return (z.groupBy(S, "frame_no")
            .agg(F.count_if("z").alias("n_flagged"), F.count("x").alias("n_removed_x"))
            .filter(F.col("n_flagged") > 0))


@query
def q_cage_center(spark, sf):
    d, p = _dedup(spark, sf), FIXTURE_CLEAN
    cc = C.cage_center(d, p.cage_width, p.cage_height)
    return (cc.select(S, r6("cx"), r6("cy"), "x_cover", "y_cover", "x_n", "y_n",
                    r6("x_min"), r6("x_max"), r6("y_min"), r6("y_max"), r6("x_median"), r6("y_median")))


@query
def q_cage_center_real(spark, sf):
    """The cage centre on positions with a fractional part, nearly all distinct."""
    d = _dedup(spark, sf)
    part = (F.col("frame_no") * 7919 + F.col("id") * 104729) % 1000003 / F.lit(1048576.0)
    d = d.withColumns({a: F.col(a) + part for a in ("x", "y")})
    cc = C.cage_center(d, FIXTURE_CLEAN.cage_width, FIXTURE_CLEAN.cage_height)
    return cc.select(S, r6("cx"), r6("cy"), "x_cover", "y_cover", "x_n", "y_n", r6("x_min"), r6("x_max"),
                     r6("y_min"), r6("y_max"))


@query
def q_cage_mask(spark, sf):
    m = P.cage_mask(P.deduped(FX.frames(spark, sf), FIXTURE_CLEAN), FIXTURE_CLEAN)
    return P.long_rows(m, FIXTURE_CLEAN.ids, [S, "frame_no", "time"]).select(S, "frame_no", t_ms(), "id", "x", "y")


CLEAN_ALL = CleanParams(fps=FIXTURE_CLEAN.fps, rm_z_outlier=True, rm_cage_outlier=True)


@query
def q_motion_clean(spark, sf):
    m = fixture_behavior(spark, sf, CLEAN_ALL).motion
    return m.select(S, t_ms(), "id", r6("time0"), r6("x"), r6("y"), r6("move"),
                    r6("roll_r"), r6("roll_f"))


def ragged_frames(spark, sf) -> DataFrame:
    """Positions with missing rows of single subjects, unparsed times and gaps in the frame numbers."""
    n = F.col("frame_no")
    f = FX.frames(spark, sf).filter(((n * 11 + F.col("id")) % 29 != 0) & (n % 101 != 0))
    return f.withColumn("time", F.when(n % 83 != 0, F.col("time")))


def _ragged(spark, sf, **chunks) -> DataFrame:
    m = behavior(ragged_frames(spark, sf), CLEAN_ALL, **chunks).motion
    return m.select(S, t_ms(), "id", r6("time0"), r6("x"), r6("y"), r6("move"), r6("roll_r"), r6("roll_f"))


@query
def q_motion_ragged(spark, sf):
    return _ragged(spark, sf)


@query
def q_motion_ragged_chunked(spark, sf):
    return _ragged(spark, sf, **CHUNKS)


# ------------------------------------------------------------- reshape
@query
def q_frames_wide(spark, sf):
    b = fixture_behavior(spark, sf)
    w = M.wide_frames(b.motion, FIXTURE_CLEAN.ids, cols=("x", "y", "move"))
    cols = [r6(c) for c in w.columns if c.startswith("id_")]
    return w.select(S, t_ms(), r6("time0"), *cols)


@query
def q_frames_long(spark, sf):
    """Raw frames to the log's wide layout (one row per frame) and back."""
    f = FX.frames(spark, sf)
    wide = RS.to_wide(f, FIXTURE_CLEAN.ids, keys=[S, "frame_no", "time"])
    long = RS.to_long(wide, FIXTURE_CLEAN.ids, keys=[S, "frame_no", "time"])
    return long.select(S, "frame_no", t_ms(), "id", "x", "y")


# ------------------------------------------------------------ measures
@query
def q_bin_activity(spark, sf):
    b = fixture_behavior(spark, sf)
    sp = FIXTURE_SWEEP
    t = windows_info(ME.bin_activity(b.rows(("move",)), sp.bin_within, sp.bin_widths), spark, sf)
    return t.select(S, "id", "bin_min", "bin", r6("bin_activity"), *INFO)


@query
def q_total_distance(spark, sf):
    b = fixture_behavior(spark, sf)
    t = windows_info(ME.total_distance(b.neighbours, FIXTURE_SWEEP.windows), spark, sf)
    return t.select(S, "id", r6("window_min"), r6("total_mean_dist"), r6("total_closest_dist"), *INFO)


@query
def q_bin_distance(spark, sf):
    b = fixture_behavior(spark, sf)
    sp = FIXTURE_SWEEP
    t = windows_info(ME.bin_distance(b.neighbours, sp.bin_within, sp.bin_widths), spark, sf)
    return t.select(S, "id", "bin_min", "bin", r6("bin_mean_dist"), r6("bin_closest_dist"), *INFO)


def fixture_bouts(spark, sf, thresholds=None):
    return fixture_behavior(spark, sf).bouts(thresholds or FIXTURE_SWEEP.thresholds)


@query
def q_contact_events(spark, sf):
    ev = fixture_behavior(spark, sf).events([FIXTURE_SWEEP.thresholds[0]])
    return ev.select(S, r6("threshold"), t_ms(), "ida", "idb", r6("time0"), r6("dist"),
                     F.col("nearing").cast("int").alias("nearing"),
                     F.col("nearing_event").cast("int").alias("nearing_event"),
                     "moving_r_id", "moving_f_id")


@query
def q_contact_bouts(spark, sf):
    bo = fixture_bouts(spark, sf)
    return bo.select(S, r6("threshold"), t_ms(), "ida", "idb",
                     F.col("nearing_event").cast("int").alias("nearing_event"),
                     "moving_r_id", "moving_f_id", "approach_id", "depart_id", r6("duration"))


@query
def q_total_interaction(spark, sf):
    t = windows_info(ME.total_interaction(fixture_bouts(spark, sf), FIXTURE_SWEEP.windows), spark, sf)
    return t.select(S, "id", r6("threshold"), r6("window_min"),
                    *[r6(f"total_{f}") if "duration" in f else F.col(f"total_{f}").cast("bigint").alias(f"total_{f}")
                      for f in ME.INTER_FIELDS], *INFO)


@query
def q_bin_interaction(spark, sf):
    sp = FIXTURE_SWEEP
    t = windows_info(ME.bin_interaction(fixture_bouts(spark, sf), sp.bin_within, sp.bin_widths), spark, sf)
    counts = [f"bin_{f}" for f in ME.INTER_FIELDS if "count" in f] + \
             [f"bin_{s}_cumul" for s in ("event", "approach", "receive")]
    return t.select(S, "id", r6("threshold"), "bin_min", "bin",
                    *[F.col(c).cast("bigint").alias(c) for c in counts],
                    *[r6(f"bin_{f}") for f in ME.INTER_FIELDS if "duration" in f], *INFO)


# --------------------------------------------------------------- sweep
def fixture_sweep(spark, sf, families=("activity", "distance", "interaction"), **chunks):
    sp = replace(FIXTURE_SWEEP, activity="activity" in families, distance="distance" in families,
                 interaction="interaction" in families)
    return SW.sweep(fixture_behavior(spark, sf, **chunks), sp), sp


def fixture_long(spark, sf, families=("activity", "distance", "interaction"), **chunks):
    """Long measure table of the sweep, subject facts joined once after the union."""
    t, sp = fixture_sweep(spark, sf, families, **chunks)
    return SW.to_long(t, sp, info=info(spark, sf))


def long_out(df: DataFrame, extra=()) -> DataFrame:
    return df.select(S, "id", "family", "kind", r6("threshold"), r6("window_min"), "bin_min", "bin",
                     "measure", r6("value"), *extra)


@query
def q_sweep_activity(spark, sf):
    t, sp = fixture_sweep(spark, sf, ("activity",))
    return long_out(SW.to_long(t, sp))


@query
def q_sweep_distance(spark, sf):
    t, sp = fixture_sweep(spark, sf, ("distance",))
    return long_out(SW.to_long(t, sp))


@query
def q_sweep_interaction(spark, sf):
    t, sp = fixture_sweep(spark, sf, ("interaction",))
    return long_out(SW.to_long(t, sp))


@query
def q_sweep_long(spark, sf):
    return long_out(fixture_long(spark, sf), INFO)


# ------------------------------------------------------------- compare
def _test_out(df: DataFrame, keys: list[str]) -> DataFrame:
    dbl = [c for c in ("mean_a", "mean_b", "var_a", "var_b", "mean_diff", "sd_diff", "t", "df", "p")
           if c in df.columns]
    ints = [F.col(c).cast("bigint").alias(c) for c in ("n_a", "n_b", "n", "n_unpaired", "n_duplicate")
            if c in df.columns]
    return df.select(*keys, *ints, *[r6(c) for c in dbl], "label")


def _activity_long(spark, sf, kind="total"):
    lg = fixture_long(spark, sf, ("activity",))
    return lg.filter(F.col("measure") == f"{kind}_activity")


@query
def q_compare_unpaired(spark, sf):
    out = CP.unpaired(_activity_long(spark, sf), FIXTURE_UNPAIRED, ["measure", "window_min"])
    return _test_out(out.withColumn("window_min", r6("window_min")), ["measure", "window_min"])


@query
def q_compare_paired(spark, sf):
    out = CP.paired(_activity_long(spark, sf), FIXTURE_PAIRED, ["measure", "window_min"])
    return _test_out(out.withColumn("window_min", r6("window_min")), ["measure", "window_min"])


def _bins(lg: DataFrame, by: list[str]) -> DataFrame:
    out = CP.bin_summary(lg, FIXTURE_UNPAIRED, by, plot_within=FIXTURE_SWEEP.bin_within)
    return out.select(*by, "grp", "group_ord", "bin_end", "n", r6("mean"), r6("sd"), r6("se"))


@query
def q_compare_bins(spark, sf):
    return _bins(_activity_long(spark, sf, "bin"), ["measure", "bin_min"])


@query
def q_compare_bins_all(spark, sf):
    """Group means per bin of every per-bin measure."""
    return _bins(fixture_long(spark, sf).filter(F.col("kind") == "bin"), ["measure", "threshold", "bin_min"])


@query
def q_paired_values(spark, sf):
    """The paired listing: each pair key's value under both conditions."""
    out = CP.paired_values(_activity_long(spark, sf), FIXTURE_PAIRED, ["measure", "window_min"])
    return out.select("measure", r6("window_min"), "mouse", r6("value_CNO"), r6("value_SAL"))


@query
def q_compare_sweep(spark, sf):
    lg = stage(fixture_long(spark, sf).filter(F.col("kind") == "total"), "long")   # both designs read it
    by = ["measure", "threshold", "window_min"]
    u = CP.unpaired(lg, FIXTURE_UNPAIRED, by)
    p = CP.paired(lg, FIXTURE_PAIRED, by)
    keys = ["design", "measure", r6("threshold"), r6("window_min")]
    u = u.select(F.lit("unpaired").alias("design"), *by, "n_a", "n_b", "mean_a", "mean_b",
                 "t", "df", "p", "label")
    p = p.select(F.lit("paired").alias("design"), *by, F.col("n").alias("n_a"), F.col("n").alias("n_b"),
                 "mean_a", "mean_b", "t", "df", "p", "label")
    return _test_out(u.unionByName(p), keys)


# -------------------------------------------------------------- ingest
def fixture_lines(spark, sf) -> DataFrame:
    """The fixture positions written as tracker log lines (one file per session).

    Odd sessions use the older header dialect, every third session has a
    trailing comma on frame lines, sessions s % 7 == 3 lack the
    ``Analysis No`` key and sessions s % 11 == 5 list three markers.
    """
    s = F.col("session")
    return L.render_lines(
        FX.frames(spark, sf), FX.IDS,
        path=F.concat(F.lit("/logs/session_"), s.cast("string"), F.lit(".csv")),
        session=s.cast("string"), marker_dialect=(s % 2 == 1), trailing_comma=(s % 3 == 0),
        drop_key=F.when(s % 7 == 3, F.lit("Analysis No")),
        n_markers=F.when(s % 11 == 5, F.lit(3)).otherwise(F.lit(4)))


def fixture_subject_list(spark, sf) -> DataFrame:
    """The subject view as a subject-list CSV would read: all strings."""
    sj = FX.subjects(spark, sf)
    return sj.select(F.col(S).cast("string").alias("Session"), F.lit("1").alias("Camera"),
                     F.col("marker_id").alias("ID"), "line", "drug",
                     F.col("mouse").cast("string").alias("mouse"))


@query
def q_ingest_metadata(spark, sf):
    m = L.parse_metadata(fixture_lines(spark, sf))
    return m.select("path", "session", "project", "camera_no", "analysis_no",
                    F.unix_millis("exp_date").alias("exp_date_ms"),
                    F.unix_millis("start_time").alias("start_ms"),
                    F.unix_millis("finish_time").alias("finish_ms"))


@query
def q_ingest_markers(spark, sf):
    return L.parse_markers(fixture_lines(spark, sf))


def scanned(lines: DataFrame) -> DataFrame:
    """Frames through the file-scan path: each rendered log is cut into
    blocks of 173 lines with scan positions that jump between blocks, as
    a split file read by several tasks would be."""
    ln = F.col("line_no")
    blk = F.floor((ln - 1) / 173)
    return L.frames_from_raw(lines.select("path", (blk * 65536).alias("_blk"), (ln + blk * 1_000_003).alias("_pos"), "value"))


@query
def q_ingest_frames(spark, sf):
    return scanned(fixture_lines(spark, sf)).select(S, "frame_no", t_ms(), "id", "x", "y")


@query
def q_sweep_two_cameras(spark, sf):
    """Logs of two cameras share a session name and their times; each stays a recording of its own."""
    s = F.col("session")
    name, cam = ((s - s % 2) / 2).cast("bigint").cast("string"), (s % 2 + 1).cast("string")
    fr = FX.frames(spark, sf).withColumn("time", F.timestamp_millis(F.unix_millis("time") - s % 2 * FX.SESSION_MS))
    lines = L.render_lines(fr, FX.IDS, path=F.concat(F.lit("/logs/"), name, F.lit("-C"), cam, F.lit(".csv")), session=name,
                           marker_dialect=(s % 2 == 1), trailing_comma=(s % 3 == 0), camera=F.concat(cam, F.lit("A")))
    sj = FX.subjects(spark, sf).select(name.alias("Session"), cam.alias("Camera"), F.col("marker_id").alias("ID"), "line", "drug")
    info = SJ.subject_info(lines, sj).withColumnRenamed("path", L.RECORDING).select(L.RECORDING, "id", S, "camera", "line", "drug")
    b = behavior(scanned(lines), FIXTURE_CLEAN, L.RECORDING)
    t = ME.join_info(ME.total_activity(b.rows(("move",)), FIXTURE_SWEEP.windows, L.RECORDING), info, L.RECORDING)
    return t.select(L.RECORDING, S, "camera", "id", r6("window_min"), r6("total_activity"), "line", "drug")


@query
def q_subjects_validated(spark, sf):
    return SJ.validated(fixture_subject_list(spark, sf), FIXTURE_PAIRED)


@query
def q_subject_info(spark, sf):
    return SJ.subject_info(fixture_lines(spark, sf), fixture_subject_list(spark, sf)).select(
        "path", S, "camera", "id", "marker_id", "description", "line", "drug", "mouse")


@query
def q_check_report(spark, sf):
    return (CK.log_report(fixture_lines(spark, sf))
            .unionByName(CK.position_report(FX.frames(spark, sf))))


# ------------------------------------------------------------- inspect
TRAJ = dict(time_point=3.0, duration=0.5, ids=FX.IDS)


@query
def q_trajectory_slice(spark, sf):
    t = IN.trajectory(fixture_behavior(spark, sf).motion, **TRAJ)
    return t.select(S, t_ms(), "id", r6("time0"), r6("x"), r6("y"), r6("x_last"), r6("y_last"),
                    r6("cx"), r6("cy"), r6("box_xmin"), r6("box_xmax"), r6("box_ymin"), r6("box_ymax"))


@query
def q_trajectory_last(spark, sf):
    t = IN.last_points(fixture_behavior(spark, sf).motion, **TRAJ)
    return t.select(S, "id", t_ms(), r6("x_last"), r6("y_last"), "n_points")


# ------------------------------------------------ generic driver tables
# equal times are ordered by event, so row numbers are stable
EVENT_ORDER = "struct(ts, event_id) AS at"


@query
def q_events_roll_zscore(spark, sf):
    # few event types: each series is split by day (index chunks + halos)
    ev = FX.table(spark, sf, "events").selectExpr("event_id", EVENT_ORDER, "event_type", "value", "to_date(ts) AS day")
    z = SR.rolling_zscore_chunked(ev, ["event_type"], "at", "value", n=2 * FIXTURE_CLEAN.fps,
                                  z=FIXTURE_CLEAN.z_threshold, chunk="day")
    return z.select("event_id", "event_type", r6("roll_mean"), r6("roll_sd"), "z_flag")


@query
def q_events_roll_zscore_wide(spark, sf):
    # windows of 2,000 rows cost no more than windows of 40
    ev = FX.table(spark, sf, "events").selectExpr("event_id", EVENT_ORDER, "event_type", "value", "to_date(ts) AS day")
    z = SR.rolling_zscore_chunked(ev, ["event_type"], "at", "value", n=2000, z=FIXTURE_CLEAN.z_threshold, chunk="day")
    return z.select("event_id", "event_type", r6("roll_mean"), r6("roll_sd"), "z_flag")


@query
def q_events_lerp(spark, sf):
    ev = FX.table(spark, sf, "events").selectExpr(
        "event_id", EVENT_ORDER, "event_type", "to_date(ts) AS day", "CASE WHEN event_id % 7 <> 0 THEN value END AS value")
    f = SR.gap_fill_chunked(ev, ["event_type"], "at", ["value"], chunk="day")
    return f.select("event_id", "event_type", r6("value"))


def _hourly(spark, sf):
    ev = FX.table(spark, sf, "events")
    agg = (ev.groupBy("user_id", F.hour("ts").cast("int").alias("hour"))
           .agg(F.sum("value").alias("total")))
    return SR.complete_domain(agg, ["user_id"], "hour", list(range(24)), {"total": 0.0})


@query
def q_events_bin_fill(spark, sf):
    return _hourly(spark, sf).select("user_id", "hour", r6("total"))


@query
def q_events_cumul(spark, sf):
    c = SR.running_total(_hourly(spark, sf), ["user_id"], "hour", "total", "cumul")
    return c.select("user_id", "hour", r6("total"), r6("cumul"))


@query
def q_lineitem_group_ttest(spark, sf):
    li = FX.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    out = CP.unpaired(li, StudyDesign("l_returnflag", ("A", "N")), [])
    return _test_out(out, [])


@query
def q_orders_paired_ttest(spark, sf):
    o = FX.table(spark, sf, "orders")
    per = (o.groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("value")))
    out = CP.paired(per, StudyDesign("o_orderpriority", ("1-URGENT", "5-LOW"), paired_col="o_custkey"), [])
    return _test_out(out, [])


@query
def q_lineitem_densest_window(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    d = C.densest_interval(li, ["l_returnflag"], "l_quantity", 10)
    return d.select("l_returnflag", r6("lo"), r6("hi"), "cover", r6("center"), "n", r6("vmin"), r6("vmax"))


@query
def q_lineitem_densest_price(spark, sf):
    # three keys of many distinct values: each is spread over 32 ranges
    li = FX.table(spark, sf, "lineitem")
    d = C.densest_interval(li, ["l_returnflag"], "l_extendedprice", 1000, ranges=32)
    return d.select("l_returnflag", r6("lo"), r6("hi"), "cover", r6("center"), "n", r6("vmin"), r6("vmax"))


# ------------------------------------------- chunked plan, same oracles
@query
def q_motion_chunked(spark, sf):
    m = fixture_behavior(spark, sf, **CHUNKS).motion
    return m.select(S, t_ms(), "id", r6("time0"), r6("x"), r6("y"))


@query
def q_motion_clean_chunked(spark, sf):
    m = fixture_behavior(spark, sf, CLEAN_ALL, **CHUNKS).motion
    return m.select(S, t_ms(), "id", r6("time0"), r6("x"), r6("y"), r6("move"),
                    r6("roll_r"), r6("roll_f"))


@query
def q_roll_move_chunked(spark, sf):
    m = fixture_behavior(spark, sf, **CHUNKS).motion
    return m.select(S, t_ms(), "id", r6("roll_r"), r6("roll_f"))


@query
def q_contact_bouts_chunked(spark, sf):
    bo = fixture_behavior(spark, sf, **CHUNKS).bouts(FIXTURE_SWEEP.thresholds)
    return bo.select(S, r6("threshold"), t_ms(), "ida", "idb",
                     F.col("nearing_event").cast("int").alias("nearing_event"),
                     "moving_r_id", "moving_f_id", "approach_id", "depart_id", r6("duration"))


@query
def q_sweep_long_chunked(spark, sf):
    return long_out(fixture_long(spark, sf, **CHUNKS), INFO)
