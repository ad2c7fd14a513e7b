"""DuckDB oracle SQL for the queries in ``__spark_entry__``.

Plain SQL over the driver's tables (views ``events``, ``lineitem``,
``orders``, ...), written independently of the Spark code: self-joins
and window functions instead of the Spark plan's wide rows.  Doubles are
rounded to 6 places and integers cast to fixed widths on both sides.
"""

from __future__ import annotations

from cagetrace.params import FIXTURE_CLEAN, FIXTURE_SWEEP
from cagetrace.sources.fixture import FRAMES_SQL, SUBJECTS_SQL

FPS = FIXTURE_CLEAN.fps

# The p value of Student's t as a numeric integral: with t = sqrt(df) * tan(theta) it is
# the integral of cos^(df-1) from atan(|t| / sqrt(df)) to pi/2 over that from 0.
SIMPSON_STEPS = 2000
CAP = 40.0
# Significance labels.
LABELS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def t_two_sided_p_sql(t: str, df: str) -> str:
    n = SIMPSON_STEPS

    def simpson(a: str, b: str) -> str:
        h = f"(({b}) - ({a})) / {float(n)}"
        f = (f"power(greatest(cos(({a}) + i * {h}), 0.0), ({df}) - 1.0)")
        wgt = f"(CASE WHEN i = 0 OR i = {n} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
        return f"(list_sum(list_transform(range({n + 1}), lambda i: {wgt} * {f})) * {h} / 3.0)"

    th = f"atan(abs({t}) / sqrt({df}))"
    cap = f"{CAP} / sqrt({df})"
    num = simpson(th, f"least(pi() / 2, {th} + {cap})")
    den = simpson("0.0", f"least(pi() / 2, {cap})")
    return (f"(CASE WHEN ({t}) IS NOT NULL AND ({df}) IS NOT NULL AND ({df}) > 0 "
            f"THEN least(1.0, {num} / {den}) END)")


def signif_label_sql(p: str) -> str:
    whens = " ".join(f"WHEN {p} < {below} THEN '{label}'" for below, label in LABELS)
    return f"(CASE WHEN {p} IS NULL THEN NULL {whens} ELSE 'NS.' END)"


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def clean_ctes(z: bool = False, cage: bool = False, fps: int = FPS, ragged: bool = False) -> list[str]:
    """CTEs ending in ``mo``: session, ms, time0, id, x, y, move, roll_r, roll_f."""
    c = [f"fx AS (SELECT session_no AS session, frame_no, ms, id, x, y FROM ({FRAMES_SQL}) t0)"]
    if ragged:  # a missing row is a null position; frames without a time or dropped are not there
        c[0] = f"""fx AS (SELECT session_no AS session, frame_no, ms, id,
            CASE WHEN (frame_no * 11 + id) % 29 <> 0 THEN x END AS x, CASE WHEN (frame_no * 11 + id) % 29 <> 0 THEN y END AS y
            FROM ({FRAMES_SQL}) t0 WHERE frame_no % 101 <> 0 AND frame_no % 83 <> 0)"""
    src = "fx"
    if z:
        n = 2 * fps
        lo, hi = (n - 1) // 2, n // 2
        full = f"count(*) OVER wz = {n}"
        c.append(f"""zr AS (SELECT *,
            CASE WHEN {full} THEN avg(x) OVER wz END AS mx, CASE WHEN {full} THEN stddev_samp(x) OVER wz END AS sx,
            CASE WHEN {full} THEN avg(y) OVER wz END AS my, CASE WHEN {full} THEN stddev_samp(y) OVER wz END AS sy
            FROM {src} WINDOW wz AS (PARTITION BY session, id ORDER BY frame_no
                                     ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING))""")
        c.append("zf AS (SELECT *, coalesce(abs(x - mx) > sx * 3.0 OR abs(y - my) > sy * 3.0, false) AS zflag FROM zr)")
        c.append("""zm AS (SELECT session, frame_no, ms, id,
            CASE WHEN NOT bool_or(zflag) OVER (PARTITION BY session, frame_no) THEN x END AS x,
            CASE WHEN NOT bool_or(zflag) OVER (PARTITION BY session, frame_no) THEN y END AS y FROM zf)""")
        src = "zm"
    c.append(f"dd AS (SELECT * FROM {src} QUALIFY frame_no = min(frame_no) OVER (PARTITION BY session, ms))")
    src = "dd"
    if cage:
        c += cage_center_ctes("dd", 380, 225)
        c.append("""cm0 AS (SELECT d.session, d.frame_no, d.ms, d.id,
              CASE WHEN NOT (d.x > cc.cx + 380 / 2 * 1.1 OR d.x < cc.cx - 380 / 2 * 1.1) THEN d.x END AS x,
              CASE WHEN NOT (d.y > cc.cy + 225 / 2 * 1.1 OR d.y < cc.cy - 225 / 2 * 1.1) THEN d.y END AS y
            FROM dd d LEFT JOIN cc ON d.session = cc.session)""")
        c.append("""cm AS (SELECT session, frame_no, ms, id,
              CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS x,
              CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS y FROM cm0)""")
        src = "cm"
    c.append(f"""mt AS (SELECT *, min(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN ms END)
                 OVER (PARTITION BY session, id) AS mintime FROM {src})""")
    c.append("""st AS (SELECT *, max(mintime) OVER (PARTITION BY session) AS start_ms,
                 bool_or(mintime IS NULL) OVER (PARTITION BY session) AS miss FROM mt)""")
    c.append("ix AS (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY ms) AS i FROM st)")
    lp = []
    for a in "xy":
        lp.append(f"""max(CASE WHEN {a} IS NOT NULL THEN i END) OVER wu AS {a}pi, last_value({a} IGNORE NULLS) OVER wu AS {a}pv,
            min(CASE WHEN {a} IS NOT NULL THEN i END) OVER wd AS {a}ni, first_value({a} IGNORE NULLS) OVER wd AS {a}nv,
            count({a}) OVER (PARTITION BY session, id) AS {a}k""")
    c.append(f"""lp AS (SELECT *, {', '.join(lp)} FROM ix
            WINDOW wu AS (PARTITION BY session, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   wd AS (PARTITION BY session, id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")

    def fill(a):
        return (f"CASE WHEN {a} IS NOT NULL THEN {a} WHEN {a}k < 2 THEN NULL WHEN {a}pi IS NULL THEN {a}nv "
                f"WHEN {a}ni IS NULL THEN {a}pv ELSE {a}pv + ({a}nv - {a}pv) * (i - {a}pi) / ({a}ni - {a}pi) END")

    c.append(f"""fl AS (SELECT session, frame_no, ms, id, {fill('x')} AS x, {fill('y')} AS y
            FROM lp WHERE NOT miss AND ms >= start_ms)""")
    c.append("tm AS (SELECT *, (ms - min(ms) OVER (PARTITION BY session)) / 60000.0 AS time0 FROM fl)")
    c.append("""mv AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS move
            FROM tm WINDOW w AS (PARTITION BY session, id ORDER BY ms))""")
    c.append(f"""mo AS (SELECT *,
            CASE WHEN count(move) OVER wr = {fps} THEN sum(move) OVER wr END AS roll_r,
            CASE WHEN count(move) OVER wf = {fps} THEN sum(move) OVER wf END AS roll_f
            FROM mv WINDOW wr AS (PARTITION BY session, id ORDER BY ms ROWS BETWEEN {fps - 1} PRECEDING AND CURRENT ROW),
                           wf AS (PARTITION BY session, id ORDER BY ms ROWS BETWEEN CURRENT ROW AND {fps - 1} FOLLOWING))""")
    return c


def cage_center_ctes(src: str, width: int, height: int) -> list[str]:
    """CTE ``cc``: session, cx, cy, x_cover, y_cover, x_n, y_n, x_min, x_max, y_min, y_max."""
    out = []
    for a, wd in (("x", width), ("y", height)):
        out.append(f"h{a} AS (SELECT session, {a} AS v, count(*) AS c FROM {src} WHERE {a} IS NOT NULL GROUP BY session, {a})")
        out.append(f"""v{a} AS (SELECT *, sum(c) OVER w AS cover, max(v) OVER w AS hi FROM h{a}
                WINDOW w AS (PARTITION BY session ORDER BY v RANGE BETWEEN CURRENT ROW AND {wd} FOLLOWING))""")
        out.append(f"""best_{a} AS (SELECT session, arg_max((v + hi) / 2, cover * 1e9 - v) AS c{a}, max(cover) AS {a}_cover,
                sum(c) AS {a}_n, min(v) AS {a}_min, max(v) AS {a}_max FROM v{a} GROUP BY session)""")
    out.append("""cc AS (SELECT coalesce(best_x.session, best_y.session) AS session, cx, cy, x_cover, y_cover,
              x_n, y_n, x_min, x_max, y_min, y_max
            FROM best_x FULL JOIN best_y ON best_x.session = best_y.session)""")
    return out


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


SUBJ = f"sj AS (SELECT session_no AS session, id, marker_id, line, drug, mouse FROM ({SUBJECTS_SQL}) t1)"
INFO_COLS = "marker_id, line, drug, mouse"

WINDOWS = ", ".join(f"({float(w)})" for w in FIXTURE_SWEEP.windows)
WIN = f"wn AS (SELECT CAST(w AS DOUBLE) AS window_min FROM (VALUES {WINDOWS}) v(w))"
ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


oracle("total_activity", with_(clean_ctes() + [SUBJ, WIN, """ta AS (
    SELECT session, id, window_min, coalesce(sum(move), 0) / 1000 AS total_activity
    FROM mo JOIN wn ON time0 < window_min GROUP BY session, id, window_min)"""],
    f"""SELECT ta.session, ta.id, round(window_min, 6) AS window_min, {r6('total_activity', 'total_activity')},
        {INFO_COLS} FROM ta LEFT JOIN sj USING (session, id)"""))

CL = clean_ctes()
SW = FIXTURE_SWEEP
BW = "bw AS (SELECT CAST(b AS INTEGER) AS bin_min FROM (VALUES " + ", ".join(f"({int(w)})" for w in SW.bin_widths) + ") v(b))"
REG = "reg AS (SELECT CAST(a AS INTEGER) AS bin_min, CAST(b AS INTEGER) AS bin FROM (VALUES " + ", ".join(
    f"({int(w)}, {b})" for w in SW.bin_widths for b in SW.regular_bins(int(w))) + ") v(a, b))"
TH = "th AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES " + ", ".join(f"({float(t)})" for t in SW.thresholds) + ") v(t))"
WITHIN = float(SW.bin_within)


def bin_expr(t: str = "time0", w: str = "bin_min") -> str:
    return f"CAST(floor({t} / {w}) * {w} AS INTEGER)"


def grid_ctes(src: str, keys: str, name: str) -> list[str]:
    """Zero-fill grid (R9): items x (observed U regular bins) per table keys."""
    return [f"""{name} AS (SELECT i.*, b.bin FROM (SELECT DISTINCT {keys}, id FROM {src}) i
        JOIN (SELECT DISTINCT {keys}, bin FROM {src}
              UNION SELECT t.*, reg.bin FROM (SELECT DISTINCT {keys} FROM {src}) t JOIN reg USING (bin_min)) b
        USING ({keys}))"""]


PAIRS = """pr AS (SELECT a.session, a.ms, a.time0, a.id AS ida, b.id AS idb,
    sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist,
    a.roll_r AS rra, b.roll_r AS rrb, a.roll_f AS rfa, b.roll_f AS rfb
    FROM mo a JOIN mo b ON a.session = b.session AND a.ms = b.ms AND a.id <> b.id)"""
NEIGH = """nd AS (SELECT session, ms, time0, ida AS id, avg(dist) AS mean_dist, min(dist) AS closest_dist
    FROM pr GROUP BY session, ms, time0, ida)"""
EVENTS = [PAIRS, TH,
          """ne AS (SELECT pr.*, threshold, CASE WHEN dist < threshold THEN 1 WHEN dist >= threshold THEN 0 END AS nearing
              FROM pr CROSS JOIN th)""",
          """ev AS (SELECT *, lag(nearing) OVER (PARTITION BY session, threshold, ida, idb ORDER BY ms) - nearing AS nearing_event
              FROM ne)""",
          """ce AS (SELECT *,
              CASE WHEN rra IS NULL OR rrb IS NULL THEN NULL WHEN rra > rrb THEN ida ELSE idb END AS moving_r_id,
              CASE WHEN rfa IS NULL OR rfb IS NULL THEN NULL WHEN rfa > rfb THEN ida ELSE idb END AS moving_f_id
              FROM ev WHERE nearing_event <> 0)""",
          """cb AS (SELECT *, (lead(ms) OVER w - ms) / 1000.0 AS duration,
              CASE WHEN nearing_event = -1 THEN lead(moving_f_id) OVER w END AS depart_id,
              CASE WHEN nearing_event = 1 THEN lag(moving_r_id) OVER w END AS approach_id
              FROM ce WINDOW w AS (PARTITION BY session, threshold, ida, idb ORDER BY ms))"""]


def inter_aggs(prefix: str) -> str:
    mine = "CASE WHEN moving_r_id = ida THEN 1 WHEN moving_r_id <> ida THEN 0 END"
    other = "CASE WHEN moving_r_id <> ida THEN 1 WHEN moving_r_id = ida THEN 0 END"
    return f"""count(*) AS {prefix}event_count,
        count(*) FILTER (WHERE moving_r_id = ida) AS {prefix}approach_count,
        count(*) FILTER (WHERE moving_r_id <> ida) AS {prefix}receive_count,
        coalesce(sum(duration), 0) AS {prefix}duration,
        coalesce(sum(duration * {mine}), 0) AS {prefix}approach_duration,
        coalesce(sum(duration * {other}), 0) AS {prefix}receive_duration"""


INTER = ["event_count", "approach_count", "receive_count", "duration", "approach_duration", "receive_duration"]


oracle("frames_dedup", with_(CL, "SELECT session, frame_no, ms AS t_ms, id, x, y FROM dd"))
oracle("common_start", with_(CL, """SELECT session, id,
    min(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN ms END) AS first_seen_ms,
    any_value(CASE WHEN NOT miss THEN start_ms END) AS start_ms,
    count(*) FILTER (WHERE NOT miss AND ms >= start_ms) AS kept_rows
    FROM st GROUP BY session, id"""))
oracle("lerp", with_(CL, f"SELECT session, frame_no, ms AS t_ms, id, {r6('x', 'x')}, {r6('y', 'y')} FROM fl"))
oracle("motion", with_(CL, f"SELECT session, ms AS t_ms, id, {r6('time0', 'time0')}, {r6('x', 'x')}, {r6('y', 'y')} FROM mo"))
oracle("step_distance", with_(CL, f"SELECT session, ms AS t_ms, id, {r6('move', 'move')} FROM mo"))
oracle("roll_move", with_(CL, f"SELECT session, ms AS t_ms, id, {r6('roll_r', 'roll_r')}, {r6('roll_f', 'roll_f')} FROM mo"))
oracle("pair_distance", with_(CL + [PAIRS], f"""SELECT session, ms AS t_ms, ida, idb, {r6('time0', 'time0')},
    {r6('dist', 'dist')} FROM pr"""))

ZC = clean_ctes(z=True)
oracle("roll_zscore", with_(ZC, f"""SELECT session, frame_no, id, {r6('mx', 'mean_x')}, {r6('sx', 'sd_x')},
    {r6('my', 'mean_y')}, {r6('sy', 'sd_y')}, zflag AS z_flag FROM zf"""))
oracle("z_mask", with_(ZC, """SELECT session, frame_no, count(*) FILTER (WHERE zflag) AS n_flagged,
    count(x) AS n_removed_x FROM zf GROUP BY session, frame_no HAVING bool_or(zflag)"""))
oracle("cage_center", with_(CL + cage_center_ctes("dd", 380, 225), f"""SELECT cc.session, {r6('cx', 'cx')}, {r6('cy', 'cy')},
    CAST(x_cover AS BIGINT) AS x_cover, CAST(y_cover AS BIGINT) AS y_cover,
    CAST(x_n AS BIGINT) AS x_n, CAST(y_n AS BIGINT) AS y_n,
    {r6('x_min', 'x_min')}, {r6('x_max', 'x_max')}, {r6('y_min', 'y_min')}, {r6('y_max', 'y_max')},
    {r6('x_median', 'x_median')}, {r6('y_median', 'y_median')}
    FROM cc LEFT JOIN (SELECT session, median(x) AS x_median, median(y) AS y_median FROM dd GROUP BY session) md
    ON cc.session = md.session"""))
_PART = "((frame_no * 7919 + id * 104729) % 1000003) / 1048576.0"
oracle("cage_center_real", with_(CL + [f"rv AS (SELECT session, x + {_PART} AS x, y + {_PART} AS y FROM dd)"]
    + cage_center_ctes("rv", 380, 225), f"""SELECT session, {r6('cx', 'cx')}, {r6('cy', 'cy')},
    CAST(x_cover AS BIGINT) AS x_cover, CAST(y_cover AS BIGINT) AS y_cover,
    CAST(x_n AS BIGINT) AS x_n, CAST(y_n AS BIGINT) AS y_n,
    {r6('x_min', 'x_min')}, {r6('x_max', 'x_max')}, {r6('y_min', 'y_min')}, {r6('y_max', 'y_max')} FROM cc"""))
oracle("cage_mask", with_(clean_ctes(cage=True), "SELECT session, frame_no, ms AS t_ms, id, x, y FROM cm"))
oracle("motion_clean", with_(clean_ctes(z=True, cage=True), f"""SELECT session, ms AS t_ms, id,
    {r6('time0', 'time0')}, {r6('x', 'x')}, {r6('y', 'y')}, {r6('move', 'move')},
    {r6('roll_r', 'roll_r')}, {r6('roll_f', 'roll_f')} FROM mo"""))

_wide_cols = ", ".join(f"{r6(f'max(CASE WHEN id = {k} THEN {c} END)', f'id_{k}_{c}')}"
                       for k in FIXTURE_CLEAN.ids for c in ("x", "y", "move"))
oracle("motion_ragged", with_(clean_ctes(z=True, cage=True, ragged=True), f"""SELECT session, ms AS t_ms, id,
    {r6('time0', 'time0')}, {r6('x', 'x')}, {r6('y', 'y')}, {r6('move', 'move')},
    {r6('roll_r', 'roll_r')}, {r6('roll_f', 'roll_f')} FROM mo"""))

_wide_cols = ", ".join(f"{r6(f'max(CASE WHEN id = {k} THEN {c} END)', f'id_{k}_{c}')}"
                       for k in FIXTURE_CLEAN.ids for c in ("x", "y", "move"))
oracle("motion_ragged_chunked", with_(clean_ctes(z=True, cage=True, ragged=True), f"""SELECT session, ms AS t_ms, id,
    {r6('time0', 'time0')}, {r6('x', 'x')}, {r6('y', 'y')}, {r6('move', 'move')},
    {r6('roll_r', 'roll_r')}, {r6('roll_f', 'roll_f')} FROM mo"""))

_wide_cols = ", ".join(f"{r6(f'max(CASE WHEN id = {k} THEN {c} END)', f'id_{k}_{c}')}"
                       for k in FIXTURE_CLEAN.ids for c in ("x", "y", "move"))
oracle("frames_wide", with_(CL, f"SELECT session, ms AS t_ms, {r6('time0', 'time0')}, {_wide_cols} FROM mo GROUP BY session, ms, time0"))
oracle("frames_long", with_(CL, "SELECT session, frame_no, ms AS t_ms, id, x, y FROM fx"))

oracle("bin_activity", with_(CL + [SUBJ, BW, REG, f"""ba AS (SELECT session, id, bin_min, bin,
        coalesce(sum(move), 0) / 1000 AS bin_activity
        FROM (SELECT mo.*, bw.bin_min, {bin_expr()} AS bin FROM mo CROSS JOIN bw WHERE time0 < {WITHIN}) t
        GROUP BY session, id, bin_min, bin)"""] + grid_ctes("ba", "session, bin_min", "g"),
    f"""SELECT g.session, g.id, g.bin_min, g.bin, {r6('coalesce(ba.bin_activity, 0)', 'bin_activity')}, {INFO_COLS}
    FROM g LEFT JOIN ba USING (session, bin_min, id, bin) LEFT JOIN sj USING (session, id)"""))
oracle("total_distance", with_(CL + [SUBJ, WIN, PAIRS, NEIGH, """td AS (SELECT session, id, window_min,
        avg(mean_dist) AS total_mean_dist, avg(closest_dist) AS total_closest_dist
        FROM nd JOIN wn ON time0 < window_min GROUP BY session, id, window_min)"""],
    f"""SELECT td.session, td.id, {r6('window_min', 'window_min')}, {r6('total_mean_dist', 'total_mean_dist')},
    {r6('total_closest_dist', 'total_closest_dist')}, {INFO_COLS} FROM td LEFT JOIN sj USING (session, id)"""))
oracle("bin_distance", with_(CL + [SUBJ, BW, PAIRS, NEIGH, f"""bd AS (SELECT session, id, bin_min, bin,
        avg(mean_dist) AS bin_mean_dist, avg(closest_dist) AS bin_closest_dist
        FROM (SELECT nd.*, bw.bin_min, {bin_expr()} AS bin FROM nd CROSS JOIN bw WHERE time0 < {WITHIN}) t
        GROUP BY session, id, bin_min, bin)"""],
    f"""SELECT bd.session, bd.id, bin_min, bin, {r6('bin_mean_dist', 'bin_mean_dist')},
    {r6('bin_closest_dist', 'bin_closest_dist')}, {INFO_COLS} FROM bd LEFT JOIN sj USING (session, id)"""))

EV = CL + EVENTS
oracle("contact_events", with_(EV, f"""SELECT session, {r6('threshold', 'threshold')}, ms AS t_ms, ida, idb,
    {r6('time0', 'time0')}, {r6('dist', 'dist')}, CAST(nearing AS INTEGER) AS nearing,
    CAST(nearing_event AS INTEGER) AS nearing_event, moving_r_id, moving_f_id
    FROM ce WHERE threshold = {float(SW.thresholds[0])}"""))
oracle("contact_bouts", with_(EV, f"""SELECT session, {r6('threshold', 'threshold')}, ms AS t_ms, ida, idb,
    CAST(nearing_event AS INTEGER) AS nearing_event, moving_r_id, moving_f_id, approach_id, depart_id,
    {r6('duration', 'duration')} FROM cb"""))
_ti_cols = ", ".join(r6(f"total_{f}", f"total_{f}") if "duration" in f else f"CAST(total_{f} AS BIGINT) AS total_{f}"
                     for f in INTER)
oracle("total_interaction", with_(EV + [SUBJ, WIN, f"""ti AS (SELECT session, threshold, ida AS id, window_min,
        {inter_aggs('total_')} FROM cb JOIN wn ON time0 < window_min WHERE nearing_event = -1
        GROUP BY session, threshold, ida, window_min)"""],
    f"""SELECT ti.session, ti.id, {r6('threshold', 'threshold')}, {r6('window_min', 'window_min')}, {_ti_cols},
    {INFO_COLS} FROM ti LEFT JOIN sj USING (session, id)"""))
_cum = ", ".join(f"""CAST(sum(bin_{s}_count) OVER (PARTITION BY session, threshold, bin_min, id ORDER BY bin
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bin_{s}_cumul""" for s in ("event", "approach", "receive"))
_bi_fill = ", ".join(r6(f"coalesce(bi.bin_{f}, 0)", f"bin_{f}") if "duration" in f
                     else f"CAST(coalesce(bi.bin_{f}, 0) AS BIGINT) AS bin_{f}" for f in INTER)
oracle("bin_interaction", with_(EV + [SUBJ, BW, REG, f"""bi AS (SELECT session, threshold, ida AS id, bin_min, bin,
        {inter_aggs('bin_')} FROM (SELECT cb.*, bw.bin_min, {bin_expr()} AS bin FROM cb CROSS JOIN bw
        WHERE nearing_event = -1 AND time0 < {WITHIN}) t GROUP BY session, threshold, ida, bin_min, bin)"""]
    + grid_ctes("bi", "session, threshold, bin_min", "g")
    + [f"bf AS (SELECT g.session, g.threshold, g.bin_min, g.id, g.bin, {_bi_fill} FROM g LEFT JOIN bi USING (session, threshold, bin_min, id, bin))"],
    f"""SELECT bf.session, bf.id, {r6('threshold', 'threshold')}, bin_min, bin, bin_event_count, bin_approach_count,
    bin_receive_count, {_cum}, bin_duration, bin_approach_duration, bin_receive_duration, {INFO_COLS}
    FROM bf LEFT JOIN sj USING (session, id)"""))


# ------------------------------------------------------------ sweep + compare
def measure_ctes(families=("activity", "dist", "inter")) -> list[str]:
    """m_ta, m_ba, m_td, m_bd, m_ti, m_bi measure tables and ``lg`` (long, with facts)."""
    c = CL + [SUBJ, WIN, BW, REG]
    longs = []
    nul_d, nul_i = "CAST(NULL AS DOUBLE)", "CAST(NULL AS INTEGER)"

    def unp(src, family, kind, measures, thr, win, bmin, b):
        for m in measures:
            longs.append(f"""SELECT session, id, '{family}' AS family, '{kind}' AS kind, {thr} AS threshold,
                CAST({win} AS DOUBLE) AS window_min, {bmin} AS bin_min, {b} AS bin, '{m}' AS measure,
                CAST({m} AS DOUBLE) AS value FROM {src}""")

    if "activity" in families:
        c.append("""m_ta AS (SELECT session, id, window_min, coalesce(sum(move), 0) / 1000 AS total_activity
            FROM mo JOIN wn ON time0 < window_min GROUP BY session, id, window_min)""")
        c.append(f"""m_ba0 AS (SELECT session, id, bin_min, bin, coalesce(sum(move), 0) / 1000 AS bin_activity
            FROM (SELECT mo.*, bw.bin_min, {bin_expr()} AS bin FROM mo CROSS JOIN bw WHERE time0 < {WITHIN}) t
            GROUP BY session, id, bin_min, bin)""")
        c += grid_ctes("m_ba0", "session, bin_min", "m_bag")
        c.append("""m_ba AS (SELECT g.session, g.id, g.bin_min, g.bin, coalesce(m_ba0.bin_activity, 0) AS bin_activity
            FROM m_bag g LEFT JOIN m_ba0 USING (session, bin_min, id, bin))""")
        unp("m_ta", "activity", "total", ["total_activity"], nul_d, "window_min", nul_i, nul_i)
        unp("m_ba", "activity", "bin", ["bin_activity"], nul_d, WITHIN, "bin_min", "bin")
    if "dist" in families:
        c += [PAIRS, NEIGH]
        c.append("""m_td AS (SELECT session, id, window_min, avg(mean_dist) AS total_mean_dist,
            avg(closest_dist) AS total_closest_dist FROM nd JOIN wn ON time0 < window_min GROUP BY session, id, window_min)""")
        c.append(f"""m_bd AS (SELECT session, id, bin_min, bin, avg(mean_dist) AS bin_mean_dist, avg(closest_dist) AS bin_closest_dist
            FROM (SELECT nd.*, bw.bin_min, {bin_expr()} AS bin FROM nd CROSS JOIN bw WHERE time0 < {WITHIN}) t
            GROUP BY session, id, bin_min, bin)""")
        unp("m_td", "dist", "total", ["total_mean_dist", "total_closest_dist"], nul_d, "window_min", nul_i, nul_i)
        unp("m_bd", "dist", "bin", ["bin_mean_dist", "bin_closest_dist"], nul_d, WITHIN, "bin_min", "bin")
    if "inter" in families:
        if "dist" not in families:
            c.append(PAIRS)
        c += EVENTS[1:]
        c.append(f"""m_ti AS (SELECT session, threshold, ida AS id, window_min, {inter_aggs('total_')}
            FROM cb JOIN wn ON time0 < window_min WHERE nearing_event = -1 GROUP BY session, threshold, ida, window_min)""")
        c.append(f"""m_bi0 AS (SELECT session, threshold, ida AS id, bin_min, bin, {inter_aggs('bin_')}
            FROM (SELECT cb.*, bw.bin_min, {bin_expr()} AS bin FROM cb CROSS JOIN bw
                  WHERE nearing_event = -1 AND time0 < {WITHIN}) t GROUP BY session, threshold, ida, bin_min, bin)""")
        c += grid_ctes("m_bi0", "session, threshold, bin_min", "m_big")
        fills = ", ".join(f"coalesce(m_bi0.bin_{f}, 0) AS bin_{f}" for f in INTER)
        c.append(f"""m_bi1 AS (SELECT g.session, g.threshold, g.bin_min, g.id, g.bin, {fills}
            FROM m_big g LEFT JOIN m_bi0 USING (session, threshold, bin_min, id, bin))""")
        cum = ", ".join(f"""sum(bin_{s}_count) OVER (PARTITION BY session, threshold, bin_min, id ORDER BY bin
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bin_{s}_cumul""" for s in ("event", "approach", "receive"))
        c.append(f"m_bi AS (SELECT *, {cum} FROM m_bi1)")
        unp("m_ti", "inter", "total", [f"total_{f}" for f in INTER], "threshold", "window_min", nul_i, nul_i)
        bin_m = ([f"bin_{f}" for f in INTER if "count" in f] + [f"bin_{s}_cumul" for s in ("event", "approach", "receive")]
                 + [f"bin_{f}" for f in INTER if "duration" in f])
        unp("m_bi", "inter", "bin", bin_m, "threshold", WITHIN, "bin_min", "bin")
    c.append("lg0 AS (" + "\nUNION ALL\n".join(longs) + ")")
    c.append(f"lg AS (SELECT lg0.*, {INFO_COLS} FROM lg0 LEFT JOIN sj USING (session, id))")
    return c


LONG_SEL = f"""SELECT session, id, family, kind, {r6('threshold', 'threshold')}, {r6('window_min', 'window_min')},
    bin_min, bin, measure, {r6('value', 'value')}"""
oracle("sweep_activity", with_(measure_ctes(("activity",)), LONG_SEL + " FROM lg"))
oracle("sweep_distance", with_(measure_ctes(("dist",)), LONG_SEL + " FROM lg"))
oracle("sweep_interaction", with_(measure_ctes(("inter",)), LONG_SEL + " FROM lg"))
oracle("sweep_long", with_(measure_ctes(), LONG_SEL + f", {INFO_COLS} FROM lg"))


def unpaired_sql(src: str, col: str, a: str, b: str, by: str) -> str:
    """Welch test rows per ``by`` over ``src`` (value, col)."""
    def st(lab, tag):
        f = f"FILTER (WHERE {col} = '{lab}')"
        return f"count(value) {f} AS n_{tag}, avg(value) {f} AS mean_{tag}, var_samp(value) {f} AS var_{tag}"
    return f"""(SELECT {by}, {st(a, 'a')}, {st(b, 'b')} FROM {src}
        WHERE {col} IN ('{a}', '{b}') AND value IS NOT NULL GROUP BY {by})"""


def welch_sql(src: str) -> str:
    return f"""(SELECT *, CASE WHEN ok THEN (mean_a - mean_b) / sqrt(se2) END AS t,
        CASE WHEN ok THEN (se2 * se2) / (qa * qa / (n_a - 1) + qb * qb / (n_b - 1)) END AS df
        FROM (SELECT *, qa + qb AS se2, n_a >= 2 AND n_b >= 2 AND qa + qb > 0 AS ok
              FROM (SELECT *, var_a / n_a AS qa, var_b / n_b AS qb FROM {src}) s0) s1)"""


def paired_sql(src: str, col: str, a: str, b: str, pair: str, by: str) -> str:
    return f"""(SELECT *, CASE WHEN n >= 2 AND sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(n)) END AS t,
        CASE WHEN n >= 2 AND sd_diff > 0 THEN CAST(n - 1 AS DOUBLE) END AS df FROM (
        SELECT {by}, count(CASE WHEN ok THEN va - vb END) AS n,
            count(*) FILTER (WHERE NOT ok AND NOT dup) AS n_unpaired, count(*) FILTER (WHERE dup) AS n_duplicate,
            avg(CASE WHEN ok THEN va END) AS mean_a, avg(CASE WHEN ok THEN vb END) AS mean_b,
            avg(CASE WHEN ok THEN va - vb END) AS mean_diff, stddev_samp(CASE WHEN ok THEN va - vb END) AS sd_diff
        FROM (SELECT *, (ca > 1 OR cb > 1) AS dup,
                     NOT (ca > 1 OR cb > 1) AND va IS NOT NULL AND vb IS NOT NULL AS ok
              FROM (SELECT {by}, {pair}, count(*) FILTER (WHERE {col} = '{a}') AS ca,
                           count(*) FILTER (WHERE {col} = '{b}') AS cb,
                           max(value) FILTER (WHERE {col} = '{a}') AS va, max(value) FILTER (WHERE {col} = '{b}') AS vb
                    FROM {src} WHERE {col} IN ('{a}', '{b}') GROUP BY {by}, {pair}) p0) p1
        GROUP BY {by}) p2)"""


def test_cols(extra_ints=("n_a", "n_b"), dbl=("mean_a", "mean_b", "var_a", "var_b")) -> str:
    p = t_two_sided_p_sql("t", "df")
    ints = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in extra_ints)
    d = ", ".join(r6(c, c) for c in dbl)
    return f"{ints}, {d}, {r6('t', 't')}, {r6('df', 'df')}, {r6(p, 'p')}, {signif_label_sql(p)} AS label"


UA, UB = "A", "B"
TOT_ACT = "(SELECT * FROM lg WHERE measure = 'total_activity')"
TOT_ALL = "(SELECT * FROM lg WHERE kind = 'total')"
PA, PB = "CNO", "SAL"
oracle("compare_unpaired", with_(measure_ctes(("activity",)) + [
    f"ua AS {welch_sql(unpaired_sql(TOT_ACT, 'line', UA, UB, 'measure, window_min'))}"],
    f"SELECT measure, {r6('window_min', 'window_min')}, {test_cols()} FROM ua"))
oracle("compare_paired", with_(measure_ctes(("activity",)) + [
    f"pa AS {paired_sql(TOT_ACT, 'drug', PA, PB, 'mouse', 'measure, window_min')}"],
    f"""SELECT measure, {r6('window_min', 'window_min')},
    {test_cols(('n', 'n_unpaired', 'n_duplicate'), ('mean_a', 'mean_b', 'mean_diff', 'sd_diff'))} FROM pa"""))
oracle("compare_bins", with_(measure_ctes(("activity",)), f"""SELECT measure, bin_min, line AS grp,
    CAST(list_position(['{UA}', '{UB}'], line) AS INTEGER) AS group_ord, bin + bin_min AS bin_end, count(*) AS n,
    {r6('CASE WHEN count(value) = count(*) THEN avg(value) END', 'mean')},
    {r6('CASE WHEN count(value) = count(*) THEN stddev_samp(value) END', 'sd')},
    {r6('CASE WHEN count(value) = count(*) THEN stddev_samp(value) END / sqrt(count(*))', 'se')}
    FROM lg WHERE measure = 'bin_activity' AND line IN ('{UA}', '{UB}') AND bin < {WITHIN}
    GROUP BY measure, bin_min, line, bin + bin_min"""))
_by = "measure, threshold, window_min"
oracle("compare_bins_all", with_(measure_ctes(), f"""SELECT measure, threshold, bin_min, line AS grp,
    CAST(list_position(['{UA}', '{UB}'], line) AS INTEGER) AS group_ord, bin + bin_min AS bin_end, count(*) AS n,
    {r6('CASE WHEN count(value) = count(*) THEN avg(value) END', 'mean')},
    {r6('CASE WHEN count(value) = count(*) THEN stddev_samp(value) END', 'sd')},
    {r6('CASE WHEN count(value) = count(*) THEN stddev_samp(value) END / sqrt(count(*))', 'se')}
    FROM lg WHERE kind = 'bin' AND line IN ('{UA}', '{UB}') AND bin < {WITHIN}
    GROUP BY measure, threshold, bin_min, line, bin + bin_min"""))
oracle("paired_values", with_(measure_ctes(("activity",)), f"""SELECT measure, {r6('window_min', 'window_min')}, mouse,
    {r6("max(CASE WHEN drug = 'CNO' THEN value END)", 'value_CNO')}, {r6("max(CASE WHEN drug = 'SAL' THEN value END)", 'value_SAL')}
    FROM lg WHERE measure = 'total_activity' AND drug IN ('CNO', 'SAL') GROUP BY measure, window_min, mouse"""))
oracle("sweep_two_cameras", with_(clean_ctes() + [SUBJ, WIN, """ta AS (
    SELECT session, id, window_min, coalesce(sum(move), 0) / 1000 AS total_activity
    FROM mo JOIN wn ON time0 < window_min GROUP BY session, id, window_min)""",
    """nm AS (SELECT *, CAST(CAST((session - session % 2) / 2 AS BIGINT) AS VARCHAR) AS nm, CAST(session % 2 + 1 AS VARCHAR) AS cam FROM ta)"""],
    f"""SELECT '/logs/' || nm || '-C' || cam || '.csv' AS recording, nm AS session, cam AS camera, nm.id,
    round(window_min, 6) AS window_min, {r6('total_activity', 'total_activity')}, line, drug
    FROM nm LEFT JOIN sj ON sj.session = nm.session AND sj.id = nm.id"""))
oracle("compare_sweep", with_(measure_ctes() + [
    f"ua AS {welch_sql(unpaired_sql(TOT_ALL, 'line', UA, UB, _by))}",
    f"pa AS {paired_sql(TOT_ALL, 'drug', PA, PB, 'mouse', _by)}",
    f"""tt AS (SELECT 'unpaired' AS design, {_by}, n_a, n_b, mean_a, mean_b, t, df FROM ua
        UNION ALL SELECT 'paired' AS design, {_by}, n AS n_a, n AS n_b, mean_a, mean_b, t, df FROM pa)"""],
    f"SELECT design, measure, {r6('threshold', 'threshold')}, {r6('window_min', 'window_min')}, "
    f"{test_cols(dbl=('mean_a', 'mean_b'))} FROM tt"))


# --------------------------------------------------------------- ingest
SESS = "ss AS (SELECT session, min(ms) AS t0, max(ms) AS t1 FROM fx GROUP BY session)"
KS = "ks AS (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)"
PATH = "'/logs/session_' || CAST(session AS VARCHAR) || '.csv'"
oracle("ingest_metadata", with_(CL[:1] + [SESS], f"""SELECT {PATH} AS path, CAST(session AS VARCHAR) AS session,
    'fixture' AS project, '1A' AS camera_no,
    CASE WHEN session % 7 = 3 THEN NULL ELSE CAST(session AS VARCHAR) END AS analysis_no,
    t0 - t0 % 86400000 AS exp_date_ms, t0 AS start_ms, t1 AS finish_ms FROM ss"""))
oracle("ingest_markers", with_(CL[:1] + [SESS, KS], f"""SELECT {PATH} AS path, k AS id, CAST(k AS VARCHAR) AS marker_id,
    'subject ' || CAST(k AS VARCHAR) AS description FROM ss CROSS JOIN ks WHERE NOT (session % 11 = 5 AND k > 3)"""))
oracle("ingest_frames", with_(CL[:1], """SELECT CAST(session AS VARCHAR) AS session, CAST(15 + frame_no % 500 AS BIGINT) AS frame_no,
    ms AS t_ms, id, x, y FROM fx"""))
oracle("subjects_validated", with_([SUBJ], """SELECT CAST(session AS VARCHAR) AS Session, '1' AS Camera, marker_id AS ID,
    line, drug, CAST(mouse AS VARCHAR) AS mouse FROM sj"""))
oracle("subject_info", with_(CL[:1] + [SESS, KS, SUBJ], f"""SELECT '/logs/session_' || CAST(ss.session AS VARCHAR) || '.csv' AS path, CAST(ss.session AS VARCHAR) AS session,
    '1' AS camera, k AS id, CAST(k AS VARCHAR) AS marker_id, 'subject ' || CAST(k AS VARCHAR) AS description,
    sj.line, sj.drug, CAST(sj.mouse AS VARCHAR) AS mouse
    FROM ss CROSS JOIN ks LEFT JOIN sj ON sj.session = ss.session AND sj.marker_id = CAST(k AS VARCHAR)
    WHERE NOT (ss.session % 11 = 5 AND k > 3)"""))
oracle("check_report", with_(CL[:2] + [SESS, """du AS (SELECT session, count(*) FILTER (WHERE frame_no <> f0) AS n
        FROM (SELECT *, min(frame_no) OVER (PARTITION BY session, ms) AS f0 FROM fx) t GROUP BY session)""",
    """pi AS (SELECT session, id, count(x) AS nx, count(y) AS ny,
        count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS nxy FROM dd GROUP BY session, id)"""],
    f"""SELECT {PATH} AS source, 'metadata_missing_key' AS check_name, 'Analysis No' AS detail, CAST(0 AS BIGINT) AS n
        FROM ss WHERE session % 7 = 3
    UNION ALL SELECT {PATH}, 'marker_count', '4', CAST(3 AS BIGINT) FROM ss WHERE session % 11 = 5
    UNION ALL SELECT CAST(session AS VARCHAR), 'duplicate_time', '', n FROM du WHERE n > 0
    UNION ALL SELECT CAST(session AS VARCHAR), 'sparse_series', 'id=' || CAST(id AS VARCHAR) || ' axis=x', nx FROM pi WHERE nx < 2
    UNION ALL SELECT CAST(session AS VARCHAR), 'sparse_series', 'id=' || CAST(id AS VARCHAR) || ' axis=y', ny FROM pi WHERE ny < 2
    UNION ALL SELECT CAST(session AS VARCHAR), 'subject_never_seen', 'id=' || CAST(id AS VARCHAR), nxy FROM pi WHERE nxy = 0"""))

# -------------------------------------------------------------- inspect
TP, DUR = 3.0, 0.5
SLICE = f"sl AS (SELECT * FROM mo WHERE time0 > {TP - DUR} AND time0 <= {TP})"
oracle("trajectory_slice", with_(CL + cage_center_ctes("mo", 380, 225) + [SLICE], f"""SELECT sl.session, ms AS t_ms, id,
    {r6('time0', 'time0')}, {r6('x', 'x')}, {r6('y', 'y')},
    {r6('arg_max(x, ms) OVER (PARTITION BY sl.session, id)', 'x_last')},
    {r6('arg_max(y, ms) OVER (PARTITION BY sl.session, id)', 'y_last')},
    {r6('cx', 'cx')}, {r6('cy', 'cy')}, {r6('cx - 190', 'box_xmin')}, {r6('cx + 190', 'box_xmax')},
    {r6('cy - 112.5', 'box_ymin')}, {r6('cy + 112.5', 'box_ymax')}
    FROM sl LEFT JOIN cc ON sl.session = cc.session"""))
oracle("trajectory_last", with_(CL + [SLICE], f"""SELECT session, id, max(ms) AS t_ms, {r6('arg_max(x, ms)', 'x_last')},
    {r6('arg_max(y, ms)', 'y_last')}, count(*) AS n_points FROM sl GROUP BY session, id"""))

# ------------------------------------------------------- generic tables
_zn = 2 * FPS
_zlo, _zhi = (_zn - 1) // 2, _zn // 2
oracle("events_roll_zscore", f"""SELECT event_id, event_type, {r6('m', 'roll_mean')}, {r6('s', 'roll_sd')},
    coalesce(abs(value - m) > s * 3.0, false) AS z_flag FROM (
    SELECT *, CASE WHEN count(*) OVER w = {_zn} THEN avg(value) OVER w END AS m,
              CASE WHEN count(*) OVER w = {_zn} THEN stddev_samp(value) OVER w END AS s
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {_zlo} PRECEDING AND {_zhi} FOLLOWING)) t""")
oracle("events_roll_zscore_wide", f"""SELECT event_id, event_type, {r6('m', 'roll_mean')}, {r6('s', 'roll_sd')},
    coalesce(abs(value - m) > s * 3.0, false) AS z_flag FROM (
    SELECT *, CASE WHEN count(*) OVER w = 2000 THEN avg(value) OVER w END AS m,
              CASE WHEN count(*) OVER w = 2000 THEN stddev_samp(value) OVER w END AS s
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND 1000 FOLLOWING)) t""")
oracle("events_lerp", f"""WITH v AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events),
    ix AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM v),
    lp AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER wu AS pi, last_value(x IGNORE NULLS) OVER wu AS pv,
        min(CASE WHEN x IS NOT NULL THEN i END) OVER wd AS ni, first_value(x IGNORE NULLS) OVER wd AS nv,
        count(x) OVER (PARTITION BY event_type) AS k FROM ix
        WINDOW wu AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               wd AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, event_type, {r6('CASE WHEN x IS NOT NULL THEN x WHEN k < 2 THEN NULL WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END', 'value')}
    FROM lp""")
HOURLY = """hr AS (SELECT u.user_id, CAST(h.hour AS INTEGER) AS hour, coalesce(a.total, 0) AS total
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT range AS hour FROM range(24)) h
    LEFT JOIN (SELECT user_id, hour(ts) AS hour, sum(value) AS total FROM events GROUP BY user_id, hour(ts)) a
    ON a.user_id = u.user_id AND a.hour = h.hour)"""
oracle("events_bin_fill", with_([HOURLY], f"SELECT user_id, hour, {r6('total', 'total')} FROM hr"))
oracle("events_cumul", with_([HOURLY], f"""SELECT user_id, hour, {r6('total', 'total')},
    {r6('sum(total) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'cumul')}
    FROM hr"""))
oracle("lineitem_group_ttest", with_([
    f"ua AS {welch_sql(unpaired_sql('(SELECT l_returnflag, 1 AS g, l_extendedprice AS value FROM lineitem)', 'l_returnflag', 'A', 'N', 'g'))}"],
    f"SELECT {test_cols()} FROM ua"))
oracle("orders_paired_ttest", with_([
    "po AS (SELECT o_custkey, o_orderpriority, 1 AS g, avg(o_totalprice) AS value FROM orders GROUP BY o_custkey, o_orderpriority)",
    f"pa AS {paired_sql('po', 'o_orderpriority', '1-URGENT', '5-LOW', 'o_custkey', 'g')}"],
    f"SELECT {test_cols(('n', 'n_unpaired', 'n_duplicate'), ('mean_a', 'mean_b', 'mean_diff', 'sd_diff'))} FROM pa"))
for _n, _v, _w in (("window", "l_quantity", 10), ("price", "l_extendedprice", 1000)):
    oracle(f"lineitem_densest_{_n}", f"""WITH h AS (SELECT l_returnflag, {_v} AS v, count(*) AS c FROM lineitem
        WHERE {_v} IS NOT NULL GROUP BY l_returnflag, {_v}),
    cv AS (SELECT *, sum(c) OVER w AS cover, max(v) OVER w AS hi FROM h
        WINDOW w AS (PARTITION BY l_returnflag ORDER BY v RANGE BETWEEN CURRENT ROW AND {_w} FOLLOWING)),
    b AS (SELECT l_returnflag, arg_max(v, (cover, -v)) AS lo, arg_max(hi, (cover, -v)) AS hi,
        max(cover) AS cover, sum(c) AS n, min(v) AS vmin, max(v) AS vmax FROM cv GROUP BY l_returnflag)
    SELECT l_returnflag, {r6('lo', 'lo')}, {r6('hi', 'hi')}, CAST(cover AS BIGINT) AS cover, {r6('(lo + hi) / 2', 'center')},
        CAST(n AS BIGINT) AS n, {r6('vmin', 'vmin')}, {r6('vmax', 'vmax')} FROM b""")


# the chunked plan answers the same questions: same oracle text
for _n in ("motion", "roll_move", "contact_bouts", "sweep_long", "motion_clean"):
    oracle(f"{_n}_chunked", ORACLE[_n])
