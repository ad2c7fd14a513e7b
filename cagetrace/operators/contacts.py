"""Contact events between subject pairs.

nearing = dist < threshold (1/0, null when dist is null); event = previous
nearing - nearing: -1 approach, +1 depart.  The lag runs over all frames
of a directed pair, before any filter.  Several thresholds are done in one
pass: the previous distance is read once and every threshold's event is
an expression of (previous dist, dist); only rows with an event survive,
so the dense pair table is never multiplied by the threshold count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

S = "session"


def _nearing(d, t):
    return F.when(d < t, F.lit(1)).when(d >= t, F.lit(0))


def _mover(a_roll: str, b_roll: str):
    ra, rb = F.col(a_roll), F.col(b_roll)
    return (F.when(ra.isNull() | rb.isNull(), F.lit(None).cast("int"))
            .when(ra > rb, F.col("ida")).otherwise(F.col("idb")))


def contact_events(pairs: DataFrame, thresholds, session: str = S, part=(),
                   keep: str | None = None) -> DataFrame:
    """Event rows (nearing_event != 0) per threshold with who moved.

    Output: session, threshold, time, time0, ida, idb, dist, nearing,
    nearing_event, moving_r_id (larger trailing move sum before the
    event), moving_f_id (larger leading sum after it); ties go to idb,
    a null sum gives null.  ``part`` adds partition keys (chunks) and
    ``keep`` names a boolean column of rows to emit after the lag (halo
    rows serve as previous frames only).
    """
    w = W.partitionBy(session, *part, "ida", "idb").orderBy("time")
    prev = F.lag("dist").over(w)
    per_t = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 _nearing(F.col("dist"), F.lit(float(t))).alias("nearing"),
                 (_nearing(F.col("_prev"), F.lit(float(t)))
                  - _nearing(F.col("dist"), F.lit(float(t)))).alias("nearing_event"))
        for t in thresholds])
    fired = F.filter(per_t, lambda e: e["nearing_event"] != 0)
    ev = pairs.withColumn("_prev", prev)
    if keep:
        ev = ev.filter(F.col(keep))
    ev = ev.select(session, *part, "time", "time0", "ida", "idb", "dist",
                   "roll_r_a", "roll_r_b", "roll_f_a", "roll_f_b", F.inline(fired))
    return ev.select(session, *part, "threshold", "time", "time0", "ida", "idb", "dist",
                     "nearing", "nearing_event",
                     _mover("roll_r_a", "roll_r_b").alias("moving_r_id"),
                     _mover("roll_f_a", "roll_f_b").alias("moving_f_id"))


def contact_bouts(events: DataFrame, session: str = S) -> DataFrame:
    """Bout attributes on event rows, per directed pair and threshold.

    duration (s) = next event time - this one (null for the last);
    depart_id on approaches = moving_f_id of the next event;
    approach_id on departs = moving_r_id of the previous event.
    Windows over event rows only, which are sparse.
    """
    w = W.partitionBy(session, "threshold", "ida", "idb").orderBy("time")
    us = F.unix_micros("time")
    ev = F.col("nearing_event")
    return (events
            .withColumn("duration", (F.lead(us).over(w) - us) / F.lit(1e6))
            .withColumn("depart_id", F.when(ev == -1, F.lead("moving_f_id").over(w)))
            .withColumn("approach_id", F.when(ev == 1, F.lag("moving_r_id").over(w))))


def _dist(a, b) -> str:
    dx, dy = f"(id_{a}_x - id_{b}_x)", f"(id_{a}_y - id_{b}_y)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def with_crossings(wide: DataFrame, ids, thresholds, session: str = S, part=()) -> DataFrame:
    """Per-frame wide rows with ``_ev``: the pairs whose distance crosses a threshold in this frame, null where none does.

    A distance is symmetric, so each unordered pair's previous distance is
    one lag over the frame order (a sort of frames, not of 12x as many
    directed pair rows).  Written as SQL text: one call however many pairs
    and thresholds there are.
    """
    from itertools import combinations
    pairs = list(combinations(sorted(ids), 2))
    order = ", ".join(f"`{c}`" for c in (session, *part))
    f = wide.selectExpr("*", *[f"{_dist(a, b)} AS _d_{a}_{b}" for a, b in pairs])
    f = f.selectExpr("*", *[f"lag(_d_{a}_{b}) OVER (PARTITION BY {order} ORDER BY time) AS _p_{a}_{b}" for a, b in pairs])

    def entry(a, b, t):
        p, d = f"_p_{a}_{b}", f"_d_{a}_{b}"
        return (f"CASE WHEN ({p} < {t}) <> ({d} < {t}) THEN named_struct('threshold', {t}, 'a', {a}, 'b', {b}, 'dist', {d}, 'nearing', int({d} < {t}), "
                f"'nearing_event', int({p} < {t}) - int({d} < {t}), 'ra', id_{a}_roll_r, 'rb', id_{b}_roll_r, 'fa', id_{a}_roll_f, 'fb', id_{b}_roll_f) END")

    ts = [f"{float(t)!r}D" for t in thresholds]
    hit = " OR ".join(f"(_p_{a}_{b} < {t}) <> (_d_{a}_{b} < {t})" for a, b in pairs for t in ts)
    found = ", ".join(entry(a, b, t) for t in ts for a, b in pairs)
    return f.selectExpr(*[f"`{c}`" for c in wide.columns], f"CASE WHEN {hit} THEN array_compact(array({found})) END AS _ev")


def crossing_events(wide: DataFrame, session: str = S, part=()) -> DataFrame:
    """Event rows, both directions of each entry of ``_ev``; same output as ``contact_events(pair_rows(wide))``."""
    keys = [f"`{c}`" for c in (session, *part)]

    def mover(e, one, other):
        return f"CASE WHEN {e}a IS NULL OR {e}b IS NULL THEN CAST(NULL AS INT) WHEN {e}{one} > {e}{other} THEN {one} ELSE {other} END"

    both = ", ".join(f"named_struct('ida', {x}, 'idb', {y}, 'moving_r_id', {mover('r', x, y)}, 'moving_f_id', {mover('f', x, y)})" for x, y in ("ab", "ba"))
    ev = wide.filter("_ev IS NOT NULL").selectExpr(*keys, "time", "time0", "inline(_ev)")
    ev = ev.selectExpr(*keys, "threshold", "time", "time0", "dist", "nearing", "nearing_event", f"inline(array({both}))")
    return ev.select(session, *part, "threshold", "time", "time0", "ida", "idb", "dist", "nearing", "nearing_event", "moving_r_id", "moving_f_id")


def contact_events_wide(wide: DataFrame, ids, thresholds, session: str = S, part=(),
                        keep: str | None = None) -> DataFrame:
    """``contact_events`` straight from per-frame wide rows."""
    f = with_crossings(wide, ids, thresholds, session, part)
    return crossing_events(f.filter(F.col(keep)) if keep else f, session, part)
