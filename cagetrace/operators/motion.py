"""Per-frame movement and pairwise distance.

``motion`` is long: one row per (session, time, id).  The pair stage
works on a per-frame wide row holding the fixed set of subject ids (the
tracker's marker slots, a parameter): each unordered pair's distance is
computed once and emitted in both directions, exactly the 12 directed
pairs of four subjects.  Rows per frame are bounded by the id list, not
by data.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.functions.rolling import leading, strict_sum, trailing

S = "session"
US_PER_MIN = 60_000_000.0


def elapsed_minutes(df: DataFrame, session: str = S) -> DataFrame:
    """time0: minutes since the session's first kept frame."""
    us = F.unix_micros("time")
    return df.withColumn("time0", (us - F.min(us).over(W.partitionBy(session))) / F.lit(US_PER_MIN))


def step_distance(df: DataFrame, session: str = S) -> DataFrame:
    """move: Euclidean step from the previous frame of the same subject."""
    w = W.partitionBy(session, "id").orderBy("time")
    dx = F.col("x") - F.lag("x").over(w)
    dy = F.col("y") - F.lag("y").over(w)
    return df.withColumn("move", F.sqrt(dx * dx + dy * dy))


def roll_move(df: DataFrame, n: int, session: str = S) -> DataFrame:
    """roll_r / roll_f: sum of ``move`` over the n rows ending / starting here.

    Null when the frame is cut off or holds a null (so roll_r is null on
    the first n rows: the first move is null).  Both frames share one
    window spec, so one WindowExec computes them.
    """
    w = W.partitionBy(session, "id").orderBy("time")
    return df.select("*", strict_sum("move", w, trailing(n)).alias("roll_r"),
                     strict_sum("move", w, leading(n)).alias("roll_f"))


MOTION_COLS = ("x", "y", "move", "roll_r", "roll_f")


def wide_frames(motion: DataFrame, ids: tuple[int, ...], cols=MOTION_COLS,
                session: str = S) -> DataFrame:
    """One row per (session, time): id_{k}_{col} for every id and column.

    An aggregation keyed by session first, so it reuses the session
    partitioning of ``motion`` (partial + final in one stage).
    """
    aggs = [F.max(F.when(F.col("id") == k, F.col(c))).alias(f"id_{k}_{c}")
            for k in ids for c in cols]
    return motion.groupBy(session, "time", "time0").agg(*aggs)


def _dist(a: int, b: int):
    dx = F.col(f"id_{a}_x") - F.col(f"id_{b}_x")
    dy = F.col(f"id_{a}_y") - F.col(f"id_{b}_y")
    return F.sqrt(dx * dx + dy * dy)


def pair_rows(wide: DataFrame, ids: tuple[int, ...], with_rolls: bool = True,
              session: str = S) -> DataFrame:
    """Directed pair rows (ida, idb, dist[, roll_r_a/b, roll_f_a/b]) per frame.

    Each unordered pair's distance is computed once and mirrored.
    """
    dists = {(a, b): f"_d_{a}_{b}" for a, b in combinations(ids, 2)}
    w = wide.select(session, "time", "time0", *[
        c for c in wide.columns if c.startswith("id_")
    ], *[_dist(a, b).alias(name) for (a, b), name in dists.items()])

    def entry(a: int, b: int):
        d = dists[(min(a, b), max(a, b))]
        fields = [F.lit(a).alias("ida"), F.lit(b).alias("idb"), F.col(d).alias("dist")]
        if with_rolls:
            fields += [F.col(f"id_{a}_roll_r").alias("roll_r_a"),
                       F.col(f"id_{b}_roll_r").alias("roll_r_b"),
                       F.col(f"id_{a}_roll_f").alias("roll_f_a"),
                       F.col(f"id_{b}_roll_f").alias("roll_f_b")]
        return F.struct(*fields)

    arr = F.array(*[entry(a, b) for a in ids for b in ids if a != b])
    return w.select(session, "time", "time0", F.inline(arr))


def neighbour_distance(wide: DataFrame, ids: tuple[int, ...], session: str = S) -> DataFrame:
    """Per frame and subject: mean and minimum distance to the other subjects.

    Nulls are skipped (mean of what is there; least ignores nulls); both
    are null when no distance is known.  Written as SQL text: one call per
    projection however many subjects there are.
    """
    def dist(a, b):
        dx, dy = f"(id_{a}_x - id_{b}_x)", f"(id_{a}_y - id_{b}_y)"
        return f"sqrt({dx} * {dx} + {dy} * {dy}) AS _d_{a}_{b}"

    w = wide.selectExpr(f"`{session}`", "time", "time0", *[dist(a, b) for a, b in combinations(ids, 2)])

    def entry(a: int) -> str:
        others = [f"_d_{min(a, b)}_{max(a, b)}" for b in ids if b != a]
        total = " + ".join(f"coalesce({o}, 0D)" for o in others)
        cnt = " + ".join(f"CAST({o} IS NOT NULL AS INT)" for o in others)
        mean = f"CASE WHEN ({cnt}) > 0 THEN ({total}) / ({cnt}) END"
        return (f"named_struct('id', {a}, 'mean_dist', {mean}, "
                f"'closest_dist', least({', '.join(others)}))")

    return w.selectExpr(f"`{session}`", "time", "time0",
                        f"inline(array({', '.join(entry(a) for a in ids)}))")
