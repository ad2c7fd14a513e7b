"""Cleaning operators on long positions (session, frame_no, time, id, x, y).

The masks and the gap fill of the pipeline run on wide frames, in
``plans.clean_derive``.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.functions.rolling import running
from cagetrace.session import stage

S = "session"
#: Rows of a histogram that a task takes at most, unless one key has more
HIST_ROWS = 1_000_000


def dedup_time(frames: DataFrame, session: str = S, within_sessions: bool = False) -> DataFrame:
    """Keep, per (session, time), the rows of the first frame in file order.

    Deterministic (unlike ``dropDuplicates``): the smallest ``frame_no``
    wins.  Default: the first frame of each time comes from an aggregation
    (copies collapse map-side) and a semi-join on (session, time,
    frame_no) keeps its rows; the copies of one time have different frame
    numbers, so even a time repeated across a third of the data spreads
    over many tasks.  ``within_sessions``: rows are already clustered by
    session (session plan), so a window over (session, time) needs no shuffle.
    """
    if within_sessions:
        first = F.min("frame_no").over(W.partitionBy(session, "time"))
        return (frames.withColumn("_first", first)
                .filter(F.col("frame_no") == F.col("_first")).drop("_first"))
    firsts = frames.groupBy(session, "time").agg(F.min("frame_no").alias("frame_no"))
    return frames.join(firsts, [session, "time", "frame_no"], "left_semi")


def _cover(hist: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Adds to a value histogram (keys, v, c) the count in [v, v + width], the
    largest value there (``hi``), the running count ``cum`` and the total ``n``.

    One ascending pass in place of a range frame, whose buffer would be
    re-aggregated per row: each value also sends a probe row to v + width,
    which finds there the running count and the last value so far; what
    was counted before v is taken off.  O(n log n) whatever the width.
    """
    w = W.partitionBy(*keys).orderBy("v")
    hist = hist.select(*keys, "v", "c", F.sum("c").over(running(w)).alias("cum"))
    rows = hist.select(*keys, F.inline(F.array(
        F.struct(F.col("v").cast("double").alias("p"), F.lit(0).alias("probe"), "v", "c", "cum"),
        F.struct((F.col("v") + width).cast("double").alias("p"), F.lit(1).alias("probe"), "v", "c", "cum"))))
    w = W.partitionBy(*keys).orderBy("p", "probe")
    own = F.col("probe") == 0
    rows = rows.select("*", F.sum(F.when(own, F.col("c"))).over(running(w)).alias("_upto"),
                       F.last(F.when(own, F.col("v")), ignorenulls=True).over(running(w)).alias("hi"))
    return rows.filter(~own).select(*keys, "v", "c", "cum", (F.col("_upto") - F.col("cum") + F.col("c")).alias("cover"), "hi")


def _cover_ranges(hist: DataFrame, keys: list[str], width: float, ranges: int) -> DataFrame:
    """What ``_cover`` adds, with each key's values spread over *ranges* tasks.

    The bounds are approximate quantiles of the distinct values of all keys,
    so no range of a key holds much more than an even share of all rows.
    Running counts are taken in a range; the counts and the last value of the
    ranges before it come from a table of one row a key and range.  A probe is
    dealt by its own place, v + width, so an interval may end in any range.
    """
    from pyspark.ml.feature import Bucketizer
    hist = stage(hist.withColumn("p", F.col("v").cast("double")), "histogram")
    bounds = sorted(set(hist.approxQuantile("p", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="p", outputCol="_range") if bounds else None
    dealt = lambda df: cut.transform(df) if cut else df.withColumn("_range", F.lit(0.0))

    def earlier(rows, count, value):
        """Count and last value in the ranges before, joined to *rows*."""
        per = rows.groupBy(*keys, "_range").agg(F.sum(count).alias("_c"), F.max(value).alias("_v"))
        w = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        per = per.select(*keys, "_range", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_count0"), F.max("_v").over(w).alias("_last0"))
        per = per.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_range"]})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_range"]]
        return rows.join(per, functools.reduce(operator.and_, same)).select(*rows.columns, "_count0", "_last0")

    w = W.partitionBy(*keys, "_range").orderBy("p")
    hist = earlier(dealt(hist), F.col("c"), F.col("v"))
    hist = hist.select(*keys, "v", "c", "p", (F.sum("c").over(running(w)) + F.col("_count0")).alias("cum"))
    rows = hist.select(*keys, "v", "c", "cum", F.inline(F.array(F.struct("p", F.lit(0).alias("probe")), F.struct((F.col("p") + F.lit(width)).alias("p"), F.lit(1).alias("probe")))))
    own = F.col("probe") == 0
    rows = earlier(dealt(rows), F.when(own, F.col("c")), F.when(own, F.col("v")))
    w = W.partitionBy(*keys, "_range").orderBy("p", "probe")
    rows = rows.select("*", (F.coalesce(F.sum(F.when(own, F.col("c"))).over(running(w)), F.lit(0)) + F.col("_count0")).alias("_upto"),
                       F.coalesce(F.last(F.when(own, F.col("v")), ignorenulls=True).over(running(w)), "_last0").alias("hi"))
    return rows.filter(~own).select(*keys, "v", "c", "cum", (F.col("_upto") - F.col("cum") + F.col("c")).alias("cover"), "hi")


def densest_interval(values: DataFrame, keys: list[str], value: str, width: float, ranges: int = 1) -> DataFrame:
    """Closed interval [lo, lo + width] covering the most values, per key.

    Exact: an optimal interval can always slide right until its left end
    is a data value, so only data values need to be tried as ``lo``.
    Values are first counted per distinct value (a partial aggregation,
    so a hot key never ships its raw rows).  Ties go to the smallest
    ``lo``.  Returns keys, lo, hi (largest covered value), cover,
    center = (lo + hi) / 2 (the middle of all centres with that cover),
    n, vmin, vmax.

    A key's distinct values are one task; with ``ranges`` above 1 they are
    spread over that many, for few keys of very many values (the counts are
    then stored once).  NaN is no value.
    """
    v = F.col(value)
    v = F.when(~F.isnan(v), v) if dict(values.dtypes)[value] in ("double", "float") else v
    hist = (values.withColumn("v", v).filter(F.col("v").isNotNull())
            .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    cov = _cover_ranges(hist, keys, float(width), ranges) if ranges > 1 else _cover(hist, keys, F.lit(float(width)))
    best = F.max(F.struct(F.col("cover"), (-F.col("v")).alias("neg"), F.col("v"), F.col("hi")))
    return (cov.groupBy(*keys)
            .agg(best.alias("b"), F.sum("c").alias("n"), F.min("v").alias("vmin"),
                 F.max("v").alias("vmax"))
            .select(*keys, F.col("b.v").alias("lo"), F.col("b.hi").alias("hi"),
                    F.col("b.cover").alias("cover"),
                    ((F.col("b.v") + F.col("b.hi")) / 2).alias("center"),
                    "n", "vmin", "vmax"))


def axis_summary(frames: DataFrame, widths: dict[str, float], session: str = S) -> DataFrame:
    """Per (session, axis): densest interval of the given width, exact median,
    n, min, max -- all from one histogram of pooled values (x and y together)."""
    vals = frames.select(session, F.inline(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in widths])))
    hist = (vals.filter(F.col("v").isNotNull())
            .groupBy(session, "axis", "v").agg(F.count(F.lit(1)).alias("c")))
    # stored, so that its rows are known: they set the number of tasks, which the setting for shuffles would fix whatever the rows
    hist = stage(hist, "histogram")
    tasks = max(int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hist.count() // HIST_ROWS))
    hist = hist.repartition(tasks, session, "axis")
    width = F.element_at(F.create_map(*[F.lit(x) for a, wd in widths.items() for x in (a, float(wd))]), F.col("axis"))
    cov = _cover(hist, [session, "axis"], width)
    cov = cov.withColumn("n", F.sum("c").over(W.partitionBy(session, "axis")))
    lo_rank = F.floor((F.col("n") + 1) / 2)
    hi_rank = F.floor(F.col("n") / 2) + 1
    below = F.col("cum") - F.col("c")
    best = F.max(F.struct(F.col("cover"), (-F.col("v")).alias("neg"), F.col("v"), F.col("hi")))
    g = cov.groupBy(session, "axis").agg(
        best.alias("b"), F.first("n").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.max(F.when((below < lo_rank) & (F.col("cum") >= lo_rank), F.col("v"))).alias("_m1"),
        F.max(F.when((below < hi_rank) & (F.col("cum") >= hi_rank), F.col("v"))).alias("_m2"))
    return g.select(session, "axis", F.col("b.v").alias("lo"), F.col("b.hi").alias("hi"),
                    F.col("b.cover").alias("cover"), ((F.col("b.v") + F.col("b.hi")) / 2).alias("center"),
                    "n", "vmin", "vmax", ((F.col("_m1") + F.col("_m2")) / 2).alias("median"))


def cage_center(frames: DataFrame, width: float, height: float, session: str = S) -> DataFrame:
    """Cage centre per session: densest interval of pooled x (width) and y (height),
    with the covered counts, n, min, max and median of each axis."""
    s = axis_summary(frames, {"x": width, "y": height}, session)
    cols = {"center": "c{a}", "cover": "{a}_cover", "n": "{a}_n", "vmin": "{a}_min",
            "vmax": "{a}_max", "median": "{a}_median"}
    return s.groupBy(session).agg(*[
        F.max(F.when(F.col("axis") == a, F.col(src))).alias(dst.format(a=a))
        for a in ("x", "y") for src, dst in cols.items()])


def gap_fill(df: DataFrame, part: list[str], order: str, cols: list[str]) -> DataFrame:
    """Linear interpolation by row index within ``part`` ordered by ``order``.

    Leading/trailing gaps take the nearest known value.  A series with
    fewer than two known values keeps them and leaves its gaps null (the
    check report lists it).
    Previous and next known points come from running frames in both
    directions (O(n) each); an unbounded-following frame would be O(n^2).
    """
    base = W.partitionBy(*part)
    up = running(base.orderBy(F.col(order).asc()))
    down = running(base.orderBy(F.col(order).desc()))
    out = df.withColumn("_i", F.row_number().over(base.orderBy(F.col(order).asc())))
    i = F.col("_i")

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(i.alias("i"), F.col(c).alias("v")))

    out = out.select("*", *[F.last(known(c), ignorenulls=True).over(up).alias(f"_p_{c}") for c in cols])
    out = out.select("*", *[F.last(known(c), ignorenulls=True).over(down).alias(f"_n_{c}") for c in cols],
                     *[F.count(c).over(base).alias(f"_k_{c}") for c in cols])
    fills = {}
    for c in cols:
        p, nx, k = F.col(f"_p_{c}"), F.col(f"_n_{c}"), F.col(f"_k_{c}")
        filled = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(k < 2, F.lit(None).cast("double"))
                  .when(p.isNull(), nx["v"])
                  .when(nx.isNull(), p["v"])
                  .otherwise(p["v"] + (nx["v"] - p["v"]) * (i - p["i"]) / (nx["i"] - p["i"])))
        fills[c] = filled
    out = out.withColumns(fills)
    return out.drop("_i", *[f"_{t}_{c}" for c in cols for t in "pnk"])
