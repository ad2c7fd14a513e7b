"""Trajectory inspection: a time slice of chosen subjects with the cage box.

Returns the table behind a trajectory drawing: positions in
(time_point - duration, time_point] minutes, each subject's last point in
the slice, and the cage rectangle from the centre estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.operators.clean import cage_center
from cagetrace.session import stage

S = "session"


def trajectory(motion: DataFrame, time_point: float, duration: float, ids,
               width: float = 380.0, height: float = 225.0, session: str = S) -> DataFrame:
    # stored once: the centres need every position, the slice reads a few of them
    motion = stage(motion.select(session, "time", "id", "time0", "x", "y"), "trajectory")
    centre = cage_center(motion, width, height, session).select(session, "cx", "cy")
    t0 = F.col("time0")
    sl = motion.filter(F.col("id").isin(list(ids)) & (t0 > F.lit(time_point - duration))
                       & (t0 <= F.lit(float(time_point))))
    last = F.max_by(F.struct("x", "y"), F.col("time")).over(W.partitionBy(session, "id"))
    sl = sl.withColumn("_last", last)
    return (sl.join(centre, session, "left")
            .select(session, "time", "id", "time0", "x", "y",
                    F.col("_last.x").alias("x_last"), F.col("_last.y").alias("y_last"),
                    "cx", "cy",
                    (F.col("cx") - width / 2).alias("box_xmin"), (F.col("cx") + width / 2).alias("box_xmax"),
                    (F.col("cy") - height / 2).alias("box_ymin"), (F.col("cy") + height / 2).alias("box_ymax")))


def last_points(motion: DataFrame, time_point: float, duration: float, ids,
                session: str = S) -> DataFrame:
    """Per subject: last position in the slice (value at the latest time) and point count."""
    t0 = F.col("time0")
    sl = motion.filter(F.col("id").isin(list(ids)) & (t0 > F.lit(time_point - duration))
                       & (t0 <= F.lit(float(time_point))))
    return (sl.groupBy(session, "id")
            .agg(F.max_by(F.struct("x", "y"), F.col("time")).alias("_l"),
                 F.max("time").alias("time"), F.count(F.lit(1)).alias("n_points"))
            .select(session, "id", "time", F.col("_l.x").alias("x_last"),
                    F.col("_l.y").alias("y_last"), "n_points"))
