"""Row-count rolling frames with the reference's null rules.

All frames are ``rowsBetween`` over a window the caller partitions (never
a window without ``partitionBy``).  ``n`` is a number of rows: the
reference uses ``fps`` as a row count everywhere.  Bounded row frames run
inside one WindowExec per spec; cost is n per row.  ``frame_moments`` costs
the same for every n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    lo: int
    hi: int

    @property
    def rows(self) -> int:
        return self.hi - self.lo + 1

    def over(self, w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(self.lo, self.hi)


def trailing(n: int) -> Frame:
    """n rows ending at the current row (right aligned)."""
    return Frame(-(n - 1), 0)


def leading(n: int) -> Frame:
    """n rows starting at the current row (left aligned)."""
    return Frame(0, n - 1)


def centred(n: int) -> Frame:
    """n rows around the current row; even n has one more row after."""
    return Frame(-((n - 1) // 2), n // 2)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: str | Column, w: WindowSpec, frame: Frame) -> Column:
    """Sum that is null when the frame is cut at an edge or holds a null."""
    c = _col(c)
    wf = frame.over(w)
    return F.when(F.count(c).over(wf) == frame.rows, F.sum(c).over(wf))


def edge_null_mean(c: str | Column, w: WindowSpec, frame: Frame) -> Column:
    """Mean of non-null values; null only when the frame is cut off."""
    c = _col(c)
    wf = frame.over(w)
    return F.when(F.count(F.lit(1)).over(wf) == frame.rows, F.avg(c).over(wf))


def edge_null_sd(c: str | Column, w: WindowSpec, frame: Frame) -> Column:
    """Sample sd of non-null values; null when cut off or < 2 values."""
    c = _col(c)
    wf = frame.over(w)
    return F.when(F.count(F.lit(1)).over(wf) == frame.rows, F.stddev_samp(c).over(wf))


def running(w: WindowSpec) -> WindowSpec:
    """Unbounded preceding .. current row: O(n) incremental frame."""
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def _state(value: Column, w: WindowSpec) -> Column:
    """(n, mean, m2) of the known values from the first row of the window to this one."""
    n = F.count(value).over(running(w))
    return F.struct(n.alias("n"), F.coalesce(F.avg(value).over(running(w)), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.var_pop(value).over(running(w)) * n, F.lit(0.0)).alias("m2"))


def frame_moments(df: DataFrame, part: list[str], index: str, value: str, frame: Frame, mean: str, sd: str) -> DataFrame:
    """Adds mean and sample sd of *value* over *frame* at a cost that does not depend on the frame's length.

    ``index`` numbers the rows of a ``part`` without gaps; rows that are dealt by
    ``part`` already are not shuffled again.  Rows lie in blocks
    as long as the frame, so a frame is the end of one block and the start of
    the next: each row gets the moments of its block up to it and from it on,
    and a frame merges one of each.  Moments are only ever added, never
    subtracted, so long series lose no digits.  Nulls are skipped; both results
    are null where the frame is cut off, the sd also with fewer than two values.
    """
    v, i, size = F.col(value), F.col(index), frame.rows
    block = W.partitionBy(*part, "_blk")
    df = df.withColumn("_blk", F.floor(i / size))
    df = df.withColumn("_from", _state(v, block.orderBy(i.desc()))).withColumn("_upto", _state(v, block.orderBy(i)))
    w = W.partitionBy(*part).orderBy(i)
    df = df.withColumns({"_a": F.lag("_from", -frame.lo).over(w), "_b": F.lead("_upto", frame.hi).over(w)})
    a, b = F.col("_a"), F.col("_b")
    whole = (i + frame.lo) % size == 0            # the frame is one block
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + apart * F.try_divide(b["n"], n)).alias("mean"),
                    (a["m2"] + b["m2"] + apart * apart * F.try_divide(a["n"] * b["n"], n)).alias("m2"))
    m = F.when(a.isNotNull() & b.isNotNull(), F.when(whole, a).otherwise(both))
    df = df.withColumn("_m", m)
    return df.withColumns({mean: F.when(F.col("_m.n") > 0, F.col("_m.mean")),
                           sd: F.when(F.col("_m.n") > 1, F.sqrt(F.col("_m.m2") / (F.col("_m.n") - 1)))}) \
        .drop("_blk", "_from", "_upto", "_a", "_b", "_m")
