"""Data checks as tables: (source, check_name, detail, n).

The reference asserts and stops; here every violation is a row, so one
job reports all files at once.  ``strict`` callers raise on a non-empty
report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.operators import clean as C
from cagetrace.sources import logs as L

S = "session"
REPORT_COLS = ("source", "check_name", "detail", "n")


def _rows(df: DataFrame, source, check: str, detail, n) -> DataFrame:
    return df.select(F.col(source).cast("string").alias("source"), F.lit(check).alias("check_name"),
                     (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"),
                     n.cast("bigint").alias("n"))


def log_report(lines: DataFrame) -> DataFrame:
    """Metadata keys, marker count, header and ids of each file."""
    return L.violations(lines).select(F.col("path").alias("source"), F.col("check").alias("check_name"), "detail", "n")


def unparsed_times(frames: DataFrame, session: str = S) -> DataFrame:
    """Positions whose frame time did not parse, per recording."""
    bad = frames.groupBy(session).agg(F.count_if(F.col("time").isNull()).alias("n")).filter(F.col("n") > 0)
    return _rows(bad, session, "unparsed_time", "", F.col("n"))


def position_report(frames: DataFrame, session: str = S) -> DataFrame:
    """Per session: rows dropped as duplicate times, sparse series, never-seen subjects.

    - duplicate_time: positions dropped by the time dedup
    - sparse_series: a subject axis with < 2 known values (stays unfilled)
    - subject_never_seen: a subject without a complete position (session dropped)
    - unparsed_time: positions whose frame time did not parse (dropped)
    """
    # rows dropped by the time dedup: two-level aggregation, so a time
    # repeated many times never gathers in one task
    per_frame = frames.groupBy(session, "time", "frame_no").agg(F.count(F.lit(1)).alias("c"))
    per_time = per_frame.groupBy(session, "time").agg(
        F.sum("c").alias("rows"), F.min(F.struct("frame_no", "c"))["c"].alias("kept"))
    dup = (per_time.groupBy(session).agg(F.sum(F.col("rows") - F.col("kept")).alias("n"))
           .filter(F.col("n") > 0))
    d = C.dedup_time(frames, session)
    per_id = d.groupBy(session, "id").agg(
        F.count("x").alias("nx"), F.count("y").alias("ny"),
        F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("nxy"))
    sparse = per_id.select(session, "id", F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("nx").alias("n")),
        F.struct(F.lit("y").alias("axis"), F.col("ny").alias("n"))))).filter(F.col("n") < 2)
    never = per_id.filter(F.col("nxy") == 0)
    return (_rows(dup, session, "duplicate_time", "", F.col("n"))
            .unionByName(unparsed_times(frames, session))
            .unionByName(_rows(sparse, session, "sparse_series",
                               F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(" axis="), F.col("axis")),
                               F.col("n")))
            .unionByName(_rows(never, session, "subject_never_seen",
                               F.concat(F.lit("id="), F.col("id").cast("string")), F.col("nxy"))))


def raise_if_any(report: DataFrame, limit: int = 20) -> None:
    """Strict mode: raise with the first violations (a bounded take)."""
    bad = report.take(limit)
    if bad:
        raise ValueError("check report not empty: " + "; ".join(
            f"{r.source}: {r.check_name} {r.detail} ({r.n})" for r in bad))
