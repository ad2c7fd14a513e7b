"""Subject list (one row per subject and session) and subject info.

The list is a header CSV with ``Session``, ``Camera``, ``ID`` plus free
study columns (strain, drug, pair key ...).  Keys are read as strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cagetrace.params import StudyDesign
from cagetrace.sources import logs as L

KEYS = ("Session", "Camera", "ID")


class DesignError(ValueError):
    pass


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as string (no type guessing)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def check_columns(subjects: DataFrame, design: StudyDesign) -> None:
    """C1/C3 on the list: key columns, comparison column and pair column exist."""
    cols = set(subjects.columns)
    missing = [k for k in KEYS if k not in cols]
    if missing:
        raise DesignError(f"the subject list lacks the key columns {missing}")
    if design.comp_col not in cols:
        raise DesignError(f"the subject list has no comparison column {design.comp_col!r}")
    if design.paired_col and design.paired_col not in cols:
        raise DesignError(f"the subject list has no pair column {design.paired_col!r}")


def comparison_present(subjects: DataFrame, design: StudyDesign) -> DataFrame:
    """C4 as a one-row table: how many of the two comparison values occur."""
    g = F.col(design.comp_col)
    return (subjects.filter(g.isin(list(design.comparison)))
            .agg(F.count_distinct(g).alias("n_present")))


def validated(subjects: DataFrame, design: StudyDesign) -> DataFrame:
    """Keys cast to string, checks C1, C3, C4 raise on violation."""
    check_columns(subjects, design)
    out = subjects.select(*[F.col(k).cast("string").alias(k) for k in KEYS],
                          *[c for c in subjects.columns if c not in KEYS])
    n = comparison_present(out, design).first()["n_present"]
    if n != 2:
        raise DesignError(f"column {design.comp_col!r} of the subject list holds {n} of the two groups {design.comparison}")
    return out


def subject_info(lines: DataFrame, subjects: DataFrame) -> DataFrame:
    """J1: markers of each log, left-joined to the subject list.

    Key: (session name, first character of the camera number, marker id).
    The subject list is small (one row per subject), a broadcast side;
    AQE makes that choice from its measured size.
    """
    meta = L.parse_metadata(lines).select(
        "path", "session", F.substring(F.col("camera_no"), 1, 1).alias("camera"))
    mk = L.parse_markers(lines).join(meta, "path")
    sj = subjects.withColumnRenamed("Session", "session").withColumnRenamed("Camera", "camera") \
        .withColumnRenamed("ID", "marker_id")
    return mk.join(sj, ["session", "camera", "marker_id"], "left")
