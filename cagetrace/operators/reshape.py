"""Wide <-> long reshapes of per-frame subject columns.

Long (keys, id, x, y) <-> wide (keys, id_{k}_x, id_{k}_y ...).  The id
list is a parameter (the tracker's marker slots), so both directions are
single projections / one aggregation with a fixed column count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(long: DataFrame, ids, keys: list[str], cols=("x", "y")) -> DataFrame:
    """One row per keys; id_{k}_{c} columns (groupBy + conditional first)."""
    aggs = [F.max(F.when(F.col("id") == k, F.col(c))).alias(f"id_{k}_{c}") for k in ids for c in cols]
    return long.groupBy(*keys).agg(*aggs)


def to_long(wide: DataFrame, ids, keys: list[str], cols=("x", "y")) -> DataFrame:
    """Melt id_{k}_{c} columns to rows (keys, id, c...) in one projection, no shuffle."""
    structs = [F.struct(F.lit(int(k)).alias("id"), *[F.col(f"id_{k}_{c}").alias(c) for c in cols])
               for k in ids]
    return wide.select(*keys, F.inline(F.array(*structs)))


def unpivot_measures(df: DataFrame, keys: list[str], measures: list[str],
                     name: str = "measure", value: str = "value") -> DataFrame:
    """Measure columns -> (measure, value) rows, all cast to double (one projection)."""
    arr = ", ".join(f"named_struct('{name}', '{m}', '{value}', CAST(`{m}` AS DOUBLE))" for m in measures)
    return df.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({arr}))")
