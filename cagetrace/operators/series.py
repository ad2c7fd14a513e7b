"""The cleaning and binning operators on any (partition, order, value) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.functions.rolling import centred, edge_null_mean, edge_null_sd, frame_moments, running


def rolling_zscore(df: DataFrame, part: list[str], order: str, value: str, n: int,
                   z: float) -> DataFrame:
    """Centred rolling mean/sd over n rows (nulls skipped, null at edges) and a z flag."""
    w = W.partitionBy(*part).orderBy(order)
    fr = centred(n)
    m, s = edge_null_mean(value, w, fr), edge_null_sd(value, w, fr)
    out = df.withColumn("roll_mean", m).withColumn("roll_sd", s)
    flag = F.abs(F.col(value) - F.col("roll_mean")) > F.col("roll_sd") * F.lit(z)
    return out.withColumn("z_flag", F.coalesce(flag, F.lit(False)))


def complete_domain(agg: DataFrame, item: list[str], bin_col: str, domain: list[int],
                    fill: dict[str, object]) -> DataFrame:
    """Zero-fill when the bin domain is known and closed (e.g. hour of day).

    Skeleton rows come from each item by ``explode`` (no join of items x
    bins), then one equi-join on (item, bin) brings the values.
    """
    items = agg.select(*item).distinct()
    grid = items.select(*item, F.explode(F.array(*[F.lit(int(b)) for b in domain])).alias(bin_col))
    out = grid.join(agg, item + [bin_col], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def running_total(df: DataFrame, part: list[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(running(W.partitionBy(*part).orderBy(order))))


# ----------------------------------------------- hot partitions: chunked forms
# A partition key with few values (an event type) makes every series
# window one task.  These forms split each series into chunks of an
# order-monotone key (e.g. the day of a timestamp), number rows globally
# from per-chunk counts, and give windows their neighbours through halo
# copies or per-chunk summaries.  Results equal the plain forms.

def with_global_index(df: DataFrame, part: list[str], order: str, chunk: str) -> DataFrame:
    """Adds ``_gi``: 1-based position of the row in its ``part`` series ordered by
    ``order``.  ``chunk`` must be a column that does not decrease with ``order``."""
    key = [*part, chunk]
    f = df.repartition(*key)
    f = f.withColumn("_li", F.row_number().over(W.partitionBy(*key).orderBy(order)))
    counts = f.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*part).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1))
    offs = counts.select(*key, F.coalesce(before, F.lit(0)).alias("_off"))
    return f.join(offs, key).withColumn("_gi", F.col("_off") + F.col("_li")).drop("_li", "_off")


def _halo(df: DataFrame, part: list[str], k_rows: int, halo: int) -> DataFrame:
    if k_rows < halo:
        raise ValueError("chunk rows must be at least the halo size")
    pos, ic = (F.col("_gi") - 1) % k_rows, F.floor((F.col("_gi") - 1) / k_rows)
    copies = F.array(
        F.struct(ic.alias("_ic"), F.lit(True).alias("_own")),
        F.when(pos >= k_rows - halo, F.struct((ic + 1).alias("_ic"), F.lit(False).alias("_own"))),
        F.when((pos < halo) & (ic > 0), F.struct((ic - 1).alias("_ic"), F.lit(False).alias("_own"))))
    return (df.select("*", F.inline(F.filter(copies, lambda c: c.isNotNull())))
            .repartition(*part, "_ic"))


def rolling_zscore_chunked(df: DataFrame, part: list[str], order: str, value: str, n: int, z: float,
                           chunk: str, k_rows: int = 100_000) -> DataFrame:
    """``rolling_zscore`` with each series split into index chunks of ``k_rows``
    plus n/2 + 1 halo rows on each side; the cost of a row does not depend on n."""
    g = _halo(with_global_index(df, part, order, chunk), part, k_rows, n // 2 + 1)
    out = frame_moments(g, [*part, "_ic"], "_gi", value, centred(n), "roll_mean", "roll_sd").filter(F.col("_own"))
    flag = F.abs(F.col(value) - F.col("roll_mean")) > F.col("roll_sd") * F.lit(z)
    return out.withColumn("z_flag", F.coalesce(flag, F.lit(False))).drop("_gi", "_ic", "_own")


def gap_fill_chunked(df: DataFrame, part: list[str], order: str, cols: list[str],
                     chunk: str) -> DataFrame:
    """``clean.gap_fill`` with series split by ``chunk``: previous/next known
    values come from the row's chunk, else from a per-chunk summary."""
    key = [*part, chunk]
    g = with_global_index(df, part, order, chunk)
    w = W.partitionBy(*key).orderBy("_gi")
    i = F.col("_gi")

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(i.alias("i"), F.col(c).alias("v")))

    g = g.select("*", *[F.last(known(c), ignorenulls=True).over(running(w)).alias(f"_lp_{c}") for c in cols])
    wd = W.partitionBy(*key).orderBy(F.col("_gi").desc())
    g = g.select("*", *[F.last(known(c), ignorenulls=True).over(running(wd)).alias(f"_ln_{c}") for c in cols])
    summ = g.groupBy(*key).agg(*[a for c in cols for a in (
        F.min(known(c)).alias(f"_f_{c}"), F.max(known(c)).alias(f"_l_{c}"), F.count(c).alias(f"_k_{c}"))])
    up = W.partitionBy(*part).orderBy(chunk)
    down = W.partitionBy(*part).orderBy(F.col(chunk).desc())
    summ = summ.select(*key, *[a for c in cols for a in (
        F.last(f"_l_{c}", ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, -1)).alias(f"_pp_{c}"),
        F.last(f"_f_{c}", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, -1)).alias(f"_nn_{c}"),
        F.sum(f"_k_{c}").over(W.partitionBy(*part)).alias(f"_kt_{c}"))])
    g = g.join(summ, key)

    def filled(c):
        pv = F.coalesce(F.col(f"_lp_{c}"), F.col(f"_pp_{c}"))
        nv = F.coalesce(F.col(f"_ln_{c}"), F.col(f"_nn_{c}"))
        return (F.when(F.col(c).isNotNull(), F.col(c))
                .when(F.col(f"_kt_{c}") < 2, F.lit(None).cast("double"))
                .when(pv.isNull(), nv["v"])
                .when(nv.isNull(), pv["v"])
                .otherwise(pv["v"] + (nv["v"] - pv["v"]) * (i - pv["i"]) / (nv["i"] - pv["i"])))

    g = g.withColumns({c: filled(c) for c in cols})
    return g.drop("_gi", *[f"_{t}_{c}" for c in cols for t in ("lp", "ln", "pp", "nn", "kt")])
