"""Two-group comparisons of per-subject measures.

Input is a long measure table (keys..., group column, value).  All tests
of a sweep run as one aggregation keyed by (measure, parameters): each
output row is one test, with n, means, variances, t, df, p, label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.functions.stats import paired_t, signif_label, t_two_sided_p, welch
from cagetrace.params import StudyDesign


def _in_design(df: DataFrame, d: StudyDesign, value: str) -> DataFrame:
    return df.filter(F.col(d.comp_col).isin(list(d.comparison)))


def unpaired(df: DataFrame, d: StudyDesign, by: list[str], value: str = "value") -> DataFrame:
    """Welch two-sample t test of comparison[0] - comparison[1] per ``by``.

    Null values are dropped first.
    """
    a, b = d.comparison
    g, v = F.col(d.comp_col), F.col(value)
    x = _in_design(df, d, value).filter(v.isNotNull())

    def stats(label, tag):
        sel = F.when(g == label, v)
        return [F.count(sel).alias(f"n_{tag}"), F.avg(sel).alias(f"mean_{tag}"),
                F.var_samp(sel).alias(f"var_{tag}")]

    agg = x.groupBy(*by).agg(*stats(a, "a"), *stats(b, "b"))
    t, df_ = welch(F.col("n_a"), F.col("mean_a"), F.col("var_a"),
                   F.col("n_b"), F.col("mean_b"), F.col("var_b"))
    out = agg.withColumn("t", t).withColumn("df", df_)
    out = out.withColumn("p", t_two_sided_p(F.col("t"), F.col("df")))
    return out.withColumn("label", signif_label(F.col("p")))


def paired(df: DataFrame, d: StudyDesign, by: list[str], value: str = "value") -> DataFrame:
    """Paired t test: pairs matched by key (``paired_col``), not by position.

    A (pair, condition) seen more than once counts in ``n_duplicate`` and
    its pair is not used; pairs missing a side or holding a null are
    dropped and counted in ``n_unpaired``.
    """
    if not d.paired_col:
        raise ValueError("paired test needs `paired_col`")
    a, b = d.comparison
    g, v = F.col(d.comp_col), F.col(value)
    x = _in_design(df, d, value)
    per_pair = (x.groupBy(*by, d.paired_col)
                .agg(F.count_if(g == a).alias("_ca"), F.count_if(g == b).alias("_cb"),
                     F.max(F.when(g == a, v)).alias("_va"), F.max(F.when(g == b, v)).alias("_vb")))
    dup = (F.col("_ca") > 1) | (F.col("_cb") > 1)
    ok = ~dup & F.col("_va").isNotNull() & F.col("_vb").isNotNull()
    diff = F.when(ok, F.col("_va") - F.col("_vb"))
    agg = per_pair.groupBy(*by).agg(
        F.count(diff).alias("n"),
        F.count_if(~ok & ~dup).alias("n_unpaired"),
        F.count_if(dup).alias("n_duplicate"),
        F.avg(F.when(ok, F.col("_va"))).alias("mean_a"),
        F.avg(F.when(ok, F.col("_vb"))).alias("mean_b"),
        F.avg(diff).alias("mean_diff"),
        F.stddev_samp(diff).alias("sd_diff"))
    t, df_ = paired_t(F.col("n"), F.col("mean_diff"), F.col("sd_diff"))
    out = agg.withColumn("t", t).withColumn("df", df_)
    out = out.withColumn("p", t_two_sided_p(F.col("t"), F.col("df")))
    return out.withColumn("label", signif_label(F.col("p")))


def paired_values(df: DataFrame, d: StudyDesign, by: list[str], value: str = "value") -> DataFrame:
    """Per pair key: the value under each condition (the data behind a paired
    plot), ordered by the run-time columns (by..., pair key)."""
    if not d.paired_col:
        raise ValueError("paired values need `paired_col`")
    a, b = d.comparison
    g, v = F.col(d.comp_col), F.col(value)
    x = _in_design(df, d, value)
    return (x.groupBy(*by, d.paired_col)
            .agg(F.max(F.when(g == a, v)).alias(f"value_{a}"), F.max(F.when(g == b, v)).alias(f"value_{b}"))
            .orderBy(*by, d.paired_col))


def bin_summary(df: DataFrame, d: StudyDesign, by: list[str], plot_within: float,
                value: str = "value") -> DataFrame:
    """Group mean and SEM per bin; bins labelled by their right edge.

    Like the reference, any null in a group makes its mean/sd null.
    ``group_ord`` is the position of the group in ``comparison``.
    """
    g, v = F.col(d.comp_col), F.col(value)
    x = (_in_design(df, d, value).filter(F.col("bin") < F.lit(float(plot_within)))
         .withColumn("bin_end", F.col("bin") + F.col("bin_min")))
    order = F.array_position(F.array(*[F.lit(c) for c in d.comparison]), g).cast("int")
    full = F.count(v) == F.count(F.lit(1))
    agg = (x.groupBy(*by, F.col(d.comp_col).alias("grp"), order.alias("group_ord"), "bin_end")
           .agg(F.count(F.lit(1)).alias("n"),
                F.when(full, F.avg(v)).alias("mean"),
                F.when(full, F.stddev_samp(v)).alias("sd")))
    return agg.withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")))


def measure_tests(spark, out_dir: str, measure: str, d: StudyDesign, **params) -> DataFrame:
    """Tests of one measure read back from the sweep tables, per window (and
    threshold); paired when the design names a pair key, else Welch.
    ``params`` (window_min=..., threshold=...) prune partitions."""
    from cagetrace.plans.sweep import measure_table, read_table
    family, kind = measure_table(measure)
    if kind != "total":
        raise ValueError(f"{measure} is a per-bin measure; use measure_bins")
    df = read_table(spark, out_dir, measure, **params).withColumn("value", F.col(measure).cast("double"))
    by = [c for c in ("threshold", "window_min") if c in df.columns]
    df = df.withColumn("measure", F.lit(measure))
    return (paired if d.paired_col else unpaired)(df, d, ["measure", *by])


def measure_bins(spark, out_dir: str, measure: str, d: StudyDesign, plot_within: float,
                 **params) -> DataFrame:
    """Group mean ± SEM per bin of one per-bin measure read back from the sweep tables."""
    from cagetrace.plans.sweep import measure_table, read_table
    family, kind = measure_table(measure)
    if kind != "bin":
        raise ValueError(f"{measure} is a whole-window measure; use measure_tests")
    df = read_table(spark, out_dir, measure, **params).withColumn("value", F.col(measure).cast("double"))
    by = ["measure", *[c for c in ("threshold", "bin_min") if c in df.columns]]
    return bin_summary(df.withColumn("measure", F.lit(measure)), d, by, plot_within)
