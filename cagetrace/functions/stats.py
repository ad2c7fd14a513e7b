"""Two-group statistics as native column expressions.

Spark has no Student-t distribution function.  Its two-sided tail is the
regularised incomplete beta function

    p = I_x(df/2, 1/2),   x = df / (df + t^2),

evaluated as a continued fraction by an ``aggregate`` over a ``sequence``: it
stays inside the JVM and runs once per test row.  Where the fraction in x
converges slowly (small t) that of the complement is used, p = 1 - I_{1-x}(1/2, df/2);
the tail itself is never a difference, so tiny p values keep their digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators of the fraction are kept this far from zero
TINY = 1e-300

# Significance labels (p < 0.001, < 0.01, < 0.05, else).
SIGNIF_LEVELS = (("***", 0.001), ("**", 0.01), ("*", 0.05))
NOT_SIGNIF = "NS."


def _away(v: Column) -> Column:
    return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)


def _fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction 1 / (1 + c1 x / (1 + c2 x / ...)) of the incomplete beta function."""
    def coefficient(j):
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        return x * F.when(j % 2 == 0, even).otherwise(odd)

    def step(acc, j):
        # forward evaluation: ratios of successive numerators and of successive denominators
        e = coefficient(j)
        below = 1.0 / _away(1.0 + e * acc["below"])
        above = _away(1.0 + e / acc["above"])
        return F.struct(below.alias("below"), above.alias("above"), (acc["value"] * below * above).alias("value"))

    one = F.lit(1.0)
    start = F.struct(one.alias("below"), F.lit(1 / TINY).alias("above"), one.alias("value"))  # no numerator before the first
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["value"])


def _log_gamma_half(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)): its series in 1/a, 20 units further up, and back by the recurrence."""
    n = 20
    z = a + n
    # Coefficients of the asymptotic series
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda acc, i: acc + F.log1p(0.5 / (a + i)))
    return series - down


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null when t or df is null or df <= 0."""
    a, b, t2 = df / 2, F.lit(0.5), t * t
    x, rest = df / (df + t2), t2 / (df + t2)
    terms = (60 + 8 * F.ceil(F.sqrt(df))).cast("int")
    front = F.exp(-a * F.log1p(t2 / df) + F.log(rest) / 2 + _log_gamma_half(a) - math.lgamma(0.5))
    tail = front * _fraction(a, b, x, terms) / a
    body = front * _fraction(b, a, rest, terms) / b
    near = F.when(x < (a + 1) / (a + b + 2), tail).otherwise(1 - body)
    p = F.when(t2 == 0, 1.0).when(t2 > 1e300, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), near)))
    return F.when(t.isNotNull() & df.isNotNull() & (df > 0), p)


def signif_label(p: Column) -> Column:
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for label, level in SIGNIF_LEVELS:
        out = out.when(p < level, F.lit(label))
    return out.otherwise(F.lit(NOT_SIGNIF))


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column):
    """Welch t and df; null when a group has < 2 values or both variances are 0."""
    a = F.try_divide(v1, n1.cast("double"))
    b = F.try_divide(v2, n2.cast("double"))
    se2 = a + b
    ok = (n1 >= 2) & (n2 >= 2) & (se2 > 0)
    t = F.when(ok, (m1 - m2) / F.sqrt(se2))
    df = F.when(ok, (se2 * se2) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
    return t, df


def paired_t(n: Column, mean_d: Column, sd_d: Column):
    """Paired t on differences; null when n < 2 or sd is 0."""
    ok = (n >= 2) & (sd_d > 0)
    t = F.when(ok, mean_d / (sd_d / F.sqrt(n.cast("double"))))
    df = F.when(ok, (n - 1).cast("double"))
    return t, df
