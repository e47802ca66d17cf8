"""W statistic of a normality test on a sample (A9, X2), as column expressions.

The sample is put in order by distributed ordinals; the weight of a place
depends on its number and the sample size alone, so the statistic is one
aggregate over the rows. Weights and the normal form of W are those of
Royston's published approximation (Applied Statistics 44, algorithm R94),
which holds for 3 to 5,000 values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from . import groups as G
from .windows import ordinal

# Polynomials (lowest power first) of the published approximation.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SECOND_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_SHIFT = [-2.273, 0.459]
SMALL_MEAN = [0.544, -0.39978, 0.025054, -0.0006714]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]
# Rational approximation of the normal quantile (relative error below 1.2e-9), highest power first.
MIDDLE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
MIDDLE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
TAIL_FROM = 0.02425
SMALLEST, LARGEST = 3, 5000


def _horner(x: Column, highest_first: Sequence[float]) -> Column:
    out = F.lit(float(highest_first[0]))
    for c in highest_first[1:]:
        out = out * x + F.lit(float(c))
    return out


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it (generated code stays small)."""
    return F.transform(F.array(value), body)[0]


def _quantile_of(p: Column) -> Column:
    middle = _bind(p - F.lit(0.5), lambda q: _bind(q * q, lambda r: _horner(r, MIDDLE_TOP) * q / _horner(r, MIDDLE_BOTTOM)))
    # the tails mirror each other: the smaller of p and 1 - p decides
    tail = _bind(F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p))), lambda t: _horner(t, TAIL_TOP) / _horner(t, TAIL_BOTTOM))
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(
        p < TAIL_FROM, tail).when(p > 1 - TAIL_FROM, -tail).otherwise(middle)


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal falls with probability ``p`` (null outside 0 to 1, both excluded)."""
    return _bind(p.cast("double"), _quantile_of)


def w_statistic(sample: DataFrame, value: str) -> DataFrame:
    """One row: ``n``, ``w_statistic``, ``z`` (its normal score), ``p_value`` and ``is_normal`` (p > 0.05).

    Null values are left out. With under 3 or over 5,000 values, or when all are equal, there is no statistic
    (nulls): take a sample first (``groups.sample_rows``). With 3 values there is W but no score, and p comes
    from its closed form."""
    v = F.col(value).cast("double")
    rows = ordinal(sample.select(v.alias("_v")).filter(F.col("_v").isNotNull()), ["_v"], "_i")
    rows = G.with_scalar(rows, rows.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_v").alias("_mu")))
    n = F.col("_n")
    score = lambda i: normal_quantile((i - F.lit(0.375)) / (n + F.lit(0.25)))
    rows = rows.withColumn("_m", score(F.col("_i")))
    last, second = F.col("_i").isin(1) | (F.col("_i") == n), F.col("_i").isin(2) | (F.col("_i") == n - 1)
    # running totals count row by row: equal values still fill every place once
    inner = ~last & ~second
    some = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))
    at = lambda place: F.max(F.when(F.col("_i") == place, F.col("_v")))
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.first("_n").alias("_n"), F.sum(F.col("_m") ** 2).alias("_mm"),
        F.sum((F.col("_v") - F.col("_mu")) ** 2).alias("_ss"), some(inner, F.col("_m") * F.col("_v")).alias("_inner"),
        some(second, F.col("_m") * F.col("_v")).alias("_second"),
        (at(n) - at(F.lit(1))).alias("_range"), (at(n - 1) - at(F.lit(2))).alias("_range2"))
    poly = lambda x, c: _bind(x, lambda bound: _horner(bound, c[::-1]))
    one = one.withColumns({"_m1": score(n), "_m2": score(n - 1)})
    m_last, m_second = F.col("_m1"), F.col("_m2")
    root = F.lit(1.0) / F.sqrt(n)
    one = one.withColumns({
        "_a1": F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(m_last / F.sqrt("_mm") + poly(root, LAST_WEIGHT)),
        "_a2": m_second / F.sqrt("_mm") + poly(root, SECOND_WEIGHT)})
    a_last, a_second = F.col("_a1"), F.col("_a2")
    wide = n > 5
    phi = F.when(wide, (F.col("_mm") - 2 * m_last ** 2 - 2 * m_second ** 2) / (1 - 2 * a_last ** 2 - 2 * a_second ** 2)).otherwise(
        (F.col("_mm") - 2 * m_last ** 2) / (1 - 2 * a_last ** 2))
    middle = F.when(n == 3, 0.0).when(wide, F.col("_inner") / F.sqrt(phi)).otherwise((F.col("_inner") + F.col("_second")) / F.sqrt(phi))
    top = a_last * F.col("_range") + F.when(wide, a_second * F.col("_range2")).otherwise(0.0) + middle
    usable = n.between(SMALLEST, LARGEST) & (F.col("_ss") > 0)
    w = F.when(usable, F.least(top ** 2 / F.col("_ss"), F.lit(1.0)))
    one = one.select("n", "_n", w.alias("w_statistic"))
    rest, ln = F.log(F.lit(1.0) - F.col("w_statistic")), F.log(n)
    small = (-F.log(poly(n, SMALL_SHIFT) - rest) - poly(n, SMALL_MEAN)) / F.exp(poly(n, SMALL_LOG_SD))
    large = (rest - poly(ln, LARGE_MEAN)) / F.exp(poly(ln, LARGE_LOG_SD))
    z = F.when(n >= 12, large).when(n > 3, small)
    one = one.withColumn("z", z)
    # normal_p is the two-sided tail; the test is one-sided (a small W, a large score, speaks against normality)
    two = tails.normal_p(F.coalesce(F.col("z"), F.lit(0.0)))
    three = F.greatest(F.lit(0.0), F.lit(1.909859) * (F.asin(F.sqrt("w_statistic")) - F.lit(1.047198)))
    p = F.when(n == 3, three).when(F.col("z") >= 0, two / 2).when(F.col("z") < 0, 1 - two / 2)
    return one.withColumn("p_value", p).select("n", "w_statistic", "z", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))
