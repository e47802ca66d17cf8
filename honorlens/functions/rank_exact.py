"""A5: exact p-values of the rank-sum test for samples without ties.

Without ties every order of the n1 + n2 values is as likely as any other, so U has the
distribution of the sum of a partition into at most m parts of at most n each (m the smaller
sample, n the larger). Counts of partitions without the bound n are polynomials on each
residue class of lcm(1..m); the bound comes in by inclusion and exclusion over the 2^m sets of
parts. All of it is whole numbers, and the work depends on m alone: n may be of any size.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the smaller sample up to which the exact distribution is used.
SMALL = 8


@lru_cache(maxsize=None)
def _numerator(m: int) -> tuple[int, tuple[int, ...]]:
    """L = lcm(1..m) and the numerator of 1 / ((1 - x)(1 - x)(1 - x^2)...(1 - x^m)) over (1 - x^L)^(m + 1)."""
    period = math.lcm(*range(1, m + 1))
    poly = [1]
    for part in (1, *range(1, m + 1)):
        out = [0] * (len(poly) + period - part)
        for i in range(len(out)):  # times (1 + x^part + ... up to x^(period - part))
            out[i] = (out[i - part] if i >= part else 0) + (poly[i] if i < len(poly) else 0) - (poly[i - period] if 0 <= i - period < len(poly) else 0)
        poly = out
    return period, tuple(poly)


def partitions_up_to(t: int, m: int) -> int:
    """Partitions of 0, 1, ... t into at most m parts, all counted together."""
    if t < 0:
        return 0
    period, poly = _numerator(m)
    whole, rest = divmod(t, period)
    return sum(poly[r] * math.comb(whole - q + m, m) for q in range(whole + 1) if (r := rest + q * period) < len(poly))


def lower_tail(k: int, m: int, n: int) -> Fraction:
    """P(U <= k) for samples of m <= n values."""
    sums = [0]  # by subset of the m parts that are too large: what they take away, with the subset's sign
    signs = [1]
    for i in range(1, m + 1):
        sums += [s + n + i for s in sums]
        signs += [-s for s in signs]
    count = sum(sign * partitions_up_to(k - s, m) for s, sign in zip(sums, signs, strict=True) if s <= k)
    return Fraction(count, math.comb(n + m, m))


def two_sided(u: float, n1: int, n2: int) -> float:
    """Twice the smaller tail at U, at most 1. U has to be a whole number (no ties)."""
    m, n = sorted((int(n1), int(n2)))
    k = min(int(u), m * n - int(u))
    return float(min(Fraction(1), 2 * lower_tail(k, m, n)))


@F.pandas_udf(T.DoubleType())
def _exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([two_sided(*row) if not any(pd.isna(x) for x in row) else None for row in zip(u, n1, n2, strict=True)], dtype="float64")


def is_exact(n1: Column, n2: Column, tie_term: Column) -> Column:
    """Whether the exact distribution applies: a sample of 1 to SMALL values, none empty, no ties."""
    return F.coalesce(F.least(n1, n2).between(1, SMALL) & (tie_term == 0), F.lit(False))


def exact_p(u: Column, n1: Column, n2: Column, applies: Column) -> Column:
    """Two-sided exact p where ``applies`` holds, else null. One evaluation a test, never a row of the data."""
    only = lambda c: F.when(applies, c)
    return _exact(only(u).cast("double"), only(n1).cast("double"), only(n2).cast("double"))
