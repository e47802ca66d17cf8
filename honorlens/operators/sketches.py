"""Mergeable sketch cubes (A1, A3, A12): distinct counts and quantiles that roll up.

Distinct counts and medians can't be added up, so every grouping of a report
is another scan of the fact. A cube of sketches (HyperLogLog for distincts, KLL
for quantiles, both Spark's own) has them once per finest group; any coarser
grouping merges the cube's rows and never reads the fact again. Bounds: the
distinct estimate has a relative standard error of 1.04 / sqrt(2 ** lg_k), the
quantile one of about 1.7 / k ** 0.9 of rank (1.4 % for k = 200).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 200


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(2 ** lg_k)


def rank_error(k: int = KLL_K) -> float:
    """Rank error that a quantile stays within in about 99 of 100 sketches."""
    return 2.296 / k ** 0.9021


def sketch_cube(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = (),
                lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """Rows of each group (``n``), a sketch ``distinct_<c>`` of the values of each column in ``distinct`` and a
    sketch ``values_<c>`` of each in ``quantiles``. Nulls are neither counted nor ranked; null keys form a group.
    A group of hot rows is sketched in the tasks that read it, only sketches are shuffled."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"distinct_{c}") for c in distinct]
    aggs += [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"values_{c}") for c in quantiles]
    return df.groupBy(*keys).agg(*aggs)


def roll_up(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cube by fewer keys (none: one row), by merging sketches."""
    aggs = [F.sum("n").alias("n")]
    aggs += [F.hll_union_agg(c).alias(c) for c in cube.columns if c.startswith("distinct_")]
    aggs += [F.kll_merge_agg_double(c).alias(c) for c in cube.columns if c.startswith("values_")]
    return cube.groupBy(*keys).agg(*aggs)


def estimates(cube: DataFrame, q: float = 0.5) -> DataFrame:
    """Sketches read: ``distinct_<c>`` as a count, ``values_<c>`` as the ``q`` quantile (null without values)."""
    out = []
    for c in cube.columns:
        if c.startswith("distinct_"):
            out.append(F.hll_sketch_estimate(c).alias(c))
        elif c.startswith("values_"):
            some = F.kll_sketch_get_n_double(c) > 0
            out.append(F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(c)), F.lit(q))).alias(c))
        else:
            out.append(F.col(c))
    return cube.select(*out)
