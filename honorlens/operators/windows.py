"""Ordered operators: global running totals, ordinals, shares, top-k per group.

A global running total is computed without a single-partition window:
range-partition on the order key and write the result once (so that every
reader sees the same ranges), total each range, prefix-sum those totals (one
row per range, a number set by configuration, not by data), and finish with a
window *partitioned by the range*. Equal keys always land in the same range,
so the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised


def running_total(
    df: DataFrame, order_cols: Sequence[str], value: str | Column, out: str = "cumulative",
    n_parts: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` over the total order ``order_cols``."""
    return running_totals(df, order_cols, {out: value}, n_parts)


def running_totals(df: DataFrame, order_cols: Sequence[str], values: Mapping[str, str | Column],
                   n_parts: int | None = None) -> DataFrame:
    """W1 for several sums over one order: ``values`` maps an output column to what it sums."""
    sums = list(values)
    keys = [F.col(c).asc_nulls_last() for c in order_cols]
    # Without an explicit count AQE sizes the range partitions; it only merges
    # adjacent ones, so partition ids stay in key order. The ranges come from a
    # sample: two plans over the same rows may cut them differently. The rows are
    # therefore written with their range, and both uses read what was written.
    ranged = df.withColumns({f"_v{i}": F.col(v) if isinstance(v, str) else v for i, v in enumerate(values.values())})
    ranged = ranged.repartitionByRange(n_parts, *keys) if n_parts else ranged.repartitionByRange(*keys)
    ranged = materialised(ranged.withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_off{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    def known(i: int) -> Column:
        off = F.col(f"_off{i}")
        return F.when(off.isNull(), F.raise_error(F.lit("a range without its offset"))).otherwise(off)

    return (
        ranged.join(F.broadcast(offsets), "_pid", "left")  # one row per range
        .withColumns({out: known(i) + F.sum(f"_v{i}").over(inside) for i, out in enumerate(sums)})
        .drop("_pid", *[f"_v{i}" for i in range(len(sums))], *[f"_off{i}" for i in range(len(sums))])
    )


def ordinal(df: DataFrame, order_cols: Sequence[str], out: str = "ord", n_parts: int | None = None) -> DataFrame:
    """1-based position in the total order ``order_cols`` (W6, O5), distributed."""
    return running_total(df, order_cols, F.lit(1).cast("long"), out, n_parts)


def share_of_group(df: DataFrame, group: Sequence[str], value: str = "n", out: str = "pct") -> DataFrame:
    """100 · value / sum(value) within its group (partitioned window)."""
    w = Window.partitionBy(*group)
    return df.withColumn(out, F.col(value) / F.sum(value).over(w) * 100)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group by ``order``; ``row_number <= k`` is planned with a
    partial per-task group limit before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Global top-k with its 1-based rank: ``orderBy().limit(k)`` is planned as a
    per-task top-k (TakeOrderedAndProject), and the rank is numbered over the ≤ k
    survivors only."""
    limited = df.orderBy(*order).limit(k)
    return limited.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def lag_windows(df: DataFrame, series: str, t: str, value: str, length: int, out: str = "window") -> DataFrame:
    """For each point the previous ``length`` values of its series, oldest first;
    only points with a full window are kept (N−L samples per series)."""
    w = Window.partitionBy(series).orderBy(t).rowsBetween(-length, -1)
    return df.withColumn(out, F.collect_list(F.col(value)).over(w)).filter(F.size(out) == length)


def zscore(df: DataFrame, series: str, value: str, out: str = "z") -> DataFrame:
    """(v - mean) / population std within a series."""
    w = Window.partitionBy(series)
    return (
        df.withColumn("_mu", F.avg(value).over(w))
        .withColumn("_sd", F.stddev_pop(value).over(w))
        .withColumn(out, F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")))
    )


def distributed_quantile(df: DataFrame, value: str, q: float = 0.5, group_cols: Sequence[str] = (),
                         out: str = "quantile") -> DataFrame:
    """``distributed_quantiles`` for one of them."""
    return distributed_quantiles(df, value, {out: q}, group_cols)


def distributed_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float],
                          group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (Spark's ``percentile``), without
    gathering a group in one task: a (group, value) histogram, the distributed
    running total over it, then for each quantile the one or two ranks that bracket
    q·(n−1). ``quantiles`` maps an output column to its q; all are picked from one
    running total. For a hot group with very many distinct values, where
    ``percentile``'s per-group buffer would have to sit in one task."""
    g = list(group_cols)
    v = F.col(value).cast("double")
    hist = df.filter(v.isNotNull()).groupBy(*g, v.alias("_qv")).agg(F.count(F.lit(1)).alias("_t"))
    ranked = materialised(running_total(hist, [*g, "_qv"], "_t", "_cum"))
    per = ranked.groupBy(*g).agg(F.min(F.col("_cum") - F.col("_t")).alias("_base"), F.sum("_t").alias("_n"))
    if g:
        ranked = ranked.join(per, g)
    else:
        from .groups import with_scalar

        ranked = with_scalar(ranked, per)
    before = F.col("_cum") - F.col("_t") - F.col("_base")  # rows of the group before this value
    upto = F.col("_cum") - F.col("_base")
    picked, wanted, values = [], F.lit(False), []
    for i, (out, q) in enumerate(quantiles.items()):
        pos = F.lit(q) * (F.col("_n") - 1)
        at_lo, at_hi = ((before <= r) & (r < upto) for r in (F.floor(pos), F.ceil(pos)))
        wanted = wanted | at_lo | at_hi
        picked += [F.min(F.when(at_lo, F.col("_qv"))).alias(f"_lo{i}"), F.max(F.when(at_hi, F.col("_qv"))).alias(f"_hi{i}"),
                   F.first(pos - F.floor(pos)).alias(f"_frac{i}")]
        values.append((F.col(f"_lo{i}") + F.col(f"_frac{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(out))
    return ranked.filter(wanted).groupBy(*g).agg(*picked).select(*g, *values)
