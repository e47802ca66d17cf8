"""Grouped reports: descriptive tables, crosstabs, rankings, facet lists.

Every function takes a DataFrame and column names and returns a DataFrame.
Null keys are dropped before grouping (pandas semantics, N1). All aggregates
are algebraic (partial + final) except the exact median and distinct counts,
which have ``approx=True`` variants for very large groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import non_null_keys


def _median(c: str, approx: bool) -> Column:
    return F.percentile_approx(c, 0.5, 10000) if approx else F.median(c)


def _distinct(c: str, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def rows_count(weight: str | None = None, cond: Column | None = None) -> Column:
    """Row count (optionally only where ``cond``); with ``weight`` each input row
    stands for ``weight`` fact rows (a pre-aggregated input), and the count is
    their sum — 0, not NULL, when nothing matches."""
    if weight is None:
        return F.count(F.lit(1)) if cond is None else F.count(F.when(cond, F.lit(1)))
    w = F.col(weight) if cond is None else F.when(cond, F.col(weight))
    return F.coalesce(F.sum(w), F.lit(0)).cast("long")


def share_true(cond: Column) -> Column:
    """Mean of a boolean where null counts as false; denominator = group size."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def descriptive_by_group(
    df: DataFrame,
    group: str = "category",
    id_col: str = "id",
    value: str = "age_at_award",
    gender: str = "gender",
    female: str = "female",
    lifespan: str = "lifespan",
    approx: bool = False,
    apart: bool = False,
) -> DataFrame:
    """A1: per group count(id), distinct ids, mean/median/std/min/max of value,
    % female, mean lifespan; sorted by count desc (key as tie-breaker).

    ``apart`` reads ``df`` twice and counts the distinct ids for themselves: else Spark
    aggregates all by group and id first, a buffer for the median each."""
    base = non_null_keys(df, [group])
    distinct = [] if apart else [_distinct(id_col, approx).alias("unique_laureates")]
    out = base.groupBy(group).agg(
        F.count(id_col).alias("count"),
        *distinct,
        F.avg(value).alias("avg_age"),
        _median(value, approx).alias("median_age"),
        F.stddev_samp(value).alias("std_age"),
        F.min(value).alias("min_age"),
        F.max(value).alias("max_age"),
        (share_true(F.col(gender) == female) * 100).alias("pct_female"),
        F.avg(lifespan).alias("avg_lifespan"),
    )
    if apart:
        ids = base.select(group, id_col).distinct().groupBy(group).agg(F.count(id_col).alias("unique_laureates"))
        out = out.join(ids, group).select(group, "count", "unique_laureates", *out.columns[2:])
    return out.orderBy(F.desc("count"), F.asc(group))


def crosstab_counts(df: DataFrame, row: str, col: str, values: Sequence[str], weight: str | None = None) -> DataFrame:
    """Wide crosstab with fixed column values, one aggregation pass.

    Conditional counts instead of ``pivot`` keep it to a single partial+final
    aggregate and never need a distinct-values job."""
    base = non_null_keys(df, [row, col])
    aggs = [rows_count(weight, F.col(col) == v).alias(str(v)) for v in values]
    return base.groupBy(row).agg(*aggs)


def gender_by_decade(
    df: DataFrame, row: str = "decade", gender: str = "gender", values: Sequence[str] = ("female", "male"),
    female: str = "female", weight: str | None = None,
) -> DataFrame:
    """A2: decade × gender counts; ``total`` over **all** genders of the row (not only
    the listed ones); ``female_pct`` = female / total · 100. A missing female column is 0."""
    base = non_null_keys(df, [row, gender])
    vals = list(values) if female in values else [female, *values]
    aggs = [rows_count(weight, F.col(gender) == v).alias(v) for v in vals]
    out = base.groupBy(row).agg(*aggs, rows_count(weight).alias("total"))
    return out.withColumn("female_pct", F.col(female) / F.col("total") * 100).orderBy(row)


def top_groups(
    df: DataFrame, key: str = "birth_country", id_col: str = "id", distinct_of: str = "category",
    top_n: int = 20, approx: bool = False, weight: str | None = None,
) -> DataFrame:
    """A3: count(id) and distinct categories per key, top-n by count (key breaks ties)."""
    return (
        non_null_keys(df, [key])
        .groupBy(key)
        .agg(rows_count(weight, F.col(id_col).isNotNull()).alias("count"),
             _distinct(distinct_of, approx).alias("categories"))
        .orderBy(F.desc("count"), F.asc(key))
        .limit(top_n)
    )


def lifespan_by_group(df: DataFrame, group: str = "category", value: str = "lifespan", id_col: str = "id",
                      approx: bool = False) -> DataFrame:
    """Rows with a value: mean, median, count per group; sort by mean desc."""
    base = non_null_keys(df.filter(F.col(value).isNotNull()), [group])
    return (
        base.groupBy(group)
        .agg(F.avg(value).alias("avg_lifespan"), _median(value, approx).alias("median_lifespan"),
             F.count(id_col).alias("count"))
        .orderBy(F.desc("avg_lifespan"), F.asc(group))
    )


def counts_per_bucket(df: DataFrame, row: str = "decade", col: str = "category", values: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """Row × col counts, 0-filled, fixed column order."""
    return crosstab_counts(df, row, col, values, weight).orderBy(row)


def summary_stats(df: DataFrame, id_col: str = "id", is_org: str = "is_org", category: str = "category",
                  year: str = "award_year", country: str = "birth_country", age: str = "age_at_award",
                  gender: str = "gender", female: str = "female") -> DataFrame:
    """One global aggregate pass with conditional aggregates.

    ``persons`` follows ``len(unique())`` (a null id counts as one value, N3);
    the other distinct counts ignore nulls. ``categories`` is the sorted list of
    categories, joined by commas (a category is a label, their number is small)."""
    person = ~F.col(is_org)
    person_null_id = F.max(F.when(person & F.col(id_col).isNull(), F.lit(1)).otherwise(F.lit(0)))
    return df.agg(
        F.count(F.lit(1)).alias("total_prizes"),
        F.count_distinct(id_col).alias("unique_laureates"),
        (F.count_distinct(F.when(person, F.col(id_col))) + person_null_id).alias("persons"),
        F.count_distinct(F.when(F.col(is_org), F.col(id_col))).alias("organizations"),
        F.array_join(F.array_sort(F.collect_set(category)), ", ").alias("categories"),
        F.count_distinct(category).alias("n_categories"),
        F.min(year).alias("year_min"),
        F.max(year).alias("year_max"),
        F.count_distinct(country).alias("countries"),
        F.avg(F.when(person, F.col(age))).alias("avg_age"),
        F.try_divide(F.count(F.when(person & (F.col(gender) == female), F.lit(1))) * 100.0,
                     F.count(F.when(person, F.lit(1)))).alias("female_pct"),  # no persons → NULL
    )


def argmax_group(df: DataFrame, key: str = "birth_country", weight: str | None = None) -> DataFrame:
    """The key with most rows, and its size (key order breaks ties)."""
    return (
        non_null_keys(df, [key]).groupBy(key).agg(rows_count(weight).alias("n"))
        .orderBy(F.desc("n"), F.asc(key)).limit(1)
    )


def extreme_rows(df: DataFrame, value: str = "age_at_award", label: str = "name",
                 tie_cols: Sequence[str] = ("award_year", "id")) -> DataFrame:
    """The row with the smallest and with the largest value (deterministic ties:
    earliest tie column values, then label)."""
    base = df.filter(F.col(value).isNotNull())
    ties = [F.col(c) for c in tie_cols]
    lo = F.struct(F.col(value), *ties, F.col(label))
    hi = F.struct(-F.col(value), *ties, F.col(label))
    return base.agg(
        F.min_by(F.col(label), lo).alias("youngest_name"),
        F.min(value).alias("youngest_age"),
        F.min_by(F.col(label), hi).alias("oldest_name"),
        F.max(value).alias("oldest_age"),
    )


def count_by(df: DataFrame, keys: Sequence[str], name: str = "count", weight: str | None = None) -> DataFrame:
    """Rows per group (``size``), null keys dropped."""
    return non_null_keys(df, keys).groupBy(*keys).agg(rows_count(weight).alias(name))


def repeat_holders(df: DataFrame, keys: Sequence[str] = ("id", "name"), min_count: int = 2,
                   weight: str | None = None) -> DataFrame:
    """Groups with more than one row (HAVING count > 1), most first."""
    return (
        count_by(df, keys, "prizes", weight).filter(F.col("prizes") >= min_count)
        .orderBy(F.desc("prizes"), *[F.asc(k) for k in keys])
    )


def mean_max_by(df: DataFrame, key: str = "award_year", value: str = "prize_amount_adjusted") -> DataFrame:
    """Mean and max per key of the non-null values."""
    return (
        non_null_keys(df.filter(F.col(value).isNotNull()), [key]).groupBy(key)
        .agg(F.avg(value).alias("avg_amount"), F.max(value).alias("max_amount"))
        .orderBy(key)
    )


def mode_by(df: DataFrame, group: str, value: str, name: str | None = None, weight: str | None = None) -> DataFrame:
    """Most frequent value per group; ties → smallest value; nulls ignored.

    Counted first (partial aggregation), then the winner per group is picked
    with ``max_by`` over (count, -value order) — no group is ever collected."""
    name = name or f"top_{value}"
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(rows_count(weight).alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_n"), F.asc(value))
    return (
        counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
        .select(F.col(group), F.col(value).alias(name), F.col("_n").alias(f"{name}_count"))
    )


def sorted_distinct_join(df: DataFrame, group: str, value: str, name: str, sep: str = ", ") -> DataFrame:
    """A20: ', '.join(sorted(unique(values))) per group (low-cardinality value columns)."""
    d = df.filter(F.col(value).isNotNull()).select(group, value).distinct()
    return d.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name))


def first_k_distinct(df: DataFrame, group: str, value: str, name: str, k: int = 5, sep: str = ", ",
                     more: str = "...") -> DataFrame:
    """The first k sorted distinct values per group, '...' when there are more.

    Rank-and-limit first: ``row_number() <= k`` lets Spark insert a partial
    group limit before the shuffle, so a hot group ships at most k names per
    task; the distinct count is a separate partial aggregate."""
    d = df.filter(F.col(value).isNotNull()).select(group, value).distinct()
    w = Window.partitionBy(group).orderBy(F.asc(value))
    top = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    listed = top.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias("_names"))
    n = d.groupBy(group).agg(F.count(F.lit(1)).alias("_nd"))
    return listed.join(n, group).select(
        F.col(group),
        F.concat(F.col("_names"), F.when(F.col("_nd") > k, F.lit(more)).otherwise(F.lit(""))).alias(name),
    )


def with_scalar(df: DataFrame, scalar_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The row becomes an uncorrelated scalar subquery (``DataFrame.scalar()``):
    Spark computes it once and inlines the value into every task — no join, so
    no nested-loop or cross join appears in the plan. All fields travel in one
    struct, so the subquery runs once however many columns are attached."""
    cols = scalar_row.columns
    packed = scalar_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_s")).scalar()
    return df.withColumn("_scalar", packed).withColumns({c: F.col("_scalar")[c] for c in cols}).drop("_scalar")


def share_of_max(df: DataFrame, value: str = "n", name: str = "share") -> DataFrame:
    """Value / global max of the (already aggregated) rows."""
    mx = df.agg(F.max(value).alias("_max"))
    return with_scalar(df, mx).withColumn(name, F.col(value) / F.col("_max"))


def hierarchy_counts(df: DataFrame, levels: Sequence[str] = ("birth_continent", "birth_country", "category"),
                     weight: str | None = None) -> DataFrame:
    """Counts at every prefix of the hierarchy (rollup) with the level id.

    Rows whose first level is null are dropped (as the treemap does)."""
    base = df.filter(F.col(levels[0]).isNotNull())
    return base.rollup(*levels).agg(rows_count(weight).alias("count"), F.grouping_id().cast("int").alias("level_id"))


def facet_values(df: DataFrame, facets: Sequence[str] = ("category", "decade", "birth_country")) -> DataFrame:
    """Sorted distinct values of each facet, as one long (facet, value) table."""
    parts = [
        df.select(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")).filter(F.col(f).isNotNull())
        for f in facets
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("facet", "value")


def delimited_tokens(df: DataFrame, col: str = "nationality", sep: str = ", ") -> DataFrame:
    """Distinct tokens of a delimited string column."""
    return (
        df.filter(F.col(col).isNotNull())
        .select(F.explode(F.split(F.col(col), sep)).alias("token"))
        .filter(F.col("token") != "")
        .distinct()
        .orderBy("token")
    )


def fixed_order(col: str, values: Sequence[str]) -> Column:
    """1-based position of ``col`` in a fixed list (0 when absent)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)).cast("int")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key_cols: Sequence[str] | None = None,
                portable: bool = False) -> DataFrame:
    """Deterministic sample of at most ``n`` rows without replacement:
    the ``n`` smallest hashes of (seed, key). A top-k, so every task keeps only n
    candidates; the limit is the operator itself. ``portable`` takes the MD5 of
    ``seed|key|key...`` (nulls left out), which any SQL engine can repeat."""
    keys = [F.col(c) for c in (key_cols or df.columns)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return df.withColumn("_h", digest if portable else F.xxhash64(F.lit(seed), *keys)).orderBy("_h").limit(n).drop("_h")
