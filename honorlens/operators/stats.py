"""Hypothesis tests and distribution statistics (A4-A10, A29, T1 wiring).

Every statistic is a handful of algebraic aggregates, so each test is one or
two shuffles of pre-aggregated rows regardless of the input size. Optional
``group_cols`` run one independent test per group in the same job.
p-values are attached by ``with_p_values`` on the aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rank_exact, tails
from ..functions.scalar import non_null_keys
from . import windows as W
from .groups import rows_count


def _median_of(c: Column, weight: str | None) -> Column:
    """Exact median; with ``weight`` each row counts that many times (Spark's
    ``percentile`` frequency argument, same interpolation as on the expanded rows)."""
    return F.median(c) if weight is None else F.percentile(c, 0.5, F.col(weight).cast("long"))


def _attach(df: DataFrame, per_group: DataFrame, g: list[str]) -> DataFrame:
    """Join per-group results back by the group key; for an ungrouped test the
    one-row result is attached as a scalar subquery (a join on the constant key
    would be folded into a cross join)."""
    if g == ["_g"]:
        from .groups import with_scalar

        return with_scalar(df, per_group.drop("_g"))
    return df.join(per_group, g)


def _keyed(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group_cols:
        return df, list(group_cols)
    return df.withColumn("_g", F.lit(1)), ["_g"]


def chi_squared(df: DataFrame, row: str = "gender", col: str = "category",
                group_cols: Sequence[str] = (), yates: bool = True, weight: str | None = None) -> DataFrame:
    """A4: Pearson χ² test of independence of ``row`` and ``col``.

    Only observed cells are aggregated: an unobserved cell contributes exactly
    its expected count e, so χ² = Σ_obs (o−e)²/e + (N − Σ_obs e). For a 2×2
    table (dof = 1) every |o−e| is equal, so Yates' correction is closed-form:
    χ²_Y = (|d| − min(½, |d|))² · Σ 1/e with Σ 1/e = N·Σ(1/r)·Σ(1/c).
    ``weight`` reads a pre-aggregated input (each row stands for that many rows).
    Output: chi2_statistic, dof, n, n_rows, n_cols, yates_applied."""
    base, g = _keyed(non_null_keys(df, [row, col]), group_cols)
    cells = base.groupBy(*g, row, col).agg(rows_count(weight).cast("double").alias("o"))
    rows = cells.groupBy(*g, row).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(*g, col).agg(F.sum("o").alias("c"))
    rsum = rows.groupBy(*g).agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_rows"),
                                F.sum(1 / F.col("r")).alias("inv_r"))
    csum = cols.groupBy(*g).agg(F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    e = F.col("r") * F.col("c") / F.col("n")
    contrib = (
        _attach(cells.join(rows, [*g, row]).join(cols, [*g, col]), rsum.select(*g, "n"), g)
        .groupBy(*g).agg(F.sum((F.col("o") - e) ** 2 / e).alias("_s"), F.sum(e).alias("_e"))
    )
    out = _attach(_attach(contrib, rsum, g), csum, g)
    raw = F.col("_s") + (F.col("n") - F.col("_e"))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    inv = F.col("n") * F.col("inv_r") * F.col("inv_c")
    d = F.sqrt(F.greatest(raw, F.lit(0.0)) / inv)
    corrected = (d - F.least(F.lit(0.5), d)) ** 2 * inv
    use_yates = (dof == 1) & F.lit(yates)
    res = out.select(
        *[c for c in g if c != "_g"],
        F.when(use_yates, corrected).otherwise(raw).alias("chi2_statistic"),
        dof.cast("long").alias("dof"),
        F.col("n").cast("long").alias("n"),
        F.col("n_rows"), F.col("n_cols"),
        use_yates.alias("yates_applied"),
    )
    return res


def mann_whitney(df: DataFrame, value: str, sample: Column, group_cols: Sequence[str] = (),
                 weight: str | None = None) -> DataFrame:
    """Two-sample rank-sum test of ``value`` between rows where ``sample``
    is true (sample 1) and false (sample 2).

    Mid-ranks come from a histogram of distinct values and a distributed
    running total over them (no global window over rows): a value with t ties
    after ``cum`` smaller values has mid-rank cum + (t+1)/2.
    Output: u_statistic (U of sample 1), u2, n1, n2, tie_term Σ(t³−t), mu,
    sigma, z (continuity-corrected, of max(U1, U2)), median_1, median_2.
    ``weight``: integral row counts of a pre-aggregated input."""
    base = df.filter(F.col(value).isNotNull() & sample.isNotNull()).withColumn("_s1", sample)
    base, g = _keyed(base, group_cols)
    hist = base.groupBy(*g, value).agg(
        rows_count(weight).cast("double").alias("t"),
        rows_count(weight, F.col("_s1")).cast("double").alias("t1"),
    )
    ranked = W.running_totals(hist, [*g, value], {"_cum_incl": "t", "_cum_1": "t1"})
    if group_cols:
        first = ranked.groupBy(*g).agg(F.min(F.col("_cum_incl") - F.col("t")).alias("_base"),
                                       F.min(F.col("_cum_1") - F.col("t1")).alias("_base_1"))
        ranked = ranked.join(first, g).withColumns(
            {"_cum_incl": F.col("_cum_incl") - F.col("_base"), "_cum_1": F.col("_cum_1") - F.col("_base_1")})
    mid = F.col("_cum_incl") - F.col("t") + (F.col("t") + 1) / 2
    agg = ranked.groupBy(*g).agg(
        F.sum(F.col("t1") * mid).alias("r1"),
        F.sum("t1").alias("n1"),
        F.sum("t").alias("nn"),
        F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_term"),
    )
    # exact medians from the same totals: no buffer of values, however many are distinct
    sided = _attach(ranked, agg.select(*g, "n1", "nn"), g)
    covers = lambda upto, own, rank: (upto - own <= rank) & (rank < upto)
    v = F.col(value).cast("double")

    def median(upto: Column, own: Column, n: Column) -> Column:
        low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
        return (F.max(F.when(covers(upto, own, low), v)) + F.max(F.when(covers(upto, own, high), v))) / 2

    meds = sided.groupBy(*g).agg(
        median(F.col("_cum_1"), F.col("t1"), F.col("n1")).alias("median_1"),
        median(F.col("_cum_incl") - F.col("_cum_1"), F.col("t") - F.col("t1"), F.col("nn") - F.col("n1")).alias("median_2"),
    )
    n1, n = F.col("n1"), F.col("nn")
    n2 = n - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    stats = agg.select(
        *g, u1.alias("u_statistic"), (n1 * n2 - u1).alias("u2"), n1.cast("long").alias("n1"),
        n2.cast("long").alias("n2"), "tie_term", mu.alias("mu"), sigma.alias("sigma"),
    ).withColumn("z", F.try_divide(F.greatest("u_statistic", "u2") - F.col("mu") - 0.5, F.col("sigma")))
    out = _attach(stats, meds, g)
    return out.drop("_g") if not group_cols else out


def ols_trend(df: DataFrame, y: str = "age_at_award", x: str = "award_year",
              group_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Simple OLS y ~ x from one pass of regr_* aggregates.

    se(slope) = sqrt((Syy − slope²·Sxx)/(n−2)) / sqrt(Sxx); t = slope / se.
    A constant x gives NULL slope (no error). With ``weight`` (row counts of a
    pre-aggregated input) the sums are centred in a second pass over the small
    input, so no cancellation enters."""
    base = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    base, g = _keyed(base, group_cols)
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    if weight is None:
        agg = base.groupBy(*g).agg(
            F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
            F.regr_r2(yy, xx).alias("r_squared"), F.regr_count(yy, xx).alias("n"),
            F.regr_sxx(yy, xx).alias("_sxx"), F.regr_syy(yy, xx).alias("_syy"),
        )
    else:
        w = F.col(weight).cast("double")
        means = base.groupBy(*g).agg(F.sum(w).alias("n"), (F.sum(w * xx) / F.sum(w)).alias("_mx"),
                                     (F.sum(w * yy) / F.sum(w)).alias("_my"))
        dx, dy = xx - F.col("_mx"), yy - F.col("_my")
        c = _attach(base, means, g).groupBy(*g, "n", "_mx", "_my").agg(
            F.sum(w * dx * dx).alias("_sxx"), F.sum(w * dy * dy).alias("_syy"), F.sum(w * dx * dy).alias("_sxy"))
        slope = F.try_divide(F.col("_sxy"), F.col("_sxx"))
        agg = c.select(*g, slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
                       F.try_divide(F.col("_sxy") ** 2, F.col("_sxx") * F.col("_syy")).alias("r_squared"),
                       "n", "_sxx", "_syy")
    rss = F.greatest(F.col("_syy") - F.col("slope") ** 2 * F.col("_sxx"), F.lit(0.0))
    se = F.try_divide(F.sqrt(F.try_divide(rss, F.col("n") - 2)), F.sqrt(F.col("_sxx")))
    out = agg.select(
        *g, "slope", "intercept", "r_squared",
        F.try_divide(F.col("slope"), se).alias("t_statistic"),
        F.col("n").cast("long").alias("n"), (F.col("n") - 2).cast("long").alias("dof"),
        F.abs(F.col("slope") * 10).alias("slope_per_decade"),
    )
    return out.drop("_g") if not group_cols else out


def predictions(df: DataFrame, fit: DataFrame, x: str = "award_year", y: str = "age_at_award") -> DataFrame:
    """J7 + C16 / O10: fitted value per row, and the distinct (x, ŷ) line sorted by x."""
    from .groups import with_scalar

    pts = with_scalar(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), fit.select("slope", "intercept"))
    return pts.withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(x))


def distribution_stats(df: DataFrame, value: str = "age_at_award", group_cols: Sequence[str] = (),
                       approx: bool = False, weight: str | None = None) -> DataFrame:
    """A8 + A9: mean, median, sample std, bias-corrected skew (G1) and excess
    kurtosis (G2) as pandas computes them, min/max, and a Jarque-Bera normality
    test on all rows (population skew S and excess kurtosis K):
    JB = n/6·(S² + K²/4), p = exp(−JB/2)."""
    base = df.filter(F.col(value).isNotNull())
    base, g = _keyed(base, group_cols)
    v = F.col(value).cast("double")
    if weight is None:
        agg = base.groupBy(*g).agg(
            F.count(F.lit(1)).cast("double").alias("_n"), F.avg(v).alias("mean"),
            (F.percentile_approx(v, 0.5, 10000) if approx else F.median(v)).alias("median"),
            F.stddev_samp(v).alias("std"), F.var_pop(v).alias("_m2"),
            F.skewness(v).alias("_s"), F.kurtosis(v).alias("_k"),
            F.min(value).alias("youngest"), F.max(value).alias("oldest"),
        )
    else:  # pre-aggregated input: two-pass central moments over the (small) weighted rows
        w = F.col(weight).cast("double")
        first = base.groupBy(*g).agg(F.sum(w).alias("_n"), (F.sum(w * v) / F.sum(w)).alias("mean"),
                                     _median_of(F.col(value), weight).alias("median"),
                                     F.min(value).alias("youngest"), F.max(value).alias("oldest"))
        d = v - F.col("mean")
        mom = _attach(base, first, g).groupBy(*g, "_n", "mean", "median", "youngest", "oldest").agg(
            *[(F.sum(w * d ** k) / F.first("_n")).alias(f"_c{k}") for k in (2, 3, 4)])
        c2 = F.col("_c2")
        agg = mom.select(
            *g, "_n", "mean", "median", "youngest", "oldest",
            F.sqrt(F.try_divide(c2 * F.col("_n"), F.col("_n") - 1)).alias("std"), c2.alias("_m2"),
            F.try_divide(F.col("_c3"), c2 ** 1.5).alias("_s"), (F.try_divide(F.col("_c4"), c2 ** 2) - 3).alias("_k"),
        )
    n = F.col("_n")
    s = F.when(F.col("_m2") == 0, F.lit(0.0)).otherwise(F.col("_s"))
    k = F.when(F.col("_m2") == 0, F.lit(0.0)).otherwise(F.col("_k"))
    g1 = F.when(n >= 3, s * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
    jb = n / 6 * (s ** 2 + k ** 2 / 4)
    out = agg.select(
        *g, "mean", "median", "std", g1.alias("skewness"), g2.alias("kurtosis"),
        "youngest", "oldest", n.cast("long").alias("n"),
        s.alias("pop_skewness"), k.alias("pop_excess_kurtosis"), jb.alias("jarque_bera"),
        tails.jarque_bera_p(jb).alias("jarque_bera_p"),
        (tails.jarque_bera_p(jb) > 0.05).alias("is_normal"),
    )
    return out.drop("_g") if not group_cols else out


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: pairwise-complete Pearson correlation of every column pair in one
    aggregate pass, as a long (var_a, var_b, r) table including the diagonal.

    A row is aggregated once a pair, for the pairs of which it has both values
    (pairwise-complete, N5), grouped by pair: three aggregates a pair side by side
    would be too much code to be compiled. ``regr_sxx``/``regr_syy``/``regr_sxy``
    merge stably (Welford), so r = Sxy / sqrt(Sxx · Syy); a constant column gives
    NULL through ``try_divide`` (``corr`` would raise under ANSI, N6), as does a pair
    that no row has. Listed columns that do not exist are skipped (P21)."""
    cols = [c for c in cols if c in df.columns]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "var_a string, var_b string, r double")
    of = [F.struct(F.lit(k).alias("k"), F.col(f"`{cols[i]}`").cast("double").alias("x"), F.col(f"`{cols[j]}`").cast("double").alias("y")) for k, (i, j) in enumerate(pairs)]
    each = df.select(F.inline(F.array(*of))).filter("x IS NOT NULL AND y IS NOT NULL")
    sums = each.groupBy("k").agg(F.regr_sxx("y", "x").alias("xx"), F.regr_syy("y", "x").alias("yy"), F.regr_sxy("y", "x").alias("xy"))
    r = sums.select("k", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))
    by_pair = r.agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("by_pair"))  # one row, as many entries as pairs
    items = []
    for k, (i, j) in enumerate(pairs):
        found = F.try_element_at("by_pair", F.lit(k)).alias("r")
        items += [F.struct(F.lit(cols[x]).alias("var_a"), F.lit(cols[y]).alias("var_b"), found) for x, y in dict.fromkeys([(i, j), (j, i)])]
    return by_pair.select(F.explode(F.array(*items)).alias("_p")).select("_p.var_a", "_p.var_b", "_p.r")


def rank_method() -> Column:
    """How the p-value of a row of ``mann_whitney`` is found: 'exact' where a sample has eight values at
    most and there are no ties, else 'asymptotic'."""
    return F.when(rank_exact.is_exact(F.col("n1"), F.col("n2"), F.col("tie_term")), F.lit("exact")).otherwise(F.lit("asymptotic"))


def rank_p() -> Column:
    """Two-sided p of a row of ``mann_whitney`` by its ``rank_method``."""
    exact = rank_exact.is_exact(F.col("n1"), F.col("n2"), F.col("tie_term"))
    return F.when(exact, rank_exact.exact_p(F.col("u_statistic"), F.col("n1"), F.col("n2"), exact)).otherwise(tails.normal_p(F.col("z")))


def with_p_values(chi: DataFrame | None = None, mw: DataFrame | None = None, ols: DataFrame | None = None,
                  dist: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """One row per test with its statistic and p-value (pandas UDF over the
    aggregated rows), plus ``significant = p < alpha``, and ``method`` (``rank_method``; null but for
    the rank-sum test)."""
    parts = []
    if chi is not None:
        parts.append(chi.select(F.lit("chi_squared").alias("test"), F.col("chi2_statistic").alias("statistic"),
                                F.col("dof").cast("double").alias("dof"),
                                tails.chi2_p(F.col("chi2_statistic"), F.col("dof")).alias("p_value")))
    if mw is not None:
        parts.append(mw.select(F.lit("mann_whitney").alias("test"), F.col("u_statistic").alias("statistic"),
                               F.lit(None).cast("double").alias("dof"), rank_p().alias("p_value"),
                               rank_method().alias("method")))
    if ols is not None:
        parts.append(ols.select(F.lit("ols_slope").alias("test"), F.col("t_statistic").alias("statistic"),
                                F.col("dof").cast("double").alias("dof"),
                                tails.t_p(F.col("t_statistic"), F.col("dof")).alias("p_value")))
    if dist is not None:
        parts.append(dist.select(F.lit("jarque_bera").alias("test"), F.col("jarque_bera").alias("statistic"),
                                 F.lit(2.0).alias("dof"), F.col("jarque_bera_p").alias("p_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if "method" not in out.columns:
        out = out.withColumn("method", F.lit(None).cast("string"))
    cols = ["test", "statistic", "dof", "p_value", "significant", "method"]
    return out.withColumn("significant", F.col("p_value") < alpha).select(cols)
