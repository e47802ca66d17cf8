"""Registered statistics queries (A4-A10, A29, C16, C17, T1) with DuckDB oracles.

p-values need distribution tails DuckDB lacks, so the oracle-checked queries
carry the statistics; ``hypothesis_tests`` adds the p-values (rows-only check,
values covered by unit tests on hand-computed cases)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import round_doubles
from ..operators import groups as G
from ..operators import normality as N
from ..operators import stats as S
from ..sources.facts import award_facts, persons
from ..sources.tables import read_table
from .oracle_sql import with_fact
from .registry import query

# Fixed values of the binding: the two categories compared by the rank-sum test.
MW_CATEGORY_1, MW_CATEGORY_2 = "1-URGENT", "5-LOW"
NUMERIC_COLUMNS = ["award_year", "age_at_award", "prize_amount", "prize_amount_adjusted", "lifespan"]


def _chi_input(spark, sf_dir):
    """Gender × category only needs order-level attributes: read the order-grain
    fact (lineitem pre-aggregated per order) and count with ``n_items``."""
    from ..sources.facts import order_facts

    return persons(order_facts(spark, sf_dir)).filter(F.col("gender").isin("male", "female"))


def _mw(spark, sf_dir):
    p = persons(award_facts(spark, sf_dir)).filter(F.col("category").isin(MW_CATEGORY_1, MW_CATEGORY_2))
    return S.mann_whitney(p, "age_at_award", F.col("category") == MW_CATEGORY_1)


@query("chi_squared_gender_category", with_fact("""
, b AS (SELECT gender, category FROM persons WHERE gender IN ('male', 'female') AND category IS NOT NULL),
cells AS (SELECT gender, category, count(*) AS o FROM b GROUP BY 1, 2),
r AS (SELECT gender, sum(o) AS r FROM cells GROUP BY 1),
c AS (SELECT category, sum(o) AS c FROM cells GROUP BY 1),
n AS (SELECT sum(o) AS n, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc FROM cells),
grid AS (SELECT r.gender, c.category, r.r, c.c, n.n, n.nr, n.nc FROM r CROSS JOIN c CROSS JOIN n),
e AS (SELECT g.*, coalesce(cells.o, 0) AS o, g.r * g.c / g.n AS e
      FROM grid g LEFT JOIN cells ON cells.gender = g.gender AND cells.category = g.category)
SELECT round(CASE WHEN (max(nr) - 1) * (max(nc) - 1) = 1
                  THEN sum((abs(o - e) - least(0.5, abs(o - e))) ^ 2 / e) ELSE sum((o - e) ^ 2 / e) END, 6) AS chi2_statistic,
       CAST((max(nr) - 1) * (max(nc) - 1) AS BIGINT) AS dof, CAST(max(n) AS BIGINT) AS n,
       max(nr) AS n_rows, max(nc) AS n_cols, (max(nr) - 1) * (max(nc) - 1) = 1 AS yates_applied
FROM e
""".replace("\n, b AS", "WITH b AS", 1)))
def q_chi2(spark, sf_dir):
    """A4: χ² of gender × category (statistic, dof, n)."""
    return round_doubles(S.chi_squared(_chi_input(spark, sf_dir), "gender", "category", weight="n_items"))


def _mw_sql(column: str) -> str:
    return with_fact(f"""
, b AS (SELECT {column} AS v, category = '{MW_CATEGORY_1}' AS s1 FROM persons
        WHERE {column} IS NOT NULL AND category IN ('{MW_CATEGORY_1}', '{MW_CATEGORY_2}')),
rk AS (SELECT v, s1, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS mr FROM b),
t AS (SELECT v, CAST(count(*) AS DOUBLE) AS t FROM b GROUP BY v),
a AS (SELECT sum(mr) FILTER (WHERE s1) AS r1, CAST(count(*) FILTER (WHERE s1) AS DOUBLE) AS n1,
             CAST(count(*) AS DOUBLE) AS n,
             median(v) FILTER (WHERE s1) AS m1, median(v) FILTER (WHERE NOT s1) AS m2 FROM rk),
tt AS (SELECT sum(t * t * t - t) AS tie FROM t),
u AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u1, n1, n - n1 AS n2, n, tie, m1, m2 FROM a CROSS JOIN tt),
z AS (SELECT *, n1 * n2 / 2 AS mu, sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))) AS sigma FROM u)
SELECT round(u1, 6) AS u_statistic, round(n1 * n2 - u1, 6) AS u2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       round(tie, 6) AS tie_term, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
       round((greatest(u1, n1 * n2 - u1) - mu - 0.5) / sigma, 6) AS z,
       round(CAST(m1 AS DOUBLE), 6) AS median_1, round(CAST(m2 AS DOUBLE), 6) AS median_2
FROM z
""".replace("\n, b AS", "WITH b AS", 1))


@query("mann_whitney_prize_amount", _mw_sql("prize_amount"))
def q_mw_prize(spark, sf_dir):
    """A5 / W2 over a column with about as many distinct values as rows."""
    p = persons(award_facts(spark, sf_dir)).filter(F.col("category").isin(MW_CATEGORY_1, MW_CATEGORY_2))
    return round_doubles(S.mann_whitney(p, "prize_amount", F.col("category") == MW_CATEGORY_1))


@query("cumulative_prize_amount", with_fact("""
SELECT prize_amount, count(*) AS count, CAST(sum(count(*)) OVER (ORDER BY prize_amount) AS BIGINT) AS cumulative
FROM fact WHERE prize_amount IS NOT NULL GROUP BY prize_amount
"""))
def q_cumulative_prize(spark, sf_dir):
    """Running total over every distinct amount."""
    from ..operators import windows as W

    fact = award_facts(spark, sf_dir).filter(F.col("prize_amount").isNotNull())
    per = fact.groupBy("prize_amount").agg(F.count(F.lit(1)).alias("count"))
    return round_doubles(W.running_total(per, ["prize_amount"], "count", "cumulative"))


@query("regression_points", with_fact("""
, a AS (SELECT regr_slope(age_at_award, award_year) AS slope, regr_intercept(age_at_award, award_year) AS intercept
        FROM persons)
SELECT p.id, p.award_year, p.age_at_award, p.category, round(a.intercept + a.slope * p.award_year, 6) AS predicted
FROM persons p CROSS JOIN a WHERE p.award_year IS NOT NULL AND p.age_at_award IS NOT NULL
""".replace("\n, a AS", "WITH a AS", 1)))
def q_points(spark, sf_dir):
    """The scatter points beside the regression line."""
    p = persons(award_facts(spark, sf_dir))
    out = S.predictions(p, S.ols_trend(p))
    return round_doubles(out.select("id", "award_year", "age_at_award", "category", "predicted"))


@query("mann_whitney_age", _mw_sql("age_at_award"))
def q_mw(spark, sf_dir):
    """Rank-sum test of age between two categories."""
    return round_doubles(_mw(spark, sf_dir))


@query("age_trend_regression", with_fact("""
, a AS (SELECT regr_slope(age_at_award, award_year) AS slope, regr_intercept(age_at_award, award_year) AS intercept,
               regr_r2(age_at_award, award_year) AS r2, CAST(regr_count(age_at_award, award_year) AS BIGINT) AS n,
               regr_sxx(age_at_award, award_year) AS sxx, regr_syy(age_at_award, award_year) AS syy
        FROM persons)
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r_squared,
       round(slope / (sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2)) / sqrt(sxx)), 6) AS t_statistic,
       n, n - 2 AS dof, round(abs(slope * 10), 6) AS slope_per_decade
FROM a
""".replace("\n, a AS", "WITH a AS", 1)))
def q_ols(spark, sf_dir):
    """OLS of age on year."""
    return round_doubles(S.ols_trend(persons(award_facts(spark, sf_dir))))


@query("regression_line", with_fact("""
, a AS (SELECT regr_slope(age_at_award, award_year) AS slope, regr_intercept(age_at_award, award_year) AS intercept
        FROM persons)
SELECT DISTINCT p.award_year, round(a.intercept + a.slope * p.award_year, 6) AS predicted
FROM persons p CROSS JOIN a WHERE p.award_year IS NOT NULL AND p.age_at_award IS NOT NULL
""".replace("\n, a AS", "WITH a AS", 1)))
def q_line(spark, sf_dir):
    """Fitted regression line points."""
    p = persons(award_facts(spark, sf_dir))
    fit = S.ols_trend(p)
    return round_doubles(S.predictions(p, fit).select("award_year", "predicted").distinct().orderBy("award_year"))


@query("age_distribution_stats", with_fact("""
, b AS (SELECT CAST(age_at_award AS DOUBLE) AS v FROM persons WHERE age_at_award IS NOT NULL),
m AS (SELECT avg(v) AS mu FROM b),
k AS (SELECT count(*) AS n, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std,
             skewness(v) AS g1, kurtosis(v) AS g2, min(v) AS lo, max(v) AS hi,
             avg((v - mu) ^ 2) AS m2, avg((v - mu) ^ 3) AS m3, avg((v - mu) ^ 4) AS m4 FROM b CROSS JOIN m),
s AS (SELECT *, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS kk FROM k),
j AS (SELECT *, n / 6.0 * (s * s + kk * kk / 4) AS jb FROM s)
SELECT round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(g1, 6) AS skewness,
       round(g2, 6) AS kurtosis, CAST(lo AS INTEGER) AS youngest, CAST(hi AS INTEGER) AS oldest, n,
       round(s, 6) AS pop_skewness, round(kk, 6) AS pop_excess_kurtosis, round(jb, 6) AS jarque_bera,
       round(exp(-jb / 2), 6) AS jarque_bera_p, exp(-jb / 2) > 0.05 AS is_normal
FROM j
""".replace("\n, b AS", "WITH b AS", 1)))
def q_dist(spark, sf_dir):
    """Age distribution statistics and Jarque-Bera."""
    return round_doubles(S.distribution_stats(persons(award_facts(spark, sf_dir))))


def _corr_sql() -> str:
    parts = []
    for a in NUMERIC_COLUMNS:
        for b in NUMERIC_COLUMNS:
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 6) AS r FROM persons")
    return with_fact("\nUNION ALL\n".join(parts))


@query("correlation_matrix", _corr_sql())
def q_corr(spark, sf_dir):
    """A10 / C17: pairwise-complete correlation matrix (long form)."""
    return round_doubles(S.correlation_long(persons(award_facts(spark, sf_dir)), NUMERIC_COLUMNS))


def person_cube(spark, sf_dir):
    """One scan of the fact for all numeric tests:
    persons counted per (category, gender, age, year). The tests read this
    partial-aggregated cube with ``weight`` — exact, since every statistic is a
    function of the value counts — and the same cube feeds every branch, so the
    fact is joined once."""
    from ..session import materialised

    p = persons(award_facts(spark, sf_dir))
    cube = p.groupBy("category", "gender", "age_at_award", "award_year").agg(F.count(F.lit(1)).alias("n_rows"))
    # The tests filter on grouping keys, which Catalyst would push below the
    # aggregate (one fact scan per test). The cube's size is set by the distinct
    # attribute combinations, not by rows: checkpoint it into the shared folder
    # once, and every test reads the materialised cube.
    return materialised(cube)


def fused_tests(cube):
    """χ², rank-sum, OLS and distribution tests from the count cube."""
    chi = S.chi_squared(cube.filter(F.col("gender").isin("male", "female")), "gender", "category", weight="n_rows")
    mw_in = cube.filter(F.col("category").isin(MW_CATEGORY_1, MW_CATEGORY_2))
    mw = S.mann_whitney(mw_in, "age_at_award", F.col("category") == MW_CATEGORY_1, weight="n_rows")
    return chi, mw, S.ols_trend(cube, weight="n_rows"), S.distribution_stats(cube, weight="n_rows")


@query("hypothesis_tests")
def q_tests(spark, sf_dir):
    """P-values of the fused tests (one count cube)."""
    chi, mw, ols, dist = fused_tests(person_cube(spark, sf_dir))
    return S.with_p_values(chi=chi, mw=mw, ols=ols, dist=dist)


# the key of a sampled row as text: whole numbers only, so that every engine writes it alike
SAMPLE_SIZE, SAMPLE_SEED = 5000, 42
SAMPLE_SQL = f"""WITH b AS (SELECT id, award_year, category, age_at_award, prize_amount, CAST(round(prize_amount * 100) AS BIGINT) AS cents FROM persons WHERE age_at_award IS NOT NULL),
sampled AS (SELECT * FROM b ORDER BY md5(concat_ws('|', '{SAMPLE_SEED}', id, award_year, category, age_at_award, cents)) LIMIT {SAMPLE_SIZE})"""


def _sample(spark, sf_dir):
    p = persons(award_facts(spark, sf_dir)).filter(F.col("age_at_award").isNotNull())
    keyed = p.select("id", "award_year", "category", "age_at_award", "prize_amount",
                     F.round(F.col("prize_amount") * 100).cast("long").alias("cents"))
    return G.sample_rows(keyed, SAMPLE_SIZE, SAMPLE_SEED, ["id", "award_year", "category", "age_at_award", "cents"], portable=True)


@query("age_sample", with_fact(SAMPLE_SQL + """
SELECT id, award_year, category, age_at_award, round(prize_amount, 6) AS prize_amount FROM sampled"""))
def q_sample(spark, sf_dir):
    """Deterministic sample of at most 5,000 person ages (seeded hash order)."""
    return round_doubles(_sample(spark, sf_dir).drop("cents"))


def _polynomial_sql(x: str, highest_first) -> str:
    out = f"{float(highest_first[0])}::DOUBLE"
    for c in highest_first[1:]:
        out = f"({out} * {x} + {float(c)}::DOUBLE)"
    return out


def _w_sql() -> str:
    """W over the sample, for samples of 12 values and more."""
    tail = f"({_polynomial_sql('t', N.TAIL_TOP)} / {_polynomial_sql('t', N.TAIL_BOTTOM)})"
    middle = f"({_polynomial_sql('(q * q)', N.MIDDLE_TOP)} * q / {_polynomial_sql('(q * q)', N.MIDDLE_BOTTOM)})"
    up = lambda x, c: _polynomial_sql(x, c[::-1])
    return f"""{SAMPLE_SQL},
o AS (SELECT CAST(age_at_award AS DOUBLE) AS v, row_number() OVER (ORDER BY age_at_award) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM sampled),
p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM o),
q AS (SELECT *, p - 0.5 AS q, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p),
m AS (SELECT *, CASE WHEN p < {N.TAIL_FROM} THEN {tail} WHEN p > 1 - {N.TAIL_FROM} THEN -{tail} ELSE {middle} END AS m FROM q),
s AS (SELECT n, sum(m * m) AS mm, var_pop(v) * n AS ss, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(n) AS u,
             sum(m * v) FILTER (i > 2 AND i < n - 1) AS inside, max(v) FILTER (i = n) - max(v) FILTER (i = 1) AS r1,
             max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) AS r2 FROM m GROUP BY n),
a AS (SELECT *, m1 / sqrt(mm) + {up('u', N.LAST_WEIGHT)} AS a1, m2 / sqrt(mm) + {up('u', N.SECOND_WEIGHT)} AS a2 FROM s),
w AS (SELECT n, pow(a1 * r1 + a2 * r2 + inside / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss AS w FROM a),
z AS (SELECT *, (ln(1 - w) - {up('ln(n)', N.LARGE_MEAN)}) / exp({up('ln(n)', N.LARGE_LOG_SD)}) AS z FROM w)
SELECT CAST(n AS BIGINT) AS n, round(w, 6) AS w_statistic, round(z, 6) AS z, z < 1.6448536269514722 AS is_normal FROM z"""


@query("age_normality", with_fact(_w_sql()))
def q_normality(spark, sf_dir):
    """W statistic of the sampled ages, its normal score and the verdict at 5 %."""
    return round_doubles(N.w_statistic(_sample(spark, sf_dir), "age_at_award").drop("p_value"))


@query("rank_test_exact", """
WITH RECURSIVE lines AS (SELECT l_orderkey, l_linenumber % 2 = 1 AS s1, l_extendedprice AS v FROM lineitem),
fit AS (SELECT l_orderkey, count(*) FILTER (s1) AS n1, count(*) FILTER (NOT s1) AS n2 FROM lines GROUP BY l_orderkey
        HAVING count(DISTINCT v) = count(*) AND count(*) FILTER (s1) > 0 AND count(*) FILTER (NOT s1) > 0),
tests AS (SELECT l_orderkey, n1, n2, count(*) FILTER (a.v > b.v) AS u FROM fit JOIN lines a USING (l_orderkey) JOIN lines b USING (l_orderkey)
          WHERE a.s1 AND NOT b.s1 GROUP BY ALL),
orders_of(n1, n2, u, c) AS (SELECT 0, 0, 0, 1::BIGINT UNION ALL
    SELECT n1, n2, u, CAST(sum(c) AS BIGINT) FROM (SELECT n1 + 1 AS n1, n2, u + n2 AS u, c FROM orders_of WHERE n1 + n2 < 30
                                     UNION ALL SELECT n1, n2 + 1, u, c FROM orders_of WHERE n1 + n2 < 30) GROUP BY n1, n2, u),
tail AS (SELECT t.l_orderkey, t.n1, t.n2, t.u, sum(o.c) FILTER (o.u >= greatest(t.u, t.n1 * t.n2 - t.u)) / sum(o.c) AS p
         FROM tests t JOIN orders_of o ON o.n1 = t.n1 AND o.n2 = t.n2 GROUP BY ALL)
SELECT l_orderkey, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(u AS DOUBLE) AS u_statistic, 'exact' AS method, round(least(1.0, 2 * p), 6) AS p_value FROM tail
""")
def q_rank_exact(spark, sf_dir):
    """A5: a rank-sum test an order (prices of its odd lines against the even ones), those with an exact p."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    tests = S.mann_whitney(lines, "l_extendedprice", F.col("l_linenumber") % 2 == 1, ["l_orderkey"])
    out = tests.select("l_orderkey", "n1", "n2", "u_statistic", S.rank_method().alias("method"), S.rank_p().alias("p_value"))
    return round_doubles(out.filter("method = 'exact'"))


@query("insight_facts")
def q_insights(spark, sf_dir):
    """The scalars quoted by the insight texts, in one row: leading country and
    its size (A14), youngest/oldest (A15), χ² / rank-sum / OLS results with
    p-values (A4-A6, T1), the slope per decade (A29), the age distribution and its
    normality verdict (A8, A9), the forecast verdict (A28), and the models' scalars:
    documents, terms, topics and explained variance (M12, M13), forecast years and
    final training loss (FC5). Fold accuracy is ``forest_cv_accuracy``'s."""
    from ..functions import tails
    from ..sources.facts import order_facts

    p = persons(award_facts(spark, sf_dir))
    top = G.argmax_group(order_facts(spark, sf_dir), "birth_country", weight="n_items").select(
        F.col("birth_country").alias("top_country"), F.col("n").alias("top_country_n"))
    ext = G.extreme_rows(p)
    chi, mw, ols, dist = fused_tests(person_cube(spark, sf_dir))
    chi = chi.select("chi2_statistic", tails.chi2_p(F.col("chi2_statistic"), F.col("dof")).alias("chi2_p"))
    mw = mw.select(F.col("u_statistic").alias("mw_u"), S.rank_p().alias("mw_p"), S.rank_method().alias("mw_method"))
    ols = ols.select("slope", "r_squared", "slope_per_decade",
                     tails.t_p(F.col("t_statistic"), F.col("dof")).alias("ols_p"))
    dist = dist.select(F.col("mean").alias("age_mean"), F.col("median").alias("age_median"),
                       F.col("is_normal").alias("age_is_normal"))
    verdict = _overall_forecast_verdict(spark, sf_dir)
    out = top
    for part in (ext, chi, mw, ols, dist, verdict, *_model_scalars(spark, sf_dir)):
        out = G.with_scalar(out, part)
    return round_doubles(out.withColumn("gender_significant", F.col("chi2_p") < 0.05)
                         .withColumn("age_trend_significant", F.col("ols_p") < 0.05))


def _model_scalars(spark, sf_dir):
    """Two one-row frames: the topic model's sizes, and the overall yearly forecast's length and final loss."""
    from ..operators import forecast as FC
    from . import models as MD

    fitted = FC.fit_ar(FC.windowed(MD._yearly_series(spark, sf_dir), MD.YEARLY_LAGS), MD.YEARLY_LAGS, ridge=MD.YEARLY_RIDGE)
    loss = fitted.filter(F.col("series_id") == "ALL").select(
        F.lit(MD.YEARLY_HORIZON).alias("forecast_years"), F.col("train_mse").alias("forecast_final_loss"))
    return MD.q_topic_summary(spark, sf_dir), loss


def _overall_forecast_verdict(spark, sf_dir):
    """A28 on the yearly series of all rows (the reference's forecast verdict)."""
    from ..operators import forecast as FC
    from ..sources.facts import order_facts
    from .models import YEARLY_HORIZON, YEARLY_LAGS, YEARLY_RIDGE

    f = order_facts(spark, sf_dir)
    # forecast the overall series together with the per-category ones: a join keyed
    # on a single literal series id would be constant-folded into a cross join
    yearly = FC.period_counts(f, F.lit("ALL"), F.col("award_year"), weight="n_items").unionByName(
        FC.period_counts(f, "category", F.col("award_year"), weight="n_items"))
    fc = FC.forecast_series(yearly, YEARLY_LAGS, YEARLY_HORIZON, ridge=YEARLY_RIDGE)
    return FC.trend_verdict(fc).filter(F.col("series_id") == "ALL").select(F.col("verdict").alias("forecast_verdict"))
