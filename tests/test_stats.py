"""Hypothesis tests against hand-computed values (FIXTURES §2.3)."""

import math

from pyspark.sql import functions as F

from honorlens.functions import tails
from honorlens.operators import stats as S


def _table(spark, grid):
    rows = []
    for i, line in enumerate(grid):
        for j, n in enumerate(line):
            rows += [(f"r{i}", f"c{j}")] * n
    return spark.createDataFrame(rows, "gender string, category string")


def test_chi_squared_2x3(spark):
    r = S.chi_squared(_table(spark, [[2, 3, 5], [8, 7, 5]])).collect()[0]
    assert abs(r["chi2_statistic"] - 2.1) < 1e-9 and r["dof"] == 2
    assert abs(tails.chi2_sf(r["chi2_statistic"], r["dof"]) - 0.349938) < 1e-6


def test_chi_squared_2x2_yates(spark):
    r = S.chi_squared(_table(spark, [[10, 20], [30, 15]])).collect()[0]
    assert abs(r["chi2_statistic"] - 6.752232) < 1e-6 and r["yates_applied"]
    r2 = S.chi_squared(_table(spark, [[10, 20], [30, 15]]), yates=False).collect()[0]
    assert abs(r2["chi2_statistic"] - 8.035714) < 1e-6


def test_chi_squared_zero_cells_and_rank_one(spark):
    # a zero cell contributes its expected count; a rank-1 table gives 0
    r = S.chi_squared(_table(spark, [[4, 0, 2], [1, 3, 2]])).collect()[0]
    obs = [[4, 0, 2], [1, 3, 2]]
    n = 12
    rs = [sum(x) for x in obs]
    cs = [sum(c) for c in zip(*obs)]
    brute = sum((obs[i][j] - rs[i] * cs[j] / n) ** 2 / (rs[i] * cs[j] / n) for i in range(2) for j in range(3))
    assert abs(r["chi2_statistic"] - brute) < 1e-9
    z = S.chi_squared(_table(spark, [[1, 2, 3], [2, 4, 6]])).collect()[0]
    assert abs(z["chi2_statistic"]) < 1e-12


def test_mann_whitney_fixture(spark):
    rows = [(v, True) for v in (30, 40, 40, 50)] + [(v, False) for v in (40, 55, 60)]
    df = spark.createDataFrame(rows, "v int, s boolean")
    r = S.mann_whitney(df, "v", F.col("s")).collect()[0]
    assert r["u_statistic"] == 2 and r["u2"] == 10 and r["tie_term"] == 24
    assert r["u_statistic"] + r["u2"] == r["n1"] * r["n2"]
    assert abs(r["z"] - 1.284149) < 1e-6
    assert abs(tails.normal_two_sided(r["z"]) - 0.199090) < 1e-6
    assert r["median_1"] == 40 and r["median_2"] == 55


def test_mann_whitney_per_group_matches_single(spark):
    rows = [(g, v, v % 3 == 0) for g in ("a", "b") for v in range(1, 40)]
    df = spark.createDataFrame(rows, "g string, v int, s boolean")
    both = {r["g"]: r["u_statistic"] for r in S.mann_whitney(df, "v", F.col("s"), group_cols=["g"]).collect()}
    one = S.mann_whitney(df.filter("g = 'a'"), "v", F.col("s")).collect()[0]["u_statistic"]
    assert both["a"] == one == both["b"]


def test_ols_fixture(spark):
    df = spark.createDataFrame([(1900, 50), (1910, 52), (1920, 51), (1930, 57)], "award_year int, age_at_award int")
    r = S.ols_trend(df).collect()[0]
    assert abs(r["slope"] - 0.2) < 1e-9 and abs(r["intercept"] + 330.5) < 1e-6
    assert abs(r["r_squared"] - 0.689655) < 1e-6 and abs(r["t_statistic"] - 2.108185) < 1e-6
    assert abs(tails.t_two_sided(r["t_statistic"], r["dof"]) - 0.169545) < 1e-6


def test_distribution_fixture(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 9, 4)], "age_at_award int")
    r = S.distribution_stats(df).collect()[0]
    assert r["mean"] == 3.5 and r["median"] == 2.5
    assert abs(r["std"] - 2.880972) < 1e-6
    assert abs(r["skewness"] - 1.806619) < 1e-6 and abs(r["kurtosis"] - 3.549136) < 1e-6
    assert abs(r["pop_skewness"] - 1.319368) < 1e-6 and abs(r["pop_excess_kurtosis"] - 0.359704) < 1e-6
    assert abs(r["jarque_bera"] - 1.773079) < 1e-6 and abs(r["jarque_bera_p"] - 0.412079) < 1e-6


def test_distribution_constant_column(spark):
    df = spark.createDataFrame([(5,)] * 6, "age_at_award int")
    r = S.distribution_stats(df).collect()[0]
    assert r["skewness"] == 0.0 and r["std"] == 0.0


def test_correlation_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0, 7.0), (2.0, None, 7.0), (3.0, 4.0, 7.0), (4.0, 4.5, 7.0)],
                               "a double, b double, c double")
    out = {(r["var_a"], r["var_b"]): r["r"] for r in S.correlation_long(df, ["a", "b", "c"]).collect()}
    assert abs(out[("a", "b")] - 0.979864) < 1e-6 and out[("a", "b")] == out[("b", "a")]
    assert out[("a", "c")] is None and abs(out[("a", "a")] - 1) < 1e-12


def test_tails():
    assert abs(tails.chi2_sf(2.1, 2) - math.exp(-1.05)) < 1e-12
    assert abs(tails.normal_two_sided(0.0) - 1.0) < 1e-12
    assert tails.normal_two_sided(-0.5) == 1.0
    assert abs(tails.t_two_sided(0.0, 10) - 1.0) < 1e-12


def test_p_values_job(spark):
    df = _table(spark, [[2, 3, 5], [8, 7, 5]])
    out = S.with_p_values(chi=S.chi_squared(df)).collect()[0]
    assert abs(out["p_value"] - 0.349938) < 1e-6 and not out["significant"]


def test_weighted_tests_equal_row_tests(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.randint(20, 60), rnd.randint(1990, 2000)) for _ in range(800)]
    df = spark.createDataFrame(rows, "category string, age_at_award int, award_year int")
    cube = df.groupBy("category", "age_at_award", "award_year").agg(F.count(F.lit(1)).alias("w"))

    def close(a, b):
        for k in a.asDict():
            x, y = a[k], b[k]
            assert (x is None and y is None) or abs(x - y) < 1e-9 * max(1.0, abs(x)), k

    close(S.ols_trend(df).collect()[0], S.ols_trend(cube, weight="w").collect()[0])
    close(S.distribution_stats(df).drop("is_normal").collect()[0],
          S.distribution_stats(cube, weight="w").drop("is_normal").collect()[0])
    s1 = F.col("category") == "a"
    close(S.mann_whitney(df, "age_at_award", s1).collect()[0],
          S.mann_whitney(cube, "age_at_award", s1, weight="w").collect()[0])


def test_grouped_tests_equal_per_group_runs(spark):
    import random

    rnd = random.Random(9)
    rows = [(g, rnd.choice(["male", "female"]), rnd.choice("xyz"), rnd.randint(1990, 2000), rnd.randint(20, 70))
            for g in ("A", "B", "C") for _ in range(300)]
    df = spark.createDataFrame(rows, "grp string, gender string, category string, award_year int, age_at_award int")
    chi = {r["grp"]: r["chi2_statistic"] for r in S.chi_squared(df, group_cols=["grp"]).collect()}
    ols = {r["grp"]: r["slope"] for r in S.ols_trend(df, group_cols=["grp"]).collect()}
    dist = {r["grp"]: r["median"] for r in S.distribution_stats(df, group_cols=["grp"]).collect()}
    for g in ("A", "B", "C"):
        one = df.filter(F.col("grp") == g)
        assert abs(chi[g] - S.chi_squared(one).collect()[0]["chi2_statistic"]) < 1e-9
        assert abs(ols[g] - S.ols_trend(one).collect()[0]["slope"]) < 1e-12
        assert dist[g] == S.distribution_stats(one).collect()[0]["median"]


def test_single_row_inputs_do_not_raise(spark):
    one = spark.createDataFrame([("a", 30, 1990)], "category string, age_at_award int, award_year int")
    mw = S.mann_whitney(one, "age_at_award", F.col("category") == "a").collect()[0]
    assert mw["n1"] == 1 and mw["n2"] == 0
    cube = one.groupBy("category", "age_at_award", "award_year").agg(F.count(F.lit(1)).alias("w"))
    d = S.distribution_stats(cube, weight="w").collect()[0]
    assert d["mean"] == 30.0 and d["std"] is None
    assert S.ols_trend(one).collect()[0]["slope"] is None


def test_rank_p_says_where_the_reference_takes_the_exact_one(spark):
    def method(a, b):
        df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v double, s boolean")
        rows = S.with_p_values(chi=S.chi_squared(df, "s", "v"), mw=S.mann_whitney(df, "v", F.col("s"))).collect()
        return {r["test"]: r["method"] for r in rows}

    small, large = [float(v) for v in range(8)], [100.0 + v for v in range(9)]
    assert method(small, large) == {"chi_squared": None, "mann_whitney": "exact"}
    assert method(large, small)["mann_whitney"] == "exact"
    assert method([*small, 8.0], large)["mann_whitney"] == "asymptotic"
    assert method([*small[:7], 100.0], large)["mann_whitney"] == "asymptotic"  # a tie


def test_exact_rank_p_is_the_counted_one():
    from itertools import combinations
    from fractions import Fraction

    from honorlens.functions import rank_exact as R

    for m, n in ((1, 1), (1, 6), (2, 3), (3, 3), (4, 7), (5, 5), (8, 4), (8, 8)):
        us = [sum(r for r in c) - m * (m - 1) // 2 for c in combinations(range(m + n), m)]
        for u in range(m * n + 1):
            upper = Fraction(sum(x >= max(u, m * n - u) for x in us), len(us))
            assert R.two_sided(u, m, n) == float(min(1, 2 * upper)), (m, n, u)
    # hand-computed: all of three below all of four, 2 / C(7, 3); two of a million: 4 orders of C(10^6 + 2, 2)
    assert R.two_sided(0, 3, 4) == 2 / 35
    assert R.two_sided(1, 2, 10**6) == 4 / ((10**6 + 2) * (10**6 + 1) // 2)
    assert abs(R.two_sided(4 * 10**6, 8, 10**6) - 1.0) < 1e-5  # the centre of the distribution


def test_small_tests_without_ties_are_exact(spark):
    rows = [("a", 1.0, True), ("a", 2.0, True), ("a", 3.0, False), ("a", 4.0, False), ("a", 5.0, False)]
    rows += [("tied", 1.0, True), ("tied", 1.0, False), ("one", 1.0, True)] + [("large", float(i), i % 2 == 0) for i in range(30)]
    out = S.mann_whitney(spark.createDataFrame(rows, "g string, v double, s boolean"), "v", F.col("s"), ["g"])
    got = {r.g: (r.method, r.p) for r in out.select("g", S.rank_method().alias("method"), S.rank_p().alias("p")).collect()}
    assert got["a"] == ("exact", 0.2)  # 2 / C(5, 2)
    assert {g: m for g, (m, _) in got.items()} == {"a": "exact", "tied": "asymptotic", "one": "asymptotic", "large": "asymptotic"}
