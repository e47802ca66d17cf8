"""Exact Euclidean silhouette (M3) against brute force, W statistic (A9) against published values."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from honorlens.operators.groups import sample_rows
from honorlens.operators.normality import normal_quantile, w_statistic
from honorlens.operators.silhouette import euclidean_silhouette, silhouette_values

X_TYPE = "x array<double>, cluster int, weight double"


def brute(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c.tolist()) if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_silhouette_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    n = 24 if block == 1 else 150
    x, c = rng.normal(size=(n, 3)).round(1), rng.integers(0, 4, n)
    x[: n // 3], c[: n // 3] = x[0], 2  # a third of all rows are one point
    x[n // 3], c[n // 3] = x[0], 1  # the same place in another cluster
    c[-1] = 9  # a cluster of one
    rows = spark.createDataFrame([(v.tolist(), int(k), 1.0) for v, k in zip(x, c)], X_TYPE)
    got = euclidean_silhouette(rows, "cluster", "x", block=block).first()
    assert got["n_points"] == n and got["n_clusters"] == len(set(c.tolist()))
    assert got["silhouette"] == pytest.approx(brute(x, c), abs=1e-12)


def test_silhouette_weights_count_rows(spark):
    rows = [([0.0, 0.0], 0, 3.0), ([1.0, 0.0], 0, 1.0), ([5.0, 0.0], 1, 2.0), ([-0.0, 0.0], 0, 1.0)]
    df = spark.createDataFrame(rows, X_TYPE)
    x = np.array([[0, 0]] * 4 + [[1, 0]] + [[5, 0]] * 2, dtype=float)
    c = np.array([0] * 5 + [1] * 2)
    assert euclidean_silhouette(df, "cluster", "x").first()["silhouette"] == pytest.approx(brute(x, c))
    assert silhouette_values(df, "cluster", "x").count() == 3  # 0.0 and -0.0 are one place


def test_silhouette_of_nothing_one_cluster_and_nulls(spark):
    df = spark.createDataFrame([([0.0], 0, 1.0), ([1.0], 0, 1.0), (None, 0, 1.0), ([2.0], None, 1.0)], X_TYPE)
    one = euclidean_silhouette(df, "cluster", "x").first()
    assert one["silhouette"] is None and one["n_points"] == 2 and one["n_clusters"] == 1
    none = euclidean_silhouette(df.limit(0), "cluster", "x").first()
    assert none["silhouette"] is None and none["n_points"] == 0
    with pytest.raises(ValueError):
        silhouette_values(df, "cluster", "x", block=0)


def test_quantile(spark):
    ps = [1e-9, 1e-4, 0.024, 0.025, 0.4, 0.5, 0.9, 0.976, 0.9999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double")
    got = dict(df.select("p", normal_quantile(F.col("p"))).collect())
    assert got.pop(0.0) is None and got.pop(1.0) is None
    for p, v in got.items():
        assert v == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-8)


def w_of(spark, values):
    return w_statistic(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()


def test_w_of_published_example(spark):
    """Weights of eleven men: the example of the test's authors."""
    r = w_of(spark, [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0, None])
    assert r["n"] == 11 and round(r["w_statistic"], 4) == 0.7888 and round(r["p_value"], 4) == 0.0067
    assert r["is_normal"] is False


def test_w_bounds_and_small_samples(spark):
    three = w_of(spark, [1.0, 2.0, 4.0])  # by hand: range^2 / 2 over the squares around the mean
    assert three["w_statistic"] == pytest.approx(4.5 / (14 / 3)) and three["z"] is None and 0 < three["p_value"] < 1
    quantiles = [statistics.NormalDist().inv_cdf((i - 0.5) / 200) for i in range(1, 201)]
    assert w_of(spark, quantiles)["w_statistic"] > 0.995
    skewed = w_of(spark, [float(np.exp(3 * q)) for q in quantiles])
    assert skewed["w_statistic"] < 0.5 and not skewed["is_normal"]
    for values in ([], [1.0, 2.0], [3.0] * 20):
        r = w_of(spark, values)
        assert r["n"] == len(values) and r["w_statistic"] is None and r["p_value"] is None and r["is_normal"] is None


def test_portable_sample(spark):
    import hashlib

    df = spark.range(500).withColumn("name", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), "id")))
    key = lambda i: hashlib.md5(f"42|{i}{f'|n{i}' if i % 7 else ''}".encode()).hexdigest()
    got = {r["id"] for r in sample_rows(df, 50, 42, ["id", "name"], portable=True).collect()}
    assert got == set(sorted(range(500), key=key)[:50])
