"""Many-series autoregressive forecasting (W4, W5, W8, FC1-FC5, A28).

Series are built with aggregates and partitioned windows; one AR(L) model per
series is fitted by least squares, from the sums of its normal equations (added
up by Spark, one row of them per series is solved); the recursive H-step forecast
is a native higher-order-function expression, one row per series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W


def period_counts(df: DataFrame, series: str | Column, t: Column, name: str = "value",
                  weight: str | None = None) -> DataFrame:
    """FC1 (first half) / A16: rows per (series, period), gaps not filled.
    ``weight`` reads a pre-aggregated input (each row stands for that many rows)."""
    sid = F.col(series) if isinstance(series, str) else series
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.filter(sid.isNotNull() & t.isNotNull())
        .groupBy(sid.alias("series_id"), t.alias("t"))
        .agg(n.cast("double").alias(name))
    )


def windowed(series_df: DataFrame, length: int) -> DataFrame:
    """FC1 (second half): z-score per series (W4) and the previous ``length``
    z-values as ``window`` (W5), oldest first; also keeps mean and std."""
    z = W.zscore(series_df, "series_id", "value", "z")
    return W.lag_windows(z, "series_id", "t", "z", length, "window")


def _dot(window: Column, weights: Column, length: int) -> Column:
    return F.aggregate(F.zip_with(F.slice(window, -length, length), weights, lambda a, b: a * b), F.lit(0.0),
                       lambda acc, x: acc + x)


def _normal_sums(windows_df: DataFrame, length: int) -> DataFrame:
    """series_id and the sums of its normal equations: the lower triangle of XᵀX row by row (a 1 as
    the last column of X), Xᵀy and yᵀy. One row a series; all that fitting needs of the data."""
    x = [F.col("window")[i] for i in range(length)] + [F.lit(1.0)]
    y = F.col("z")
    sums = [F.sum(x[i] * x[j]) for i in range(length + 1) for j in range(i + 1)] + [F.sum(a * y) for a in x] + [F.sum(y * y)]
    per = windows_df.groupBy("series_id").agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    return per.select("series_id", F.array(*[F.col(f"_s{i}").cast("double") for i in range(len(sums))]).alias("sums"))


def _equations(flat, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XᵀX, Xᵀy and yᵀy of each row of ``flat`` (rows of _normal_sums)."""
    lower = np.tril_indices(length + 1)
    m = np.zeros((len(flat), length + 1, length + 1))
    m[:, lower[0], lower[1]] = m[:, lower[1], lower[0]] = flat[:, : len(lower[0])]
    return m, flat[:, len(lower[0]) : -1], flat[:, -1]


def fit_ar(windows_df: DataFrame, length: int, ridge: float = 1e-8) -> DataFrame:
    """FC2: per-series least squares z_t ≈ w·window_t + b (MSE loss).
    Returns series_id, weights (array, oldest lag first), bias, train_mse."""

    @F.pandas_udf("weights array<double>, bias double, train_mse double")
    def solve(rows: pd.Series) -> pd.DataFrame:
        out = []
        for flat in rows:
            flat = np.asarray(flat, dtype=float)
            if np.isnan(flat).any():
                out.append((None, None, None))
                continue
            (m,), (xy,), (yy,) = _equations(flat[None], length)
            coef = np.linalg.solve(m + ridge * np.eye(length + 1), xy)
            loss = max(0.0, yy - 2 * coef @ xy + coef @ m @ coef) / m[-1, -1]
            out.append((coef[:length].tolist(), float(coef[length]), float(loss)))
        return pd.DataFrame(out, columns=["weights", "bias", "train_mse"])

    fit = _normal_sums(windows_df, length).select("series_id", solve("sums").alias("m"))
    return fit.select("series_id", "m.weights", "m.bias", "m.train_mse")


def loss_history(windows_df: DataFrame, length: int, epochs: int) -> DataFrame:
    """FC5: series_id, epoch (1, 2, ...), loss: the mean squared error after each epoch of full-batch
    gradient descent from zero weights, for all series at once.

    The gradient of an epoch is a function of the sums of the normal equations, so the data is
    summed up once and the epochs run over one row a series. A step is the gradient over twice the
    trace of XᵀX / n, which no eigenvalue exceeds: the loss never rises, and falls to that of the
    least-squares fit. A series with a null or NaN among its values has no losses."""

    @F.pandas_udf("array<double>")
    def train(rows: pd.Series) -> pd.Series:
        flat = np.array([np.asarray(r, dtype=float) for r in rows]).reshape(len(rows), -1)
        good = ~np.isnan(flat).any(axis=1)
        m, xy, yy = _equations(flat[good], length)
        trace = np.trace(m, axis1=1, axis2=2)[:, None]
        weights, losses = np.zeros_like(xy), np.empty((len(xy), epochs))
        for epoch in range(epochs):
            weights = weights - (np.einsum("sij,sj->si", m, weights) - xy) / trace
            losses[:, epoch] = (yy - 2 * (weights * xy).sum(axis=1) + np.einsum("si,sij,sj->s", weights, m, weights)) / m[:, -1, -1]
        out = pd.Series([None] * len(rows), dtype=object)
        out[good] = pd.Series(list(np.maximum(losses, 0.0)), index=np.flatnonzero(good), dtype=object)
        return out

    trained = _normal_sums(windows_df, length).select("series_id", F.posexplode(train("sums")).alias("epoch", "loss"))
    return trained.select("series_id", (F.col("epoch") + 1).alias("epoch"), "loss")


def fitted(windows_df: DataFrame, models: DataFrame, length: int) -> DataFrame:
    """FC3: in-sample one-step predictions, de-normalised (·std + mean)."""
    j = windows_df.join(models, "series_id")
    pred = _dot(F.col("window"), F.col("weights"), length) + F.col("bias")
    return j.select("series_id", "t", "value", (pred * F.col("_sd") + F.col("_mu")).alias("fitted"))


def recursive_forecast(last_windows: DataFrame, length: int, horizon: int) -> DataFrame:
    """FC4: feed each prediction back as the newest lag, ``horizon`` steps.

    Input: series_id, last (array of the last ``length`` z-values), weights, bias,
    _mu, _sd, last_t. Output one row per (series, step) de-normalised; periods are
    days after a date ``last_t`` or integer steps (years) after a numeric one."""
    seq = F.sequence(F.lit(1), F.lit(horizon))
    grown = F.aggregate(seq, F.col("last"), lambda acc, i: F.concat(
        acc, F.array(_dot(acc, F.col("weights"), length) + F.col("bias"))))
    preds = F.slice(grown, -horizon, horizon)
    is_date = last_windows.schema["last_t"].dataType.typeName() == "date"
    ahead = F.col("step") + 1
    t_next = F.date_add(F.col("last_t"), ahead) if is_date else (F.col("last_t") + ahead).cast(
        last_windows.schema["last_t"].dataType)
    return last_windows.select(
        "series_id", "last_t", "_mu", "_sd", F.posexplode(preds).alias("step", "zhat")
    ).select("series_id", ahead.alias("step"), t_next.alias("t"),
             (F.col("zhat") * F.col("_sd") + F.col("_mu")).alias("forecast"))


def forecast_series(series_df: DataFrame, length: int = 10, horizon: int = 10, ridge: float = 1e-8) -> DataFrame:
    """FC1-FC5: one tagged long table per series: kind ∈ {actual, fitted, forecast}.
    ``actual`` skips the first ``length`` periods (as the reference does). ``ridge``
    shrinks the AR weights (on z-scores); short series need it to stay stable.
    ``series_id`` should come from data: a lone literal id makes Catalyst fold the
    per-series joins into cross joins (union it with data-derived series instead)."""
    win = windowed(series_df, length)
    models = fit_ar(win, length, ridge)
    fit = fitted(win, models, length)
    z_all = W.zscore(series_df, "series_id", "value", "z")
    tail = _last_window(z_all, length)
    fc = recursive_forecast(tail.join(models, "series_id"), length, horizon)
    actual = fit.select("series_id", "t", F.lit("actual").alias("kind"), F.col("value"))
    fitted_rows = fit.select("series_id", "t", F.lit("fitted").alias("kind"), F.col("fitted").alias("value"))
    fc_rows = fc.select("series_id", "t", F.lit("forecast").alias("kind"), F.col("forecast").alias("value"))
    return actual.unionByName(fitted_rows).unionByName(fc_rows)


def _last_window(z_all: DataFrame, length: int) -> DataFrame:
    """The last ``length`` z-values of every series, oldest first (a top-k per
    series, so no whole series is collected)."""
    ranked = W.top_k_per_group(z_all, ["series_id"], [F.desc("t")], length, "_r")
    return ranked.groupBy("series_id").agg(
        F.max("t").alias("last_t"), F.first("_mu").alias("_mu"), F.first("_sd").alias("_sd"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "z"))), lambda s: s["z"]).alias("last"),
    ).filter(F.size("last") == length)


def trend_verdict(forecasts: DataFrame, threshold: float = 3.0) -> DataFrame:
    """|last − first forecast| < threshold → 'relatively stable', else 'changing'."""
    f = forecasts.filter(F.col("kind") == "forecast")
    ends = f.groupBy("series_id").agg(F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"))
    return ends.withColumn("verdict", F.when(F.abs(F.col("last") - F.col("first")) < threshold,
                                             F.lit("relatively stable")).otherwise(F.lit("changing")))
