"""Windows and the recursive forecaster (FIXTURES §2.4)."""

import datetime as dt

from pyspark.sql import functions as F

from honorlens.operators import forecast as FC
from honorlens.operators import windows as W


def test_w5_lag_windows(spark):
    df = spark.createDataFrame([("s", t, float(t)) for t in (1, 2, 3, 4)], "series_id string, t int, v double")
    out = [(r["window"], r["v"]) for r in W.lag_windows(df, "series_id", "t", "v", 2).orderBy("t").collect()]
    assert out == [([1.0, 2.0], 3.0), ([2.0, 3.0], 4.0)]


def test_fc4_recursive_forecast(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0], [0.0, 1.0], 1.0, 0.0, 1.0, dt.date(2024, 1, 1))],
                               "series_id string, last array<double>, weights array<double>, bias double, "
                               "_mu double, _sd double, last_t date")
    got = [r["forecast"] for r in FC.recursive_forecast(df, 2, 3).orderBy("step").collect()]
    assert got == [3.0, 4.0, 5.0]


def test_ar_fit_recovers_linear_recurrence(spark):
    # x_t = 0.5 x_{t-1} + 0.25 x_{t-2} + 1 (deterministic, two series)
    rows = []
    for s, (a, b) in {"p": (1.0, 2.0), "q": (3.0, -1.0)}.items():
        xs = [a, b]
        for _ in range(40):
            xs.append(0.5 * xs[-1] + 0.25 * xs[-2] + 1)
        rows += [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(xs)]
    series = spark.createDataFrame(rows, "series_id string, t date, value double")
    out = FC.forecast_series(series, length=2, horizon=3)
    fitted = out.filter(F.col("kind") == "fitted").join(
        out.filter(F.col("kind") == "actual").select("series_id", "t", F.col("value").alias("a")), ["series_id", "t"])
    assert fitted.select(F.max(F.abs(F.col("value") - F.col("a")))).collect()[0][0] < 1e-4
    assert out.filter(F.col("kind") == "forecast").count() == 6


def test_integer_periods_forecast_years(spark):
    rows = [("s", 2000 + i, float(10 + (i % 3))) for i in range(12)]
    series = spark.createDataFrame(rows, "series_id string, t int, value double")
    out = FC.forecast_series(series, length=3, horizon=4, ridge=1.0)
    years = [r["t"] for r in out.filter(F.col("kind") == "forecast").orderBy("t").collect()]
    assert years == [2012, 2013, 2014, 2015]
    vals = [r["value"] for r in out.filter(F.col("kind") == "forecast").collect()]
    assert all(5 < v < 15 for v in vals)


def test_loss_falls_to_that_of_the_fit(spark):
    import math

    rows = [(s, t, float(v)) for s, f in (("wave", lambda t: 10 + 3 * math.sin(t)), ("trend", lambda t: t + (t * 7) % 5)) for t, v in ((t, f(t)) for t in range(40))]
    rows += [("flat", t, 5.0) for t in range(6)]  # no spread: its z-scores are null
    win = FC.windowed(spark.createDataFrame(rows, "series_id string, t int, value double"), 3)
    fit = {r.series_id: r.train_mse for r in FC.fit_ar(win, 3).collect()}
    losses = {}
    for r in FC.loss_history(win, 3, 3000).orderBy("series_id", "epoch").collect():
        losses.setdefault(r.series_id, []).append(r.loss)
    assert set(losses) == {"wave", "trend"} and {len(x) for x in losses.values()} == {3000}
    for name, curve in losses.items():
        assert all(a >= b - 1e-12 for a, b in zip(curve, curve[1:]))
        assert abs(curve[-1] - fit[name]) < 1e-5
