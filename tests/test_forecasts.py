"""Forecasters against known processes, and the rules around them."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.series_fit import dickey_fuller, fit_arima, fit_autoregressive
from tallyframe.operators import evaluation as score
from tallyframe.operators import forecasting as ops
from tallyframe.plans import jobs

D0 = dt.date(2022, 1, 1)
FC = "forecaster string, category string, ds date, amount double, lower_bound double, upper_bound double"


def series(spark, values, category="a"):
    rows = [(category, D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "category string, date date, amount double")


def forecasts(spark, rows):
    return spark.createDataFrame(
        [(m, c, D0 + dt.timedelta(days=i), float(v), float(v) - 1, float(v) + 1)
         for m, c, i, v in rows], FC)


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(42)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 10 + 0.7 * y[t - 1] + rng.normal()
    point, low, high = fit_arima(y[100:], 60, "grid")
    assert point[0] == pytest.approx(10 + 0.7 * y[-1], abs=0.5)
    assert point[-1] == pytest.approx(10 / 0.3, abs=1.0)
    assert (high - low)[0] == pytest.approx(2 * 1.96, rel=0.1)
    assert (high - low)[-1] == pytest.approx(2 * 1.96 / np.sqrt(1 - 0.49), rel=0.15)


def test_arima_follows_a_random_walk():
    y = 50 + np.cumsum(np.random.default_rng(1).normal(size=800))
    point, low, high = fit_arima(y, 30, "auto")
    assert abs(point - y[-1]).max() < 5
    widths = high - low
    assert (np.diff(widths) > 0).all()
    assert widths[-1] / widths[0] == pytest.approx(np.sqrt(30), rel=0.35)


def test_dickey_fuller_tells_noise_from_a_walk():
    noise = np.random.default_rng(3).normal(size=400)
    assert dickey_fuller(noise) < -10
    assert dickey_fuller(np.cumsum(noise)) > -2.86


def test_autoregression_follows_a_cycle():
    y = 100 + 10 * np.sin(2 * np.pi * np.arange(120) / 12)
    point, _ = fit_autoregressive(y, 12, 10, 1e-6)
    np.testing.assert_allclose(point, 100 + 10 * np.sin(2 * np.pi * np.arange(120, 132) / 12), atol=0.5)


@pytest.mark.parametrize("model", [ops.forecast_arima, ops.forecast_autoregressive,
                                   ops.forecast_trend_seasonal, ops.forecast_mean,
                                   ops.forecast_fallback])
def test_every_model_gives_future_rows_per_series(spark, model):
    rng = random.Random(5)
    both = series(spark, [20 + 5 * (i % 7) + rng.random() for i in range(90)]).unionByName(
        series(spark, [9 + rng.random() for _ in range(60)], "b"))
    rows = model(both, 30).collect()
    assert {r.category for r in rows} == {"a", "b"} and len(rows) == 60
    last = {"a": D0 + dt.timedelta(days=89), "b": D0 + dt.timedelta(days=59)}
    for r in rows:
        assert last[r.category] < r.ds <= last[r.category] + dt.timedelta(days=30)
        assert r.lower_bound <= r.amount <= r.upper_bound
    assert set(model(both, 1).columns) == {"forecaster", "category", "ds", "amount", "lower_bound",
                                           "upper_bound"}


def test_short_series_are_left_to_the_mean(spark):
    short = series(spark, [4.0, 6.0])
    assert ops.forecast_arima(short, 5).isEmpty()
    assert ops.forecast_autoregressive(short, 5).isEmpty()
    assert ops.forecast_trend_seasonal(short, 5).isEmpty()
    single = series(spark, [4.0])
    assert ops.forecast_trend_seasonal(single, 5).isEmpty()
    assert ops.stationarity_test(single).first().d == 1
    row = ops.forecast_mean(short, 1, short_only=True).first()
    assert (row.amount, row.upper_bound) == (5.0, pytest.approx(5 + 2 ** 0.5))
    one = ops.forecast_mean(series(spark, [50.0]), 1).first()
    assert (one.lower_bound, one.upper_bound) == (45.0, 55.0)
    assert ops.forecast_mean(series(spark, range(9)), 1, short_only=True).isEmpty()


def test_fallback_levels(spark):
    s = series(spark, [1.0, 2.0, 6.0])
    assert ops.forecast_fallback(s, 1).first().amount == 3.0
    last = ops.forecast_fallback(s, 1, level="last").first()
    assert (last.amount, last.lower_bound, last.upper_bound) == (6.0, pytest.approx(4.8), pytest.approx(7.2))


def test_trend_seasonal_repeats_the_week(spark):
    week = [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0]
    rows = ops.forecast_trend_seasonal(series(spark, [100 * week[i % 7] for i in range(140)]), 7)
    values = [r.amount for r in rows.orderBy("ds").collect()]
    np.testing.assert_allclose(values, [100 * w for w in week], rtol=0.1)


def test_trend_seasonal_does_not_depend_on_the_days_ahead(spark):
    """The trend of a falling series meets zero only in the far future."""
    falling = series(spark, [(100 - i) * (1.5 if i % 7 == 0 else 1.0) for i in range(70)])
    near, far = (ops.forecast_trend_seasonal(falling, days).orderBy("ds").limit(7).collect()
                 for days in (7, 90))
    assert [r.ds for r in near] == [r.ds for r in far]
    np.testing.assert_allclose([r.amount for r in near], [r.amount for r in far], rtol=1e-9)


def test_trend_seasonal_regressor(spark):
    rng = random.Random(8)
    sale = [float(rng.random() < 0.4) for _ in range(200)]
    rows = [("a", D0 + dt.timedelta(days=i), 100 + 50 * x, x) for i, x in enumerate(sale)]
    both = spark.createDataFrame(rows, "category string, date date, amount double, sale double")
    history = both.filter(F.col("date") < F.lit(D0 + dt.timedelta(days=190)))
    ahead = both.drop("amount").filter(F.col("date") >= F.lit(D0 + dt.timedelta(days=190)))
    got = ops.forecast_trend_seasonal(history, 10, regressors=["sale"], future=ahead).orderBy("ds")
    for r, x in zip(got.collect(), sale[190:]):
        assert r.amount == pytest.approx(100 + 50 * x, abs=25)
        assert abs(r.amount - (100 + 50 * x)) < abs(r.amount - (150 - 50 * x))
    with pytest.raises(ValueError):
        ops.forecast_trend_seasonal(history, 10, regressors=["sale"])


def test_ensemble_uses_common_dates_and_shortest_model(spark):
    rows = [("arima", "a", i, 10) for i in range(3)] + [("prophet", "a", i, 20) for i in range(1, 6)]
    rows += [("arima", "b", 0, 7)]
    fc = forecasts(spark, rows)
    got = {(r.category, (r.ds - D0).days): r.amount for r in ops.ensemble_forecast(fc).collect()}
    assert got == {("a", 1): pytest.approx(16.0), ("a", 2): pytest.approx(16.0), ("b", 0): 7.0}
    simple = ops.ensemble_forecast(fc, "simple_average").filter("category = 'a'").first()
    assert (simple.amount, simple.lower_bound) == (15.0, 14.0)
    assert ops.ensemble_forecast(fc, "unknown").filter("category = 'a'").first().amount == pytest.approx(16.0)


def test_weights(spark):
    w = spark.createDataFrame([("arima", 0.4), ("prophet", 0.6), ("x", 1.0)], "forecaster string, weight double")
    got = {r.forecaster: r.weight for r in ops.normalize_weights(w).collect()}
    assert got == {"arima": 0.2, "prophet": 0.3, "x": 0.5}
    assert ops.default_weight("arima", 0) == 0.4 and ops.default_weight("x", 1) == pytest.approx(1 / 3)
    # Renormalising after each addition would drift to 0.625 / 0.375 for these two.
    first = 0.4 / 0.4
    assert first / (first + 0.6) == pytest.approx(0.625)


def test_metrics_are_positional_and_guard_zero(spark):
    actual = series(spark, [10, 20, 0, 40], "a").unionByName(series(spark, [10, 20], "b"))
    fc = forecasts(spark, [("m", "a", i + 50, 12) for i in range(3)] + [("m", "b", i, 12) for i in range(9)])
    got = {r.category: r for r in score.forecast_metrics(fc, actual).collect()}
    assert got["a"].mae == pytest.approx((2 + 8 + 12) / 3) and got["a"].mape is None
    assert got["a"].rmse == pytest.approx(((4 + 64 + 144) / 3) ** 0.5)
    assert got["b"].mape == pytest.approx((0.2 + 0.4) / 2 * 100)


def test_best_forecaster_tie_and_direction(spark):
    m = spark.createDataFrame(
        [("z", "a", "rmse", 1.0), ("b", "a", "rmse", 1.0), ("c", "a", "rmse", 3.0)],
        "forecaster string, category string, metric string, value double")
    assert score.best_forecaster(m).first().forecaster == "b"
    assert score.best_forecaster(m, lower_is_better=False).first().forecaster == "c"
    best = score.evaluation_table(m).filter("is_best").collect()
    assert [r.forecaster for r in best] == ["b"]


def test_scale_round_trip_and_constant(spark):
    both = ops.minmax_inverse(ops.minmax_scale(series(spark, [2, 4, 6]).unionByName(series(spark, [3, 3], "b"))))
    for r in both.collect():
        assert 0 <= r.scaled <= 1 and r.restored == r.amount


def test_sequences_need_three_times_n(spark):
    s = series(spark, range(9)).unionByName(series(spark, range(5), "b"))
    got = ops.make_sequences(s, 3).orderBy("date").collect()
    assert {r.category for r in got} == {"a"} and len(got) == 6
    assert got[0].inputs == [0.0, 1.0, 2.0] and got[0].target == 3.0


def test_stationarity_short_and_choice(spark):
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(size=300))
    s = series(spark, rng.normal(size=300), "noise").unionByName(series(spark, walk, "walk")).unionByName(
        series(spark, range(10), "short"))
    got = {r.category: r for r in ops.stationarity_test(s).collect()}
    assert (got["noise"].is_stationary, got["noise"].d) == (True, 0)
    assert (got["walk"].is_stationary, got["walk"].d) == (False, 1)
    assert (got["short"].is_stationary, got["short"].d) == (False, 1)
    assert got["walk"].t_stat_0 == pytest.approx(dickey_fuller(walk))


def test_split_keeps_order(spark):
    parts = ops.chrono_split(series(spark, range(11)), min_points=10).orderBy("date").collect()
    assert [r.part for r in parts] == ["train"] * 8 + ["test"] * 3
    assert ops.chrono_split(series(spark, range(9)), min_points=10).isEmpty()


def test_highlights_take_the_first_of_equal_peaks(spark):
    fc = forecasts(spark, [("m", "a", 3, 9), ("m", "b", 1, 9), ("m", "b", 2, 4)])
    row = ops.forecast_highlights(fc).first()
    assert row.highest_date == D0 + dt.timedelta(days=1)
    assert row.total_forecast == 22 and row.categories == 2


def test_forecast_per_freq(spark):
    rng = random.Random(4)
    rows = [(dt.datetime(2021, 1, 1) + dt.timedelta(hours=7 * i), c, -rng.uniform(5, 50))
            for i in range(1600) for c in ("food", "rent")]
    df = spark.createDataFrame(rows, "transaction_date timestamp, category string, amount double")
    models = {"mean": ops.forecast_mean, "arima": ops.forecast_arima}
    fc, metrics = jobs.forecast_per_freq(df, models, horizon=5)
    seen = {(r.freq, r.forecaster) for r in fc.select("freq", "forecaster").distinct().collect()}
    assert seen == {(f, m) for f in "DWM" for m in ("mean", "arima", "ensemble")}
    assert metrics.filter("value < 0").isEmpty() and not metrics.isEmpty()


def test_train_on_history_needs_category(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), -1.0)], "transaction_date timestamp, amount double")
    with pytest.raises(ValueError, match="category"):
        jobs.train_on_history(df, ops.forecast_mean)


def test_fit_predict_names_models(spark):
    with pytest.raises(ValueError):
        ops.fit_predict(series(spark, range(20)), {}, 3)
    out = ops.fit_predict(series(spark, range(20)), {"one": ops.forecast_mean, "two": ops.forecast_fallback}, 3)
    assert {r.forecaster for r in out.collect()} == {"one", "two"}
    assert out.filter(F.col("ds") <= F.lit(D0)).isEmpty()
