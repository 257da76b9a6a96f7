"""Least squares inside the JVM against direct solutions in numpy."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import least_squares as ls
from tallyframe.functions.series_fit import _inside, fit_arima, fit_autoregressive
from tallyframe.operators import forecasting as ops
from tallyframe.operators.lag_models import unit_root_p_value

D0 = dt.date(2020, 1, 1)


def table(spark, named):
    rows = [(c, D0 + dt.timedelta(days=i), float(v)) for c, y in named.items()
            for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "category string, date date, amount double")


def by_series(df):
    out = {}
    for r in df.orderBy("category", "ds").collect():
        out.setdefault(r.category, []).append((r.amount, r.lower_bound, r.upper_bound))
    return {c: np.array(v) for c, v in out.items()}


def processes():
    rng = np.random.default_rng(7)
    noise = rng.normal(size=400)
    ar, walk, smooth = np.zeros(400), 1e5 + np.cumsum(noise) * 50, np.zeros(400)
    for t in range(3, 400):
        ar[t] = 5 + 0.5 * ar[t - 1] - 0.3 * ar[t - 2] + 0.2 * ar[t - 3] + noise[t]
        smooth[t] = smooth[t - 1] + 0.6 * (smooth[t - 1] - smooth[t - 2]) + noise[t]
    return {"ar": ar, "walk": walk, "smooth": smooth, "short": noise[:11] + 9, "flat": [4.0] * 30,
            "line": 3.0 * np.arange(50), "noise": 1e6 + noise}


@pytest.mark.parametrize("orders", [
    [(1, 0, 0)], [(2, 1, 0)], [(0, 0, 0), (0, 1, 0), (0, 2, 0)], [(3, 2, 0), (1, 2, 0)],
    list(ops.LAG_ORDERS)])
def test_lag_orders_equal_the_direct_fit(spark, orders):
    named = processes()
    got = by_series(ops.forecast_arima(table(spark, named), 20, orders=orders))
    assert set(got) == set(named)
    for name, y in named.items():
        if name in ("flat", "line"):  # nothing is left to explain; any order may be taken
            assert np.isfinite(got[name]).all()
            continue
        want = np.column_stack(fit_arima(np.array(y, float), 20, orders=orders))
        np.testing.assert_allclose(got[name], want, rtol=1e-6, atol=1e-6, err_msg=name)


def test_search_by_lags(spark):
    named = processes()
    got = by_series(ops.forecast_arima(table(spark, named), 5, search="lags"))
    want = np.column_stack(fit_arima(named["ar"], 5, orders=ops.LAG_ORDERS))
    np.testing.assert_allclose(got["ar"], want, rtol=1e-6)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_autoregression_equals_the_direct_fit(spark, n):
    named = {k: v for k, v in processes().items() if len(v) >= 3 * n}
    got = by_series(ops.forecast_autoregressive(table(spark, named), 15, n=n))
    assert set(got) == set(named)
    for name, y in named.items():
        if name in ("flat", "line"):
            continue
        point, std = fit_autoregressive(np.array(y, float), 15, n, 1e-3)
        scale = np.ptp(y)
        np.testing.assert_allclose(got[name][:, 0], point, atol=1e-5 * scale)
        np.testing.assert_allclose(got[name][:, 2] - point, 1.96 * std, atol=1e-5 * scale)


def test_solve_and_stable(spark):
    rng = np.random.default_rng(3)
    for size in (1, 2, 6):
        x = rng.normal(size=(40, size))
        left, right = x.T @ x, rng.normal(size=size)
        rows = F.array(*[F.array(*map(F.lit, [*map(float, left[i]), float(right[i])]))
                         for i in range(size)])
        got = spark.range(1).select(ls.solve(rows).alias("x"),
                                    ls.inverse_diagonal(rows, size - 1).alias("v")).first()
        np.testing.assert_allclose(got.x, np.linalg.solve(left, right), rtol=1e-8)
        assert got.v == pytest.approx(np.linalg.inv(left)[-1, -1])
    coefs = [list(map(float, rng.uniform(-1.5, 1.5, k))) for k in (1, 2, 3, 4) for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(coefs)], "i int, c array<double>")
    for r in df.select("i", ls.stable(F.col("c")).alias("ok")).collect():
        assert r.ok == _inside(np.array(coefs[r.i]))
    empty = spark.range(1).select(F.array().cast("array<double>").alias("c"))
    assert empty.select(ls.stable(F.col("c"))).first()[0]


def design(days, span, weekly, yearly, changepoints):
    day = np.array([(D0 + dt.timedelta(days=int(i)) - dt.date(1970, 1, 1)).days for i in days])
    t = days / span
    turns = [0.8 * (j + 1) / (changepoints + 1) for j in range(changepoints)]
    columns = [np.ones_like(t), t, *[np.maximum(t - c, 0) for c in turns]]
    for period, order in ((7, weekly), (365.25, yearly)):
        for k in range(1, order + 1):
            columns += [np.sin(2 * np.pi * k * day / period), np.cos(2 * np.pi * k * day / period)]
    return np.column_stack(columns)


@pytest.mark.parametrize("size, yearly", [(1100, 2), (300, 0)])
def test_fourier_equals_the_direct_fit(spark, size, yearly):
    rng = np.random.default_rng(size)
    i = np.arange(size)
    y = 200 + 0.3 * i + np.where(i > 150, 0.5 * (i - 150), 0) + 20 * np.sin(
        2 * np.pi * i / 7) + 40 * np.cos(2 * np.pi * i / 365.25) + rng.normal(size=size)
    got = by_series(ops.forecast_fourier(table(spark, {"a": y}), 40))["a"]
    x = design(i, size - 1, 3, yearly, 4)
    scale, ridge = np.abs(y).mean(), 0.05 * size * np.eye(x.shape[1])
    ridge[:2, :2] = 0
    coefs = np.linalg.solve(x.T @ x + ridge, x.T @ (y / scale))
    ahead = design(np.arange(size, size + 40), size - 1, 3, yearly, 4) @ coefs * scale
    np.testing.assert_allclose(got[:, 0], ahead, rtol=1e-6)
    std = np.std(y - x @ coefs * scale, ddof=1)
    np.testing.assert_allclose(got[:, 2] - got[:, 0], 1.96 * std, rtol=1e-6)


def test_fourier_follows_weeks_years_and_turns(spark):
    i = np.arange(1200)
    y = 500 + 30 * np.sin(2 * np.pi * i / 7) + 80 * np.cos(2 * np.pi * i / 365.25)
    ahead = np.arange(1200, 1260)
    want = 500 + 30 * np.sin(2 * np.pi * ahead / 7) + 80 * np.cos(2 * np.pi * ahead / 365.25)
    # The multiplicative form fits the trend first, which takes up part of a year that is not whole.
    for form, off in (("additive", 3), ("multiplicative", 15)):
        got = by_series(ops.forecast_fourier(table(spark, {"a": y}), 60, penalty=1e-4, form=form,
                                              changepoints=0))
        np.testing.assert_allclose(got["a"][:, 0], want, atol=off)
    turned = np.where(i < 600, i, 600 - 2.0 * (i - 600)) + 1000
    got = by_series(ops.forecast_fourier(table(spark, {"a": turned}), 10, penalty=1e-5))["a"]
    assert (np.diff(got[:, 0]) < -1.5).all()


@pytest.mark.parametrize("model", [
    ops.forecast_trend_seasonal, ops.forecast_fourier,
    lambda s, d: ops.forecast_fourier(s, d, form="multiplicative")])
def test_a_series_that_falls_to_zero_does_not_swing(spark, model):
    rng = np.random.default_rng(11)
    for seed in range(3):
        y = np.linspace(100, 0, 90) + rng.normal(scale=8, size=90)
        got = by_series(model(table(spark, {"a": y}), 30))["a"]
        line = np.polyval(np.polyfit(np.arange(90), y, 1), np.arange(90, 120))
        assert np.abs(got[:, 0] - line).max() < 30


def slow_augmented(y, max_lags):
    y = y - y.mean()
    change = np.diff(y)
    target = change[max_lags:]
    best = None
    for k in range(max_lags + 1):
        x = np.column_stack([np.ones(len(target)), y[max_lags:-1],
                             *[change[max_lags - j:len(change) - j] for j in range(1, k + 1)]])
        coef, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = float(((target - x @ coef) ** 2).sum())
        aic = len(target) * np.log(rss / len(target)) + 2 * x.shape[1]
        error = np.sqrt(rss / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        if best is None or aic < best[0]:
            best = aic, k, coef[1] / error
    return best[1:]


def test_augmented_test_equals_the_direct_fit(spark):
    named = {k: v for k, v in processes().items() if k not in ("flat", "line", "short")}
    got = {r.category: r for r in ops.augmented_test(table(spark, named)).collect()}
    plain = {r.category: r for r in ops.augmented_test(table(spark, named), max_lags=0).collect()}
    old = {r.category: r for r in ops.stationarity_test(table(spark, named)).collect()}
    for name, y in named.items():
        for i in range(3):
            lags, t = slow_augmented(np.diff(y, i), 4)
            assert (got[name][f"lags_{i}"], got[name][f"t_stat_{i}"]) == (
                lags, pytest.approx(t, rel=1e-5))
            assert plain[name][f"t_stat_{i}"] == pytest.approx(old[name][f"t_stat_{i}"], rel=1e-6)
        assert plain[name].d == old[name].d
    assert got["walk"].d == 1 and got["ar"].is_stationary and got["smooth"].d >= 1
    odd = ops.augmented_test(table(spark, {"flat": [4.0] * 30, "one": [1.0]})).collect()
    assert {r.category: (r.d, r.is_stationary) for r in odd} == {
        "flat": (1, False), "one": (1, False)}


def test_p_values(spark):
    points = {-3.43: 0.01, -2.86: 0.05, -2.57: 0.10, 0.6: 0.987}
    for t, p in points.items():
        got = spark.range(1).select(unit_root_p_value(F.lit(t))).first()[0]
        assert got == pytest.approx(p, abs=0.003)
    for x in (-4.0, -1.0, 0.0, 0.3, 2.5):
        got = spark.range(1).select(ls.normal_cdf(F.lit(x))).first()[0]
        assert got == pytest.approx(NormalDist().cdf(x), abs=1e-7)


def test_odd_tables(spark):
    empty = table(spark, {}).limit(0)
    for model in (ops.forecast_lag_orders, ops.forecast_autoregressive, ops.forecast_fourier):
        assert model(empty, 3).collect() == []
    gap = table(spark, {"a": range(40)}).withColumn(
        "amount", F.when(F.dayofmonth("date") != 12, F.col("amount")))
    for model in (ops.forecast_lag_orders, ops.forecast_autoregressive, ops.forecast_fourier):
        rows = model(gap, 3).collect()
        assert len(rows) == 3 and all(np.isfinite(r.amount) for r in rows)
    with pytest.raises(ValueError):
        ops.forecast_fourier(empty, 3, form="other")
