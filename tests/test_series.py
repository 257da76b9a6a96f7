"""Pandas semantics of the series features, on generated tables."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import calendar as cal
from tallyframe.functions.stats import exact_quantiles
from tallyframe.operators import timeseries as ops


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(42)
    start = dt.datetime(2022, 12, 20, 7, 30)
    data = []
    for i in range(300):
        day = start + dt.timedelta(days=rng.randrange(100), minutes=rng.randrange(900))
        amount = round(rng.uniform(-200, -5), 2) if rng.random() > 0.1 else 1500.0
        data.append((day, rng.choice(["food", "transport", "housing", "health"]), amount))
    return pd.DataFrame(data, columns=["transaction_date", "category", "amount"])


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def panda(sdf, order):
    return sdf.toPandas().sort_values(order).reset_index(drop=True)


@pytest.mark.parametrize("freq, alias", [("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("Y", "YE")])
def test_series_match_pandas(df, frame, freq, alias):
    order = ["transaction_date", "category"]
    want = frame.groupby([pd.Grouper(key="transaction_date", freq=alias), "category"]).agg(
        amount_sum=("amount", "sum"), amount_count=("amount", "count"), amount_mean=("amount", "mean")
    ).reset_index().sort_values(order)
    got = panda(ops.to_time_series(df, freq), order)
    assert list(pd.to_datetime(got.transaction_date)) == list(want.transaction_date.dt.normalize())
    np.testing.assert_allclose(got.amount_sum, want.amount_sum)
    np.testing.assert_allclose(got.amount_mean, want.amount_mean)


@pytest.mark.parametrize("freq, alias", [("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("Y", "YE")])
def test_dense_series_match_pandas(df, frame, freq, alias):
    one = frame[frame.category == "food"]
    want = one.groupby(pd.Grouper(key="transaction_date", freq=alias))["amount"].agg(
        ["sum", "count", "mean"]).reset_index()
    got = panda(ops.to_dense_series(df.filter("category = 'food'"), freq), "transaction_date")
    assert list(pd.to_datetime(got.transaction_date)) == list(want.transaction_date.dt.normalize())
    np.testing.assert_allclose(got.amount_sum, want["sum"], atol=1e-9)
    np.testing.assert_array_equal(got.amount_count, want["count"])
    np.testing.assert_allclose(got.amount_mean, want["mean"])


def test_features_match_pandas(df):
    series = ops.to_time_series(df)
    got = panda(ops.time_series_features(df), ["category", "transaction_date"])
    base = panda(series, ["category", "transaction_date"])
    groups = base.groupby("category")["amount_sum"]
    for n in (1, 7, 30):
        np.testing.assert_allclose(got[f"amount_sum_lag_{n}"], groups.shift(n))
        np.testing.assert_allclose(got[f"amount_sum_pct_change_{n}"], groups.pct_change(n))
    for n in (7, 14, 30):
        mean = groups.transform(lambda x, n=n: x.rolling(n, min_periods=1).mean())
        std = groups.transform(lambda x, n=n: x.rolling(n, min_periods=3).std())
        np.testing.assert_allclose(got[f"amount_sum_rolling_mean_{n}"], mean)
        np.testing.assert_allclose(got[f"amount_sum_rolling_std_{n}"], std)
    z = (base.amount_sum - groups.transform("mean")) / groups.transform("std")
    np.testing.assert_array_equal(got.amount_sum_is_outlier, (z.abs() > 3).astype(int))
    days = pd.to_datetime(base.transaction_date)
    np.testing.assert_array_equal(got.dayofweek, days.dt.dayofweek)
    np.testing.assert_array_equal(got.is_month_end, days.dt.is_month_end.astype(int))
    np.testing.assert_array_equal(got.is_holiday, days.dt.strftime("%m%d").isin(["0101", "0704", "1225"]))


def test_features_share_one_shuffle(df):
    plan = ops.time_series_features(df, guard=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(category") == 1


def test_pct_change_guard(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "a", float(i)) for i in range(5)]
    s = spark.createDataFrame(rows, "transaction_date date, category string, amount_sum double")
    guarded = ops.pct_change_features(s, lags=(1,), guard=True).select("amount_sum_pct_change_1")
    assert {r[0] for r in guarded.collect()} == {None}
    forced = ops.pct_change_features(s, lags=(1,)).orderBy("transaction_date").collect()
    assert [r.amount_sum_pct_change_1 for r in forced] == [None, None, 1.0, 0.5, pytest.approx(1 / 3)]


def test_fill_gaps_per_series(spark):
    d = dt.date
    rows = [("a", d(2020, 1, 1), 1.0), ("a", d(2020, 1, 4), 2.0), ("b", d(2020, 1, 3), 5.0)]
    s = spark.createDataFrame(rows, "category string, date date, amount double")
    got = sorted(tuple(r) for r in ops.fill_gaps(s).collect())
    assert got == [("a", d(2020, 1, 1), 1.0), ("a", d(2020, 1, 2), 0.0), ("a", d(2020, 1, 3), 0.0),
                   ("a", d(2020, 1, 4), 2.0), ("b", d(2020, 1, 3), 5.0)]


def test_iqr_and_constant_series(spark):
    rows = [(dt.date(2020, 1, i + 1), "a", float(v)) for i, v in enumerate([1, 2, 3, 4, 100])]
    rows += [(dt.date(2020, 1, i + 1), "b", 7.0) for i in range(5)]
    s = spark.createDataFrame(rows, "transaction_date date, category string, amount_sum double")
    iqr = ops.outliers_iqr(s, threshold=1.5).filter("amount_sum_is_outlier = 1").collect()
    assert [(r.category, r.amount_sum) for r in iqr] == [("a", 100.0)]
    assert ops.outliers_zscore(s).agg(F.sum("amount_sum_is_outlier")).first()[0] == 0


@pytest.mark.parametrize("day, week, quarter", [
    ("2023-01-01", "2023-01-01", "2023-03-31"),
    ("2023-01-02", "2023-01-08", "2023-03-31"),
    ("2024-02-29", "2024-03-03", "2024-03-31"),
    ("2024-12-31", "2025-01-05", "2024-12-31"),
])
def test_labels(spark, day, week, quarter):
    df = spark.createDataFrame([(day + " 23:59:59",)], "t string").select(F.col("t").cast("timestamp"))
    row = df.select(cal.period_label(F.col("t"), "W"), cal.period_label(F.col("t"), "Q")).first()
    assert tuple(map(str, row)) == (week, quarter)
    with pytest.raises(ValueError):
        cal.period_label(F.col("t"), "H")


@pytest.mark.parametrize("small", [1, 50, 1_000_000])
def test_exact_quantiles_with_hot_values(spark, small):
    rng = random.Random(7)
    values = [0.0] * 4000 + [rng.lognormvariate(0, 3) for _ in range(5000)] + [1.5] * 3000
    other = [None if i % 3 else float("nan") if i % 6 else float(i) for i in range(len(values))]
    data = spark.createDataFrame(list(zip(values, other)), "x double, y double").repartition(8)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = exact_quantiles(data, ["x", "y"], probs, small=small).collect()
    frames = {"x": pd.Series(values), "y": pd.Series(other, dtype=float)}
    assert len(got) == 14
    for r in got:
        assert r.quantile == pytest.approx(frames[r.column_name].quantile(r.prob))


def test_dense_series_is_checked_on_all_transactions(spark, sf_dir):
    import __spark_entry__ as contract
    from checks.base import tx

    total = tx(spark, sf_dir).where("amount is not null").count()
    for suffix in ("", "_weekly", "_monthly", "_quarterly", "_yearly"):
        rows = contract.queries()[f"to_dense_series_all{suffix}"](spark, sf_dir).collect()
        assert sum(r.amount_count for r in rows) == total
