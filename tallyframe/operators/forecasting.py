"""Forecasts of many series at once.

A series table is ``(*keys, date, amount)``, one row per day, without gaps. All forecasters return
the ``FORECAST`` columns. Only model fitting leaves the JVM: ``applyInPandas`` gets one series at a
time, and a series has one row per day however many transactions went into it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyframe.functions import calendar as cal
from tallyframe.functions.filters import not_null
from tallyframe.functions.series_fit import fit_arima
from tallyframe.operators.cleaning import select_expenses
from tallyframe.operators.lag_models import (  # noqa: F401
    augmented_test,
    forecast_autoregressive,
    forecast_fourier,
    forecast_lag_orders,
)
from tallyframe.operators.timeseries import CATEGORY, DATE, fill_gaps
from tallyframe.session import materialize

# Fixed values.
MIN_POINTS = 10
SHORT_SERIES = 5
ADF_MIN_POINTS = 20
DF_CRITICAL = -2.86
Z95 = 1.96
FALLBACK_LEVEL = 100.0
# A trend that comes below this share of the mean is not divided by.
NEAR_ZERO = 0.05
# The trend and season model stands where the second one does.
DEFAULT_WEIGHTS = {"arima": 0.4, "prophet": 0.6, "trend_seasonal": 0.6}
DEFAULT_MODELS = 2
LAG_ORDERS = tuple((p, d, 0) for p in range(4) for d in range(2))


class Forecaster(Protocol):
    """A pluggable model: series in, ``FORECAST`` rows out."""

    def __call__(self, series: DataFrame, days: int, keys: Sequence[str] = CATEGORY) -> DataFrame: ...


def fit_predict(
    series: DataFrame, models: dict[str, Forecaster], days: int, keys: Sequence[str] = CATEGORY
) -> DataFrame:
    """Run several forecasters over the same series; ``forecaster`` names the model of a row."""
    out = None
    for name, model in models.items():
        rows = model(series, days, keys=keys).withColumn("forecaster", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("No forecasters given")
    return out


def daily_spending_series(
    df: DataFrame, keys: Sequence[str] = CATEGORY, mode: str = "signed"
) -> DataFrame:
    """Daily spending per series, gaps filled with 0; one series ``all`` without categories."""
    spending = select_expenses(not_null(df, DATE), mode)
    if "category" in keys and "category" not in df.columns:
        spending = spending.withColumn("category", F.lit("all"))
    daily = (
        not_null(spending, *keys)
        .groupBy(*keys, F.to_date(DATE).alias("date"))
        .agg(F.sum("spending").alias("amount"))
    )
    return fill_gaps(daily, keys)


def chrono_split(
    series: DataFrame,
    test_size: float = 0.2,
    keys: Sequence[str] = CATEGORY,
    date: str = "date",
    min_points: int = 0,
) -> DataFrame:
    """Adds ``part``: ``train`` for the first rows of each series by date, ``test`` for the rest.
    Series shorter than ``min_points`` are left out."""
    w = Window.partitionBy(*keys)
    rows = series.withColumns(
        {"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(date))}
    )
    cut = F.floor(F.col("_n") * F.lit(1 - test_size))
    part = F.when(F.col("_i") <= cut, "train").otherwise("test")
    return rows.filter(F.col("_n") >= min_points).withColumn("part", part).drop("_n", "_i")


def difference(
    series: DataFrame,
    d: int = 1,
    keys: Sequence[str] = CATEGORY,
    date: str = "date",
    value: str = "amount",
) -> DataFrame:
    """Differences of order ``d``; the first ``d`` rows of each series drop out."""
    w = Window.partitionBy(*keys).orderBy(date)
    for _ in range(d):
        series = series.withColumn(value, F.col(value) - F.lag(value).over(w))
    return series.filter(F.col(value).isNotNull())


def _df_statistic(change: str, level: str) -> Column:
    """t statistic of the slope of change on level: slope / standard error."""
    n = F.regr_count(change, level)
    sxx, sxy, syy = (f(change, level) for f in (F.regr_sxx, F.regr_sxy, F.regr_syy))
    slope = F.try_divide(sxy, sxx)
    residual = syy - slope * sxy
    return F.try_divide(slope, F.sqrt(F.try_divide(F.try_divide(residual, n - 2), sxx)))


def stationarity_test(
    series: DataFrame,
    keys: Sequence[str] = CATEGORY,
    date: str = "date",
    value: str = "amount",
) -> DataFrame:
    """Dickey-Fuller statistics of the series and its first and second difference, and the order
    ``d`` they lead to. The regression has a constant and no lagged changes, compared with the 5 %
    critical value; a series below 20 points counts as not stationary."""
    w = Window.partitionBy(*keys).orderBy(date)
    names = ["_y0", "_y1", "_y2", "_y3"]
    rows = series.withColumn("_y0", F.col(value))
    for before, after in zip(names, names[1:]):
        rows = rows.withColumn(after, F.col(before) - F.lag(before).over(w))
    rows = rows.withColumns({f"{n}_prev": F.lag(n).over(w) for n in names[:3]})
    tests = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[_df_statistic(names[i + 1], f"_y{i}_prev").alias(f"t_stat_{i}") for i in range(3)],
    )
    steady = [
        F.coalesce((F.col("n") - i >= ADF_MIN_POINTS) & (F.col(f"t_stat_{i}") < DF_CRITICAL),
                   F.lit(False))
        for i in range(3)
    ]
    order = F.when(steady[0], 0).when(steady[1], 1).when(steady[2], 2).otherwise(1)
    return tests.withColumns({"is_stationary": steady[0], "d": order})


def _spread(
    levels: DataFrame, name: str, days: int, keys: Sequence[str], low: Column, high: Column
) -> DataFrame:
    """One row per future day from one row ``(*keys, last, level)`` per series."""
    first, last = F.date_add("last", 1), F.date_add("last", days)
    return levels.select(
        F.lit(name).alias("forecaster"),
        *keys,
        F.explode(F.sequence(first, last)).alias("ds"),
        F.col("level").alias("amount"),
        low.alias("lower_bound"),
        high.alias("upper_bound"),
    )


def forecast_mean(
    series: DataFrame, days: int = 30, keys: Sequence[str] = CATEGORY, short_only: bool = False
) -> DataFrame:
    """The mean with one sample deviation either side; a tenth of the mean for a single point.
    ``short_only`` keeps the series that are too short for another model."""
    stats = series.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("amount").alias("level"),
        F.stddev_samp("amount").alias("std"),
        F.max("date").alias("last"),
    )
    if short_only:
        stats = stats.filter(F.col("n") < SHORT_SERIES)
    std = F.when(F.col("n") > 1, F.col("std")).otherwise(F.abs("level") * 0.1)
    level = F.col("level")
    return _spread(stats, "mean", days, keys, level - std, level + std)


def forecast_fallback(
    series: DataFrame, days: int = 30, keys: Sequence[str] = CATEGORY, level: str = "mean"
) -> DataFrame:
    """A flat level with bounds at 0.8 and 1.2 of it, 100 where nothing is known. The level stored
    with a fitted model is the mean of its series; ``level="last"`` takes the last value."""
    found = F.avg("amount") if level == "mean" else F.max_by("amount", "date")
    stats = series.groupBy(*keys).agg(
        F.coalesce(found, F.lit(FALLBACK_LEVEL)).alias("level"), F.max("date").alias("last")
    )
    value = F.col("level")
    return _spread(stats, "fallback", days, keys, value * 0.8, value * 1.2)


def _per_series(
    series: DataFrame,
    keys: Sequence[str],
    name: str,
    fit: Callable[[pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    types = dict(series.dtypes)
    columns = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{columns}, ds date, amount double, lower_bound double, upper_bound double"
    keys = list(keys)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        out = fit(rows)
        for column, value in zip(keys, key):
            out[column] = value
        return out[[*keys, "ds", "amount", "lower_bound", "upper_bound"]]

    fitted = series.select(*keys, "date", "amount").groupBy(*keys).applyInPandas(one, schema)
    return fitted.select(F.lit(name).alias("forecaster"), "*")


def _future(rows: pd.DataFrame, days: int) -> pd.Series:
    last = pd.Timestamp(rows["date"].iloc[-1])
    return pd.Series(pd.date_range(last + pd.Timedelta(days=1), periods=days).date)


def forecast_arima(
    series: DataFrame,
    days: int = 30,
    keys: Sequence[str] = CATEGORY,
    search: str = "grid",
    alpha: float = 0.05,
    orders: Sequence[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """Order search by AIC, then point forecasts with an interval, for series of 10 points or more;
    ``forecast_spending`` covers shorter ones. ``grid`` tries p 0-2, d 0-1, q 0-2; ``auto`` lets a
    unit-root test pick d and tries p, q 0-3; ``lags`` tries p 0-3, d 0-1 without moving averages;
    ``orders`` names the orders to try. Orders without a moving average are fitted inside the JVM, for
    all series at once; those with one need innovations, and run on one series at a time in Python."""
    if search == "lags" and orders is None:
        orders = LAG_ORDERS
    if orders is not None and all(q == 0 for _, _, q in orders):
        return forecast_lag_orders(series, days, keys, orders, alpha)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < MIN_POINTS:
            return pd.DataFrame(columns=["ds", "amount", "lower_bound", "upper_bound"])
        point, low, high = fit_arima(
            rows["amount"].to_numpy(float), days, search, alpha, orders)
        return pd.DataFrame(
            {"ds": _future(rows, days), "amount": point, "lower_bound": low, "upper_bound": high}
        )

    return _per_series(series, keys, "arima", fit)


def forecast_trend_seasonal(
    series: DataFrame,
    days: int = 30,
    keys: Sequence[str] = CATEGORY,
    regressors: Sequence[str] = (),
    future: DataFrame | None = None,
) -> DataFrame:
    """Linear trend times weekday index times month index, with a 95 % interval from the residuals.
    Where the trend comes near zero on a known day, the indexes are added to it instead: shares of
    next to nothing would swing without bound.

    ``regressors`` names further numeric columns of the series. Each takes up what the fit before it
    left over, by least squares; ``future`` has one row ``(*keys, date, *regressors)`` per day ahead.

    History and future days form one table, the future with unknown values. Averages over the
    windows of a series skip those values yet reach those rows, so no lookup joins are needed and
    every window is served by one shuffle.
    """
    keys = list(keys)
    last = F.max("date")
    spans = series.groupBy(*keys).agg(last.alias("last"), F.count("amount").alias("n"))
    ahead = spans.filter(F.col("n") >= MIN_POINTS).select(
        *keys, F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days))).alias("date")
    )
    if regressors:
        if future is None:
            raise ValueError("Regressors need their future values")
        ahead = ahead.join(future.select(*keys, "date", *regressors), [*keys, "date"], "left")
    rows = series.select(*keys, "date", F.col("amount").alias("y"), *regressors).unionByName(
        ahead.withColumn("y", F.lit(None).cast("double"))
    )
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("t", F.datediff("date", F.min("date").over(own)).cast("double"))
    b = F.try_divide(F.regr_sxy("y", "t").over(own), F.regr_sxx("y", "t").over(own))
    a = F.avg("y").over(own) - b * F.regr_avgx("y", "t").over(own)
    rows = rows.withColumn("trend", a + b * F.col("t"))
    # The trend on known days decides for the whole series: only there is anything divided by it.
    known = F.when(F.col("y").isNotNull(), F.col("trend"))
    nearest = F.min(known).over(own) * F.signum(F.avg("y").over(own))
    farthest = F.max(known).over(own) * F.signum(F.avg("y").over(own))
    away = F.least(nearest, farthest) > NEAR_ZERO * F.abs(F.avg("y").over(own))
    rows = rows.withColumn("away", F.coalesce(away, F.lit(False)))
    rows = rows.withColumn("ratio", F.when(F.col("away"), F.try_divide("y", "trend")).otherwise(
        F.col("y") - F.col("trend")))
    one = F.when(F.col("away"), 1.0).otherwise(0.0)
    rows = rows.withColumn("wd", cal.weekday(F.col("date"))).withColumn("mo", F.month("date"))
    rows = rows.withColumn(
        "week_index", F.coalesce(F.avg("ratio").over(Window.partitionBy(*keys, "wd")), one)
    )
    rest = F.when(F.col("away"), F.try_divide("ratio", "week_index")).otherwise(
        F.col("ratio") - F.col("week_index"))
    rows = rows.withColumn("rest", rest).withColumn(
        "month_index", F.coalesce(F.avg("rest").over(Window.partitionBy(*keys, "mo")), one)
    )
    fit = F.when(F.col("away"), F.col("trend") * F.col("week_index") * F.col("month_index"))
    rows = rows.withColumn("fit", fit.otherwise(
        F.col("trend") + F.col("week_index") + F.col("month_index")))
    for name in regressors:
        rows = rows.withColumns({"_left": F.col("y") - F.col("fit"), "_x": F.col(name)})
        b = F.try_divide(F.regr_sxy("_left", "_x").over(own), F.regr_sxx("_left", "_x").over(own))
        a = F.regr_avgy("_left", "_x").over(own) - b * F.regr_avgx("_left", "_x").over(own)
        effect = F.coalesce(a + b * F.col("_x"), F.lit(0.0))
        rows = rows.withColumn("fit", F.col("fit") + effect)
    rows = rows.withColumn("std", F.stddev_samp(F.col("y") - F.col("fit")).over(own))
    future = rows.filter("y is null and fit is not null")
    return future.select(
        F.lit("trend_seasonal").alias("forecaster"),
        *keys,
        F.col("date").alias("ds"),
        F.col("fit").alias("amount"),
        (F.col("fit") - Z95 * F.col("std")).alias("lower_bound"),
        (F.col("fit") + Z95 * F.col("std")).alias("upper_bound"),
    )


def forecast_spending(
    series: DataFrame,
    days: int = 30,
    keys: Sequence[str] = CATEGORY,
    model: Forecaster = forecast_arima,
) -> DataFrame:
    """Exactly ``days`` rows for every series: those of ``model`` where it forecasts the series, else
    the mean, else the flat level for a series without any known value. ``forecaster`` names the one
    used."""
    keys = list(keys)

    def without(rows: DataFrame, done: DataFrame) -> DataFrame:
        names = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return rows.join(names, functools.reduce(lambda a, b: a & b, same), "left_anti")

    fitted = model(series, days, keys=keys)
    fitted = materialize(fitted.select("forecaster", *keys, "ds", "amount", "lower_bound",
                                       "upper_bound").where("amount is not null"))
    short = without(series, fitted)
    mean = forecast_mean(short, days, keys)
    known = mean.where("amount is not null")
    flat = forecast_fallback(without(short, known), days, keys)
    return fitted.unionByName(known).unionByName(flat)


def minmax_scale(
    series: DataFrame, keys: Sequence[str] = CATEGORY, value: str = "amount"
) -> DataFrame:
    """Adds ``scaled`` in [0, 1] per series, with ``low`` and ``high`` for the way back."""
    w = Window.partitionBy(*keys)
    rows = series.withColumns({"low": F.min(value).over(w), "high": F.max(value).over(w)})
    span = F.col("high") - F.col("low")
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("low"), span), F.lit(0.0))
    return rows.withColumn("scaled", scaled)


def minmax_inverse(scaled: DataFrame, value: str = "scaled", out: str = "restored") -> DataFrame:
    span = F.col("high") - F.col("low")
    return scaled.withColumn(out, F.col(value) * span + F.col("low"))


def make_sequences(
    series: DataFrame,
    n: int = 10,
    keys: Sequence[str] = CATEGORY,
    date: str = "date",
    value: str = "amount",
) -> DataFrame:
    """The ``n`` values before each point as ``inputs`` and the point as ``target``, for series of
    at least ``3 n`` points."""
    w = Window.partitionBy(*keys)
    inputs = F.collect_list(value).over(w.orderBy(date).rowsBetween(-n, -1))
    rows = series.withColumns({"_n": F.count("*").over(w), "inputs": inputs})
    kept = rows.filter((F.col("_n") >= 3 * n) & (F.size("inputs") == n))
    return kept.select(*keys, date, "inputs", F.col(value).alias("target"))


def normalize_weights(weights: DataFrame) -> DataFrame:
    """Weights ``(forecaster, weight)`` divided once by their sum."""
    total = weights.agg(F.sum("weight")).scalar()
    return weights.withColumn("weight", F.try_divide(F.col("weight"), total))


def default_weight(name: str, known: int) -> float:
    """Weight of a model added after ``known`` others."""
    return DEFAULT_WEIGHTS.get(name, 1.0 / (known + 2))


def ensemble_forecast(
    forecasts: DataFrame,
    method: str = "weighted_average",
    weights: dict[str, float] | None = None,
    keys: Sequence[str] = CATEGORY,
) -> DataFrame:
    """Combine the models of a series on the dates that all of them have, within the length of the
    shortest. An unknown method means the weighted average. A weight that is missing from
    ``weights`` counts 1; without ``weights``, models beyond the default ones get the weight of a
    model added after those."""
    other = 1.0 if weights is not None else default_weight("", DEFAULT_MODELS)
    weights = DEFAULT_WEIGHTS if weights is None else weights
    keys = list(keys)
    own = Window.partitionBy("forecaster", *keys)
    rows = forecasts.withColumns(
        {"_i": F.row_number().over(own.orderBy("ds")), "_n": F.count("*").over(own)}
    )
    models = forecasts.groupBy("forecaster", *keys).agg(F.count("*").alias("_len"))
    common = models.groupBy(*keys).agg(
        F.count("*").alias("_models"), F.min("_len").alias("_shortest")
    )
    rows = rows.join(common, keys).filter("_i <= _shortest")
    weight = F.lit(other)
    for name, value in weights.items():
        weight = F.when(F.col("forecaster") == name, F.lit(float(value))).otherwise(weight)
    rows = rows.withColumn("_w", weight)

    def combine(column: str) -> Column:
        if method == "simple_average":
            return F.avg(column)
        if method == "median":
            return F.median(column)
        known = F.when(F.col(column).isNotNull(), F.col("_w"))
        return F.try_divide(F.sum(F.col(column) * F.col("_w")), F.sum(known))

    combined = rows.groupBy(*keys, "ds").agg(
        F.count("*").alias("_have"),
        F.first("_models").alias("_models"),
        *[combine(c).alias(c) for c in ("amount", "lower_bound", "upper_bound")],
    )
    return combined.filter("_have = _models").select(
        F.lit("ensemble").alias("forecaster"), *keys, "ds", "amount", "lower_bound", "upper_bound"
    )


def forecast_by_category(forecasts: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Absolute points as an array, their total, range and confidence level per series."""
    point = F.struct(
        "ds",
        F.abs("amount").alias("amount"),
        F.abs("lower_bound").alias("lower_bound"),
        F.abs("upper_bound").alias("upper_bound"),
    )
    return forecasts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(point)).alias("points"),
        F.sum(F.abs("amount")).alias("total_forecast"),
        F.min("ds").alias("start_date"),
        F.max("ds").alias("end_date"),
        (F.datediff(F.max("ds"), F.min("ds")) + 1).alias("period_days"),
        F.lit(0.80).alias("confidence_level"),
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Absolute total per category as a map, grand total and overall range."""
    per = forecasts.groupBy("category").agg(
        F.abs(F.sum("amount")).alias("total"), F.min("ds").alias("a"), F.max("ds").alias("b")
    )
    return per.agg(
        F.sum("total").alias("total_forecast"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "total")))).alias(
            "categories_forecast"
        ),
        F.min("a").alias("start_date"),
        F.max("b").alias("end_date"),
        (F.datediff(F.max("b"), F.min("a")) + 1).alias("period_days"),
    )


def combine_forecasts(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("ds").agg(F.sum("amount").alias("amount"))


def forecast_highlights(forecasts: DataFrame) -> DataFrame:
    """Total, highest single point and its first date, total over 30 and number of categories."""
    per = forecasts.groupBy("category").agg(
        F.sum("amount").alias("total"),
        F.max(F.struct("amount", (-F.unix_date("ds")).alias("late"))).alias("top"),
    )
    return per.agg(
        F.sum("total").alias("total_forecast"),
        F.max("top").alias("top"),
        (F.sum("total") / 30).alias("daily_average"),
        F.count("*").alias("categories"),
    ).select(
        "total_forecast",
        F.col("top.amount").alias("highest_amount"),
        F.date_from_unix_date((-F.col("top.late")).cast("int")).alias("highest_date"),
        "daily_average",
        "categories",
    )


def forecast_horizon(forecasts: DataFrame, n: int = 30, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Total and average of the first ``n`` points of each series."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    return (
        forecasts.withColumn("_i", i)
        .filter(F.col("_i") <= n)
        .groupBy(*keys)
        .agg(F.sum("amount").alias("total"), F.avg("amount").alias("average"))
    )


def forecast_cumulative(forecasts: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    running = Window.partitionBy(*keys).orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return forecasts.withColumn("cumulative", F.sum("amount").over(running))
