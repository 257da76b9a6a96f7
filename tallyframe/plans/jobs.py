"""Whole jobs: file to clean table, table to forecasts and scores, partition maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.functions import calendar as cal
from tallyframe.functions.filters import not_null
from tallyframe.functions.rules import DEFAULT, Rules
from tallyframe.operators.categorize import keyword_categorize
from tallyframe.operators.cleaning import (
    clean_transactions,
    derive_amount,
    map_columns_if_missing,
    require_columns,
    select_expenses,
)
from tallyframe.operators.evaluation import compare_forecasters
from tallyframe.operators.forecasting import (
    Forecaster,
    chrono_split,
    daily_spending_series,
    ensemble_forecast,
    fit_predict,
)
from tallyframe.operators.timeseries import time_series_features
from tallyframe.session import materialize
from tallyframe.sources.readers import read_transactions


def process_transactions(
    spark: SparkSession, path: str, schema: StructType | None = None, rules: Rules = DEFAULT
) -> DataFrame:
    """Load, clean and categorise: one lazy plan without a shuffle."""
    return keyword_categorize(clean_transactions(read_transactions(spark, path, schema)), rules)


def series_tables(df: DataFrame, freqs: Sequence[str] = ("D", "W", "M")) -> dict[str, DataFrame]:
    """Feature tables per frequency. Weeks and months come from the transactions, not from days,
    because a mean of daily means is not the mean."""
    df = derive_amount(map_columns_if_missing(df))
    return {f: time_series_features(df, f) for f in freqs}


def train_on_history(
    df: DataFrame, model: Forecaster, horizon: int = 30, days: int | None = 90
) -> DataFrame:
    """Forecasts from the last ``days`` days of history; the table needs categories."""
    df = derive_amount(map_columns_if_missing(df))
    require_columns(df, ("transaction_date", "amount", "category"))
    if days is not None:
        newest = df.agg(F.max("transaction_date")).scalar()
        df = df.filter(F.col("transaction_date") >= newest - F.expr(f"interval {days} days"))
    return model(daily_spending_series(df), horizon)


def spending_per_freq(
    df: DataFrame, freqs: Sequence[str] = ("D", "W", "M"), mode: str = "signed"
) -> DataFrame:
    """Spending per (freq, category, period) in one pass: every row goes to its period of each
    frequency and is summed there."""
    labels = [
        F.struct(F.lit(f).alias("freq"), cal.period_label(F.col("transaction_date"), f).alias("date"))
        for f in freqs
    ]
    rows = not_null(select_expenses(df, mode), "transaction_date", "category")
    spread = rows.select("category", "spending", F.inline(F.array(*labels)))
    return spread.groupBy("freq", "category", "date").agg(F.sum("spending").alias("amount"))


def period_dates(forecasts: DataFrame, series: DataFrame, freqs: Sequence[str]) -> DataFrame:
    """``forecasts`` of models that step by days, with ``ds`` at the label of the n-th period after
    the last one of its series instead of at the n-th day."""
    last = series.groupBy("freq", "category").agg(F.max("date").alias("_last"))
    rows = forecasts.join(last, ["freq", "category"])
    step = F.datediff("ds", "_last")
    label = F.col("ds")
    for freq in freqs:
        if freq == "D":
            continue
        days, months = {"W": (7, 0), "M": (0, 1), "Q": (0, 3), "Y": (0, 12)}[freq]
        start = cal.period_start(F.col("_last"), freq)
        begin = F.date_add(start, step * days) if days else F.add_months(start, step * months)
        label = F.when(F.col("freq") == freq, cal.period_end(begin, freq)).otherwise(label)
    return rows.withColumn("ds", label).select(*forecasts.columns)


def forecast_per_freq(
    df: DataFrame,
    models: dict[str, Forecaster],
    freqs: Sequence[str] = ("D", "W", "M"),
    horizon: int = 30,
    test_size: float = 0.2,
    min_points: int = 10,
    method: str = "weighted_average",
) -> tuple[DataFrame, DataFrame]:
    """Split, fit, forecast, combine and score every (freq, category) series in one job. Returns
    the forecasts of all models with the ensemble, and the long metrics. ``ds`` is the label of the
    period that a row forecasts; scores pair rows with the test periods by position."""
    keys = ("freq", "category")
    series = materialize(spending_per_freq(df, freqs))
    parts = chrono_split(series, test_size, keys, min_points=min_points)
    train = parts.filter("part = 'train'").drop("part")
    test = parts.filter("part = 'test'").drop("part")
    single = materialize(period_dates(fit_predict(train, models, horizon, keys), train, freqs))
    combined = ensemble_forecast(single, method, keys=keys)
    forecasts = single.unionByName(combined.select(*single.columns))
    return forecasts, compare_forecasters(forecasts, test, keys=keys)


def map_partitions(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
) -> DataFrame:
    """Apply a table function to every Arrow batch, in parallel over the partitions."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    return df.mapInPandas(batches, schema)
