"""Forecast accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

METRICS = ("mae", "rmse", "mape")


def _numbered(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return df.withColumn("_step", F.row_number().over(Window.partitionBy(*keys).orderBy(date)))


def forecast_metrics(
    predicted: DataFrame,
    actual: DataFrame,
    keys: Sequence[str] = ("category",),
    predicted_value: str = "amount",
    actual_value: str = "amount",
    predicted_date: str = "ds",
    actual_date: str = "date",
) -> DataFrame:
    """MAE, RMSE and MAPE per series and forecaster. The n-th forecast is held against the n-th
    actual value, up to the shorter of the two; MAPE is null when an actual value is 0."""
    keys = list(keys)
    by = (["forecaster"] if "forecaster" in predicted.columns else []) + keys
    left = _numbered(predicted, by, predicted_date).select(
        *by, "_step", F.col(predicted_value).alias("_p")
    )
    right = _numbered(actual, keys, actual_date).select(
        *keys, "_step", F.col(actual_value).alias("_a")
    )
    error = F.col("_a") - F.col("_p")
    mape = F.avg(F.abs(F.try_divide(error, F.col("_a")))) * 100
    return (
        left.join(right, [*keys, "_step"])
        .groupBy(*by)
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.when(F.min(F.abs("_a")) > 0, mape).alias("mape"),
        )
    )


def compare_forecasters(predicted: DataFrame, actual: DataFrame, **columns) -> DataFrame:
    """``forecast_metrics`` of several models as long rows (forecaster, category, metric, value)."""
    wide = forecast_metrics(predicted, actual, **columns)
    ids = [c for c in wide.columns if c not in METRICS]
    return wide.unpivot(ids, list(METRICS), "metric", "value").filter("value is not null")


def best_forecaster(
    metrics: DataFrame, metric: str = "rmse", lower_is_better: bool = True
) -> DataFrame:
    """The best model per category; a tie goes to the name that sorts first."""
    rank = F.col("value") if lower_is_better else -F.col("value")
    best = F.min(F.struct(rank.alias("rank"), "forecaster", "value"))
    found = metrics.filter(F.col("metric") == metric).groupBy("category").agg(best.alias("b"))
    return found.select("category", F.col("b.forecaster").alias("forecaster"),
                        F.col("b.value").alias("value"))


def metrics_pivot(metrics: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    return metrics.groupBy("forecaster", "category").pivot("metric", list(names)).avg("value")


def evaluation_table(metrics: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """Long metrics with ``is_best`` per category and metric; ties as in ``best_forecaster``."""
    order = F.asc("value") if lower_is_better else F.desc("value")
    w = Window.partitionBy("category", "metric").orderBy(order, "forecaster")
    return metrics.withColumn("is_best", F.row_number().over(w) == 1)
