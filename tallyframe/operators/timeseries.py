"""Transactions as series, and the features of a series.

Raw rows are summed per period first (partial sums before the shuffle). Everything after that runs
on series whose length is bounded by the calendar, so a window over one category stays small
however many transactions that category has. ``keys`` names the columns that identify a series,
for example ``("account_id", "category")``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from tallyframe.functions import calendar as cal
from tallyframe.functions.filters import not_null
from tallyframe.functions.stats import correlation

DATE = "transaction_date"
VALUE = "amount_sum"
LAGS = (1, 7, 30)
WINDOWS = (7, 14, 30)
CATEGORY = ("category",)


def _measures(value: str) -> list[Column]:
    return [
        F.sum(value).alias("amount_sum"),
        F.count(value).alias("amount_count"),
        F.avg(value).alias("amount_mean"),
    ]


def to_time_series(
    df: DataFrame, freq: str = "D", keys: Sequence[str] = CATEGORY, value: str = "amount"
) -> DataFrame:
    """Sum, count and mean per observed period and series; rows with a null key are left out."""
    label = cal.period_label(F.col(DATE), freq).alias(DATE)
    return not_null(df, DATE, *keys).groupBy(label, *keys).agg(*_measures(value))


def series_of_freqs(
    df: DataFrame,
    freqs: Sequence[str] = ("D", "W", "M"),
    keys: Sequence[str] = CATEGORY,
    value: str = "amount",
) -> DataFrame:
    """``to_time_series`` of several frequencies as one table with a column ``freq``, in one pass: each
    row goes to its period of every frequency, and is summed there before anything is shuffled."""
    labels = [F.struct(F.lit(f).alias("freq"), cal.period_label(F.col(DATE), f).alias(DATE))
              for f in freqs]
    rows = not_null(df, DATE, *keys).select(*keys, value, F.array(*labels).alias("_labels"))
    rows = rows.select(*keys, value, F.inline("_labels"))
    return rows.groupBy("freq", DATE, *keys).agg(*_measures(value))


def to_dense_series(df: DataFrame, freq: str = "D", value: str = "amount") -> DataFrame:
    """One series over all rows with every period between the first and the last; an empty period
    has sum 0, count 0 and no mean."""
    start = cal.period_start(F.col(DATE), freq).alias("_start")
    observed = not_null(df, DATE).groupBy(start).agg(*_measures(value))
    span = observed.agg(F.min("_start").alias("a"), F.max("_start").alias("b"))
    step = F.expr(cal.FREQUENCIES[freq][1])
    spine = span.filter("a is not null").select(
        F.explode(F.sequence("a", "b", step)).alias("_start")
    )
    dense = spine.join(observed, "_start", "left")
    return dense.select(
        cal.period_end(F.col("_start"), freq).alias(DATE),
        F.coalesce("amount_sum", F.lit(0.0)).alias("amount_sum"),
        F.coalesce("amount_count", F.lit(0)).alias("amount_count"),
        "amount_mean",
    )


def series_by_category(df: DataFrame, freq: str = "D", by_category: bool = True) -> DataFrame:
    """Long ``(category, date, amount)``; one series named ``all`` without categories."""
    if by_category and "category" in df.columns:
        series, name = to_time_series(df, freq), F.col("category")
    else:
        series, name = to_dense_series(df, freq), F.lit("all")
    return series.select(name.alias("category"), F.col(DATE).alias("date"),
                         F.col(VALUE).alias("amount"))


def temporal_features(df: DataFrame, date: str = DATE) -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "quarter": F.quarter(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "dayofweek": cal.weekday(d),
            "is_weekend": (cal.weekday(d) >= 5).cast("int"),
            "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
            "is_month_end": (F.to_date(d) == F.last_day(d)).cast("int"),
        }
    )


def cyclic_features(df: DataFrame, date: str = DATE) -> DataFrame:
    """Position in month, year and week as sine and cosine."""
    d = F.col(date)
    parts = {
        "day": F.dayofmonth(d) / 31,
        "month": F.month(d) / 12,
        "dayofweek": cal.weekday(d) / 7,
    }
    angle = {name: 2 * F.pi() * part for name, part in parts.items()}
    return df.withColumns(
        {f"{n}_sin": F.sin(a) for n, a in angle.items()}
        | {f"{n}_cos": F.cos(a) for n, a in angle.items()}
    )


def _ordered(keys: Sequence[str], date: str) -> WindowSpec:
    """Date order within a series. Without keys the window spans one already summed series; ties
    between categories on a date are ordered by the caller's columns only."""
    return Window.partitionBy(*keys).orderBy(date)


def lag_features(
    df: DataFrame,
    value: str = VALUE,
    lags: Sequence[int] = LAGS,
    keys: Sequence[str] = CATEGORY,
    date: str = DATE,
) -> DataFrame:
    """Value of the n-th earlier row of the series, not of the n-th earlier day."""
    w = _ordered(keys, date)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags})


def pct_change_features(
    df: DataFrame,
    value: str = VALUE,
    lags: Sequence[int] = LAGS,
    keys: Sequence[str] = CATEGORY,
    date: str = DATE,
    guard: bool = False,
) -> DataFrame:
    """Relative change to the n-th earlier row, null where that row is 0. With ``guard`` the columns
    stay null unless the table has more than ``max(lags) + 10`` rows, which takes another scan."""
    w = _ordered(keys, date)
    enough = F.lit(True) if not guard else df.agg(F.count("*")).scalar() > max(lags) + 10
    change = {
        f"{value}_pct_change_{n}": F.when(
            enough, F.try_divide(F.col(value), F.lag(value, n).over(w)) - 1
        )
        for n in lags
    }
    return df.withColumns(change)


def rolling_mean(
    df: DataFrame,
    value: str = VALUE,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = CATEGORY,
    date: str = DATE,
) -> DataFrame:
    w = _ordered(keys, date)
    return df.withColumns(
        {f"{value}_rolling_mean_{n}": F.avg(value).over(w.rowsBetween(1 - n, 0)) for n in windows}
    )


def rolling_std(
    df: DataFrame,
    value: str = VALUE,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = CATEGORY,
    date: str = DATE,
    min_rows: int = 3,
) -> DataFrame:
    w = _ordered(keys, date)
    columns = {}
    for n in windows:
        frame = w.rowsBetween(1 - n, 0)
        enough = F.count(value).over(frame) >= min_rows
        columns[f"{value}_rolling_std_{n}"] = F.when(enough, F.stddev_samp(value).over(frame))
    return df.withColumns(columns)


def seasonal_features(df: DataFrame, date: str = DATE) -> DataFrame:
    return df.withColumns(
        {"season": cal.season(F.col(date)), "is_holiday": cal.is_holiday(F.col(date))}
    )


def outliers_zscore(
    df: DataFrame, value: str = VALUE, threshold: float = 3.0, keys: Sequence[str] = CATEGORY
) -> DataFrame:
    """Flag values further than ``threshold`` sample deviations from the mean of their series. The
    window shares the partitioning of the lag and rolling features."""
    if keys:
        w = Window.partitionBy(*keys)
        mean, std = F.avg(value).over(w), F.stddev_samp(value).over(w)
    else:
        both = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))).scalar()
        mean, std = both["m"], both["s"]
    far = (std > 0) & (F.abs(F.col(value) - mean) / std > threshold)
    return df.withColumn(f"{value}_is_outlier", F.coalesce(far.cast("int"), F.lit(0)))


def outliers_iqr(
    df: DataFrame, value: str = VALUE, threshold: float = 3.0, keys: Sequence[str] = CATEGORY
) -> DataFrame:
    """Flag values outside ``q1 - t*iqr … q3 + t*iqr`` with interpolated quartiles."""
    q1, q3 = (F.percentile(value, p) for p in (0.25, 0.75))
    bounds = F.struct(q1.alias("q1"), q3.alias("q3"))
    if keys:
        flagged = df.join(df.groupBy(*keys).agg(bounds.alias("_q")), list(keys), "left")
        low, high = F.col("_q.q1"), F.col("_q.q3")
    else:
        flagged, both = df, df.agg(bounds).scalar()
        low, high = both["q1"], both["q3"]
    spread = (high - low) * threshold
    outside = (F.col(value) < low - spread) | (F.col(value) > high + spread)
    flag = F.coalesce(outside.cast("int"), F.lit(0))
    return flagged.withColumn(f"{value}_is_outlier", flag).drop("_q")


def spending_trend_pivot(series: DataFrame, categories: Sequence[str]) -> DataFrame:
    return series.groupBy(DATE).pivot("category", list(categories)).sum(VALUE)


def monthly_pattern(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    month = F.month(DATE).alias("month")
    return series.groupBy(month, *keys).agg(F.avg(VALUE).alias("mean_amount"))


def weekday_pattern(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    day = cal.weekday(F.col(DATE)).alias("weekday")
    return series.groupBy(day, *keys).agg(F.avg(VALUE).alias("mean_amount"))


def category_series_totals(series: DataFrame, k: int | None = None) -> DataFrame:
    """Total per category, largest first; with ``k`` the ``k`` largest by absolute value."""
    totals = series.groupBy("category").agg(F.sum(VALUE).alias("total"))
    if k is None:
        return totals.orderBy(F.desc("total"), "category")
    return totals.orderBy(F.desc(F.abs("total")), "category").limit(k)


def lag_correlation(
    series: DataFrame,
    value: str = VALUE,
    lags: Sequence[int] = LAGS,
    keys: Sequence[str] = CATEGORY,
) -> DataFrame:
    """Pearson correlation of the value with each lag over the rows that have all lags."""
    names = [f"{value}_lag_{n}" for n in lags]
    rows = not_null(lag_features(series, value, lags, keys), value, *names)
    return rows.agg(*[correlation(value, n).alias(f"corr_lag_{k}") for n, k in zip(names, lags)])


def outlier_report(flagged: DataFrame, value: str = VALUE) -> DataFrame:
    flag = F.col(f"{value}_is_outlier")
    return flagged.agg(
        F.coalesce(F.sum(flag), F.lit(0)).alias("outliers"),
        F.count("*").alias("total"),
        F.try_divide(F.sum(flag), F.count("*")).alias("rate"),
    )


def top_outliers(flagged: DataFrame, k: int = 5, value: str = VALUE) -> DataFrame:
    rows = flagged.filter(F.col(f"{value}_is_outlier") == 1)
    return rows.orderBy(F.desc(value), DATE, "category").limit(k)


def fill_gaps(
    daily: DataFrame, keys: Sequence[str] = CATEGORY, date: str = "date", value: str = "amount"
) -> DataFrame:
    """Every day from the first to the last of each series, missing days 0. ``daily`` has one row
    per series and day; each row spreads over the gap that follows it, so neither a join nor a
    second aggregate is needed."""
    after = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    spans = daily.withColumn("_last", F.coalesce(F.date_sub(after, 1), F.col(date)))
    days = spans.withColumn("_day", F.explode(F.sequence(F.col(date), F.col("_last"))))
    filled = F.when(F.col("_day") == F.col(date), F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return days.select(*keys, F.col("_day").alias(date), filled.alias(value))


def time_series_features(
    df: DataFrame, freq: str = "D", keys: Sequence[str] = CATEGORY, guard: bool = False
) -> DataFrame:
    """Series with calendar, lag, rolling, season and outlier columns. All windows share one
    partitioning and one sort order, so the series is shuffled once after the sums. ``guard`` is
    passed to ``pct_change_features``."""
    series = cyclic_features(temporal_features(to_time_series(df, freq, keys)))
    series = pct_change_features(lag_features(series, keys=keys), keys=keys, guard=guard)
    series = rolling_std(rolling_mean(series, keys=keys), keys=keys)
    return outliers_zscore(seasonal_features(series), keys=keys)


def historical_daily(df: DataFrame, category: str | None = None, n: int = 30) -> DataFrame:
    """Daily signed sums, the last ``n`` days that have data."""
    if category:
        df = df.filter(F.col("category") == category)
    daily = df.groupBy(F.to_date(DATE).alias("date")).agg(F.sum("amount").alias("amount"))
    return daily.orderBy(F.desc("date")).limit(n)
