"""Series and their features."""

from pyspark.sql import functions as F

from checks.base import (
    CATEGORIES, EV, EV_TYPES, TX, TXC, ev, register, sql_daily, sql_label, tx, txc,
)
from tallyframe.functions import calendar as cal
from tallyframe.operators import timeseries as ops

MEASURES = "sum(amount) AS amount_sum, count(amount) AS amount_count, avg(amount) AS amount_mean"


def sql_series(source, freq="D", keys="category"):
    return f"""series AS (
      SELECT {sql_label('transaction_date', freq)} AS transaction_date, {keys}, {MEASURES}
      FROM {source} WHERE category IS NOT NULL GROUP BY ALL)"""


def sql_dense(source, freq):
    unit, step = {"D": ("day", "1 DAY"), "W": ("week", "7 DAY"), "M": ("month", "1 MONTH"),
                  "Q": ("quarter", "3 MONTH"), "Y": ("year", "1 YEAR")}[freq]
    return f"""obs AS (SELECT date_trunc('{unit}', transaction_date) AS p, {MEASURES}
        FROM {source} GROUP BY 1),
      grid AS (SELECT unnest(generate_series(min(CAST(p AS TIMESTAMP)),
        max(CAST(p AS TIMESTAMP)), INTERVAL {step})) AS p FROM obs),
      series AS (SELECT {sql_label('CAST(p AS TIMESTAMP)', freq)} AS transaction_date,
        coalesce(amount_sum, 0) AS amount_sum, coalesce(amount_count, 0) AS amount_count,
        amount_mean FROM grid LEFT JOIN (SELECT CAST(p AS TIMESTAMP) AS p, * EXCLUDE (p) FROM obs)
        AS o USING (p))"""


def series(s, d, freq="D"):
    return ops.to_time_series(txc(s, d), freq)


SERIES = f"{TXC}, {sql_series('txc')}"
LAG = ", ".join(f"lag(amount_sum, {n}) OVER w AS amount_sum_lag_{n}" for n in (1, 7, 30))
PCT = ", ".join(
    f"amount_sum / nullif(lag(amount_sum, {n}) OVER w, 0) - 1 AS amount_sum_pct_change_{n}"
    for n in (1, 7, 30)
)
MEAN = ", ".join(
    f"avg(amount_sum) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) "
    f"AS amount_sum_rolling_mean_{n}" for n in (7, 14, 30)
)
STD = ", ".join(
    f"CASE WHEN count(*) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= 3 "
    f"THEN stddev_samp(amount_sum) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END "
    f"AS amount_sum_rolling_std_{n}" for n in (7, 14, 30)
)
W = "WINDOW w AS (PARTITION BY category ORDER BY transaction_date)"
Z = """CAST(coalesce(stddev_samp(amount_sum) OVER (PARTITION BY category) > 0 AND
    abs(amount_sum - avg(amount_sum) OVER (PARTITION BY category))
    / stddev_samp(amount_sum) OVER (PARTITION BY category) > {t}, FALSE) AS INTEGER)
    AS amount_sum_is_outlier"""
R_SUM = "amount_sum amount_mean"
R_LAG = " ".join(f"amount_sum_lag_{n}" for n in (1, 7, 30))
R_PCT = " ".join(f"amount_sum_pct_change_{n}" for n in (1, 7, 30))
R_MEAN = " ".join(f"amount_sum_rolling_mean_{n}" for n in (7, 14, 30))
R_STD = " ".join(f"2:amount_sum_rolling_std_{n}" for n in (7, 14, 30))
CALENDAR = """CAST(year({0}) AS INTEGER) AS year, CAST(quarter({0}) AS INTEGER) AS quarter,
    CAST(month({0}) AS INTEGER) AS month, CAST(day({0}) AS INTEGER) AS day,
    CAST(isodow({0}) - 1 AS INTEGER) AS dayofweek,
    CAST(isodow({0}) >= 6 AS INTEGER) AS is_weekend,
    CAST(day({0}) = 1 AS INTEGER) AS is_month_start,
    CAST(CAST({0} AS DATE) = last_day({0}) AS INTEGER) AS is_month_end"""
CYCLES = ", ".join(
    f"{f}(2 * pi() * {p}) AS {n}_{f}"
    for n, p in (("day", "day({0}) / 31"), ("month", "month({0}) / 12"),
                 ("dayofweek", "(isodow({0}) - 1) / 7"))
    for f in ("sin", "cos")
)
R_CYCLES = " ".join(f"{n}_{f}" for n in ("day", "month", "dayofweek") for f in ("sin", "cos"))
SEASON = """CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) <= 5 THEN 'spring'
    WHEN month({0}) <= 8 THEN 'summer' ELSE 'fall' END AS season"""
HOLIDAY = """CAST(strftime({0}, '%m-%d') IN ('01-01', '07-04', '12-25') AS INTEGER)
    AS is_holiday"""
DATE = "transaction_date"

register(
    "period_label",
    lambda s, d: tx(s, d).select(
        "id", *[cal.period_label(F.col(DATE), f).alias(f"label_{f}") for f in "DWMQY"]
    ),
    f"""WITH {TX} SELECT id, {', '.join(
        f'{sql_label(DATE, f)} AS label_{f}' for f in 'DWMQY')} FROM tx""",
)
for freq in "DWM":
    suffix = {"D": "", "W": "_weekly", "M": "_monthly"}[freq]
    register(
        f"to_time_series{suffix}",
        lambda s, d, f=freq: ops.to_time_series(tx(s, d), f),
        f"WITH {TX}, {sql_series('tx', freq)} SELECT * FROM series",
        R_SUM,
    )
for freq in "DWMQY":
    suffix = {"D": "", "W": "_weekly", "M": "_monthly", "Q": "_quarterly", "Y": "_yearly"}[freq]
    register(
        f"to_dense_series{suffix}",
        lambda s, d, f=freq: ops.to_dense_series(ev(s, d), f),
        f"WITH {EV}, {sql_dense('ev', freq)} SELECT * FROM series",
        R_SUM,
    )
    register(
        f"to_dense_series_all{suffix}",
        lambda s, d, f=freq: ops.to_dense_series(tx(s, d), f),
        f"WITH {TX}, {sql_dense('tx', freq)} SELECT * FROM series",
        R_SUM,
    )
register(
    "to_time_series_by_account",
    lambda s, d: ops.to_time_series(ev(s, d), "W", ("account_id", "category")),
    f"WITH {EV}, {sql_series('ev', 'W', 'account_id, category')} SELECT * FROM series",
    R_SUM,
)
register(
    "series_by_category",
    lambda s, d: ops.series_by_category(tx(s, d)),
    f"""WITH {TX}, {sql_series('tx')}
        SELECT category, transaction_date AS date, amount_sum AS amount FROM series""",
    "amount",
)
register(
    "series_by_category_all",
    lambda s, d: ops.series_by_category(tx(s, d), "M", by_category=False),
    f"""WITH {TX}, {sql_dense('tx', 'M')}
        SELECT 'all' AS category, transaction_date AS date, amount_sum AS amount FROM series""",
    "amount",
)
register(
    "temporal_features",
    lambda s, d: ops.temporal_features(tx(s, d).select("id", DATE)),
    f"WITH {TX} SELECT id, transaction_date, {CALENDAR.format(DATE)} FROM tx",
)
register(
    "cyclic_features",
    lambda s, d: ops.cyclic_features(tx(s, d).select("id", DATE)),
    f"WITH {TX} SELECT id, transaction_date, {CYCLES.format(DATE)} FROM tx",
    R_CYCLES,
)
register(
    "lag_features",
    lambda s, d: ops.lag_features(series(s, d)),
    f"WITH {SERIES} SELECT *, {LAG} FROM series {W}",
    f"{R_SUM} {R_LAG}",
)
register(
    "pct_change_features",
    lambda s, d: ops.pct_change_features(series(s, d)),
    f"WITH {SERIES} SELECT *, {PCT} FROM series {W}",
    f"{R_SUM} {R_PCT}",
)
register(
    "rolling_mean",
    lambda s, d: ops.rolling_mean(series(s, d)),
    f"WITH {SERIES} SELECT *, {MEAN} FROM series {W}",
    f"{R_SUM} {R_MEAN}",
)
register(
    "rolling_std",
    lambda s, d: ops.rolling_std(series(s, d)),
    f"WITH {SERIES} SELECT *, {STD} FROM series {W}",
    f"{R_SUM} {R_STD}",
)
register(
    "lag_features_ungrouped",
    lambda s, d: ops.lag_features(ops.to_dense_series(tx(s, d)), keys=()),
    f"""WITH {TX}, {sql_dense('tx', 'D')} SELECT *, {LAG} FROM series
        WINDOW w AS (ORDER BY transaction_date)""",
    f"{R_SUM} {R_LAG}",
)
register(
    "season",
    lambda s, d: tx(s, d).select("id", cal.season(F.col(DATE)).alias("season")),
    f"WITH {TX} SELECT id, {SEASON.format(DATE)} FROM tx",
)
register(
    "is_holiday",
    lambda s, d: tx(s, d).select("id", cal.is_holiday(F.col(DATE)).alias("is_holiday")),
    f"WITH {TX} SELECT id, {HOLIDAY.format(DATE)} FROM tx",
)
register(
    "outliers_zscore",
    lambda s, d: ops.outliers_zscore(series(s, d)),
    f"WITH {SERIES} SELECT *, {Z.format(t=3)} FROM series",
    R_SUM,
)
_IQR = """q AS (SELECT category, quantile_cont(amount_sum, 0.25) AS q1,
      quantile_cont(amount_sum, 0.75) AS q3 FROM series GROUP BY 1)
    SELECT series.*, CAST(amount_sum < q1 - 1.5 * (q3 - q1) OR amount_sum > q3 + 1.5 * (q3 - q1)
      AS INTEGER) AS amount_sum_is_outlier FROM series JOIN q USING (category)"""
register(
    "outliers_iqr",
    lambda s, d: ops.outliers_iqr(series(s, d), threshold=1.5),
    f"WITH {SERIES}, {_IQR}",
    R_SUM,
)
register(
    "outliers_zscore_ungrouped",
    lambda s, d: ops.outliers_zscore(ops.to_dense_series(tx(s, d)), threshold=2.0, keys=()),
    f"""WITH {TX}, {sql_dense('tx', 'D')} SELECT *, CAST(abs(amount_sum -
        (SELECT avg(amount_sum) FROM series)) / (SELECT stddev_samp(amount_sum) FROM series) > 2
        AS INTEGER) AS amount_sum_is_outlier FROM series""",
    R_SUM,
)
register(
    "outliers_iqr_ungrouped",
    lambda s, d: ops.outliers_iqr(ops.to_dense_series(tx(s, d)), threshold=1.0, keys=()),
    f"""WITH {TX}, {sql_dense('tx', 'D')}, q AS (SELECT quantile_cont(amount_sum, 0.25) AS q1,
        quantile_cont(amount_sum, 0.75) AS q3 FROM series)
        SELECT series.*, CAST(amount_sum < q1 - (q3 - q1) OR amount_sum > q3 + (q3 - q1)
        AS INTEGER) AS amount_sum_is_outlier FROM series CROSS JOIN q""",
    R_SUM,
)
register(
    "spending_trend_pivot",
    lambda s, d: ops.spending_trend_pivot(series(s, d, "M"), CATEGORIES),
    f"""WITH {TXC}, {sql_series('txc', 'M')} SELECT transaction_date, {', '.join(
        f"sum(amount_sum) FILTER (WHERE category = '{c}') AS {c}" for c in CATEGORIES)}
        FROM series GROUP BY 1""",
    " ".join(CATEGORIES),
)
for keys, cols in (((), ""), (("category",), ", category")):
    suffix = "_by_category" if keys else ""
    register(
        f"monthly_pattern{suffix}",
        lambda s, d, k=keys: ops.monthly_pattern(series(s, d), k),
        f"""WITH {SERIES} SELECT CAST(month(transaction_date) AS INTEGER) AS month{cols},
            avg(amount_sum) AS mean_amount FROM series GROUP BY ALL""",
        "mean_amount",
    )
    register(
        f"weekday_pattern{suffix}",
        lambda s, d, k=keys: ops.weekday_pattern(series(s, d), k),
        f"""WITH {SERIES} SELECT CAST(isodow(transaction_date) - 1 AS INTEGER) AS weekday{cols},
            avg(amount_sum) AS mean_amount FROM series GROUP BY ALL""",
        "mean_amount",
    )
register(
    "category_series_totals",
    lambda s, d: ops.category_series_totals(series(s, d)),
    f"WITH {SERIES} SELECT category, sum(amount_sum) AS total FROM series GROUP BY 1",
    "total",
)
register(
    "category_series_top",
    lambda s, d: ops.category_series_totals(series(s, d), 5),
    f"""WITH {SERIES} SELECT category, sum(amount_sum) AS total FROM series GROUP BY 1
        ORDER BY abs(sum(amount_sum)) DESC LIMIT 5""",
    "total",
)
register(
    "lag_correlation",
    lambda s, d: ops.lag_correlation(series(s, d)),
    f"""WITH {SERIES}, lags AS (SELECT *, {LAG} FROM series {W})
        SELECT {', '.join(f'corr(amount_sum, amount_sum_lag_{n}) AS corr_lag_{n}'
                          for n in (1, 7, 30))}
        FROM lags WHERE amount_sum_lag_30 IS NOT NULL""",
    "8:corr_lag_1 8:corr_lag_7 8:corr_lag_30",
)
register(
    "outlier_report",
    lambda s, d: ops.outlier_report(ops.outliers_zscore(series(s, d), threshold=2.0)),
    f"""WITH {SERIES}, f AS (SELECT *, {Z.format(t=2)} FROM series)
        SELECT CAST(sum(amount_sum_is_outlier) AS BIGINT) AS outliers, count(*) AS total,
        sum(amount_sum_is_outlier) / count(*) AS rate FROM f""",
    "8:rate",
)
register(
    "top_outliers",
    lambda s, d: ops.top_outliers(ops.outliers_zscore(series(s, d), threshold=2.0)),
    f"""WITH {SERIES}, f AS (SELECT *, {Z.format(t=2)} FROM series)
        SELECT * FROM f WHERE amount_sum_is_outlier = 1
        ORDER BY amount_sum DESC, transaction_date, category LIMIT 5""",
    R_SUM,
)


def _daily(s, d):
    return txc(s, d).filter("amount < 0").groupBy(
        "category", F.to_date(DATE).alias("date")
    ).agg((-F.sum("amount")).alias("amount"))


register(
    "fill_gaps",
    lambda s, d: ops.fill_gaps(_daily(s, d)),
    f"WITH {TXC}, {sql_daily('txc')} SELECT category, date, amount FROM filled",
    "amount",
)


def sql_features(freq):
    return f"""WITH {TXC}, {sql_series('txc', freq)} SELECT *, {CALENDAR.format(DATE)},
        {CYCLES.format(DATE)}, {LAG}, {PCT}, {MEAN}, {STD}, {SEASON.format(DATE)},
        {HOLIDAY.format(DATE)}, {Z.format(t=3)} FROM series {W}"""


R_FEATURES = f"{R_SUM} {R_CYCLES} {R_LAG} {R_PCT} {R_MEAN} {R_STD}"
for freq in "DWM":
    suffix = {"D": "", "W": "_weekly", "M": "_monthly"}[freq]
    register(
        f"time_series_features{suffix}",
        lambda s, d, f=freq: ops.time_series_features(txc(s, d), f),
        sql_features(freq),
        R_FEATURES,
    )
register(
    "historical_daily",
    lambda s, d: ops.historical_daily(txc(s, d), "food"),
    f"""WITH {TXC} SELECT CAST(transaction_date AS DATE) AS date, sum(amount) AS amount FROM txc
        WHERE category = 'food' GROUP BY 1 ORDER BY date DESC LIMIT 30""",
    "amount",
)
