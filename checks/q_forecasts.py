"""Forecasts and their scores."""

from pyspark.sql import functions as F

from checks.base import EV, TXC, ev, register, sql_daily, sql_label, table, txc
from tallyframe.operators import evaluation as score
from tallyframe.operators import forecasting as ops
from tallyframe.plans import jobs

DAYS = 30
BOUNDS = "amount lower_bound upper_bound"


def ev_series(s, d):
    return ops.daily_spending_series(ev(s, d))


def tx_series(s, d):
    return ops.daily_spending_series(txc(s, d))


EV_SERIES = f"{EV}, {sql_daily('ev')}"
TX_SERIES = f"{TXC}, {sql_daily('txc')}"


def _ahead(source, level, low, high, name, days=DAYS):
    return f"""SELECT '{name}' AS forecaster, category,
      CAST(unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL {days} DAY,
        INTERVAL 1 DAY)) AS DATE) AS ds,
      {level} AS amount, {low} AS lower_bound, {high} AS upper_bound FROM ({source}) AS levels"""


def sql_mean(source, days=DAYS):
    levels = f"""SELECT category, avg(amount) AS m, coalesce(stddev_samp(amount),
        0.1 * abs(avg(amount))) AS s, max(date) AS last FROM {source} GROUP BY 1"""
    return _ahead(levels, "m", "m - s", "m + s", "mean", days)


def sql_fallback(source, level="avg(amount)", days=DAYS):
    levels = f"SELECT category, {level} AS v, max(date) AS last FROM {source} GROUP BY 1"
    return _ahead(levels, "v", "v * 0.8", "v * 1.2", "fallback", days)


def fc(s, d):
    """Two forecasters on the event series; their levels differ."""
    series = ev_series(s, d)
    return ops.forecast_mean(series, DAYS).unionByName(
        ops.forecast_fallback(series, DAYS, level="last")
    )


FC = f"""{EV_SERIES}, fc AS ({sql_mean('filled')} UNION ALL
    {sql_fallback('filled', 'max_by(amount, date)')})"""


def trend(s, d):
    """One forecast per category with values that change from day to day."""
    return ops.forecast_trend_seasonal(ev_series(s, d), DAYS)


def sql_trend(source, days=DAYS):
    """CTEs that end in ``trend``."""
    return f"""ahead AS (SELECT category,
        CAST(unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL {days} DAY,
        INTERVAL 1 DAY)) AS DATE) AS date, CAST(NULL AS DOUBLE) AS y FROM (
        SELECT category, max(date) AS last FROM {source} GROUP BY 1 HAVING count(*) >= 10) AS l),
      line AS (SELECT category, regr_slope(amount, t) AS b, regr_intercept(amount, t) AS a,
        min(first) AS first FROM (SELECT category, amount, min(date) OVER w AS first,
        CAST(date - min(date) OVER w AS DOUBLE) AS t FROM {source}
        WINDOW w AS (PARTITION BY category)) AS x GROUP BY 1),
      every AS (SELECT category, date, amount AS y FROM {source} UNION ALL SELECT * FROM ahead),
      fitted AS (SELECT category, date, y, a + b * (date - first) AS trend,
        isodow(date) AS wd, month(date) AS mo FROM every JOIN line USING (category)),
      weekly AS (SELECT *, coalesce(avg(y / nullif(trend, 0)) OVER
        (PARTITION BY category, wd), 1) AS wi FROM fitted),
      monthly AS (SELECT *, coalesce(avg(y / nullif(trend, 0) / nullif(wi, 0)) OVER
        (PARTITION BY category, mo), 1) AS mi FROM weekly),
      full_fit AS (SELECT *, trend * wi * mi AS fit FROM monthly),
      spread AS (SELECT *, stddev_samp(y - fit) OVER (PARTITION BY category) AS sd FROM full_fit),
      trend AS (SELECT 'trend_seasonal' AS forecaster, category, date AS ds, fit AS amount,
        fit - 1.96 * sd AS lower_bound, fit + 1.96 * sd AS upper_bound FROM spread
        WHERE y IS NULL)"""


TREND = f"{EV_SERIES}, {sql_trend('filled')}"

register("daily_spending_series", tx_series,
         f"WITH {TX_SERIES} SELECT category, date, amount FROM filled", "amount")
register(
    "daily_spending_series_by_account",
    lambda s, d: ops.daily_spending_series(ev(s, d), ("account_id", "category")),
    f"""WITH {EV}, {sql_daily('ev', 'account_id, category')}
        SELECT account_id, category, date, amount FROM filled""",
    "amount",
)
register(
    "daily_spending_series_all",
    lambda s, d: ops.daily_spending_series(txc(s, d).drop("category")),
    f"""WITH {TXC}, whole AS (SELECT 'all' AS category, transaction_date, amount FROM txc),
        {sql_daily('whole')} SELECT category, date, amount FROM filled""",
    "amount",
)
_SPLIT = """parts AS (SELECT category, date, amount, CASE WHEN row_number() OVER w
    <= floor(count(*) OVER (PARTITION BY category) * CAST(0.8 AS DOUBLE)) THEN 'train'
    ELSE 'test' END AS part FROM filled WINDOW w AS (PARTITION BY category ORDER BY date))"""
register("chrono_split", lambda s, d: ops.chrono_split(tx_series(s, d), min_points=10),
         f"WITH {TX_SERIES}, {_SPLIT} SELECT * FROM parts", "amount")
register("difference", lambda s, d: ops.difference(tx_series(s, d)),
         f"""WITH {TX_SERIES} SELECT category, date, amount - lag(amount) OVER w AS amount
         FROM filled WINDOW w AS (PARTITION BY category ORDER BY date)
         QUALIFY lag(amount) OVER w IS NOT NULL""", "amount")
register("difference_twice", lambda s, d: ops.difference(tx_series(s, d), 2),
         f"""WITH {TX_SERIES} SELECT category, date,
         amount - 2 * lag(amount) OVER w + lag(amount, 2) OVER w AS amount
         FROM filled WINDOW w AS (PARTITION BY category ORDER BY date)
         QUALIFY lag(amount, 2) OVER w IS NOT NULL""", "amount")
_T = """regr_sxy({y}, {x}) / regr_sxx({y}, {x}) / sqrt((regr_syy({y}, {x})
    - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x}))
    / (regr_count({y}, {x}) - 2) / regr_sxx({y}, {x}))"""
register(
    "stationarity_test",
    lambda s, d: ops.stationarity_test(tx_series(s, d)),
    f"""WITH {TX_SERIES}, d0 AS (SELECT category, date, amount AS y0,
          amount - lag(amount) OVER w AS y1 FROM filled
          WINDOW w AS (PARTITION BY category ORDER BY date)),
        d1 AS (SELECT *, y1 - lag(y1) OVER w AS y2, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1
          FROM d0 WINDOW w AS (PARTITION BY category ORDER BY date)),
        d2 AS (SELECT *, y2 - lag(y2) OVER w AS y3, lag(y2) OVER w AS p2 FROM d1
          WINDOW w AS (PARTITION BY category ORDER BY date)),
        t AS (SELECT category, count(*) AS n, {', '.join(
            _T.format(y=f'y{i + 1}', x=f'p{i}') + f' AS t_stat_{i}' for i in range(3))}
          FROM d2 GROUP BY 1)
        SELECT *, n >= 20 AND t_stat_0 < -2.86 AS is_stationary,
          CAST(CASE WHEN n >= 20 AND t_stat_0 < -2.86 THEN 0 WHEN n >= 21 AND t_stat_1 < -2.86
          THEN 1 WHEN n >= 22 AND t_stat_2 < -2.86 THEN 2 ELSE 1 END AS INTEGER) AS d FROM t""",
    "t_stat_0 t_stat_1 t_stat_2",
)
register("forecast_mean", lambda s, d: ops.forecast_mean(tx_series(s, d), DAYS),
         f"WITH {TX_SERIES} {sql_mean('filled')}", BOUNDS)
register("forecast_fallback", lambda s, d: ops.forecast_fallback(tx_series(s, d), DAYS),
         f"WITH {TX_SERIES} {sql_fallback('filled')}", BOUNDS)
register("forecast_fallback_last",
         lambda s, d: ops.forecast_fallback(tx_series(s, d), DAYS, level="last"),
         f"WITH {TX_SERIES} {sql_fallback('filled', 'max_by(amount, date)')}", BOUNDS)
register("forecast_trend_seasonal", lambda s, d: ops.forecast_trend_seasonal(tx_series(s, d), DAYS),
         f"WITH {TX_SERIES}, {sql_trend('filled')} SELECT * FROM trend",
         " ".join(f"2:{c}" for c in BOUNDS.split()))
# Iterative fits without a SQL form; tests compare them with known processes.
register("forecast_arima", lambda s, d: ops.forecast_arima(tx_series(s, d), DAYS))
register("forecast_arima_auto",
         lambda s, d: ops.forecast_arima(ev_series(s, d), DAYS, search="auto"))
register("forecast_autoregressive", lambda s, d: ops.forecast_autoregressive(tx_series(s, d)))
register(
    "minmax_scale",
    lambda s, d: ops.minmax_inverse(ops.minmax_scale(tx_series(s, d))),
    f"""WITH {TX_SERIES}, b AS (SELECT *, min(amount) OVER w AS low, max(amount) OVER w AS high
          FROM filled WINDOW w AS (PARTITION BY category))
        SELECT *, coalesce((amount - low) / nullif(high - low, 0), 0) AS scaled,
        amount AS restored FROM b""",
    "amount low high 8:scaled restored",
)
register(
    "make_sequences",
    lambda s, d: ops.make_sequences(tx_series(s, d)).select(
        "category", "date", "target", F.element_at("inputs", 1).alias("oldest"),
        F.element_at("inputs", 10).alias("newest"), F.size("inputs").alias("n"),
        F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x).alias("total"),
    ),
    f"""WITH {TX_SERIES} SELECT category, date, amount AS target, lag(amount, 10) OVER w AS oldest,
        lag(amount) OVER w AS newest, CAST(10 AS INTEGER) AS n,
        sum(amount) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS total FROM filled
        WINDOW w AS (PARTITION BY category ORDER BY date)
        QUALIFY lag(amount, 10) OVER w IS NOT NULL AND
        count(*) OVER (PARTITION BY category) >= 30""",
    "target oldest newest total",
)
_WEIGHTS = {"mean": 0.4, "fallback": 0.6}
_SQL_W = "CASE forecaster WHEN 'mean' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END"
for method, agg in (
    ("weighted_average", f"sum({{c}} * {_SQL_W}) / sum({_SQL_W})"),
    ("simple_average", "avg({c})"),
    ("median", "median({c})"),
):
    register(
        f"ensemble_forecast_{method}",
        lambda s, d, m=method: ops.ensemble_forecast(fc(s, d), m, _WEIGHTS),
        f"""WITH {FC} SELECT 'ensemble' AS forecaster, category, ds, {', '.join(
            f"{agg.format(c=c)} AS {c}" for c in BOUNDS.split())}
            FROM fc GROUP BY category, ds HAVING count(*) = 2""",
        BOUNDS,
    )
register(
    "normalize_weights",
    lambda s, d: ops.normalize_weights(
        ev(s, d).groupBy(F.col("category").alias("forecaster")).agg(
            F.count("*").cast("double").alias("weight")
        )
    ),
    f"""WITH {EV} SELECT category AS forecaster,
        count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM ev GROUP BY 1""",
    "8:weight",
)


def _split(s, d):
    parts = ops.chrono_split(ev_series(s, d))
    return parts.filter("part = 'train'"), parts.filter("part = 'test'")


def _predicted(s, d):
    train, test = _split(s, d)
    both = ops.forecast_mean(train, DAYS).unionByName(
        ops.forecast_fallback(train, DAYS, level="last")
    )
    return both, test


_PRED = f"""{EV_SERIES}, {_SPLIT}, train AS (SELECT * FROM parts WHERE part = 'train'),
    pred AS ({sql_mean('train')} UNION ALL {sql_fallback('train', 'max_by(amount, date)')}),
    p AS (SELECT forecaster, category, amount AS p, row_number() OVER
      (PARTITION BY forecaster, category ORDER BY ds) AS step FROM pred),
    a AS (SELECT category, amount AS a, row_number() OVER (PARTITION BY category ORDER BY date)
      AS step FROM parts WHERE part = 'test'),
    scores AS (SELECT forecaster, category, avg(abs(a - p)) AS mae,
      sqrt(avg((a - p) * (a - p))) AS rmse,
      CASE WHEN min(abs(a)) > 0 THEN avg(abs((a - p) / nullif(a, 0))) * 100 END AS mape
      FROM p JOIN a USING (category, step) GROUP BY 1, 2),
    metrics AS (SELECT forecaster, category, 'mae' AS metric, mae AS value FROM scores UNION ALL
      SELECT forecaster, category, 'rmse', rmse FROM scores UNION ALL
      SELECT forecaster, category, 'mape', mape FROM scores WHERE mape IS NOT NULL)"""


def metrics(s, d):
    return score.compare_forecasters(*_predicted(s, d))


register("forecast_metrics", lambda s, d: score.forecast_metrics(*_predicted(s, d)),
         f"WITH {_PRED} SELECT * FROM scores", "mae rmse mape")
register("compare_forecasters", metrics, f"WITH {_PRED} SELECT * FROM metrics", "value")
register("best_forecaster", lambda s, d: score.best_forecaster(metrics(s, d)),
         f"""WITH {_PRED} SELECT category, forecaster, value FROM metrics WHERE metric = 'rmse'
         QUALIFY row_number() OVER (PARTITION BY category ORDER BY value, forecaster) = 1""",
         "value")
register("metrics_pivot", lambda s, d: score.metrics_pivot(metrics(s, d)),
         f"WITH {_PRED} SELECT forecaster, category, mae, rmse, mape FROM scores",
         "mae rmse mape")
register("evaluation_table", lambda s, d: score.evaluation_table(metrics(s, d)),
         f"""WITH {_PRED} SELECT *, row_number() OVER (PARTITION BY category, metric
         ORDER BY value, forecaster) = 1 AS is_best FROM metrics""", "value")
_CAT = """SELECT category, sum(abs(amount)) AS total_forecast, min(ds) AS start_date,
    max(ds) AS end_date, CAST(max(ds) - min(ds) + 1 AS INTEGER) AS period_days,
    CAST(0.8 AS DOUBLE) AS confidence_level, CAST(count(*) AS INTEGER) AS points FROM trend
    GROUP BY 1"""
register("forecast_by_category",
         lambda s, d: ops.forecast_by_category(trend(s, d)).withColumn("points", F.size("points")),
         f"WITH {TREND} {_CAT}", "2:total_forecast")
register(
    "forecast_by_category_points",
    lambda s, d: ops.forecast_by_category(trend(s, d)).select(
        "category", F.inline("points")
    ),
    f"""WITH {TREND} SELECT category, ds, abs(amount) AS amount, abs(lower_bound) AS lower_bound,
        abs(upper_bound) AS upper_bound FROM trend""",
    " ".join(f"2:{c}" for c in BOUNDS.split()),
)
register(
    "forecast_summary",
    lambda s, d: ops.forecast_summary(trend(s, d)).select(
        "total_forecast", "start_date", "end_date", "period_days",
        F.explode("categories_forecast").alias("category", "amount"),
    ),
    f"""WITH {TREND}, c AS (SELECT category, abs(sum(amount)) AS amount, min(ds) AS a, max(ds) AS b
        FROM trend GROUP BY 1)
        SELECT sum(amount) OVER () AS total_forecast, min(a) OVER () AS start_date,
        max(b) OVER () AS end_date, CAST(max(b) OVER () - min(a) OVER () + 1 AS INTEGER)
        AS period_days, category, amount FROM c""",
    "2:total_forecast 2:amount",
)
register("combine_forecasts", lambda s, d: ops.combine_forecasts(trend(s, d)),
         f"WITH {TREND} SELECT ds, sum(amount) AS amount FROM trend GROUP BY 1", "2:amount")
register(
    "forecast_highlights",
    lambda s, d: ops.forecast_highlights(trend(s, d)),
    f"""WITH {TREND} SELECT sum(amount) AS total_forecast, max(amount) AS highest_amount,
        max_by(ds, amount) AS highest_date, sum(amount) / 30 AS daily_average,
        count(DISTINCT category) AS categories FROM trend""",
    "2:total_forecast 2:highest_amount 2:daily_average",
)
for n in (7, 30, 90):
    register(
        f"forecast_horizon_{n}",
        lambda s, d, n=n: ops.forecast_horizon(
            ops.forecast_trend_seasonal(ev_series(s, d), 90), n
        ),
        f"""WITH {EV_SERIES}, {sql_trend('filled', 90)} SELECT category, sum(amount) AS total,
            avg(amount) AS average FROM (SELECT *, row_number() OVER (PARTITION BY category
            ORDER BY ds) AS i FROM trend) AS numbered WHERE i <= {n} GROUP BY 1""",
        "2:total 2:average",
    )
register(
    "forecast_cumulative",
    lambda s, d: ops.forecast_cumulative(trend(s, d)).select("category", "ds", "cumulative"),
    f"""WITH {TREND} SELECT category, ds, sum(amount) OVER (PARTITION BY category ORDER BY ds)
        AS cumulative FROM trend""",
    "2:cumulative",
)
register(
    "train_on_history",
    lambda s, d: jobs.train_on_history(txc(s, d), ops.forecast_mean, DAYS, days=90),
    f"""WITH {TXC}, recent AS (SELECT * FROM txc WHERE transaction_date >=
          (SELECT max(transaction_date) FROM txc) - INTERVAL 90 DAY),
        {sql_daily('recent')} {sql_mean('filled')}""",
    BOUNDS,
)


def _models():
    return {
        "arima": ops.forecast_arima,
        "autoregressive": ops.forecast_autoregressive,
        "mean": ops.forecast_mean,
    }


register("forecast_per_freq",
         lambda s, d: jobs.forecast_per_freq(txc(s, d), _models(), horizon=10)[0])
register("forecast_per_freq_metrics",
         lambda s, d: jobs.forecast_per_freq(txc(s, d), _models(), horizon=10)[1])
register(
    "fit_predict",
    lambda s, d: ops.fit_predict(
        ev_series(s, d),
        {"mean": ops.forecast_mean, "trend_seasonal": ops.forecast_trend_seasonal}, DAYS,
    ),
    f"WITH {TREND} SELECT * FROM trend UNION ALL {sql_mean('filled')}",
    " ".join(f"2:{c}" for c in BOUNDS.split()),
)


def _cents(part):
    return part.assign(cents=(part["l_extendedprice"] * 100).round().astype("int64"))


register(
    "map_partitions",
    lambda s, d: jobs.map_partitions(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), _cents,
        "l_orderkey long, l_linenumber int, l_extendedprice double, cents long",
    ),
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem""",
)

Z975 = 1.959963984540054

register(
    "forecast_arima_100",
    lambda s, d: ops.forecast_arima(ev_series(s, d), DAYS, orders=[(1, 0, 0)]),
    f"""WITH {EV_SERIES},
        pairs AS (SELECT category, date, amount AS y, lag(amount) OVER (PARTITION BY category
          ORDER BY date) AS x FROM filled),
        fits AS (SELECT category, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
          (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / regr_count(y, x)
            AS s2, max(date) AS last, max_by(y, date) AS y0 FROM pairs GROUP BY 1),
        steps AS (SELECT *, unnest(range(1, {DAYS + 1})) AS h FROM fits),
        points AS (SELECT category, CAST(last + CAST(h AS INTEGER) AS DATE) AS ds,
          a / (1 - b) + pow(b, h) * (y0 - a / (1 - b)) AS amount,
          {Z975} * sqrt(s2 * (1 - pow(b, 2 * h)) / (1 - b * b)) AS reach FROM steps)
        SELECT 'arima' AS forecaster, category, ds, amount, amount - reach AS lower_bound,
          amount + reach AS upper_bound FROM points""",
    BOUNDS,
)


def sql_walk(source, keys="category", name="arima"):
    """The forecast of order (0, 1, 0): the last value, with a band that widens."""
    return f"""SELECT '{name}' AS forecaster, {keys}, CAST(last + CAST(h AS INTEGER) AS DATE) AS ds,
          y0 AS amount, y0 - {Z975} * sqrt(s2 * h) AS lower_bound,
          y0 + {Z975} * sqrt(s2 * h) AS upper_bound
        FROM (SELECT *, unnest(range(1, {DAYS + 1})) AS h FROM (
          SELECT {keys}, count(*) AS n, avg(step * step) AS s2, max(date) AS last,
            max_by(amount, date) AS y0 FROM (SELECT *, amount - lag(amount) OVER (
              PARTITION BY {keys} ORDER BY date) AS step FROM {source}) AS stepped
          GROUP BY ALL) AS fits WHERE n >= 10) AS steps"""


def _walk(series, days=DAYS, keys=ops.CATEGORY):
    return ops.forecast_arima(series, days, keys, orders=[(0, 1, 0)])


register("forecast_arima_010", lambda s, d: _walk(ev_series(s, d)),
         f"WITH {EV_SERIES} {sql_walk('filled')}", BOUNDS)

BY_ACCOUNT = "account_id, category"
register(
    "forecast_spending",
    lambda s, d: ops.forecast_spending(
        ops.daily_spending_series(ev(s, d), ("account_id", "category")), DAYS,
        ("account_id", "category"), _walk),
    f"""WITH {EV}, {sql_daily('ev', BY_ACCOUNT)}
        {sql_walk('filled', BY_ACCOUNT)}
        UNION ALL
        SELECT 'mean', {BY_ACCOUNT}, CAST(last + CAST(h AS INTEGER) AS DATE), m, m - sd, m + sd
        FROM (SELECT *, unnest(range(1, {DAYS + 1})) AS h FROM (
          SELECT {BY_ACCOUNT}, count(*) AS n, avg(amount) AS m, max(date) AS last,
            coalesce(stddev_samp(amount), 0.1 * abs(avg(amount))) AS sd
          FROM filled GROUP BY ALL) AS short WHERE n < 10) AS steps""",
    BOUNDS,
)
register(
    "ensemble_default_weights",
    lambda s, d: ops.ensemble_forecast(fc(s, d).replace(
        {"mean": "arima", "fallback": "trend_seasonal"}, subset=["forecaster"])),
    f"""WITH {FC} SELECT 'ensemble' AS forecaster, category, ds,
          {', '.join(f"(0.4 * max(CASE WHEN forecaster = 'mean' THEN {c} END)"
                     f" + 0.6 * max(CASE WHEN forecaster = 'fallback' THEN {c} END)) AS {c}"
                     for c in BOUNDS.split())}
        FROM fc GROUP BY category, ds""",
    BOUNDS,
)
register(
    "forecast_per_freq_dates",
    lambda s, d: jobs.forecast_per_freq(txc(s, d), {"mean": ops.forecast_mean}, horizon=6)[0].filter(
        "forecaster = 'mean'"),
    f"""WITH {TXC}, labelled AS ({' UNION ALL '.join(
          f"SELECT '{f}' AS freq, category, CAST({sql_label('transaction_date', f)} AS DATE) AS date, "
          f"-amount AS spending FROM txc WHERE amount < 0" for f in "DWM")}),
        sums AS (SELECT freq, category, date, sum(spending) AS amount FROM labelled GROUP BY ALL),
        placed AS (SELECT *, count(*) OVER (PARTITION BY freq, category) AS n, row_number() OVER (
          PARTITION BY freq, category ORDER BY date) AS i FROM sums),
        levels AS (SELECT freq, category, avg(amount) AS m, stddev_samp(amount) AS sd,
          max(date) AS last FROM placed
          WHERE n >= 10 AND i <= floor(n * CAST(0.8 AS DOUBLE)) GROUP BY ALL),
        steps AS (SELECT *, CAST(unnest(range(1, 7)) AS INTEGER) AS h FROM levels)
        SELECT 'mean' AS forecaster, freq, category,
          CAST(CASE freq WHEN 'D' THEN last + h WHEN 'W' THEN last + 7 * h
               ELSE last_day(last_day(last) - 27 + to_months(h)) END AS DATE) AS ds,
          m AS amount, m - sd AS lower_bound, m + sd AS upper_bound FROM steps""",
    BOUNDS,
)
