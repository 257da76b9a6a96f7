"""Least-squares models inside the JVM: closed forms of their small cases."""

from checks.base import register
from checks.q_forecasts import BOUNDS, DAYS, TX_SERIES, Z975, tx_series
from tallyframe.operators import forecasting as ops

_STEP = "ds, amount, amount - reach AS lower_bound, amount + reach AS upper_bound"

register(
    "forecast_autoregressive_1",
    lambda s, d: ops.forecast_autoregressive(tx_series(s, d), DAYS, n=1),
    f"""WITH {TX_SERIES}, scaled AS (SELECT category, date, (amount - low) / span AS x, low, span
          FROM (SELECT *, min(amount) OVER w AS low, coalesce(nullif(max(amount) OVER w
          - min(amount) OVER w, 0), 1) AS span FROM filled
          WINDOW w AS (PARTITION BY category)) AS ranged),
        pairs AS (SELECT *, lag(x) OVER (PARTITION BY category ORDER BY date) AS x1 FROM scaled),
        fits AS (SELECT category, max(date) AS last, max_by(x, date) AS x0, max(low) AS low,
          max(span) AS span, regr_sxy(x, x1) / (regr_sxx(x, x1) + 0.001) AS b,
          regr_avgy(x, x1) AS my, regr_avgx(x, x1) AS mx, regr_syy(x, x1) AS syy,
          regr_sxy(x, x1) AS sxy, regr_sxx(x, x1) AS sxx, regr_count(x, x1) AS m, count(*) AS n
          FROM pairs GROUP BY 1),
        steps AS (SELECT *, my - b * mx AS a, CAST(unnest(range(1, {DAYS + 1})) AS INTEGER) AS h
          FROM fits WHERE n >= 3),
        points AS (SELECT category, CAST(last + h AS DATE) AS ds,
          (a / (1 - b) + pow(b, h) * (x0 - a / (1 - b))) * span + low AS amount,
          1.96 * sqrt((syy - 2 * b * sxy + b * b * sxx) / (m - 1)) * span AS reach FROM steps)
        SELECT 'autoregressive' AS forecaster, category, {_STEP} FROM points""",
    BOUNDS,
)
register(
    "forecast_arima_search",
    lambda s, d: ops.forecast_arima(
        tx_series(s, d), DAYS, orders=[(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]),
    f"""WITH {TX_SERIES}, steps AS (SELECT category, date, amount AS y, lag(amount) OVER w AS y1,
          row_number() OVER w AS i FROM filled
          WINDOW w AS (PARTITION BY category ORDER BY date)),
        lagged AS (SELECT *, y - y1 AS w, lag(y - y1) OVER (PARTITION BY category ORDER BY date)
          AS w1 FROM steps),
        sums AS (SELECT category, max(date) AS last, max_by(y, date) AS y0, max_by(w, date) AS w0,
          count(*) FILTER (i > 2) AS m, avg(y) FILTER (i > 2) AS mean,
          var_pop(y) FILTER (i > 2) AS v00, avg(w * w) FILTER (i > 2) AS v01,
          regr_slope(y, y1) FILTER (i > 2) AS b10, regr_intercept(y, y1) FILTER (i > 2) AS a10,
          (regr_syy(y, y1) FILTER (i > 2) - pow(regr_sxy(y, y1) FILTER (i > 2), 2)
            / regr_sxx(y, y1) FILTER (i > 2)) / count(*) FILTER (i > 2) AS v10,
          sum(w * w1) FILTER (i > 2) / sum(w1 * w1) FILTER (i > 2) AS b11,
          (sum(w * w) FILTER (i > 2) - pow(sum(w * w1) FILTER (i > 2), 2)
            / sum(w1 * w1) FILTER (i > 2)) / count(*) FILTER (i > 2) AS v11
          FROM lagged GROUP BY 1 HAVING count(*) >= 10),
        tried AS (
          SELECT *, 0 AS pick, v00 AS v, 4 AS k, mean AS a, CAST(0 AS DOUBLE) AS b FROM sums UNION ALL
          SELECT *, 1, v10, 6, a10, b10 FROM sums WHERE abs(b10) < 0.999 UNION ALL
          SELECT *, 2, v01, 2, 0, 0 FROM sums UNION ALL
          SELECT *, 3, v11, 4, 0, b11 FROM sums WHERE abs(b11) < 0.999),
        best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY category
          ORDER BY m * (ln(2 * pi() * v) + 1) + k, pick) = 1),
        ahead AS (SELECT *, CAST(unnest(range(1, {DAYS + 1})) AS INTEGER) AS h FROM best),
        points AS (SELECT category, CAST(last + h AS DATE) AS ds,
          CASE WHEN pick = 0 THEN a WHEN pick = 1 THEN a / (1 - b) + pow(b, h) * (y0 - a / (1 - b))
               ELSE y0 + w0 * b * (1 - pow(b, h)) / (1 - b) END AS amount,
          {Z975} * sqrt(v * list_sum(list_transform(range(h), lambda j: CASE pick
            WHEN 0 THEN CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END WHEN 1 THEN pow(b, 2 * j)
            ELSE pow((1 - pow(b, j + 1)) / (1 - b), 2) END))) AS reach FROM ahead)
        SELECT 'arima' AS forecaster, category, {_STEP} FROM points""",
    BOUNDS,
)
register(
    "forecast_fourier_trend",
    lambda s, d: ops.forecast_fourier(tx_series(s, d), DAYS, weekly=0, yearly=0, changepoints=0),
    f"""WITH {TX_SERIES}, placed AS (SELECT category, date, amount AS y, CAST(date - min(date) OVER (
          PARTITION BY category) AS DOUBLE) AS t FROM filled),
        line AS (SELECT category, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) AS n,
          max(date) AS last FROM placed GROUP BY 1 HAVING count(*) >= 10),
        spread AS (SELECT category, 1.96 * stddev_samp(y - a - b * t) AS reach
          FROM placed JOIN line USING (category) GROUP BY 1),
        steps AS (SELECT *, CAST(unnest(range(1, {DAYS + 1})) AS INTEGER) AS h
          FROM line JOIN spread USING (category)),
        points AS (SELECT category, CAST(last + h AS DATE) AS ds, a + b * (n + h) AS amount, reach
          FROM steps)
        SELECT 'fourier' AS forecaster, category, {_STEP} FROM points""",
    " ".join(f"3:{c}" for c in BOUNDS.split()),
)
# All terms: compared with a direct solution in tests.
register("forecast_fourier", lambda s, d: ops.forecast_fourier(tx_series(s, d), DAYS))
_T = """regr_sxy({y}, {x}) / regr_sxx({y}, {x}) / sqrt((regr_syy({y}, {x})
    - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x}))
    / (regr_count({y}, {x}) - 2) / regr_sxx({y}, {x}))"""
register(
    "augmented_test_without_lags",
    lambda s, d: ops.augmented_test(tx_series(s, d), max_lags=0).select(
        "category", "n", *[f"{c}_{i}" for i in range(3) for c in ("t_stat", "lags")]),
    f"""WITH {TX_SERIES}, d0 AS (SELECT category, date, amount AS y0,
          amount - lag(amount) OVER w AS y1 FROM filled
          WINDOW w AS (PARTITION BY category ORDER BY date)),
        d1 AS (SELECT *, y1 - lag(y1) OVER w AS y2, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1
          FROM d0 WINDOW w AS (PARTITION BY category ORDER BY date)),
        d2 AS (SELECT *, y2 - lag(y2) OVER w AS y3, lag(y2) OVER w AS p2 FROM d1
          WINDOW w AS (PARTITION BY category ORDER BY date))
        SELECT category, count(*) AS n, {', '.join(
            _T.format(y=f'y{i + 1}', x=f'p{i}') + f' AS t_stat_{i}, CAST(0 AS INTEGER) AS lags_{i}'
            for i in range(3))} FROM d2 GROUP BY 1""",
    "t_stat_0 t_stat_1 t_stat_2",
)
register("augmented_test", lambda s, d: ops.augmented_test(tx_series(s, d)))
