"""Report sections."""

from pyspark.sql import functions as F

from checks.base import LEDGER, TXC, ledger, register, txc
from checks.q_forecasts import TREND as EV_TREND
from checks.q_forecasts import ev, trend
from checks.q_recommend import ranked, sql_ranked
from tallyframe.operators import reports as ops

EXP = "coalesce(-sum(amount) FILTER (WHERE amount < 0), 0)"
INC = "coalesce(sum(amount) FILTER (WHERE amount > 0), 0)"
RECENT = "transaction_date >= (SELECT max(transaction_date) FROM {0}) - INTERVAL 30 DAY"

register(
    "report_summary",
    lambda s, d: ops.report_summary(txc(s, d)),
    f"""WITH {TXC}, r AS (SELECT min(transaction_date) AS start_date,
          max(transaction_date) AS end_date, {INC} AS total_income, {EXP} AS total_expenses,
          coalesce(sum(amount) FILTER (WHERE amount > 0 AND {RECENT.format('txc')}), 0)
            AS recent_income,
          coalesce(-sum(amount) FILTER (WHERE amount < 0 AND {RECENT.format('txc')}), 0)
            AS recent_expenses,
          count(*) AS transaction_count,
          CAST(floor((epoch_us(max(transaction_date)) - epoch_us(min(transaction_date)))
            / 86400000000) AS BIGINT) AS days FROM txc)
        SELECT *, total_income - total_expenses AS net_cashflow,
          recent_income - recent_expenses AS recent_net_cashflow,
          total_income / greatest(1, days // 30) AS monthly_income,
          total_expenses / greatest(1, days // 30) AS monthly_expenses,
          (total_income - total_expenses) / greatest(1, days // 30) AS monthly_net_cashflow,
          (total_income - total_expenses) / total_income * 100 AS savings_rate FROM r""",
    "total_income total_expenses recent_income recent_expenses net_cashflow recent_net_cashflow "
    "monthly_income monthly_expenses monthly_net_cashflow savings_rate",
)
_CATS = f"""{TXC}, sums AS (
      SELECT 'income' AS kind, category, sum(amount) AS amount, count(*) AS n FROM txc
      WHERE amount > 0 GROUP BY 2 UNION ALL
      SELECT 'expense', category, -sum(amount), count(*) FROM txc WHERE amount < 0 GROUP BY 2)"""
register(
    "top_categories",
    lambda s, d: ops.top_categories(txc(s, d)),
    f"""WITH {_CATS} SELECT kind, category, amount, CAST(row_number() OVER (PARTITION BY kind
        ORDER BY amount DESC, category) AS INTEGER) AS rank FROM sums QUALIFY rank <= 3""",
    "amount",
)
for name, kind, column, fn in (
    ("income_sources", "income", "source", ops.income_sources),
    ("expense_categories", "expense", "category", ops.expense_categories),
):
    register(
        name,
        lambda s, d, fn=fn: fn(txc(s, d)),
        f"""WITH {_CATS}, mine AS (SELECT * FROM sums WHERE kind = '{kind}')
            SELECT category AS {column}, amount, amount / (SELECT sum(amount) FROM mine) * 100
            AS percentage FROM mine WHERE amount >= 0.01 * (SELECT sum(amount) FROM mine)""",
        "amount percentage",
    )


def sql_month(kind):
    sign, op = ("", ">") if kind == "income" else ("-", "<")
    return f"""months AS (SELECT date_trunc('month', transaction_date) AS month,
        {sign}sum(amount) AS amount FROM txc WHERE amount {op} 0 GROUP BY 1)"""


for kind in ("income", "expense"):
    register(
        f"monthly_stability_{kind}",
        lambda s, d, k=kind: ops.monthly_stability(txc(s, d), k),
        f"""WITH {TXC}, {sql_month(kind)}, st AS (SELECT count(*) AS months, avg(amount) AS mean,
            quantile_cont(amount, 0.5) AS median, min(amount) AS min, max(amount) AS max,
            stddev_samp(amount) AS std_dev, stddev_samp(amount) / avg(amount) AS cv FROM months)
            SELECT *, CASE WHEN months < 3 THEN 'insufficient data' WHEN cv < 0.1 THEN 'very stable'
            WHEN cv < 0.2 THEN 'stable' WHEN cv < 0.3 THEN 'moderately stable'
            WHEN cv < 0.5 THEN 'variable' ELSE 'highly variable' END AS stability FROM st""",
        "2:mean 2:median min max 2:std_dev 8:cv",
    )
    register(
        f"monthly_trend_{kind}",
        lambda s, d, k=kind: ops.monthly_trend(txc(s, d), k),
        f"""WITH {TXC}, {sql_month(kind)}, n AS (SELECT *,
            CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS i FROM months)
            SELECT count(*) AS months, regr_slope(amount, i) AS slope, corr(amount, i)
            AS correlation, (max_by(amount, month) - min_by(amount, month))
            / min_by(amount, month) * 100 AS percent_change, CASE WHEN regr_slope(amount, i) > 0
            THEN 'increasing' WHEN regr_slope(amount, i) < 0 THEN 'decreasing' ELSE 'stable' END
            AS interpretation FROM n""",
        "2:slope 8:correlation percent_change",
    )
register(
    "category_section",
    lambda s, d: ops.category_section(ledger(s, d)),
    f"""WITH {LEDGER}, e AS (SELECT * FROM ledger WHERE amount < 0),
        m AS (SELECT category, date_trunc('month', transaction_date) AS month, -sum(amount) AS v,
          row_number() OVER (PARTITION BY category ORDER BY date_trunc('month', transaction_date)
          DESC) AS back FROM e GROUP BY 1, 2),
        c AS (SELECT category, max(v) FILTER (WHERE back = 1) AS last,
          max(v) FILTER (WHERE back = 2) AS previous FROM m GROUP BY 1),
        t AS (SELECT category, -sum(amount) AS amount, count(*) AS n FROM e GROUP BY 1)
        SELECT category, amount, round(amount / (SELECT sum(amount) FROM t) * 100, 1) AS percentage,
        n AS transaction_count, amount / n AS average_transaction,
        (last - previous) / previous * 100 AS month_to_month_change FROM t JOIN c USING (category)
        WHERE round(amount / (SELECT sum(amount) FROM t) * 100, 1) >= 1""",
    "amount average_transaction month_to_month_change",
)
register(
    "pie_buckets",
    lambda s, d: ops.pie_buckets(ledger(s, d)),
    f"""WITH {LEDGER}, t AS (SELECT category, -sum(amount) AS amount FROM ledger WHERE amount < 0
          GROUP BY 1),
        p AS (SELECT category, round(amount / (SELECT sum(amount) FROM t) * 100, 1) AS pct FROM t)
        SELECT CASE WHEN pct >= 3 THEN category ELSE 'Other' END AS slice, sum(pct) AS percentage
        FROM p GROUP BY 1""",
    "1:percentage",
)
register(
    "group_recommendations",
    lambda s, d: ops.group_recommendations(ranked(s, d)).select(
        "type", "n", F.explode("messages").alias("message")
    ),
    f"""WITH {sql_ranked(15)} SELECT type, count(*) OVER (PARTITION BY type) AS n, message
        FROM ranked""",
)
register(
    "forecast_section",
    lambda s, d: ops.forecast_section(trend(s, d), ev(s, d)),
    f"""WITH {EV_TREND}, a AS (SELECT category, sum(abs(amount)) AS forecast_total,
          count(*) AS forecast_period_days FROM trend
          WHERE lower(category) NOT IN ('income', 'deposit', 'transfer') GROUP BY 1),
        c AS (SELECT category, -sum(amount) AS current_amount FROM ev
          WHERE amount < 0 AND {RECENT.format('ev')} GROUP BY 1)
        SELECT *, round((forecast_total - current_amount) / current_amount * 100, 1)
          AS percentage_change,
        CASE WHEN round((forecast_total - current_amount) / current_amount * 100, 1) > 0
          THEN 'increase' WHEN current_amount IS NOT NULL THEN 'decrease' END AS direction
        FROM a LEFT JOIN c USING (category)""",
    "2:forecast_total current_amount",
)
# One nested row; the sections above are what SQL compares.
register("financial_report",
         lambda s, d: ops.financial_report(txc(s, d), ranked(s, d), trend(s, d)).select(
             F.to_json(F.struct("*")).alias("report")))
