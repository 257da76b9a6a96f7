"""Recommendations and reports for every account at once."""

from pyspark.sql import functions as F

from checks.base import LEDGER, TXC, ledger, register, txc
from checks.q_recommend import CASH, HIGH, R_REC, REC_COLS, RECURRING, SAVING, _STATS, sql_monthly
from tallyframe.operators import recommend as ops
from tallyframe.operators import reports

KEYS = ("account_id",)


def _own(sql):
    """A rule's rows with their account."""
    return sql.replace("SELECT ", "SELECT account_id, ", 1)


_HABIT = "'" + ops.MESSAGES["financial_habit"] + "'"
# Means of a few amounts in cents often end in half a cent, which engines round either way; the scaled
# amounts do not.
SCALE = 1.01373
BY_ACCOUNT = f"""{LEDGER}, scaled AS (SELECT * REPLACE (amount * CAST({SCALE} AS DOUBLE) AS amount)
      FROM ledger), {sql_monthly('scaled', 'account_id, ')},
    aged AS (SELECT *, dense_rank() OVER (PARTITION BY account_id ORDER BY month DESC) <= 3 AS fresh
      FROM monthly),
    patterns AS (SELECT account_id, category, {_STATS.replace('month >= cutoff', 'fresh')}
      FROM aged GROUP BY ALL),
    steps AS (SELECT account_id, description, amount, transaction_date,
      floor((epoch_us(transaction_date) - epoch_us(lag(transaction_date) OVER
        (PARTITION BY account_id, description ORDER BY transaction_date))) / 86400000000) AS gap
      FROM scaled),
    charges AS (SELECT account_id, description, avg(-amount) FILTER (WHERE amount < 0) AS amount,
      avg(-amount) FILTER (WHERE amount < 0) * (365 / nullif(avg(gap), 0)) AS annual_cost
      FROM steps GROUP BY ALL
      HAVING count(*) >= 3 AND count(*) FILTER (WHERE amount < 0) >= 3
        AND stddev_samp(-amount) FILTER (WHERE amount < 0)
          / avg(-amount) FILTER (WHERE amount < 0) <= 0.1
        AND max(gap) - min(gap) <= 5 AND sum(gap) > 0),
    flow AS (SELECT *, CASE WHEN i > 0 THEN (i - e) / i * 100 END AS rate FROM (
      SELECT account_id, avg(e) AS e, avg(i) AS i, sum(ne) AS ne, sum(ni) AS ni FROM (
        SELECT account_id, -sum(amount) FILTER (WHERE amount < 0) AS e,
          sum(amount) FILTER (WHERE amount > 0) AS i, count(*) FILTER (WHERE amount < 0) AS ne,
          count(*) FILTER (WHERE amount > 0) AS ni
        FROM scaled GROUP BY account_id, date_trunc('month', transaction_date)) AS m
      GROUP BY 1) AS t),
    rules AS ({_own(HIGH)} UNION ALL {_own(SAVING)} UNION ALL {_own(RECURRING)}
      UNION ALL {_own(CASH)}),
    habit AS (SELECT l.account_id, 'financial_habit' AS type, NULL AS category, NULL AS description,
      {_HABIT} AS message, NULL AS amount, NULL AS percentage, NULL AS annual_cost,
      100 AS savings_potential, 50 AS priority, 0.9 AS confidence, NULL AS action, 5 AS seq
      FROM (SELECT DISTINCT account_id FROM ledger) AS l
      WHERE (SELECT count(*) FROM rules AS r WHERE r.account_id = l.account_id) < 3),
    named AS (SELECT * REPLACE (coalesce(category, 'general') AS category)
      FROM (SELECT * FROM rules UNION ALL SELECT * FROM habit) AS every),
    ranked AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY account_id
      ORDER BY priority DESC, seq, category, description NULLS FIRST) <= {{limit}})"""
_COLS = "account_id, " + ", ".join(REC_COLS)


def _scaled(s, d):
    return ledger(s, d).withColumn("amount", F.col("amount") * SCALE)


def _ranked(s, d, limit):
    return ops.recommendations(_scaled(s, d), limit=limit, keys=KEYS)


register("recommendations_by_account",
         lambda s, d: _ranked(s, d, 5).select("account_id", *REC_COLS),
         f"WITH {BY_ACCOUNT.format(limit=5)} SELECT {_COLS} FROM ranked", R_REC)
register("all_recommendations_by_account",
         lambda s, d: ops.all_recommendations(_scaled(s, d), keys=KEYS).groupBy(
             "account_id", "type").agg(F.count("*").alias("n"), F.max("priority").alias("priority")),
         f"""WITH {BY_ACCOUNT.format(limit=5)} SELECT account_id, type, count(*) AS n,
             max(priority) AS priority FROM named GROUP BY ALL""")
register("top_recommendations_by_account",
         lambda s, d: ops.top_recommendations(_ranked(s, d, 10), 2, KEYS).select(
             "account_id", "type", "category", "message"),
         f"""WITH {BY_ACCOUNT.format(limit=10)} SELECT account_id, type, category, message FROM ranked
             QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY priority DESC, type, category,
             description NULLS FIRST) <= 2""")
register("recommendation_report_by_account",
         lambda s, d: ops.recommendation_report(_ranked(s, d, 10), keys=KEYS).select(
             "account_id", F.size("top_recommendations").cast("long").alias("best"),
             F.size("recommendation_by_type").cast("long").alias("types"), "savings_potential"),
         f"""WITH {BY_ACCOUNT.format(limit=10)} SELECT account_id, least(5, count(*)) AS best,
             count(DISTINCT type) AS types, coalesce(sum(CASE WHEN type = 'saving_opportunity'
             THEN savings_potential END), 0) AS savings_potential FROM ranked GROUP BY 1""",
         "savings_potential")
register("group_recommendations_by_account",
         lambda s, d: reports.group_recommendations(_ranked(s, d, 10), KEYS).select(
             "account_id", "type", "n", F.explode("messages").alias("message")),
         f"""WITH {BY_ACCOUNT.format(limit=10)} SELECT account_id, type, count(*) OVER (
             PARTITION BY account_id, type) AS n, message FROM ranked""")

_SUMMARY = ("total_income", "total_expenses", "recent_income", "recent_expenses",
            "transaction_count", "days", "net_cashflow", "recent_net_cashflow", "monthly_income",
            "monthly_expenses", "monthly_net_cashflow", "savings_rate")
_STABLE = ("months", "mean", "median", "min", "max", "std_dev", "cv")
_TREND = ("months", "slope", "correlation", "percent_change")


def _unpivot(source, section, name, measures, words=()):
    rows = [f"('{m}', CAST({m} AS DOUBLE), NULL)" for m in measures]
    rows += [f"('{w}', NULL, CAST({w} AS VARCHAR))" for w in words]
    return f"""SELECT account_id, '{section}' AS section, {name} AS name, f.measure, f.value, f.word
        FROM {source}, LATERAL (VALUES {', '.join(rows)}) AS f(measure, value, word)"""


def _side(kind):
    sign, op = ("", ">") if kind == "income" else ("-", "<")
    return f"""{kind}_sums AS (SELECT account_id, category, {sign}sum(amount) AS amount,
        count(*) AS n, {sign}sum(sum(amount)) OVER (PARTITION BY account_id) AS whole
        FROM txc WHERE amount {op} 0 GROUP BY 1, 2),
      {kind}_parts AS (SELECT *, amount / whole * 100 AS percentage FROM {kind}_sums
        WHERE amount >= 0.01 * whole),
      {kind}_months AS (SELECT account_id, date_trunc('month', transaction_date) AS month,
        {sign}sum(amount) AS amount, CAST(row_number() OVER (PARTITION BY account_id
        ORDER BY date_trunc('month', transaction_date)) - 1 AS DOUBLE) AS i
        FROM txc WHERE amount {op} 0 GROUP BY 1, 2),
      {kind}_stats AS (SELECT account_id, count(*) AS months, avg(amount) AS mean,
        quantile_cont(amount, 0.5) AS median, min(amount) AS min, max(amount) AS max,
        stddev_samp(amount) AS std_dev, stddev_samp(amount) / avg(amount) AS cv,
        CASE WHEN count(*) < 3 THEN 'insufficient data'
          WHEN stddev_samp(amount) / avg(amount) < 0.1 THEN 'very stable'
          WHEN stddev_samp(amount) / avg(amount) < 0.2 THEN 'stable'
          WHEN stddev_samp(amount) / avg(amount) < 0.3 THEN 'moderately stable'
          WHEN stddev_samp(amount) / avg(amount) < 0.5 THEN 'variable' ELSE 'highly variable'
          END AS stability FROM {kind}_months GROUP BY 1),
      {kind}_stable AS (SELECT account_id, months, stability, {', '.join(
          f'CASE WHEN months >= 3 THEN {c} END AS {c}' for c in _STABLE[1:])} FROM {kind}_stats),
      {kind}_line AS (SELECT account_id, count(*) AS months, regr_slope(amount, i) AS slope,
        corr(amount, i) AS correlation, (max_by(amount, month) - min_by(amount, month))
          / min_by(amount, month) * 100 AS percent_change,
        CASE WHEN regr_slope(amount, i) > 0 THEN 'increasing'
          WHEN regr_slope(amount, i) < 0 THEN 'decreasing' ELSE 'stable' END AS interpretation
        FROM {kind}_months GROUP BY 1 HAVING count(*) >= 4 AND var_pop(amount) > 0)"""


register(
    "financial_report_by_account",
    # Moments are left to the plain summary: their text form differs between engines.
    lambda s, d: reports.account_report(txc(s, d)).filter(
        ~F.col("measure").isin("start_date", "end_date")).withColumn(
        "value", F.round(F.col("value") + 0.00137, 2)),
    f"""WITH {TXC}, last AS (SELECT account_id, max(transaction_date) - INTERVAL 30 DAY AS since
          FROM txc GROUP BY 1),
        r AS (SELECT account_id, coalesce(sum(amount) FILTER (amount > 0), 0) AS total_income,
          coalesce(-sum(amount) FILTER (amount < 0), 0) AS total_expenses,
          coalesce(sum(amount) FILTER (amount > 0 AND transaction_date >= since), 0)
            AS recent_income,
          coalesce(-sum(amount) FILTER (amount < 0 AND transaction_date >= since), 0)
            AS recent_expenses, count(*) AS transaction_count,
          CAST(floor((epoch_us(max(transaction_date)) - epoch_us(min(transaction_date)))
            / 86400000000) AS BIGINT) AS days FROM txc JOIN last USING (account_id) GROUP BY 1),
        summary AS (SELECT *, total_income - total_expenses AS net_cashflow,
          recent_income - recent_expenses AS recent_net_cashflow,
          total_income / greatest(1, days // 30) AS monthly_income,
          total_expenses / greatest(1, days // 30) AS monthly_expenses,
          (total_income - total_expenses) / greatest(1, days // 30) AS monthly_net_cashflow,
          CASE WHEN total_income > 0 THEN (total_income - total_expenses) / total_income * 100
               ELSE 0 END AS savings_rate FROM r),
        {_side('income')}, {_side('expense')},
        tops AS (SELECT *, row_number() OVER (PARTITION BY account_id, kind
          ORDER BY amount DESC, category) AS rank FROM (
            SELECT account_id, category, amount, 'income' AS kind FROM income_sums UNION ALL
            SELECT account_id, category, amount, 'expense' FROM expense_sums) AS s),
        back AS (SELECT account_id, category, -sum(amount) AS v, row_number() OVER (
          PARTITION BY account_id, category ORDER BY date_trunc('month', transaction_date) DESC) AS b
          FROM txc WHERE amount < 0
          GROUP BY account_id, category, date_trunc('month', transaction_date)),
        moves AS (SELECT account_id, category, max(v) FILTER (b = 1) AS last,
          max(v) FILTER (b = 2) AS previous FROM back GROUP BY 1, 2),
        breakdown AS (SELECT e.account_id, e.category, amount, round(amount / whole * 100, 1)
          AS percentage, n AS transaction_count, amount / n AS average_transaction,
          (last - previous) / previous * 100 AS month_to_month_change
          FROM expense_sums AS e JOIN moves USING (account_id, category)
          WHERE round(amount / whole * 100, 1) >= 1),
        slices AS (SELECT account_id, CASE WHEN round(amount / whole * 100, 1) >= 3 THEN category
          ELSE 'Other' END AS slice, sum(round(amount / whole * 100, 1)) AS percentage
          FROM expense_sums GROUP BY 1, 2),
        facts AS ({_unpivot('summary', 'summary', 'NULL', _SUMMARY)}
          UNION ALL {' UNION ALL '.join(
              _unpivot(f'{k}_parts', f'{k}_parts', 'category', ('amount', 'percentage'))
              + ' UNION ALL '
              + _unpivot(f'{k}_stable', f'{k}_stability', 'NULL', _STABLE, ('stability',))
              + ' UNION ALL '
              + _unpivot(f'{k}_line', f'{k}_trend', 'NULL', _TREND, ('interpretation',))
              for k in ('income', 'expense'))}
          UNION ALL {_unpivot('(SELECT * FROM tops WHERE rank <= 3) AS t', 'top_categories',
                              "kind || ':' || category", ('amount', 'rank'))}
          UNION ALL {_unpivot('breakdown', 'category_breakdown', 'category', (
              'amount', 'percentage', 'transaction_count', 'average_transaction',
              'month_to_month_change'))}
          UNION ALL {_unpivot('slices', 'slices', 'slice', ('percentage',))})
        SELECT * REPLACE (round(value + 0.00137, 2) AS value) FROM facts""",
)
