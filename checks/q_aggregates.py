"""Totals, shares and summaries."""

from pyspark.sql import functions as F

from checks.base import CATEGORIES, TX, TX_RAW, TXC, register, table, tx_raw, txc
from tallyframe.operators import aggregates as ops

SPENT = "coalesce(-sum(amount) FILTER (WHERE amount < 0), 0)"
EARNED = "coalesce(sum(amount) FILTER (WHERE amount > 0), 0)"
MONTH = "CAST(date_trunc('month', transaction_date) AS DATE)"
SPAN = """transaction_date >= TIMESTAMP '1996-01-01' AND transaction_date <= TIMESTAMP '2000-06-30'"""

register(
    "transaction_summary",
    lambda s, d: ops.transaction_summary(txc(s, d), "1996-01-01", "2000-06-30"),
    f"""WITH {TXC} SELECT count(*) AS total_transactions, min(transaction_date) AS start_date,
        max(transaction_date) AS end_date, {SPENT} AS total_spending, {EARNED} AS total_income,
        sum(amount) AS net_cashflow FROM txc WHERE {SPAN}""",
    "total_spending total_income net_cashflow",
)


def _pairs(s, d):
    raw = tx_raw(s, d)
    return raw.select(
        F.try_to_timestamp("DATE").alias("transaction_date"),
        F.col("` WITHDRAWAL AMT `").cast("double").alias("withdrawal"),
        F.col("` DEPOSIT AMT `").cast("double").alias("deposit"),
    )


register(
    "transaction_summary_statement",
    lambda s, d: ops.transaction_summary(_pairs(s, d)),
    f"""WITH {TX_RAW}, p AS (SELECT CAST(TRY_CAST("DATE" AS DATE) AS TIMESTAMP) AS t,
        CAST(" WITHDRAWAL AMT " AS DOUBLE) AS w, CAST(" DEPOSIT AMT " AS DOUBLE) AS p FROM tx_raw)
        SELECT count(*) AS total_transactions, min(t) AS start_date, max(t) AS end_date,
        sum(w) AS total_spending, sum(p) AS total_income, sum(p) - sum(w) AS net_cashflow FROM p""",
    "total_spending total_income net_cashflow",
)
register(
    "category_breakdown",
    lambda s, d: ops.category_breakdown(txc(s, d)),
    f"WITH {TXC} SELECT category, -sum(amount) AS spending FROM txc WHERE amount < 0 GROUP BY 1",
    "spending",
)
register(
    "transaction_stats",
    lambda s, d: ops.transaction_stats(txc(s, d), "2000-06-30", days=90).select(
        "period_start", "period_end", "total_income", "total_expenses", "net_cashflow",
        F.explode("categories").alias("category", "amount"),
    ),
    f"""WITH {TXC}, w AS (SELECT * FROM txc WHERE transaction_date
          BETWEEN TIMESTAMP '2000-06-30' - INTERVAL 90 DAY AND TIMESTAMP '2000-06-30')
        SELECT TIMESTAMP '2000-06-30' - INTERVAL 90 DAY AS period_start,
        TIMESTAMP '2000-06-30' AS period_end,
        (SELECT {EARNED} FROM w) AS total_income, (SELECT {SPENT} FROM w) AS total_expenses,
        (SELECT {EARNED} - {SPENT} FROM w) AS net_cashflow, category, sum(amount) AS amount
        FROM w GROUP BY category""",
    "total_income total_expenses net_cashflow amount",
)
register(
    "category_stats",
    lambda s, d: ops.category_stats(txc(s, d), "food", "2000-06-30", "1996-01-01"),
    f"""WITH {TXC}, w AS (SELECT * FROM txc WHERE {SPAN}),
        mine AS (SELECT * FROM w WHERE category = 'food'),
        months AS (SELECT {MONTH} AS month, abs(sum(amount)) AS v FROM mine GROUP BY 1
                   ORDER BY month DESC LIMIT 2)
        SELECT 'food' AS name, count(*) AS transaction_count, abs(sum(amount)) AS total_amount,
        abs(avg(amount)) AS average_transaction,
        abs(sum(amount)) / abs((SELECT sum(amount) FROM w)) * 100 AS percentage_of_total,
        (SELECT (max_by(v, month) - min_by(v, month)) / min_by(v, month) * 100 FROM months)
          AS month_to_month_change FROM mine""",
    "total_amount average_transaction percentage_of_total month_to_month_change",
)
register(
    "category_totals",
    lambda s, d: ops.category_totals(txc(s, d)),
    f"WITH {TXC} SELECT category, sum(amount) AS amount FROM txc GROUP BY 1",
    "amount",
)
_TOP = f"""WITH {TXC}, totals AS (SELECT category, sum(amount) AS amount FROM txc GROUP BY 1)
    SELECT category, -amount AS amount FROM totals WHERE amount < 0 AND category <> 'income'"""
register(
    "top_spending",
    lambda s, d: ops.top_spending(txc(s, d)),
    f"{_TOP} ORDER BY amount DESC, category LIMIT 5",
    "amount",
)
register(
    "category_share",
    lambda s, d: ops.category_share(txc(s, d)),
    f"SELECT category, amount, amount / sum(amount) OVER () * 100 AS percentage FROM ({_TOP}) AS t",
    "amount percentage",
)
register(
    "monthly_totals",
    lambda s, d: ops.monthly_totals(txc(s, d)),
    f"""WITH {TXC} SELECT {MONTH} AS month, sum(amount) AS total, count(*) AS n FROM txc
        GROUP BY 1""",
    "total",
)
register(
    "monthly_category_pivot",
    lambda s, d: ops.monthly_category_pivot(txc(s, d), CATEGORIES),
    f"""WITH {TXC} SELECT {MONTH} AS month, {', '.join(
        f"coalesce(sum(amount) FILTER (WHERE category = '{c}'), 0) AS {c}" for c in CATEGORIES)}
        FROM txc GROUP BY 1""",
    " ".join(CATEGORIES),
)
register(
    "monthly_balance",
    lambda s, d: ops.monthly_balance(txc(s, d), "1998-03-01"),
    f"""WITH {TXC} SELECT {EARNED} AS income, {SPENT} AS expenses, {EARNED} - {SPENT} AS balance
        FROM txc WHERE {MONTH} = DATE '1998-03-01'""",
    "income expenses balance",
)
for name, fn, bucket, sql in (
    ("weekday", ops.spending_by_weekday, "weekday",
     "CAST(isodow(transaction_date) - 1 AS INTEGER)"),
    ("month", ops.spending_by_month, "month", "CAST(month(transaction_date) AS INTEGER)"),
):
    by = f"""WITH {TXC} SELECT {sql} AS {bucket}, -sum(amount) AS spending FROM txc
        WHERE amount < 0 GROUP BY 1"""
    register(f"spending_by_{name}", lambda s, d, fn=fn: fn(txc(s, d)), by, "spending")
    register(
        f"spending_extremes_{name}",
        lambda s, d, fn=fn, b=bucket: ops.spending_extremes(fn(txc(s, d)), b),
        f"""SELECT max_by({bucket}, spending) AS highest, min_by({bucket}, spending) AS lowest
            FROM ({by}) AS t""",
    )
register(
    "income_expense_totals",
    lambda s, d: ops.income_expense_totals(txc(s, d)),
    f"WITH {TXC} SELECT {SPENT} AS expenses, {EARNED} AS income, {EARNED} - {SPENT} AS net FROM txc",
    "expenses income net",
)


def _budgets(s, d):
    """A budget per category: a round sum per row of the category."""
    return txc(s, d).groupBy("category").agg(
        (F.count("*") * 200000.0 + F.length("category") * 10000.0).alias("budget")
    )


register(
    "budget_usage",
    lambda s, d: ops.budget_usage(txc(s, d), _budgets(s, d)),
    f"""WITH {TXC}, budgets AS (SELECT category,
          count(*) * CAST(200000 AS DOUBLE) + length(category) * CAST(10000 AS DOUBLE) AS budget
          FROM txc GROUP BY 1),
        used AS (SELECT category, budget, coalesce(-sum(amount) FILTER (WHERE amount < 0), 0)
          AS spent FROM budgets JOIN txc USING (category) GROUP BY 1, 2)
        SELECT *, CAST(least(100, floor(spent / budget * 100 + 0.5)) AS INTEGER) AS percentage,
        least(100, floor(spent / budget * 100 + 0.5)) > 90 AS alert FROM used""",
    "spent",
)

_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
          "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
          "l_discount": "double", "l_tax": "double"}
_PROFILE = " UNION ALL ".join(
    [
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows,
        count(*) - count({c}) AS n_nulls, avg(CAST({c} AS DOUBLE)) AS mean,
        stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
        quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
        quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM lineitem"""
        for c, t in _TYPES.items()
    ]
    + [
        f"""SELECT '{c}', '{t}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL,
        NULL, NULL FROM lineitem"""
        for c, t in (("l_returnflag", "string"), ("l_linestatus", "string"),
                     ("l_shipdate", "timestamp_ntz"))
    ]
)
register(
    "profile_table",
    lambda s, d: ops.profile_table(table(s, d, "lineitem")),
    _PROFILE,
    "mean std min max q25 q50 q75",
)
register(
    "value_counts",
    lambda s, d: ops.value_counts(table(s, d, "lineitem")),
    """SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS n FROM lineitem
       GROUP BY 2 UNION ALL
       SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2""",
)
register(
    "monthly_summary",
    lambda s, d: ops.monthly_summary(txc(s, d)).select(
        "month", "total_income", "total_expenses", "net", F.posexplode("top_categories")
    ).select("month", "total_income", "total_expenses", "net", "pos", "col.*"),
    f"""WITH {TXC}, sums AS (
          SELECT strftime(transaction_date, '%Y-%m') AS month, category, {EARNED} AS e, {SPENT} AS s,
                 count(*) FILTER (WHERE amount < 0) AS n FROM txc GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY s DESC, category) AS r,
                 sum(s) OVER w AS ms, sum(e) OVER w AS me FROM sums
                 WINDOW w AS (PARTITION BY month))
        SELECT month, me AS total_income, ms AS total_expenses, me - ms AS net,
               CAST(r - 1 AS INTEGER) AS pos, category, s AS amount, s / ms * 100 AS percentage,
               n AS count FROM ranked WHERE r <= 5 AND s > 0""",
    "total_income total_expenses net amount percentage",
)
