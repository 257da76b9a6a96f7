"""Patterns, recurring charges and recommendations."""

from pyspark.sql import functions as F

from checks.base import EV, LEDGER, TX_RECURRING, ev, ledger, register, sql_daily, tx_recurring
from checks.q_forecasts import sql_mean
from tallyframe.operators import forecasting
from tallyframe.operators import recommend as ops
from tallyframe.operators import tables

REC_COLS = ("type", "category", "description", "message", "amount", "percentage", "annual_cost",
            "savings_potential", "priority", "confidence", "action")
R_REC = "amount percentage annual_cost savings_potential"


def sql_monthly(source, keys=""):
    return f"""monthly AS (SELECT {keys}CAST(date_trunc('month', transaction_date) AS DATE) AS month,
      category, sum(-amount) AS spending FROM {source}
      WHERE amount < 0 AND category IS NOT NULL GROUP BY ALL)"""


_STATS = """avg(spending) AS avg_spending, quantile_cont(spending, 0.5) AS median_spending,
      quantile_cont(spending, 0.75) AS threshold,
      coalesce(avg(spending) FILTER (WHERE month >= cutoff), 0) AS recent_spending,
      count(*) AS months_count,
      coalesce(avg(spending) FILTER (WHERE month >= cutoff), 0) / avg(spending) AS recent_trend"""


def sql_patterns(source):
    return f"""{sql_monthly(source)},
    cut AS (SELECT min(month) AS cutoff FROM (
      SELECT DISTINCT month FROM monthly ORDER BY month DESC LIMIT 3) AS newest),
    patterns AS (SELECT category, {_STATS} FROM monthly CROSS JOIN cut GROUP BY category)"""


R_PATTERNS = "avg_spending median_spending threshold recent_spending recent_trend"


def sql_recurring(source):
    return f"""steps AS (SELECT description, amount, transaction_date,
      floor((epoch_us(transaction_date) - epoch_us(lag(transaction_date) OVER
        (PARTITION BY description ORDER BY transaction_date))) / 86400000000) AS gap
      FROM {source}),
    charges AS (SELECT description, avg(-amount) FILTER (WHERE amount < 0) AS amount,
      avg(gap) AS frequency_days, count(*) AS occurrences, max(transaction_date) AS last_date,
      avg(-amount) FILTER (WHERE amount < 0) * (365 / nullif(avg(gap), 0)) AS annual_cost
      FROM steps GROUP BY description
      HAVING count(*) >= 3 AND count(*) FILTER (WHERE amount < 0) >= 3
        AND stddev_samp(-amount) FILTER (WHERE amount < 0)
          / avg(-amount) FILTER (WHERE amount < 0) <= 0.1
        AND max(gap) - min(gap) <= 5 AND sum(gap) > 0)"""


def _text(expr, digits):
    return (f"regexp_replace(CAST(CAST(round({expr}, {digits}) AS DECIMAL(38, {digits})) AS VARCHAR)"
            f", '(\\.\\d+?)0+$', '\\1')")


def _message(kind, *values):
    parts = ops.MESSAGES[kind].replace("%%", "\0").split("%s")
    quoted = ["'" + p.replace("\0", "%").replace("'", "''") + "'" for p in parts]
    out = quoted[0]
    for value, part in zip(values, quoted[1:]):
        out += f" || {value} || {part}"
    return out


_LISTS = " ".join(
    f"WHEN '{k}' THEN [" + ", ".join(f"'{a}'" for a in v) + "]"
    for k, v in ops.SAVINGS_ACTIONS.items()
)
_ACTION = f"""(CASE category {_LISTS} END)[
    CAST(CAST('0x' || substr(md5(category), 1, 8) AS BIGINT) % 4 + 1 AS INTEGER)]"""
_OVER = "(recent_spending - avg_spending) / avg_spending * 100"
_SAVE = "(recent_spending - avg_spending)"
_RISE = "(ahead - avg_spending) / avg_spending * 100"


def _row(kind, source, where, **cols):
    values = {
        "type": f"'{kind}'", "category": "CAST(NULL AS VARCHAR)",
        "description": "CAST(NULL AS VARCHAR)", "message": "NULL",
        "amount": "CAST(NULL AS DOUBLE)", "percentage": "CAST(NULL AS DOUBLE)",
        "annual_cost": "CAST(NULL AS DOUBLE)", "savings_potential": "NULL", "priority": "NULL",
        "confidence": "NULL", "action": "CAST(NULL AS VARCHAR)", **cols,
    }
    values["priority"] = f"CAST({values['priority']} AS INTEGER)"
    values["confidence"] = f"CAST({values['confidence']} AS DOUBLE)"
    values["savings_potential"] = f"CAST({values['savings_potential']} AS DOUBLE)"
    order = ops.RULE_ORDER.index(kind)
    cols = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"SELECT {cols}, CAST({order} AS INTEGER) AS seq FROM {source} WHERE {where}"


HIGH = _row(
    "high_spending", "patterns",
    f"recent_spending > threshold AND months_count >= 3 AND {_OVER} > 10 AND {_SAVE} > 5",
    category="category", message=_message("high_spending", _text(_OVER, 1), "category",
                                          _text(_SAVE, 2)),
    amount=f"round({_OVER}, 1)", savings_potential=f"round({_SAVE}, 2)",
    priority=f"trunc(least(90, {_OVER}))", confidence="0.8",
)
SAVING = _row(
    "saving_opportunity", "patterns",
    "avg_spending > 100 AND category IN (" + ", ".join(f"'{c}'" for c in ops.SAVINGS_ACTIONS) + ")",
    category="category",
    message=_message("saving_opportunity", _text("avg_spending * 0.15", 2), "category", _ACTION),
    savings_potential="round(avg_spending * 0.15, 2)",
    priority="trunc(least(60, avg_spending * 0.15 / 5))", confidence="0.7", action=_ACTION,
)
TREND = _row(
    "spending_trend",
    "(SELECT * FROM patterns JOIN (SELECT category, abs(avg(amount)) AS ahead FROM fcast "
    "GROUP BY 1) AS f USING (category)) AS j",
    "ahead > avg_spending * 1.2",
    category="category", message=_message("spending_trend", "category", _text(_RISE, 1)),
    percentage=f"round({_RISE}, 1)", savings_potential="(ahead - avg_spending) * 0.5",
    priority=f"trunc(least(80, {_RISE}))", confidence="0.75",
)
RECURRING = _row(
    "recurring_charge", "charges", "annual_cost > 100",
    description="description", message=_message("recurring_charge", _text("amount", 2),
                                                "description"),
    amount="round(amount, 2)", annual_cost="round(annual_cost, 2)",
    savings_potential="annual_cost * 0.5", priority="trunc(least(70, annual_cost / 10))",
    confidence="0.8",
)


def sql_flow(source):
    return f"""flow AS (SELECT *, CASE WHEN i > 0 THEN (i - e) / i * 100 END AS rate FROM (
      SELECT avg(e) AS e, avg(i) AS i, sum(ne) AS ne, sum(ni) AS ni FROM (
        SELECT -sum(amount) FILTER (WHERE amount < 0) AS e,
          sum(amount) FILTER (WHERE amount > 0) AS i, count(*) FILTER (WHERE amount < 0) AS ne,
          count(*) FILTER (WHERE amount > 0) AS ni
        FROM {source} GROUP BY date_trunc('month', transaction_date)) AS m) AS t)"""


CASH = _row(
    "cashflow_improvement", "flow", "ne > 10 AND ni > 0 AND rate < 10",
    message=_message("cashflow_improvement",
                     f"CASE WHEN round(rate, 1) > 0 THEN {_text('rate', 1)} ELSE '0' END",
                     _text("e - i * 0.8", 2)),
    savings_potential="round(e - i * 0.8, 2)", priority="85", confidence="0.9",
)
ALL = f"""{LEDGER}, {sql_patterns('ledger')}, {sql_recurring('ledger')}, {sql_flow('ledger')},
    recs AS ({HIGH} UNION ALL {SAVING} UNION ALL {RECURRING} UNION ALL {CASH}),
    named AS (SELECT * REPLACE (coalesce(category, 'general') AS category) FROM recs)"""


def sql_ranked(limit):
    return f"""{ALL}, ranked AS (SELECT * EXCLUDE (seq) FROM named
      ORDER BY priority DESC, seq, category, description NULLS FIRST LIMIT {limit})"""


def patterns(s, d):
    return ops.spending_patterns(ledger(s, d))


def shown(df):
    return df.select(*REC_COLS)


NO_SEQ = "SELECT * EXCLUDE (seq) FROM ({0}) AS r"

register("monthly_category_spending", lambda s, d: ops.monthly_category_spending(ledger(s, d)),
         f"WITH {LEDGER}, {sql_monthly('ledger')} SELECT * FROM monthly", "spending")
register("spending_patterns", patterns,
         f"WITH {LEDGER}, {sql_patterns('ledger')} SELECT * FROM patterns", R_PATTERNS)
register(
    "spending_patterns_by_account",
    lambda s, d: ops.spending_patterns(ledger(s, d), keys=("account_id",)),
    f"""WITH {LEDGER}, {sql_monthly('ledger', 'account_id, ')},
        cut AS (SELECT account_id, min(month) AS cutoff FROM (SELECT DISTINCT account_id, month
          FROM monthly QUALIFY dense_rank() OVER (PARTITION BY account_id ORDER BY month DESC) <= 3)
          AS newest GROUP BY 1)
        SELECT account_id, category, {_STATS} FROM monthly JOIN cut USING (account_id)
        GROUP BY 1, 2""",
    R_PATTERNS,
)


def _late_uncategorised(s, d):
    """The ledger without categories in its last sixty days, so that its newest months have none."""
    rows = ledger(s, d)
    newest = rows.agg(F.max("transaction_date")).scalar()
    late = F.col("transaction_date") > newest - F.expr("interval 60 days")
    return rows.withColumn("category", F.when(~late, F.col("category")))


register(
    "spending_patterns_uncategorised",
    lambda s, d: ops.spending_patterns(_late_uncategorised(s, d)),
    f"""WITH {LEDGER}, late AS (SELECT * REPLACE (CASE WHEN transaction_date <=
          (SELECT max(transaction_date) FROM ledger) - INTERVAL 60 DAY THEN category END
          AS category) FROM ledger),
        {sql_monthly('late')},
        cut AS (SELECT min(month) AS cutoff FROM (SELECT DISTINCT
          CAST(date_trunc('month', transaction_date) AS DATE) AS month FROM late WHERE amount < 0
          ORDER BY month DESC LIMIT 3) AS newest)
        SELECT category, {_STATS} FROM monthly CROSS JOIN cut GROUP BY category""",
    R_PATTERNS,
)
register("rec_high_spending", lambda s, d: shown(ops.rec_high_spending(patterns(s, d))),
         NO_SEQ.format(f"WITH {LEDGER}, {sql_patterns('ledger')} {HIGH}"), R_REC)


def _shifted(s, d):
    """The newest three months of half of the descriptions count three times."""
    df = ledger(s, d)
    late = (F.col("transaction_date") >= "2001-06-01") & (F.length("description") % 2 == 0)
    return df.withColumn("amount", F.when(late, F.col("amount") * 3).otherwise(F.col("amount")))


register(
    "rec_high_spending_shifted",
    lambda s, d: shown(ops.rec_high_spending(ops.spending_patterns(_shifted(s, d)))),
    NO_SEQ.format(f"""WITH {LEDGER}, shifted AS (SELECT * REPLACE (
        CASE WHEN transaction_date >= TIMESTAMP '2001-06-01' AND length(description) % 2 = 0
        THEN amount * 3 ELSE amount END AS amount) FROM ledger),
        {sql_patterns('shifted')} {HIGH}"""), R_REC)
register("rec_saving_opportunity", lambda s, d: shown(ops.rec_saving_opportunity(patterns(s, d))),
         NO_SEQ.format(f"WITH {LEDGER}, {sql_patterns('ledger')} {SAVING}"), R_REC)


def _ev_forecast(s, d):
    series = forecasting.daily_spending_series(ev(s, d))
    return forecasting.forecast_mean(series, 30).withColumn(
        "amount", F.col("amount") * F.length("category")
    )


_EV_TREND = f"""{EV}, {sql_patterns('ev')}, {sql_daily('ev')}, mean_fc AS ({sql_mean('filled')}),
    fcast AS (SELECT * REPLACE (amount * length(category) AS amount) FROM mean_fc),
    small AS (SELECT * REPLACE (avg_spending / 10 AS avg_spending) FROM patterns)"""
register(
    "rec_spending_trend",
    lambda s, d: shown(ops.rec_spending_trend(
        ops.spending_patterns(ev(s, d)).withColumn("avg_spending", F.col("avg_spending") / 10),
        _ev_forecast(s, d),
    )),
    NO_SEQ.format(f"WITH {_EV_TREND} " + TREND.replace("FROM patterns JOIN", "FROM small JOIN")),
    R_REC,
)
register("recurring_charges", lambda s, d: ops.recurring_charges(ledger(s, d)),
         f"WITH {LEDGER}, {sql_recurring('ledger')} SELECT * FROM charges",
         "amount frequency_days annual_cost")
register("recurring_charges_events",
         lambda s, d: ops.recurring_charges(
             ev(s, d).withColumnRenamed("account_id", "description"), max_variance=2.0),
         f"""WITH {EV}, named_ev AS (SELECT account_id AS description, transaction_date, amount
         FROM ev), {sql_recurring('named_ev').replace('<= 0.1', '<= 2.0')} SELECT * FROM charges""",
         "amount frequency_days annual_cost")
register("rec_recurring_charge",
         lambda s, d: shown(ops.rec_recurring_charge(ops.recurring_charges(tx_recurring(s, d)))),
         NO_SEQ.format(f"WITH {TX_RECURRING}, {sql_recurring('tx_recurring')} {RECURRING}"), R_REC)
register("rec_cashflow", lambda s, d: shown(ops.rec_cashflow(ledger(s, d))),
         NO_SEQ.format(f"WITH {LEDGER}, {sql_flow('ledger')} {CASH}"), R_REC)
register("cashflow", lambda s, d: ops.cashflow(ledger(s, d)),
         f"""WITH {LEDGER}, {sql_flow('ledger')} SELECT e AS monthly_expenses, i AS monthly_income,
         CAST(ne AS BIGINT) AS expense_count, CAST(ni AS BIGINT) AS income_count,
         rate AS savings_rate FROM flow""", "monthly_expenses monthly_income savings_rate")
register(
    "rec_habit",
    lambda s, d: shown(ops.rec_habit(ops.rec_cashflow(ledger(s, d)))),
    NO_SEQ.format(f"""WITH {LEDGER}, {sql_flow('ledger')}, n AS (SELECT count(*) AS n FROM flow
        WHERE ne > 10 AND ni > 0 AND rate < 10) """ + _row(
        "financial_habit", "n", "n < 3",
        message="'" + ops.MESSAGES["financial_habit"] + "'", savings_potential="100",
        priority="50", confidence="0.9")), R_REC)
register("recommendations", lambda s, d: shown(ops.recommendations(ledger(s, d), limit=10)),
         f"WITH {sql_ranked(10)} SELECT * FROM ranked", R_REC)
register("all_recommendations",
         lambda s, d: ops.all_recommendations(ledger(s, d)).select(*REC_COLS),
         f"WITH {ALL} SELECT * EXCLUDE (seq) FROM named", R_REC)


def _ev_ledger(s, d):
    return ev(s, d).withColumn("description", F.col("category"))


register(
    "recommendations_with_forecasts",
    lambda s, d: shown(ops.recommendations(_ev_ledger(s, d), _ev_forecast(s, d).withColumn(
        "amount", F.col("amount") * 10))),
    f"""WITH {EV.replace('event_type AS category', 'event_type AS category, event_type AS description')},
        {sql_patterns('ev')}, {sql_recurring('ev')}, {sql_flow('ev')}, {sql_daily('ev')},
        mean_fc AS ({sql_mean('filled')}),
        fcast AS (SELECT * REPLACE (amount * length(category) * 10 AS amount) FROM mean_fc),
        recs AS ({HIGH} UNION ALL {SAVING} UNION ALL {TREND} UNION ALL {RECURRING} UNION ALL {CASH})
        SELECT * EXCLUDE (seq) REPLACE (coalesce(category, 'general') AS category) FROM (
          SELECT * FROM recs UNION ALL
          {_row('financial_habit', '(SELECT count(*) AS n FROM recs) AS c', 'n < 3',
                message="'" + ops.MESSAGES['financial_habit'] + "'", savings_potential='100',
                priority='50', confidence='0.9')}) AS u
        ORDER BY priority DESC, seq, category, description NULLS FIRST LIMIT 10""",
    R_REC,
)


def stored(s, d):
    """All recommendations with ids that do not change between runs."""
    return ops.with_stable_ids(ops.all_recommendations(ledger(s, d)).drop("seq"))


STORED = f"""{ALL}, stored AS (SELECT * EXCLUDE (seq), md5(type || '|' || category || '|' ||
    coalesce(description, '')) AS id FROM named)"""
LIST_COLS = ("id", "type", "category", "priority", "message")
register(
    "list_recommendations",
    lambda s, d: tables.list_recommendations(
        stored(s, d), skip=5, limit=20, min_priority=15, max_priority=80).select(*LIST_COLS),
    f"""WITH {STORED} SELECT {', '.join(LIST_COLS)} FROM stored WHERE priority BETWEEN 15 AND 80
        ORDER BY priority DESC, id LIMIT 20 OFFSET 5""",
)
register(
    "filter_recommendations",
    lambda s, d: tables.filter_recommendations(
        stored(s, d), type="recurring_charge", category="general").select(*LIST_COLS),
    f"""WITH {STORED} SELECT {', '.join(LIST_COLS)} FROM stored
        WHERE type = 'recurring_charge' AND category = 'general'""",
)
register(
    "recommendation_filters",
    lambda s, d: tables.recommendation_filters(stored(s, d)).select(
        F.concat_ws(",", "types").alias("types"), F.concat_ws(",", "categories").alias("categories"),
        "min_priority", "max_priority",
    ),
    f"""WITH {STORED} SELECT string_agg(DISTINCT type, ',' ORDER BY type) AS types,
        string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
        min(priority) AS min_priority, max(priority) AS max_priority FROM stored""",
)
register(
    "get_recommendation",
    lambda s, d: tables.get_recommendation(
        stored(s, d), "9e06dbd34f337d2c339318f12634fb14").select(*LIST_COLS),
    f"""WITH {STORED} SELECT {', '.join(LIST_COLS)} FROM stored
        WHERE id = '9e06dbd34f337d2c339318f12634fb14'""",
)
register("top_recommendations",
         lambda s, d: shown(ops.top_recommendations(ops.all_recommendations(ledger(s, d)))),
         f"""WITH {ALL} SELECT * EXCLUDE (seq) FROM named
         ORDER BY priority DESC, type, category, description NULLS FIRST LIMIT 3""", R_REC)


def ranked(s, d, limit=15):
    return ops.recommendations(ledger(s, d), limit=limit)


register(
    "recommendation_report",
    lambda s, d: ops.recommendation_report(ranked(s, d)).select(
        "savings_potential", F.posexplode("top_recommendations").alias("pos", "r")
    ).select("savings_potential", "pos", "r.type", "r.priority", "r.message"),
    f"""WITH {sql_ranked(15)} SELECT
        (SELECT sum(savings_potential) FILTER (WHERE type = 'saving_opportunity') FROM ranked)
          AS savings_potential,
        CAST(row_number() OVER (ORDER BY priority DESC, message) - 1 AS INTEGER) AS pos,
        type, priority, message FROM ranked QUALIFY pos < 5""",
    "savings_potential",
)
register(
    "recommendation_report_by_type",
    lambda s, d: ops.recommendation_report(ranked(s, d)).select(
        F.explode("recommendation_by_type").alias("type", "items")
    ).select("type", F.explode("items.message").alias("message")),
    f"WITH {sql_ranked(15)} SELECT type, message FROM ranked",
)
