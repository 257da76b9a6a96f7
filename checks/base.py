"""Registration, and the input views in both forms (DataFrame and SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.rules import DEFAULT, Rules, with_keyword_category
from tallyframe.operators.categorize import keyword_categorize
from tallyframe.session import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _digits(spec: str) -> dict[str, int]:
    """``"a b 2:c"`` to digits per column, 4 where none are given."""
    out = {}
    for item in spec.split():
        digits, _, name = item.rpartition(":")
        out[name] = int(digits or 4)
    return out


def _nudge(digits: int) -> float:
    """Moves exact halves off the rounding border: sums of cents over 8 rows often end there, and
    the last bit of a sum depends on the order of its terms."""
    return 0.0137 * 10.0**-digits


def register(name: str, query: Query, sql: str | None = None, rounded: str = "") -> None:
    """Add a query. ``rounded`` names the double columns that both sides round at the very end."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    digits = _digits(rounded)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        nudged = {c: F.round(F.col(c) + _nudge(d), d) for c, d in digits.items()}
        return df.withColumns(nudged) if digits else df

    QUERIES[name] = run
    if sql is not None:
        if digits:
            cols = ", ".join(f"round({c} + {_nudge(d):e}, {d}) AS {c}" for c, d in digits.items())
            sql = f"SELECT * REPLACE ({cols}) FROM ({sql}) AS result"
        ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The descriptions of the transaction view.
WORDS = ("GROCERY STORE", "RESTAURANT", "UBER", "GAS STATION", "RENT", "ELECTRIC BILL",
         "NETFLIX", "AMAZON", "DOCTOR", "SALARY", "DIRECT DEPOSIT", "TRANSFER")
CATEGORIES = ("food", "transport", "shopping", "utilities", "entertainment", "health", "housing",
              "income", "other")
SQL_WORDS = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def sql_keywords(text: str, rules: Rules = DEFAULT) -> str:
    """The keyword rules as a SQL CASE."""
    whens = []
    for category, keywords in rules:
        hits = " OR ".join(f"contains(lower({text}), '{k}')" for k in keywords)
        whens.append(f"WHEN {hits} THEN '{category}'")
    return f"CASE WHEN {text} IS NULL THEN 'other' {' '.join(whens)} ELSE 'other' END"


def word(index):
    return F.element_at(F.array(*map(F.lit, WORDS)), (index + 1).cast("int"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard transactions, with null and empty categories among them."""
    key = F.col("o_orderkey")
    description = word(key % 12)
    amount = F.when((key % 12).isin(9, 10), F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("o_orderdate").alias("transaction_date"),
        description.alias("description"),
        amount.alias("amount"),
        (key % 5).alias("kind"),
    )
    known = with_keyword_category(rows, "description", "category")
    category = F.when(F.col("kind") == 1, "").when(F.col("kind") > 1, F.col("category"))
    return known.withColumn("category", category).drop("kind")


_DESC = f"{SQL_WORDS}[o_orderkey % 12 + 1]"
TX = f"""tx AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS account_id,
         o_orderdate AS transaction_date, {_DESC} AS description,
         CASE WHEN o_orderkey % 12 IN (9, 10) THEN o_totalprice ELSE -o_totalprice END AS amount,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN ''
              ELSE {sql_keywords(_DESC)} END AS category
  FROM orders)"""


def txc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx`` with all categories filled."""
    return keyword_categorize(tx(spark, sf_dir))


TXC = f"""{TX},
txc AS (
  SELECT id, account_id, transaction_date, description, amount,
         CASE WHEN category IS NULL OR category = '' THEN {sql_keywords('description')}
              ELSE category END AS category
  FROM tx)"""


def tx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank statement text with bad dates and missing descriptions."""
    line = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    deposit = F.col("l_returnflag") == "R"
    bad = (F.col("l_orderkey") + F.col("l_linenumber")) % 50 == 0
    return line.select(
        F.when(bad, "bad").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("DATE"),
        F.when(F.col("l_partkey") % 20 != 0, word(F.col("l_partkey") % 12)).alias(
            "TRANSACTION DETAILS"
        ),
        F.when(~deposit, price.cast("string")).alias(" WITHDRAWAL AMT "),
        F.when(deposit, price.cast("string")).alias(" DEPOSIT AMT "),
    )


def tx_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement with one signed text amount such as ``$1,234.56``."""
    line = table(spark, sf_dir, "lineitem")
    money = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    broken = F.col("l_partkey") % 30 == 0
    return line.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        word(F.col("l_partkey") % 12).alias("memo"),
        F.when(broken, "n/a").otherwise(money).alias("amt"),
    )


TX_RAW = f"""tx_raw AS (
  SELECT CASE WHEN (l_orderkey + l_linenumber) % 50 = 0 THEN 'bad'
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS "DATE",
         CASE WHEN l_partkey % 20 <> 0 THEN {SQL_WORDS}[l_partkey % 12 + 1] END
           AS "TRANSACTION DETAILS",
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS VARCHAR) END
           AS " WITHDRAWAL AMT ",
         CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS VARCHAR) END
           AS " DEPOSIT AMT "
  FROM lineitem)"""
TX_MONEY = f"""tx_money AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS "date", {SQL_WORDS}[l_partkey % 12 + 1] AS memo,
         CASE WHEN l_partkey % 30 = 0 THEN 'n/a'
              ELSE concat('$', format('{{:,.2f}}', l_extendedprice)) END AS amt
  FROM lineitem)"""
CLEAN = f"""{TX_RAW},
clean AS (
  SELECT * FROM (
    SELECT CAST(TRY_CAST("DATE" AS DATE) AS TIMESTAMP) AS transaction_date,
           coalesce("TRANSACTION DETAILS", 'Unknown') AS description,
           coalesce(TRY_CAST(" DEPOSIT AMT " AS DOUBLE), 0)
             - coalesce(TRY_CAST(" WITHDRAWAL AMT " AS DOUBLE), 0) AS amount
    FROM tx_raw) AS parsed
  WHERE transaction_date IS NOT NULL)"""


def tx_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve regular charges per customer; every fifth customer's amounts are unsteady."""
    key, i = F.col("c_custkey"), F.col("i")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # Twelve rows each: a task that reads a large part of the table would group twelve times as much.
    base = dealt(customers, 12 * customers.count(), "c_custkey").select(
        "c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")
    )
    day = F.date_add(F.lit("2000-01-01").cast("date"), (30 * i + key % 3).cast("int"))
    cost = -(10 + key % 25).cast("double")
    return base.select(
        F.concat(F.lit("r"), key, F.lit("-"), i).alias("id"),
        key.cast("string").alias("account_id"),
        day.cast("timestamp_ntz").alias("transaction_date"),
        F.concat(F.lit("SUBSCRIPTION "), "c_name").alias("description"),
        F.when((key % 5 == 0) & (i % 3 == 0), cost * 2).otherwise(cost).alias("amount"),
        F.lit("entertainment").alias("category"),
    )


TX_RECURRING = """tx_recurring AS (
  SELECT 'r' || c_custkey || '-' || i AS id, CAST(c_custkey AS VARCHAR) AS account_id,
         CAST(DATE '2000-01-01' + CAST(30 * i + c_custkey % 3 AS INTEGER) AS TIMESTAMP)
           AS transaction_date,
         'SUBSCRIPTION ' || c_name AS description,
         CAST(-(10 + c_custkey % 25) AS DOUBLE)
           * CASE WHEN c_custkey % 5 = 0 AND i % 3 = 0 THEN 2 ELSE 1 END AS amount,
         'entertainment' AS category
  FROM customer CROSS JOIN (SELECT unnest(range(12)) AS i) AS twelve)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions and regular charges together."""
    return txc(spark, sf_dir).unionByName(tx_recurring(spark, sf_dir))


LEDGER = f"""{TXC}, {TX_RECURRING},
ledger AS (SELECT * FROM txc UNION ALL BY NAME SELECT * FROM tx_recurring)"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of frequent small amounts in five categories."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.col("ts").alias("transaction_date"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type") == "signup", value).otherwise(-value).alias("amount"),
    )


EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS account_id,
         ts AS transaction_date, event_type AS category,
         CASE WHEN event_type = 'signup' THEN value ELSE -value END AS amount
  FROM events)"""
EV_TYPES = ("click", "error", "purchase", "signup", "view")


def sql_daily(source: str, keys: str = "category") -> str:
    """Daily spending per series with gaps filled, as CTEs ``daily`` and ``filled``."""
    return f"""daily AS (
  SELECT {keys}, CAST(transaction_date AS DATE) AS date, sum(-amount) AS amount
  FROM {source} WHERE amount < 0 GROUP BY ALL),
spine AS (
  SELECT {keys}, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM daily GROUP BY {keys}),
filled AS (
  SELECT {', '.join(f'spine.{k.strip()}' for k in keys.split(','))}, spine.date,
         coalesce(daily.amount, 0) AS amount
  FROM spine LEFT JOIN daily USING ({keys}, date))"""


def sql_label(ts: str, freq: str) -> str:
    """Period label of a timestamp expression."""
    day = f"CAST({ts} AS DATE)"
    return {
        "D": day,
        "W": f"{day} + CAST(7 - isodow({ts}) AS INTEGER)",
        "M": f"last_day({ts})",
        "Q": f"CAST(date_trunc('quarter', {ts}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)",
        "Y": f"CAST(date_trunc('year', {ts}) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE)",
    }[freq]
