"""Cleaning, typing and projection."""

from pyspark.sql import functions as F

from checks.base import (
    CLEAN, TX, TX_MONEY, TX_RAW, register, table, tx, tx_money, tx_raw,
)
from tallyframe.operators import cleaning as ops

AGG = "count(*) AS n, sum(amount) AS total"


def _debit_credit(spark, sf):
    raw = tx_raw(spark, sf)
    return raw.select(
        "DATE", "TRANSACTION DETAILS",
        F.col("` WITHDRAWAL AMT `").alias("debit"), F.col("` DEPOSIT AMT `").alias("credit"),
    )


register(
    "canonicalize_columns",
    lambda s, d: ops.canonicalize_columns(_debit_credit(s, d)).select(
        "transaction_date", "description", "amount", "debit"
    ),
    f"""WITH {TX_RAW} SELECT "DATE" AS transaction_date, "TRANSACTION DETAILS" AS description,
        " DEPOSIT AMT " AS amount, " WITHDRAWAL AMT " AS debit FROM tx_raw""",
)
register(
    "map_columns_if_missing",
    lambda s, d: ops.map_columns_if_missing(tx_raw(s, d)).select(
        "transaction_date", "description", "withdrawal", "deposit"
    ),
    f"""WITH {TX_RAW} SELECT "DATE" AS transaction_date, "TRANSACTION DETAILS" AS description,
        " WITHDRAWAL AMT " AS withdrawal, " DEPOSIT AMT " AS deposit FROM tx_raw""",
)
register(
    "derive_amount",
    lambda s, d: ops.derive_amount(tx_raw(s, d)).select(
        F.col("TRANSACTION DETAILS").alias("description"), "amount"
    ),
    f"""WITH {TX_RAW} SELECT "TRANSACTION DETAILS" AS description,
        coalesce(TRY_CAST(" DEPOSIT AMT " AS DOUBLE), 0)
          - coalesce(TRY_CAST(" WITHDRAWAL AMT " AS DOUBLE), 0) AS amount FROM tx_raw""",
)
register(
    "coerce_dates",
    lambda s, d: ops.coerce_dates(ops.map_columns_if_missing(tx_raw(s, d)))
    .groupBy("transaction_date").agg(F.count("*").alias("n")),
    f"""WITH {TX_RAW} SELECT CAST(TRY_CAST("DATE" AS DATE) AS TIMESTAMP) AS transaction_date,
        count(*) AS n FROM tx_raw GROUP BY 1""",
)
register(
    "fill_description",
    lambda s, d: ops.fill_description(ops.map_columns_if_missing(tx_raw(s, d)))
    .groupBy("description").agg(F.count("*").alias("n")),
    f"""WITH {TX_RAW} SELECT coalesce("TRANSACTION DETAILS", 'Unknown') AS description,
        count(*) AS n FROM tx_raw GROUP BY 1""",
)
register(
    "parse_currency",
    lambda s, d: ops.parse_amount(ops.canonicalize_columns(tx_money(s, d))).select("amt", "amount"),
    f"""WITH {TX_MONEY} SELECT amt,
        TRY_CAST(regexp_replace(amt, '[$,]', '', 'g') AS DOUBLE) AS amount FROM tx_money""",
)
register(
    "ensure_category",
    lambda s, d: ops.ensure_category(tx_raw(s, d)).groupBy("category")
    .agg(F.count("*").alias("n")),
    f"""WITH {TX_RAW} SELECT CAST(NULL AS VARCHAR) AS category, count(*) AS n FROM tx_raw""",
)
register(
    "require_columns",
    lambda s, d: ops.require_columns(tx(s, d)).select("transaction_date", "description", "amount"),
    f"WITH {TX} SELECT transaction_date, description, amount FROM tx",
)
register(
    "clean_transactions",
    lambda s, d: ops.clean_transactions(tx_raw(s, d)).select(
        "transaction_date", "description", "amount", "category"
    ),
    f"""WITH {CLEAN} SELECT transaction_date, description, amount,
        CAST(NULL AS VARCHAR) AS category FROM clean""",
)
register(
    "clean_transactions_currency",
    lambda s, d: ops.clean_transactions(tx_money(s, d)).groupBy("description").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total")
    ),
    f"""WITH {TX_MONEY} SELECT memo AS description, count(*) AS n,
        sum(TRY_CAST(regexp_replace(amt, '[$,]', '', 'g') AS DOUBLE)) AS total
        FROM tx_money WHERE amt <> 'n/a' GROUP BY 1""",
    "total",
)


def _validated(s, d):
    df = ops.coerce_dates(ops.map_columns_if_missing(ops.derive_amount(tx_raw(s, d))))
    good, bad = ops.validate_transactions(df)
    return good.select(F.lit("").alias("errors")).unionByName(
        bad.select(F.concat_ws(",", "errors").alias("errors"))
    ).groupBy("errors").agg(F.count("*").alias("n"))


register(
    "validate_transactions",
    _validated,
    f"""WITH {TX_RAW} SELECT concat_ws(',',
          CASE WHEN TRY_CAST("DATE" AS DATE) IS NULL THEN 'transaction_date' END,
          CASE WHEN "TRANSACTION DETAILS" IS NULL THEN 'description' END) AS errors,
        count(*) AS n FROM tx_raw GROUP BY 1""",
)
for mode in ("signed", "auto"):
    register(
        "select_expenses" if mode == "signed" else "select_expenses_auto",
        lambda s, d, mode=mode: ops.select_expenses(tx(s, d), mode).select("id", "spending"),
        f"WITH {TX} SELECT id, -amount AS spending FROM tx WHERE amount < 0",
    )


def _statement(s, d):
    raw = ops.derive_amount(tx_raw(s, d))
    names = {"` WITHDRAWAL AMT `": "withdrawal", "` DEPOSIT AMT `": "deposit"}
    return raw.select(*[F.col(k).alias(v) for k, v in names.items()])


register(
    "select_expenses_withdrawal",
    lambda s, d: ops.select_expenses(_statement(s, d)).agg(
        F.count("*").alias("n"), F.sum("spending").alias("total")
    ),
    f"""WITH {TX_RAW} SELECT count(*) AS n, sum(x) AS total FROM (
        SELECT TRY_CAST(" WITHDRAWAL AMT " AS DOUBLE) AS x FROM tx_raw) AS w WHERE x > 0""",
    "total",
)
register(
    "split_signed",
    lambda s, d: ops.split_signed(tx(s, d)).groupBy("description").agg(
        F.sum("income").alias("income"), F.sum("expense").alias("expense")
    ),
    f"""WITH {TX} SELECT description, sum(amount) FILTER (WHERE amount > 0) AS income,
        -sum(amount) FILTER (WHERE amount < 0) AS expense FROM tx GROUP BY 1""",
    "income expense",
)
register(
    "dedupe_transactions",
    lambda s, d: ops.dedupe_transactions(tx(s, d), ("transaction_date", "description")).select(
        "id", "transaction_date", "description", "amount"
    ),
    f"""WITH {TX} SELECT id, transaction_date, description, amount FROM tx
        QUALIFY row_number() OVER (PARTITION BY transaction_date, description ORDER BY id) = 1""",
)

_INTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_DOUBLES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_TEXTS = ("l_returnflag", "l_linestatus")
_PROFILE = " UNION ALL ".join(
    [
        f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value,
        CAST(max({c}) AS DOUBLE) AS max_value,
        CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint'
             WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint'
             WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int'
             ELSE 'bigint' END AS narrow_type, CAST(NULL AS BOOLEAN) AS dictionary_friendly
        FROM lineitem""" for c in _INTS
    ]
    + [
        f"""SELECT '{c}', min({c}), max({c}),
        CASE WHEN max(abs(CAST(CAST({c} AS FLOAT) AS DOUBLE) - {c})) <= 5e-4 THEN 'float'
             ELSE 'double' END, CAST(NULL AS BOOLEAN) FROM lineitem""" for c in _DOUBLES
    ]
    + [
        f"""SELECT '{c}', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'string',
        count(DISTINCT {c}) / count(*) < 0.5 FROM lineitem""" for c in _TEXTS
    ]
    + ["""SELECT 'l_shipdate', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'timestamp_ntz',
        CAST(NULL AS BOOLEAN)"""]
)
register("profile_types", lambda s, d: ops.profile_types(table(s, d, "lineitem"), lossy=True), _PROFILE)
register("profile_types_exact", lambda s, d: ops.profile_types(table(s, d, "lineitem")),
         f"SELECT * REPLACE (replace(narrow_type, 'float', 'double') AS narrow_type) FROM ({_PROFILE})")
register(
    "dedupe_cleaned",
    lambda s, d: ops.dedupe_transactions(ops.clean_transactions(tx_raw(s, d))).select(
        "transaction_date", "description", "amount"),
    f"WITH {CLEAN} SELECT DISTINCT transaction_date, description, amount FROM clean", "amount")


def _narrowed(s, d):
    narrow = ops.narrow_types(table(s, d, "lineitem"))
    names = narrow.columns
    kinds = F.lit(",".join(f"{n}:{t}" for n, t in narrow.dtypes if n in _INTS))
    return narrow.select(*names).agg(
        kinds.alias("int_types"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in _INTS],
        *[F.sum(F.col(c).cast("double")).alias(c) for c in ("l_quantity", "l_extendedprice")],
    )


def _narrow_sql():
    kinds = " || ',' || ".join(
        f"""'{c}:' || (CASE WHEN max({c}) < 128 THEN 'tinyint' WHEN max({c}) < 32768 THEN 'smallint'
        WHEN max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END)""" for c in _INTS
    )
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _INTS)
    return f"""SELECT {kinds} AS int_types, {sums}, sum(l_quantity) AS l_quantity,
        sum(l_extendedprice) AS l_extendedprice FROM lineitem"""


register("narrow_types", _narrowed, _narrow_sql(), "l_quantity l_extendedprice")


def _null_ids(s, d):
    """A third of the groups has no id at all, and the rest has some."""
    number = F.col("id").cast("long")
    return tx(s, d).withColumn("id", F.when((number % 3 > 0) & (number % 12 > 3), F.col("id")))


register(
    "dedupe_null_ids",
    lambda s, d: ops.dedupe_transactions(_null_ids(s, d), ("transaction_date", "description")),
    f"""WITH {TX}, marked AS (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 3 > 0
          AND CAST(id AS BIGINT) % 12 > 3 THEN id END AS id) FROM tx)
        SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY transaction_date, description
          ORDER BY id NULLS LAST, account_id, amount, category NULLS FIRST) = 1""",
)
