"""Readers, writers and the upload stream. Each query writes a table derived from the input below
the session's shared folder, reads it back and sums it."""

from pyspark.sql import functions as F

from checks.base import (
    CLEAN, ORACLES, TX, TXC, register, sql_keywords, tx, tx_raw, txc,
)
from checks.q_forecasts import FC, _PRED, fc, metrics
from checks.q_recommend import ranked, sql_ranked
from checks.q_series import sql_series
from tallyframe.operators.reports import financial_report
from tallyframe.operators.timeseries import series_of_freqs, to_time_series
from tallyframe.plans.jobs import process_transactions
from tallyframe.schemas import RAW_STATEMENT
from tallyframe.session import new_path
from tallyframe.sources import readers, store, writers
from tallyframe.streaming.ingest import ingest_stream, ingest_upload

BY_CATEGORY = "category, count(*) AS n, sum(amount) AS total"


def _unrounded(name):
    """The SQL of another query as it was given."""
    return ORACLES[name].split("FROM (", 1)[1].rsplit(") AS result", 1)[0]


def by_category(df):
    return df.groupBy("category").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


register(
    "read_transactions",
    lambda s, d: readers.read_transactions(s, f"{d}/orders.parquet").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")),
    "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders",
    "total",
)


def _csv(s, df, sep=","):
    path = new_path(s, "statement") + ".csv"
    df.write.option("header", True).option("sep", sep).option("timestampFormat",
                                                              "yyyy-MM-dd").csv(path)
    return path


register(
    "read_transactions_csv",
    lambda s, d: by_category(readers.read_transactions(s, _csv(s, txc(s, d)))),
    f"WITH {TXC} SELECT {BY_CATEGORY} FROM txc GROUP BY 1",
    "total",
)
register(
    "read_delimited",
    lambda s, d: by_category(readers.read_delimited(s, _csv(s, txc(s, d), ";"))),
    f"WITH {TXC} SELECT {BY_CATEGORY} FROM txc GROUP BY 1",
    "total",
)


def _written(s, df):
    path = new_path(s, "transactions")
    writers.write_transactions(df, path)
    return path


register(
    "read_transactions_table",
    lambda s, d: readers.read_transactions_table(s, _written(s, tx(s, d))).select(
        "id", "transaction_date", "amount", "category", "notes", "updated_at"),
    f"""WITH {TX} SELECT id, transaction_date, amount, category, CAST(NULL AS VARCHAR) AS notes,
        CAST(NULL AS TIMESTAMP) AS updated_at FROM tx""",
)
register(
    "write_transactions",
    lambda s, d: by_category(s.read.parquet(_written(s, txc(s, d)))),
    f"WITH {TXC} SELECT {BY_CATEGORY} FROM txc GROUP BY 1",
    "total",
)
register(
    "from_records",
    lambda s, d: readers.from_json_records(
        tx(s, d).select(F.to_json(F.struct(
            "id", "amount", F.col("transaction_date").cast("date").alias("transaction_date"),
            F.col("description").alias("TRANSACTION DETAILS"))).alias("value"))
    ).groupBy("description").agg(F.count("*").alias("n"), F.sum("amount").alias("total"),
                                 F.max("transaction_date").alias("newest")),
    f"""WITH {TX} SELECT description, count(*) AS n, sum(amount) AS total,
        CAST(max(transaction_date) AS DATE) AS newest FROM tx GROUP BY 1""",
    "total",
)


def _series(s, d):
    path = new_path(s, "series")
    writers.write_series({f: to_time_series(txc(s, d), f) for f in "DWM"}, path)
    return s.read.parquet(path).groupBy("freq", "category").agg(
        F.count("*").alias("n"), F.sum("amount_sum").alias("total"))


register(
    "write_series",
    _series,
    f"WITH {TXC}, " + ", ".join(
        sql_series("txc", f).replace("series AS", f"series_{f} AS") for f in "DWM")
    + " UNION ALL ".join(
        f" SELECT '{f}' AS freq, category, count(*) AS n, sum(amount_sum) AS total FROM series_{f}"
        " GROUP BY 2" for f in "DWM"),
    "total",
)


def _series_in_one_pass(s, d):
    path = new_path(s, "series")
    writers.write_series(series_of_freqs(txc(s, d)), path)
    return s.read.parquet(path).groupBy("freq", "category").agg(
        F.count("*").alias("n"), F.sum("amount_sum").alias("total"))


register("write_series_in_one_pass", _series_in_one_pass, _unrounded("write_series"), "total")


def _forecasts(s, d):
    path = new_path(s, "forecasts")
    writers.write_forecasts(fc(s, d), path)
    return s.read.parquet(path).groupBy("forecaster", "category").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"))


register(
    "write_forecasts",
    _forecasts,
    f"""WITH {FC} SELECT forecaster, category, count(*) AS n, sum(amount) AS total FROM fc
        GROUP BY 1, 2""",
    "total",
)


def _metrics(s, d):
    path = new_path(s, "metrics")
    writers.write_metrics(metrics(s, d), path)
    long = s.read.parquet(f"{path}/metrics").groupBy("forecaster").agg(F.count("*").alias("n"))
    wide = s.read.parquet(f"{path}/metrics_pivot").groupBy("forecaster").agg(
        F.sum("mae").alias("mae"), F.sum("rmse").alias("rmse"))
    return long.join(wide, "forecaster")


register(
    "write_metrics",
    _metrics,
    f"""WITH {_PRED} SELECT forecaster, n, mae, rmse FROM
        (SELECT forecaster, count(*) AS n FROM metrics GROUP BY 1) AS l JOIN
        (SELECT forecaster, sum(mae) AS mae, sum(rmse) AS rmse FROM scores GROUP BY 1) AS w
        USING (forecaster)""",
    "mae rmse",
)


def _report(s, d):
    path = new_path(s, "report")
    writers.write_report(financial_report(txc(s, d)), path)
    return s.read.json(path).select(
        F.col("summary.transaction_count").alias("n"),
        F.col("summary.total_income").alias("total"),
        F.size("top_categories").cast("bigint").alias("tops"),
    )


register(
    "write_report",
    _report,
    f"""WITH {TXC} SELECT count(*) AS n, sum(amount) FILTER (WHERE amount > 0) AS total,
        (SELECT sum(least(3, k)) FROM (SELECT amount > 0 AS up, count(DISTINCT category) AS k
        FROM txc GROUP BY 1) AS g) :: BIGINT AS tops FROM txc""",
    "total",
)


def _recs(s, d):
    path = new_path(s, "recommendations")
    writers.write_recommendations(ranked(s, d), path)
    return s.read.parquet(path).groupBy("type", "category").agg(
        F.countDistinct("id").alias("ids"), F.count("created_at").alias("stamps"),
        F.max("priority").alias("priority"))


register(
    "write_recommendations",
    _recs,
    f"""WITH {sql_ranked(15)} SELECT type, category, count(*) AS ids, count(*) AS stamps,
        max(priority) AS priority FROM ranked GROUP BY 1, 2""",
)
_INGESTED = f"""WITH {CLEAN} SELECT {sql_keywords('description')} AS category, count(*) AS n,
    sum(amount) AS total FROM clean GROUP BY 1"""
_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _statement(s, d):
    path = new_path(s, "upload") + ".csv"
    tx_raw(s, d).write.option("header", True).options(**_SPACES).csv(path)
    return path


def _upload(s, d):
    table = new_path(s, "ingested")
    ingest_upload(s, _statement(s, d), table)
    return by_category(s.read.parquet(table))


def _stream(s, d):
    table = new_path(s, "streamed")
    ingest_stream(s, _statement(s, d), table, new_path(s, "progress")).awaitTermination()
    return by_category(s.read.parquet(table))


register("ingest_upload", _upload, _INGESTED, "total")
register("ingest_stream", _stream, _INGESTED, "total")
register(
    "process_transactions",
    lambda s, d: by_category(process_transactions(s, _statement(s, d), RAW_STATEMENT)),
    _INGESTED,
    "total",
)


def _by_category_stored(s, path):
    return by_category(readers.read_transactions_table(s, path))


def _store_append(s, d):
    path = _written(s, tx(s, d).withColumns({"created_at": F.lit(None).cast("timestamp"),
                                             "updated_at": F.lit(None).cast("timestamp")}))
    new = tx(s, d).filter(F.col("id").cast("long") % 11 == 0).drop("id")
    writers.append_to(path, new)
    return _by_category_stored(s, path)


def _store_update(s, d):
    path = _written(s, tx(s, d))
    ids = tx(s, d).filter(F.col("id").cast("long") % 7 == 0).select("id")
    writers.update_in(path, ids.withColumns({"amount": F.lit(-1.0), "category": F.lit("new")}))
    return _by_category_stored(s, path)


def _store_delete(s, d):
    path = _written(s, tx(s, d))
    writers.delete_from(path, tx(s, d).filter(F.col("id").cast("long") % 3 == 0))
    return _by_category_stored(s, path)


register(
    "store_append", _store_append,
    f"""WITH {TX} SELECT {BY_CATEGORY} FROM (SELECT * FROM tx UNION ALL
        SELECT * FROM tx WHERE CAST(id AS BIGINT) % 11 = 0) AS both_parts GROUP BY 1""",
    "total",
)
register(
    "store_update", _store_update,
    f"""WITH {TX} SELECT {BY_CATEGORY} FROM (
          SELECT CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'new' ELSE category END AS category,
                 CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN -1.0 ELSE amount END AS amount FROM tx)
        AS patched GROUP BY 1""",
    "total",
)
register(
    "store_delete", _store_delete,
    f"WITH {TX} SELECT {BY_CATEGORY} FROM tx WHERE CAST(id AS BIGINT) % 3 <> 0 GROUP BY 1",
    "total",
)


def _store_append_new(s, d):
    path = new_path(s, "first-rows")
    rows = tx(s, d).drop("id")
    writers.append_to(path, rows.filter("amount < 0"))
    writers.append_to(path, rows.filter("amount >= 0"))
    return _by_category_stored(s, path)


register("store_append_new", _store_append_new,
         f"WITH {TX} SELECT {BY_CATEGORY} FROM tx GROUP BY 1", "total")


def _buckets(s, d):
    """Made, appended to, patched and cut, all bucket by bucket."""
    path = new_path(s, "buckets")
    rows = tx(s, d).withColumns({"created_at": F.lit(None).cast("timestamp"),
                                 "updated_at": F.lit(None).cast("timestamp")})
    number = F.col("id").cast("long")
    store.create_store(rows, path, buckets=16)
    writers.append_to(path, rows.filter(number % 11 == 0).drop("id"))
    patches = rows.filter(number % 7 == 0).select("id", F.lit(-1.0).alias("amount"),
                                                  F.lit("new").alias("category"))
    writers.update_in(path, patches)
    writers.delete_from(path, rows.filter(number % 3 == 0))
    return _by_category_stored(s, path)


register(
    "store_buckets", _buckets,
    f"""WITH {TX} SELECT {BY_CATEGORY} FROM (
          SELECT CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'new' ELSE category END AS category,
                 CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN -1.0 ELSE amount END AS amount FROM tx
          WHERE CAST(id AS BIGINT) % 3 <> 0
          UNION ALL SELECT category, amount FROM tx WHERE CAST(id AS BIGINT) % 11 = 0)
        AS changed GROUP BY 1""",
    "total",
)


def _store_update_twice(s, d):
    path = _written(s, tx(s, d))
    ids = tx(s, d).filter(F.col("id").cast("long") % 7 == 0).select("id")
    first = ids.withColumns({"seq": F.lit(1), "amount": F.lit(-1.0), "category": F.lit("old")})
    second = ids.withColumns({"seq": F.lit(2), "amount": F.lit(None).cast("double"),
                              "category": F.lit("new")})
    writers.update_in(path, second.unionByName(first))
    return _by_category_stored(s, path)


register("store_update_twice", _store_update_twice, _unrounded("store_update"), "total")


def _stream_twice(s, d):
    """Two uploads of one statement, the second after the first was taken in."""
    source, table, progress = (new_path(s, n) for n in ("uploads", "taken", "progress"))
    rows = tx_raw(s, d)
    for _ in range(2):
        rows.write.mode("append").option("header", True).options(**_SPACES).csv(source)
        ingest_stream(s, source, table, progress, dedupe="30 days").awaitTermination()
    return by_category(s.read.parquet(table))


register(
    "ingest_stream_dedupe", _stream_twice,
    f"""WITH {CLEAN} SELECT {sql_keywords('description')} AS category, count(*) AS n,
        sum(amount) AS total FROM (SELECT DISTINCT transaction_date, description, amount FROM clean)
        AS once GROUP BY 1""",
    "total",
)
