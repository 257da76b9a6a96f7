"""Uploaded statements as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.functions.rules import DEFAULT, Rules
from tallyframe.operators.categorize import keyword_categorize
from tallyframe.operators.cleaning import clean_transactions
from tallyframe.schemas import RAW_STATEMENT
from tallyframe.sources.readers import read_transactions
from tallyframe.sources.writers import write_transactions


STORED = ("transaction_date", "description", "amount", "category")
KEY = ("transaction_date", "description", "amount")


def ingest_upload(
    spark: SparkSession, source: str, table: str, rules: Rules = DEFAULT
) -> tuple[int, DataFrame]:
    """One uploaded file: clean, categorise, overwrite the table; row count and a 5-row sample. Both
    come from the written table. A CSV file is taken as text under the names of its header, which
    cleaning parses, so nothing but the header is read twice."""
    if source.rstrip("/").lower().endswith(".csv"):
        raw = spark.read.option("header", True).csv(source)
    else:
        raw = read_transactions(spark, source)
    rows = keyword_categorize(clean_transactions(raw), rules)
    write_transactions(rows.select(*STORED), table)
    stored = spark.read.parquet(table)
    return stored.count(), stored.limit(5)


def ingest_stream(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    schema: StructType = RAW_STATEMENT,
    rules: Rules = DEFAULT,
    dedupe: str | None = None,
):
    """The same transformations and columns over a folder of statements. Takes all files present and
    stops; run again, it takes only new files. The file sink writes each batch exactly once.

    ``dedupe``, a time such as ``30 days``, drops transactions that came before, in the same file or
    an earlier upload: same date, description and amount. It counts from the time a transaction was
    first taken in, not from its date, so a late statement loses no row; a copy that comes after more
    than that time counts as new. What is remembered is one key per transaction of that time, kept by
    the stream's state store and spread over its tasks. Without it no state is kept.
    """
    files = spark.readStream.schema(schema).option("header", True).csv(source)
    rows = keyword_categorize(clean_transactions(files), rules).select(*STORED)
    if dedupe is not None:
        rows = rows.withColumn("_taken", F.current_timestamp()).withWatermark(
            "_taken", dedupe).dropDuplicatesWithinWatermark(list(KEY)).drop("_taken")
    return (
        rows.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
