"""Readers of transaction data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.schemas import TX_RECORD, TX_STORED
from tallyframe.sources import store


def read_delimited(
    spark: SparkSession, path: str, sep: str = ";", schema: StructType | None = None
) -> DataFrame:
    """Delimited text with a header. Without a schema the types are inferred, which reads the
    files twice; pass one for large inputs."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_transactions(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> DataFrame:
    """Read by suffix: ``.csv`` with a header, or ``.parquet``."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_delimited(spark, path, ",", schema)
    if name.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {path}")


def read_transactions_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, dates parsed; an empty table of the same shape where none exists. A folder
    kept by ``store`` is read as of now."""
    if store.is_store(spark, path):
        return store.read_store(spark, path)
    try:
        if path.rstrip("/").lower().endswith(".csv"):
            return spark.read.schema(TX_STORED).option("header", True).csv(path)
        return spark.read.schema(TX_STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TX_STORED)


def _described(df: DataFrame) -> DataFrame:
    if "description" not in df.columns and "TRANSACTION DETAILS" in df.columns:
        df = df.withColumn("description", F.col("`TRANSACTION DETAILS`"))
    if "description" not in df.columns:
        raise ValueError("Transactions must include description field")
    return df


def from_records(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A few JSON-like records from the caller; ``TRANSACTION DETAILS`` may stand for the
    description."""
    return _described(spark.createDataFrame([dict(r) for r in rows]))


def from_json_records(
    lines: DataFrame, column: str = "value", schema: StructType = TX_RECORD
) -> DataFrame:
    """The same for a column of JSON texts, parsed where the rows are."""
    full = StructType([*schema.fields]).add("TRANSACTION DETAILS", "string")
    record = lines.select(F.from_json(column, full).alias("r")).select("r.*")
    text = F.coalesce("description", "`TRANSACTION DETAILS`")
    return record.withColumn("description", text).drop("TRANSACTION DETAILS")
