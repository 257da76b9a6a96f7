"""Canonical schemas."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, NUMBER, WHEN, DAY = StringType(), DoubleType(), TimestampType(), DateType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TX = _struct(
    id=TEXT, account_id=TEXT, transaction_date=WHEN, description=TEXT, amount=NUMBER, category=TEXT
)

TX_STORED = _struct(
    id=TEXT, description=TEXT, amount=NUMBER, transaction_date=WHEN, category=TEXT,
    account_id=TEXT, notes=TEXT, created_at=WHEN, updated_at=WHEN,
)

# One typed record, with the optional fields a caller may send.
TX_RECORD = _struct(
    transaction_id=TEXT, transaction_date=DAY, description=TEXT, amount=NUMBER, category=TEXT,
    user_category=TEXT, merchant=TEXT, location=TEXT, is_recurring=BooleanType(), notes=TEXT,
    tags=ArrayType(TEXT),
)

# Bank statement text as exported: the spaces belong to the column names.
RAW_STATEMENT = _struct(
    **{"DATE": TEXT, "TRANSACTION DETAILS": TEXT, " WITHDRAWAL AMT ": TEXT, " DEPOSIT AMT ": TEXT}
)

CATEGORY = _struct(name=TEXT, description=TEXT, color=TEXT, icon=TEXT, parent_category=TEXT)


FORECAST = _struct(
    forecaster=TEXT, category=TEXT, ds=DAY, amount=NUMBER, lower_bound=NUMBER, upper_bound=NUMBER
)

METRIC = _struct(forecaster=TEXT, category=TEXT, metric=TEXT, value=NUMBER)

REC = _struct(
    type=TEXT, category=TEXT, description=TEXT, message=TEXT, amount=NUMBER, percentage=NUMBER,
    annual_cost=NUMBER, savings_potential=NUMBER, priority=IntegerType(), confidence=NUMBER,
    action=TEXT,
)
