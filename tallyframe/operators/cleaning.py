"""Column mapping, parsing, validation and typing of transaction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.filters import not_null
from tallyframe.functions.stats import expense_of, income_of
from tallyframe.functions.text import parse_currency, to_number

# Column names that stand for a standard column. The last one present wins.
ALIASES = (
    ("DATE", "transaction_date"),
    ("date", "transaction_date"),
    ("transaction date", "transaction_date"),
    ("trans_date", "transaction_date"),
    ("TRANSACTION DETAILS", "description"),
    ("desc", "description"),
    ("memo", "description"),
    ("transaction", "description"),
    ("transactiondescription", "description"),
    ("amt", "amount"),
    ("debit", "amount"),
    ("credit", "amount"),
    ("transaction_amount", "amount"),
    ("categ", "category"),
    ("transaction_category", "category"),
)
FALLBACK_NAMES = (
    ("DATE", "transaction_date"),
    (" WITHDRAWAL AMT ", "withdrawal"),
    (" DEPOSIT AMT ", "deposit"),
    ("TRANSACTION DETAILS", "description"),
)
AMOUNT_PAIRS = ((" DEPOSIT AMT ", " WITHDRAWAL AMT "), ("deposit", "withdrawal"))
REQUIRED = ("transaction_date", "description", "amount")
# Date forms besides ISO, each with the shape of its text.
DATE_FORMATS = {
    "d-MMM-yy": r"^\d{1,2}-[A-Za-z]{3}-\d{2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyyMMdd": r"^\d{8}$",
}


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Copy known aliases onto the four standard names; the old columns stay. Names are matched
    exactly, by position, so ``DATE`` and ``date`` may both be present."""
    names = df.columns
    source = {std: alias for alias, std in ALIASES if alias in names}
    spot = {name: f"_{i}" for i, name in enumerate(names)}
    columns = [F.col(spot[source.get(n, n)]).alias(n) for n in names]
    columns += [F.col(spot[alias]).alias(std) for std, alias in source.items() if std not in names]
    return df.toDF(*spot.values()).select(*columns)


def map_columns_if_missing(df: DataFrame) -> DataFrame:
    """Copy statement columns onto their short names where those are absent."""
    present = df.columns
    return df.withColumns(
        {new: _c(old) for old, new in FALLBACK_NAMES if old in present and new not in present}
    )


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def derive_amount(df: DataFrame) -> DataFrame:
    """``amount = deposit - withdrawal`` where no amount exists; bad or missing parts count 0."""
    if "amount" in df.columns:
        return df
    for deposit, withdrawal in AMOUNT_PAIRS:
        if deposit in df.columns and withdrawal in df.columns:
            parts = {}
            for name in (deposit, withdrawal):
                number = to_number(_c(name)) if _is_text(df, name) else _c(name).cast("double")
                parts[name] = F.coalesce(number, F.lit(0.0))
            return df.withColumns(parts).withColumn("amount", _c(deposit) - _c(withdrawal))
    return df


def coerce_dates(
    df: DataFrame, column: str = "transaction_date", formats: dict[str, str] = DATE_FORMATS
) -> DataFrame:
    """Parse dates, bad text to null. Text is tried as ISO first, then by the format whose shape it
    has, because a parser that fails on a row costs far more than a pattern that does not match."""
    if column not in df.columns:
        return df
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df
    if not isinstance(kind, T.StringType):
        return df.withColumn(column, _c(column).cast("timestamp"))
    text = _c(column)
    if not formats:
        return df.withColumn(column, F.try_to_timestamp(text))
    other = F.lit(None).cast("timestamp")
    for form, shape in reversed(formats.items()):
        other = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))).otherwise(other)
    return df.withColumn(column, F.coalesce(F.try_to_timestamp(text), other))


def fill_description(df: DataFrame) -> DataFrame:
    if "description" not in df.columns:
        return df
    return df.withColumn("description", F.coalesce("description", F.lit("Unknown")))


def parse_amount(df: DataFrame) -> DataFrame:
    """Amount as double; text loses its currency signs first. NaN counts as missing."""
    if "amount" not in df.columns:
        return df
    amount = _c("amount")
    if _is_text(df, "amount"):
        return df.withColumn("amount", parse_currency(amount))
    number = amount.cast("double")
    return df.withColumn("amount", F.when(~F.isnan(number), number))


def ensure_category(df: DataFrame) -> DataFrame:
    if "category" in df.columns:
        return df
    return df.withColumn("category", F.lit(None).cast("string"))


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Required columns missing: {missing}")
    return df


def clean_transactions(df: DataFrame) -> DataFrame:
    """Names, amount, dates, description and category brought to the standard form; rows without
    date, description or amount dropped. One projection and one filter, no shuffle."""
    df = canonicalize_columns(df)
    # A derived amount is a number already, and never missing.
    df = parse_amount(df) if "amount" in df.columns else derive_amount(df)
    df = ensure_category(fill_description(coerce_dates(df)))
    return not_null(require_columns(df), *REQUIRED)


def validate_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows that meet the record contract and rows that do not, the latter with the
    names of the failing fields in ``errors``."""
    require_columns(df)
    rules = {
        "transaction_date": F.col("transaction_date").isNotNull(),
        "description": F.col("description").isNotNull(),
        "amount": F.col("amount").isNotNull() & ~F.isnan(F.col("amount").try_cast("double")),
    }
    errors = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    )
    checked = df.withColumn("errors", errors)
    return checked.filter("size(errors) = 0").drop("errors"), checked.filter("size(errors) > 0")


def select_expenses(df: DataFrame, mode: str = "signed") -> DataFrame:
    """Expense rows with a positive ``spending``.

    ``signed``: negative amounts. ``withdrawal``: positive withdrawals. ``all``: every row.
    ``auto``: signed when any amount is negative, else withdrawal where that column exists, else
    all; the probe is one lazy scalar subquery.
    """
    has_amount, has_withdrawal = "amount" in df.columns, "withdrawal" in df.columns
    if not has_amount and not has_withdrawal:
        raise ValueError("Cannot identify expense amounts in the data")
    if not has_amount:
        mode = "withdrawal"
    if mode == "signed":
        return df.filter("amount < 0").withColumn("spending", -F.col("amount"))
    if mode == "withdrawal":
        return df.filter("withdrawal > 0").withColumn("spending", F.col("withdrawal"))
    if mode == "all":
        return df.withColumn("spending", F.col("amount"))
    if mode != "auto":
        raise ValueError(f"Unknown mode: {mode}")
    signed = F.coalesce(df.agg(F.min("amount") < 0).scalar(), F.lit(False))
    if has_withdrawal:
        keep, value = F.col("withdrawal") > 0, F.col("withdrawal").cast("double")
    else:
        keep, value = F.lit(True), F.col("amount")
    return df.filter(F.when(signed, F.col("amount") < 0).otherwise(keep)).withColumn(
        "spending", F.when(signed, -F.col("amount")).otherwise(value)
    )


def split_signed(df: DataFrame) -> DataFrame:
    """Adds ``income`` and ``expense`` (positive); zero amounts belong to neither."""
    return df.withColumns(
        {"income": income_of(F.col("amount")), "expense": expense_of(F.col("amount"))}
    )


def dedupe_transactions(
    df: DataFrame, subset: Sequence[str] = REQUIRED, order: str | None = None
) -> DataFrame:
    """One row per ``subset``, the one with the smallest ``order``: a column, by default ``id``
    where the table has one and else all remaining columns in turn. Rows whose ``order`` is null
    come last, and ties go to the smallest remaining columns. A partial aggregate runs before the
    shuffle, so a value with many copies sends one row per task."""
    if order is None and "id" in df.columns:
        order = "id"
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates(list(subset))
    if order is None:
        row = F.min(F.struct(*rest))
    else:
        rest = [order] + [c for c in rest if c != order]
        unknown = F.col(order).isNull().alias("_unknown")
        maps = any(isinstance(f.dataType, T.MapType) for f in df.schema.fields)
        row = F.min_by(F.struct(*rest), F.struct(unknown, order)) if maps else F.min(
            F.struct(unknown, *rest))
    kept = df.groupBy(*subset).agg(row.alias("_row"))
    return kept.select(*[c if c in subset else F.col(f"_row.{c}").alias(c) for c in df.columns])


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BOUNDS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))
# Fixed value: the largest change of any value for which a double column becomes float.
FLOAT_TOLERANCE = 5e-4


def profile_types(df: DataFrame, lossy: bool = False) -> DataFrame:
    """One row per column: smallest type that holds it, and whether a text column is worth a
    dictionary (fewer distinct values than half the rows). One pass over the table. Doubles stay
    doubles unless ``lossy`` allows a float whose values differ by ``FLOAT_TOLERANCE`` at most."""
    aggs, rows = [F.count("*").alias("_n")], []
    null = F.lit(None).cast("double")
    for i, field in enumerate(df.schema.fields):
        col, kind = _c(field.name), field.dataType
        low, high, flag = null, null, F.lit(None).cast("boolean")
        narrow = F.lit(kind.simpleString())
        if isinstance(kind, _INTEGERS):
            aggs += [F.min(col).alias(f"_lo{i}"), F.max(col).alias(f"_hi{i}")]
            low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
            fits = F.when(F.lit(False), F.lit(""))
            for name, bound in _BOUNDS:
                inside = (F.col(f"_lo{i}") >= -bound) & (F.col(f"_hi{i}") < bound)
                fits = fits.when(inside, F.lit(name))
            narrow = fits.otherwise(F.lit("bigint"))
        elif isinstance(kind, T.DoubleType):
            gap = F.max(F.abs(col.cast("float").cast("double") - col))
            aggs += [F.min(col).alias(f"_lo{i}"), F.max(col).alias(f"_hi{i}"), gap.alias(f"_e{i}")]
            low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            close = F.lit(lossy) & (F.col(f"_e{i}") <= FLOAT_TOLERANCE)
            narrow = F.when(close, "float").otherwise("double")
        elif isinstance(kind, T.StringType):
            aggs.append(F.approx_count_distinct(col).alias(f"_d{i}"))
            flag = F.try_divide(F.col(f"_d{i}"), F.col("_n")) < 0.5
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                low.alias("min_value"),
                high.alias("max_value"),
                narrow.alias("narrow_type"),
                flag.alias("dictionary_friendly"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def narrow_types(df: DataFrame, lossy: bool = False) -> DataFrame:
    """Cast every column to the type found by ``profile_types``. Only the profile, one row per
    column, reaches the driver."""
    types = {r.column_name: r.narrow_type for r in profile_types(df, lossy).collect()}
    return df.select(*[_c(n).cast(types[n]).alias(n) for n in df.columns])
