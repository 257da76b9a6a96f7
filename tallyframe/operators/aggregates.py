"""Totals, shares and summaries of transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tallyframe.functions.calendar import month_start, weekday
from tallyframe.functions.rules import OTHER
from tallyframe.functions.stats import (
    exact_quantiles,
    expense_of,
    income_of,
    percent_change,
    quantile_sketch,
    share,
)
from tallyframe.operators.cleaning import map_columns_if_missing
from tallyframe.operators.tables import filter_transactions, moment


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def spent() -> Column:
    return zero(F.sum(expense_of(F.col("amount"))))


def earned() -> Column:
    return zero(F.sum(income_of(F.col("amount"))))


def transaction_summary(df: DataFrame, start=None, end=None) -> DataFrame:
    """Count, date range, spending, income and net flow in one pass; statements without an amount
    use their withdrawal and deposit columns."""
    df = map_columns_if_missing(df)
    if "amount" in df.columns:
        spending, income, net = spent(), earned(), zero(F.sum("amount"))
    else:
        spending, income = zero(F.sum("withdrawal")), zero(F.sum("deposit"))
        net = income - spending
    return filter_transactions(df, start=start, end=end).agg(
        F.count("*").alias("total_transactions"),
        F.min("transaction_date").alias("start_date"),
        F.max("transaction_date").alias("end_date"),
        spending.alias("total_spending"),
        income.alias("total_income"),
        net.alias("net_cashflow"),
    )


def category_breakdown(df: DataFrame) -> DataFrame:
    """Spending per category; withdrawals where the table has no amount."""
    df = df.filter(F.col("category").isNotNull())
    if "amount" not in df.columns:
        return df.groupBy("category").agg(zero(F.sum("withdrawal")).alias("spending"))
    return df.filter("amount < 0").groupBy("category").agg((-F.sum("amount")).alias("spending"))


def transaction_stats(df: DataFrame, end, start=None, days: int = 30) -> DataFrame:
    """Totals of a window that ends at ``end`` and the signed sum per category as a map. Rows are
    summed per category first; only those sums meet in one row."""
    last = moment(df, end)
    first = moment(df, start) if start else last - F.expr(f"interval {days} days")
    window = (F.col("transaction_date") >= first) & (F.col("transaction_date") <= last)
    sums = df.filter(window).groupBy("category").agg(
        spent().alias("spent"), earned().alias("earned"), F.sum("amount").alias("total")
    )
    entry = F.when(F.col("category").isNotNull(), F.struct("category", "total"))
    return sums.agg(
        zero(F.sum("earned")).alias("total_income"),
        zero(F.sum("spent")).alias("total_expenses"),
        (zero(F.sum("earned")) - zero(F.sum("spent"))).alias("net_cashflow"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("categories"),
    ).select(first.alias("period_start"), last.alias("period_end"), "*")


def category_stats(df: DataFrame, name: str, end, start=None, days: int = 30) -> DataFrame:
    """Figures of one category in a window, its share of the whole window, and the change between
    its last two observed months. One pass; a month of the category is one row after it."""
    last = moment(df, end)
    first = moment(df, start) if start else last - F.expr(f"interval {days} days")
    window = (F.col("transaction_date") >= first) & (F.col("transaction_date") <= last)
    mine = F.coalesce(F.col("category") == name, F.lit(False))
    monthly = (
        df.filter(window)
        .groupBy(mine.alias("mine"), month_start(F.col("transaction_date")).alias("month"))
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    )
    own = F.col("mine")
    months = F.sort_array(
        F.collect_list(F.when(own, F.struct("month", F.abs("total").alias("value"))))
    )
    total, count = zero(F.sum(F.when(own, F.col("total")))), F.sum(F.when(own, F.col("n")))
    one = monthly.agg(
        F.coalesce(count, F.lit(0)).alias("transaction_count"),
        F.abs(total).alias("total_amount"),
        zero(F.abs(F.try_divide(total, count))).alias("average_transaction"),
        zero(share(F.abs(total), F.abs(F.sum("total")))).alias("percentage_of_total"),
        months.alias("months"),
    )
    newest, previous = F.try_element_at("months", F.lit(-1)), F.try_element_at("months", F.lit(-2))
    change = percent_change(newest["value"], previous["value"])
    return one.withColumn("month_to_month_change", change).select(
        F.lit(name).alias("name"), "transaction_count", "total_amount", "average_transaction",
        "percentage_of_total", "month_to_month_change",
    )


def category_totals(df: DataFrame) -> DataFrame:
    """Signed total per category; null and empty count as ``other``."""
    known = F.when(F.col("category") == "", None).otherwise(F.col("category"))
    return df.groupBy(F.coalesce(known, F.lit(OTHER)).alias("category")).agg(
        F.sum("amount").alias("amount")
    )


def top_spending(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` categories with the largest net spending, income left out."""
    kept = category_totals(df).filter("amount < 0 and category <> 'income'")
    return kept.withColumn("amount", -F.col("amount")).orderBy(F.desc("amount"), "category").limit(k)


def category_share(df: DataFrame, expenses_only: bool = True) -> DataFrame:
    """Absolute total per category and its share, as a pie needs them."""
    totals = category_totals(df)
    if expenses_only:
        totals = totals.filter("amount < 0 and category <> 'income'")
    totals = totals.withColumn("amount", F.abs("amount"))
    whole = F.sum("amount").over(Window.partitionBy())  # one row per category
    return totals.withColumn("percentage", share(F.col("amount"), whole))


def monthly_totals(df: DataFrame) -> DataFrame:
    month = month_start(F.col("transaction_date")).alias("month")
    return df.groupBy(month).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def monthly_category_pivot(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Month by category, missing cells 0. The columns are given, so no extra pass finds them."""
    month = month_start(F.col("transaction_date")).alias("month")
    return df.groupBy(month).pivot("category", list(categories)).sum("amount").fillna(0.0)


def monthly_balance(df: DataFrame, month) -> DataFrame:
    date, kind = F.col("transaction_date"), df.schema["transaction_date"].dataType
    first = F.lit(month).cast("date")
    begin, end = first.cast(kind), F.add_months(first, 1).cast(kind)
    inside = df.filter((date >= begin) & (date < end))
    return inside.agg(earned().alias("income"), spent().alias("expenses")).withColumn(
        "balance", F.col("income") - F.col("expenses")
    )


def spending_by_weekday(df: DataFrame) -> DataFrame:
    return _spending_by(df, weekday(F.col("transaction_date")).alias("weekday"))


def spending_by_month(df: DataFrame) -> DataFrame:
    return _spending_by(df, F.month("transaction_date").alias("month"))


def _spending_by(df: DataFrame, bucket: Column) -> DataFrame:
    return df.filter("amount < 0").groupBy(bucket).agg((-F.sum("amount")).alias("spending"))


def spending_extremes(spending: DataFrame, bucket: str) -> DataFrame:
    """Highest and lowest bucket of ``spending_by_weekday`` or ``spending_by_month``; a tie goes to
    the smaller bucket."""
    return spending.agg(
        F.max_by(bucket, F.struct("spending", -F.col(bucket))).alias("highest"),
        F.min_by(bucket, F.struct("spending", bucket)).alias("lowest"),
    )


def income_expense_totals(df: DataFrame) -> DataFrame:
    return df.agg(spent().alias("expenses"), earned().alias("income")).withColumn(
        "net", F.col("income") - F.col("expenses")
    )


def budget_usage(df: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spending against a budget table ``(category, budget)``: percentage capped at 100, alert above
    90."""
    used = budgets.join(category_breakdown(df), "category", "left")
    used = used.withColumn("spent", zero(F.col("spending"))).drop("spending")
    rounded = F.floor(F.try_divide("spent", "budget") * 100 + 0.5)
    used = used.withColumn("percentage", F.least(F.lit(100), rounded.cast("int")))
    return used.withColumn("alert", F.col("percentage") > 90)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _stack(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(kind).alias("value"))
        for c in columns
    ]
    return df.select(F.inline(F.array(*pairs)))


QUARTILES = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
_PROFILE = ("column_name string, data_type string, n_rows long, n_nulls long, mean double, std double, "
            "min double, max double")


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and, for numbers, mean, deviation, range and quartiles.

    One pass takes all counts and moments and, with them, a sketch of the quartiles; a second one
    counts around these, and a third orders the few values between. One row per column reaches the
    driver."""
    numbers = _numeric(df)
    probs = [p for _, p in QUARTILES]
    aggs = [F.count("*").alias("_n"), *quantile_sketch(numbers, probs)]
    moments = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    for i, field in enumerate(df.schema.fields):
        col = F.col(f"`{field.name}`")
        aggs.append(F.count(col).alias(f"_c{i}"))
        if field.name in numbers:
            aggs += [fn(col.cast("double")).alias(f"_{name}{i}") for name, fn in moments]
    found = df.agg(*aggs).first()
    rows = [
        (field.name, field.dataType.simpleString(), found["_n"], found["_n"] - found[f"_c{i}"],
         *[found[f"_{name}{i}"] if field.name in numbers else None for name, _ in moments])
        for i, field in enumerate(df.schema.fields)
    ]
    profile = df.sparkSession.createDataFrame(rows, _PROFILE)
    if not numbers:
        empty = F.lit(None).cast("double")
        return profile.select("*", *[empty.alias(q) for q, _ in QUARTILES])
    quartiles = exact_quantiles(df, numbers, probs, sketch=found)
    wide = quartiles.groupBy("column_name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in QUARTILES]
    )
    return profile.join(wide, "column_name", "left")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, value, n)`` of text columns, counted in one pass."""
    long = _stack(df, columns or _texts(df), "string").filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def monthly_summary(df: DataFrame, k: int = 5) -> DataFrame:
    """Month ``yyyy-MM``, income, expenses, net and the ``k`` largest spending categories as an
    array. Ranking runs on the month and category sums, one row per category."""
    month = F.date_format("transaction_date", "yyyy-MM").alias("month")
    sums = df.groupBy(month, "category").agg(
        earned().alias("earned"),
        spent().alias("spent"),
        F.count(expense_of(F.col("amount"))).alias("n"),
    )
    of_month = Window.partitionBy("month")
    ranked = sums.withColumns(
        {
            "rank": F.row_number().over(of_month.orderBy(F.desc("spent"), "category")),
            "month_spent": F.sum("spent").over(of_month),
        }
    )
    entry = F.struct(
        "rank",
        "category",
        F.col("spent").alias("amount"),
        zero(share(F.col("spent"), F.col("month_spent"))).alias("percentage"),
        F.col("n").alias("count"),
    )
    shown = (F.col("rank") <= k) & (F.col("spent") > 0)
    out = ranked.groupBy("month").agg(
        F.sum("earned").alias("total_income"),
        F.sum("spent").alias("total_expenses"),
        (F.sum("earned") - F.sum("spent")).alias("net"),
        F.sort_array(F.collect_list(F.when(shown, entry))).alias("top"),
    )
    top = F.transform(
        "top", lambda e: F.struct(e["category"], e["amount"], e["percentage"], e["count"])
    )
    return out.withColumn("top_categories", top).drop("top")
