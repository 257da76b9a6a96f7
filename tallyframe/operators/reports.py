"""Report sections and the nested financial report.

All sections read one rollup: sums per day, category and recency. The rollup is made in a single
pass over the transactions and has at most days x categories x 2 rows, whatever their number, so a
full report does not scan the raw table once per section. Every function also accepts the raw table.
With ``keys`` each key value is a ledger of its own: its newest date, its shares and its months.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyframe.functions.calendar import month_start, whole_days
from tallyframe.functions.stats import (
    correlation,
    expense_of,
    income_of,
    percent_change,
    share,
    slope,
)
from tallyframe.session import materialize

SIGNS = {"income": "income", "expense": "expense"}
# Upper limits of the coefficient of variation, and what lies above the last one.
STABILITY = ((0.1, "very stable"), (0.2, "stable"), (0.3, "moderately stable"), (0.5, "variable"))
UNSTABLE = "highly variable"
NOT_SPENDING = ("income", "deposit", "transfer")


def report_rollup(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Income, expense and row counts per day, category and whether a row lies in the 30 days
    before the newest one."""
    if "n_rows" in df.columns:
        return df
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(None).cast("string"))
    ts, amount = F.col("transaction_date"), F.col("amount")
    if keys:
        # Sums per moment would not be smaller than the rows, so the newest moments are joined.
        newest = F.col("_newest")
        last = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(ts).alias("_newest"))
        same = functools.reduce(lambda a, b: a & b,
                                [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        df = df.join(last, same)
    else:
        newest = df.agg(F.max("transaction_date")).scalar()
    recent = F.coalesce(ts >= newest - F.expr("interval 30 days"), F.lit(False))
    return df.groupBy(*keys, F.to_date(ts).alias("date"), "category", recent.alias("recent")).agg(
        F.sum(income_of(amount)).alias("income"),
        F.sum(expense_of(amount)).alias("expense"),
        F.count(income_of(amount)).alias("n_income"),
        F.count(expense_of(amount)).alias("n_expense"),
        F.count("*").alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def _total(column: str, when: Column | None = None) -> Column:
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0.0))


def report_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Range, totals, the last 30 days, monthly averages and the savings rate as one row."""
    recent = F.col("recent")
    one = report_rollup(df, keys).groupBy(*keys).agg(
        F.min("first_ts").alias("start_date"),
        F.max("last_ts").alias("end_date"),
        _total("income").alias("total_income"),
        _total("expense").alias("total_expenses"),
        _total("income", recent).alias("recent_income"),
        _total("expense", recent).alias("recent_expenses"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("transaction_count"),
    )
    one = one.withColumn("days", whole_days(F.col("end_date"), F.col("start_date")))
    months = F.greatest(F.lit(1), F.floor(F.col("days") / 30))
    income, expenses = F.col("total_income"), F.col("total_expenses")
    rate = F.when(income > 0, (income - expenses) / income * 100).otherwise(0.0)
    return one.withColumns(
        {
            "net_cashflow": income - expenses,
            "recent_net_cashflow": F.col("recent_income") - F.col("recent_expenses"),
            "monthly_income": income / months,
            "monthly_expenses": expenses / months,
            "monthly_net_cashflow": income / months - expenses / months,
            "savings_rate": rate,
        }
    )


def _by_category(df: DataFrame, sign: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(category, amount, n, whole)`` of one sign, categories without such rows left out. ``whole``
    is the total over all rows; the window behind it has one row per category."""
    rows = report_rollup(df, keys).filter(F.col(f"n_{sign}") > 0).groupBy(*keys, "category")
    sums = rows.agg(F.sum(sign).alias("amount"), F.sum(f"n_{sign}").alias("n"))
    whole = F.sum("amount").over(Window.partitionBy(*keys))
    return sums.withColumn("whole", whole).filter(F.col("category").isNotNull())


def _monthly(df: DataFrame, sign: str, keys: Sequence[str] = ()) -> DataFrame:
    rows = report_rollup(df, keys).filter(F.col(f"n_{sign}") > 0)
    return rows.groupBy(*keys, month_start(F.col("date")).alias("month")).agg(F.sum(sign).alias("amount"))


def top_categories(df: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest categories of each sign."""
    rollup = report_rollup(df, keys)
    both = None
    for sign in SIGNS:
        part = _by_category(rollup, sign, keys).select(
            *keys, F.lit(sign).alias("kind"), "category", "amount")
        both = part if both is None else both.unionByName(part)
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("amount"), "category")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _shares(df: DataFrame, sign: str, keys: Sequence[str] = ()) -> DataFrame:
    rows = _by_category(df, sign, keys).filter("amount >= 0.01D * whole")
    percentage = share(F.col("amount"), F.col("whole")).alias("percentage")
    return rows.select(*keys, "category", "amount", percentage)


def income_sources(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Income per category and its share; below one percent left out."""
    return _shares(df, "income", keys).withColumnRenamed("category", "source")


def expense_categories(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _shares(df, "expense", keys)


def monthly_stability(
    df: DataFrame, sign: str = "income", keys: Sequence[str] = ()
) -> DataFrame:
    """Monthly statistics and a stability word from their coefficient of variation."""
    stats = _monthly(df, SIGNS[sign], keys).groupBy(*keys).agg(
        F.count("*").alias("months"),
        F.avg("amount").alias("mean"),
        F.percentile("amount", 0.5).alias("median"),
        F.min("amount").alias("min"),
        F.max("amount").alias("max"),
        F.stddev_samp("amount").alias("std_dev"),
    )
    cv = F.try_divide("std_dev", "mean")
    word = F.when(F.col("months") < 3, "insufficient data")
    for limit, name in STABILITY:
        word = word.when(cv < limit, name)
    enough = F.col("months") >= 3
    known = {c: F.when(enough, F.col(c)) for c in ("mean", "median", "min", "max", "std_dev")}
    stats = stats.withColumns({"cv": F.when(enough, cv), "stability": word.otherwise(UNSTABLE)})
    return stats.withColumns(known)


def monthly_trend(df: DataFrame, sign: str = "income", keys: Sequence[str] = ()) -> DataFrame:
    """Slope, correlation and overall change of the monthly totals; no row below four months, for
    constant totals, or when the first total is not positive."""
    # One row per calendar month.
    by_month = Window.partitionBy(*keys).orderBy("month")
    rows = _monthly(df, SIGNS[sign], keys).withColumn("i", F.row_number().over(by_month) - 1)
    first, last = F.min_by("amount", "month"), F.max_by("amount", "month")
    trend = rows.groupBy(*keys).agg(
        F.count("*").alias("months"),
        slope("amount", F.col("i").cast("double")).alias("slope"),
        correlation("amount", F.col("i").cast("double")).alias("correlation"),
        percent_change(last, first).alias("percent_change"),
        F.var_pop("amount").alias("_var"),
    )
    word = (
        F.when(F.col("slope") > 0, "increasing")
        .when(F.col("slope") < 0, "decreasing")
        .otherwise("stable")
    )
    kept = trend.filter("months >= 4 and _var > 0 and percent_change is not null")
    return kept.drop("_var").withColumn("interpretation", word)


def category_section(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expense categories of at least one rounded percent: total, share, count, mean and the change
    between their last two observed months."""
    rollup = report_rollup(df, keys).filter(
        (F.col("n_expense") > 0) & F.col("category").isNotNull())
    monthly = rollup.groupBy(*keys, "category", month_start(F.col("date")).alias("month")).agg(
        F.sum("expense").alias("value"), F.sum("n_expense").alias("n")
    )
    rows = monthly.groupBy(*keys, "category").agg(
        F.sum("value").alias("amount"),
        F.sum("n").alias("transaction_count"),
        F.sort_array(F.collect_list(F.struct("month", "value"))).alias("months"),
    )
    whole = F.sum("amount").over(Window.partitionBy(*keys))  # one row per category
    last = F.try_element_at("months", F.lit(-1))["value"]
    previous = F.try_element_at("months", F.lit(-2))["value"]
    rows = rows.withColumn("share", share(F.col("amount"), whole))
    return rows.filter(F.round("share", 1) >= 1).select(
        *keys,
        "category",
        "amount",
        F.round("share", 1).alias("percentage"),
        "transaction_count",
        (F.col("amount") / F.col("transaction_count")).alias("average_transaction"),
        percent_change(last, previous).alias("month_to_month_change"),
    )


def pie_buckets(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rounded expense shares, those below three percent folded into ``Other``."""
    totals = _by_category(df, "expense", keys).filter("category is not null")
    whole = F.sum("amount").over(Window.partitionBy(*keys))  # one row per category
    totals = totals.withColumn("pct", F.round(share(F.col("amount"), whole), 1))
    pct = F.col("pct")
    slice_name = F.when(pct >= 3, F.col("category")).otherwise("Other")
    return totals.groupBy(*keys, slice_name.alias("slice")).agg(F.sum(pct).alias("percentage"))


def group_recommendations(
    recs: DataFrame, keys: Sequence[str] = (), most: int = 100
) -> DataFrame:
    """Number and messages of each type in a ranked and cut list. At most the ``most`` messages of
    highest priority are gathered in a row; the number counts all."""
    order = Window.partitionBy(*keys, "type").orderBy(F.desc("priority"), "message")
    ranked = recs.withColumn("_place", F.row_number().over(order))
    counts = recs.groupBy(*[F.col(k).alias(f"_{k}") for k in (*keys, "type")]).agg(
        F.count("*").alias("n"))
    entry = F.struct((-F.col("priority")).alias("order"), "message")
    lists = ranked.filter(F.col("_place") <= most).groupBy(*keys, "type").agg(
        F.sort_array(F.collect_list(entry)).alias("items"))
    same = functools.reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "type")])
    grouped = lists.join(counts, same)
    return grouped.select(*keys, "type", "n", F.col("items.message").alias("messages"))


def forecast_section(forecasts: DataFrame, df: DataFrame) -> DataFrame:
    """Forecast total per spending category against its expenses in the last 30 days."""
    spending = ~F.lower("category").isin(*NOT_SPENDING)
    ahead = forecasts.filter(spending).groupBy("category").agg(
        F.sum(F.abs("amount")).alias("forecast_total"),
        F.count("*").alias("forecast_period_days"),
    )
    recent = report_rollup(df).filter("recent and n_expense > 0")
    now = recent.groupBy("category").agg(F.sum("expense").alias("current_amount"))
    rows = ahead.join(now, "category", "left")
    change = F.round(percent_change(F.col("forecast_total"), F.col("current_amount")), 1)
    word = F.when(change > 0, "increase").when(change.isNotNull(), "decrease")
    return rows.withColumns({"percentage_change": change, "direction": word})


def _as_array(df: DataFrame, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != order]
    entry = F.struct(F.col(order).alias("_order"), *rest)
    ordered = F.sort_array(F.collect_list(entry), asc=False)
    plain = F.transform(ordered, lambda e: F.struct(e["_order"].alias(order), *[e[c] for c in rest]))
    return df.agg(plain.alias("items"))


def financial_report(
    df: DataFrame, recs: DataFrame | None = None, forecasts: DataFrame | None = None
) -> DataFrame:
    """All sections as one nested row. The rollup is written out once and feeds every section; each
    section arrives as a one-row subquery."""
    has_category = "category" in df.columns
    rollup = materialize(report_rollup(df))

    def whole_row(section: DataFrame) -> Column:
        return section.select(F.struct("*")).scalar()

    def rows(section: DataFrame, order: str) -> Column:
        return _as_array(section, order).scalar()

    sections = {"summary": whole_row(report_summary(rollup))}
    for sign, parts in (("income", income_sources), ("expense", expense_categories)):
        sections[f"{sign}_analysis"] = F.struct(
            rows(parts(rollup), "amount").alias("parts"),
            whole_row(monthly_stability(rollup, sign)).alias("stability"),
            whole_row(monthly_trend(rollup, sign)).alias("trend"),
        )
    if has_category:
        sections["top_categories"] = rows(top_categories(rollup), "amount")
        sections["category_breakdown"] = rows(category_section(rollup), "amount")
    if recs is not None:
        sections["recommendations"] = rows(group_recommendations(recs), "n")
    if forecasts is not None:
        sections["forecasts"] = rows(forecast_section(forecasts, rollup), "forecast_total")
    one = df.sparkSession.range(1)
    return one.select(*[c.alias(n) for n, c in sections.items()])


def _facts(df: DataFrame, keys: Sequence[str], section: str, name: Column) -> DataFrame:
    """One row ``(*keys, section, name, measure, value, word)`` for each column of a section; numbers
    go to ``value``, words and moments to ``word``."""
    facts = []
    for field in df.schema.fields:
        if field.name in keys or field.name.startswith("_"):
            continue
        column = F.col(field.name)
        text = field.dataType.simpleString() in ("string", "timestamp", "date", "timestamp_ntz")
        facts.append(F.struct(
            F.lit(field.name).alias("measure"),
            (F.lit(None) if text else column).cast("double").alias("value"),
            (column if text else F.lit(None)).cast("string").alias("word")))
    return df.select(*keys, F.lit(section).alias("section"), name.alias("name"),
                     F.inline(F.array(*facts)))


def account_report(df: DataFrame, keys: Sequence[str] = ("account_id",), k: int = 3) -> DataFrame:
    """The sections of ``financial_report`` for every account at once, as rows
    ``(*keys, section, name, measure, value, word)``. The transactions are rolled up once, with the
    account among the groups; each section sums that rollup, so an account costs a few rows and the
    whole report a few shuffles of days and categories, however many accounts there are."""
    rollup = materialize(report_rollup(df, keys))
    nothing = F.lit(None).cast("string")
    parts = [_facts(report_summary(rollup, keys), keys, "summary", nothing)]
    for sign, shares, column in (("income", income_sources, "source"),
                                 ("expense", expense_categories, "category")):
        named = shares(rollup, keys).withColumnRenamed(column, "_name")
        parts += [
            _facts(named, keys, f"{sign}_parts", F.col("_name")),
            _facts(monthly_stability(rollup, sign, keys), keys, f"{sign}_stability", nothing),
            _facts(monthly_trend(rollup, sign, keys), keys, f"{sign}_trend", nothing)]
    top = top_categories(rollup, k, keys).withColumn(
        "_name", F.concat_ws(":", "kind", "category")).drop("kind", "category")
    section = category_section(rollup, keys).withColumnRenamed("category", "_name")
    slices = pie_buckets(rollup, keys).withColumnRenamed("slice", "_name")
    parts += [_facts(top, keys, "top_categories", F.col("_name")),
              _facts(section, keys, "category_breakdown", F.col("_name")),
              _facts(slices, keys, "slices", F.col("_name"))]
    return functools.reduce(DataFrame.unionByName, parts)
