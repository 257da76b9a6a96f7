"""Spending patterns, recurring charges and the savings rules built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyframe.functions.calendar import month_start, whole_days
from tallyframe.functions.filters import not_null
from tallyframe.functions.rules import OTHER
from tallyframe.functions.stats import expense_of, income_of, share
from tallyframe.functions.text import amount_text
from tallyframe.operators.cleaning import select_expenses
from tallyframe.schemas import REC
from tallyframe.session import dealt, materialize

# Ways to save per category.
SAVINGS_ACTIONS = {
    "food": ("cooking at home more often", "using grocery coupons", "meal planning",
             "reducing takeout orders"),
    "transport": ("using public transportation", "carpooling", "planning trips more efficiently",
                  "comparing gas prices"),
    "shopping": ("comparing prices before purchasing", "waiting for sales",
                 "creating a shopping list and sticking to it", "using cashback apps"),
    "utilities": ("reducing energy consumption", "comparing service providers",
                  "negotiating your bills", "using programmable thermostats"),
    "entertainment": ("sharing subscriptions with family", "using free alternatives",
                      "looking for discount codes", "reducing unused subscriptions"),
    "health": ("comparing pharmacy prices", "using generic medications", "preventive care",
               "using in-network providers"),
    "housing": ("refinancing your mortgage", "negotiating rent", "comparing insurance rates",
                "reducing utility costs"),
    "other": ("creating a budget", "reviewing expenses regularly", "avoiding impulse purchases",
              "setting financial goals"),
}
# Message texts; %s marks an inserted value.
MESSAGES = {
    "high_spending": "You've spent %s%% more on %s than usual. "
                     "Consider limiting this to save $%s next month.",
    "recurring_charge": "We noticed a recurring charge of $%s for %s. "
                        "Do you still use this service?",
    "saving_opportunity": "Based on your spending patterns, you could save $%s on %s by %s.",
    "spending_trend": "Your spending on %s has increased by %s%% over the last next month.",
    "cashflow_improvement": "Your current savings rate is only %s%%. Reduce monthly expenses by "
                            "$%s to reach a healthier 20%% savings rate.",
    "financial_habit": "Consider automating your savings by setting up automatic transfers to a "
                       "savings account on payday.",
}
RULE_ORDER = ("high_spending", "saving_opportunity", "spending_trend", "recurring_charge",
              "cashflow_improvement", "financial_habit")


def monthly_category_spending(
    df: DataFrame, mode: str = "signed", keys: Sequence[str] = ()
) -> DataFrame:
    """Spending per (month, category); a table without categories counts as ``other``."""
    spending = select_expenses(not_null(df, "transaction_date"), mode)
    if "category" not in spending.columns:
        spending = spending.withColumn("category", F.lit(OTHER))
    month = month_start(F.col("transaction_date")).alias("month")
    grouped = not_null(spending, "category").groupBy(*keys, month, "category")
    return grouped.agg(F.sum("spending").alias("spending"))


def monthly_spending_of_all(
    df: DataFrame, mode: str = "signed", keys: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """As ``monthly_category_spending``, with a row for the spending of a month that has no
    category, so that every month with an expense can be ranked. ``rows``, the number of rows of
    ``df``, sizes the tasks where there are ``keys``."""
    spending = select_expenses(not_null(df, "transaction_date"), mode)
    if "category" not in spending.columns:
        spending = spending.withColumn("category", F.lit(OTHER))
    spending = spending.withColumn("month", month_start(F.col("transaction_date")))
    return _by_groups(spending, [*keys, "month", "category"], keys, ["spending"], rows).agg(
        F.sum("spending").alias("spending"))


def _by_groups(df: DataFrame, groups: Sequence[str], keys: Sequence[str],
               columns: Sequence[str], rows: int | None):
    """``df`` grouped by ``groups``. Without ``keys`` the sums combine before the shuffle. With them
    there are nearly as many groups as rows, and ``rows``, the number of rows, sizes the tasks."""
    if keys and rows is not None:
        df = dealt(df.select(*groups, *columns), rows, *groups)
    return df.groupBy(*groups)


def spending_patterns(
    df: DataFrame, pct: float = 75, mode: str = "signed", keys: Sequence[str] = ()
) -> DataFrame:
    """Statistics of the observed months per category. ``recent`` is the mean over the last three
    months with any expense, also an uncategorised one. With ``keys`` each key value is judged on
    its own months."""
    rows = df.count() if keys else None
    return patterns_of(monthly_spending_of_all(df, mode, keys, rows), pct, keys, rows)


def patterns_of(
    monthly: DataFrame, pct: float = 75, keys: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """``spending_patterns`` from the monthly sums. The months of one key value are ranked together:
    one row per month and category, however many transactions there were. Rows without a category
    take part in the ranking of the months only. With ``keys``, ``rows`` bounds the monthly sums and
    sizes the tasks."""
    if keys and rows is not None:
        monthly = dealt(monthly, rows, *keys)
    age = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("month")))
    recent = F.avg(F.when(F.col("_age") <= 3, F.col("spending")))
    aged = not_null(monthly.withColumn("_age", age), "category")
    stats = aged.groupBy(*keys, "category").agg(
        F.avg("spending").alias("avg_spending"),
        F.percentile("spending", 0.5).alias("median_spending"),
        F.percentile("spending", pct / 100).alias("threshold"),
        F.coalesce(recent, F.lit(0.0)).alias("recent_spending"),
        F.count("*").alias("months_count"),
    )
    trend = F.when(F.col("avg_spending") > 0, F.col("recent_spending") / F.col("avg_spending"))
    return stats.withColumn("recent_trend", F.coalesce(trend, F.lit(1.0)))


def _rec(df: DataFrame, kind: str, keys: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Rows in the ``REC`` shape, with their keys before it and the place of their rule behind."""
    columns = {"type": F.lit(kind), **columns}
    shaped = [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in REC.fields
    ]
    return df.select(*keys, *shaped, F.lit(RULE_ORDER.index(kind)).alias("seq"))


def _message(kind: str, *values: Column) -> Column:
    return F.format_string(MESSAGES[kind], *values)


def rec_high_spending(patterns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Recent spending above the usual threshold by more than 10 % and 5 units."""
    over = share(F.col("recent_spending") - F.col("avg_spending"), F.col("avg_spending"))
    saving = F.col("recent_spending") - F.col("avg_spending")
    hit = patterns.filter("recent_spending > threshold and months_count >= 3").filter(
        (over > 10) & (saving > 5)
    )
    text = _message("high_spending", amount_text(over, 1), F.col("category"),
                    amount_text(saving, 2))
    return _rec(
        hit,
        "high_spending",
        keys,
        category=F.col("category"),
        message=text,
        amount=F.round(over, 1),
        savings_potential=F.round(saving, 2),
        priority=F.least(F.lit(90.0), over).cast("int"),
        confidence=F.lit(0.8),
    )


def pick_action(category: Column, actions: dict[str, Sequence[str]] = SAVINGS_ACTIONS) -> Column:
    """One of the actions of a category, chosen by a hash of its name."""
    lists = F.create_map(
        *[c for k, v in actions.items() for c in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    options = F.try_element_at(lists, category)
    number = F.conv(F.substring(F.md5(category), 1, 8), 16, 10).cast("bigint")
    return F.try_element_at(options, (number % F.size(options) + 1).cast("int"))


def rec_saving_opportunity(
    patterns: DataFrame,
    actions: dict[str, Sequence[str]] = SAVINGS_ACTIONS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """15 % of the mean of every category above 100 that has known ways to save."""
    saving = F.col("avg_spending") * 0.15
    action = pick_action(F.col("category"), actions)
    hit = patterns.filter((F.col("avg_spending") > 100) & F.col("category").isin(list(actions)))
    text = _message("saving_opportunity", amount_text(saving, 2), F.col("category"), action)
    return _rec(
        hit,
        "saving_opportunity",
        keys,
        category=F.col("category"),
        message=text,
        savings_potential=F.round(saving, 2),
        priority=F.least(F.lit(60.0), saving / 5).cast("int"),
        confidence=F.lit(0.7),
        action=action,
    )


def rec_spending_trend(
    patterns: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean forecast more than 20 % above the historical mean."""
    ahead = forecasts.groupBy(*keys, "category").agg(F.abs(F.avg("amount")).alias("ahead"))
    usual = F.col("avg_spending")
    rise = share(F.col("ahead") - usual, usual)
    hit = patterns.join(ahead, [*keys, "category"]).filter(F.col("ahead") > usual * 1.2)
    return _rec(
        hit,
        "spending_trend",
        keys,
        category=F.col("category"),
        message=_message("spending_trend", F.col("category"), amount_text(rise, 1)),
        percentage=F.round(rise, 1),
        savings_potential=(F.col("ahead") - usual) * 0.5,
        priority=F.least(F.lit(80.0), rise).cast("int"),
        confidence=F.lit(0.75),
    )


def recurring_charges(
    df: DataFrame,
    min_occurrences: int = 3,
    max_variance: float = 0.1,
    keys: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Descriptions with steady amounts at steady intervals.

    Intervals between neighbouring dates count whole days, so two rows of one day are 0 apart. It
    is enough to know each day's first and last time: rows are summed per (description, day), and the
    ordered window then sees at most one row per calendar day, even for a description that holds a
    third of all rows. Regular charges have nearly as many sums as rows, so the number of rows sizes
    the tasks of the sums and of that window; it is counted unless ``rows`` gives it.
    """
    if "amount" in df.columns:
        charge = expense_of(F.col("amount"))
    elif "withdrawal" in df.columns:
        charge = F.col("withdrawal")
    else:
        raise ValueError("Cannot identify amount column in the data")
    ids = [*keys, "description"]
    ts = F.col("transaction_date")
    named = not_null(df, *ids)
    rows = named.count() if rows is None else rows
    named = named.withColumns({"_charge": charge, "_day": F.to_date(ts)})
    days = (
        _by_groups(named, [*ids, "_day"], ids, ["transaction_date", "_charge"], rows)
        .agg(
            F.count("*").alias("_rows"),
            F.count(ts).alias("_dated"),
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.count("_charge").alias("_n"),
            F.avg("_charge").alias("_mean"),
            (F.var_pop("_charge") * F.count("_charge")).alias("_m2"),
        )
    )
    days = dealt(days, rows, *ids)
    own = Window.partitionBy(*ids)
    before = F.lag("_last").over(own.orderBy("_day"))
    total = F.sum(F.col("_mean") * F.col("_n")).over(own) / F.nullif(
        F.sum("_n").over(own), F.lit(0)
    )
    days = days.withColumns({"_gap": whole_days(F.col("_first"), before), "_avg": total})
    off = F.col("_mean") - F.col("_avg")
    same_day = F.when(F.max("_dated") > 1, F.lit(0))
    found = days.groupBy(*ids).agg(
        F.sum("_rows").alias("occurrences"),
        F.sum("_dated").alias("dated"),
        F.sum("_n").alias("charges"),
        F.first("_avg").alias("amount"),
        F.sum(F.col("_m2") + F.col("_n") * off * off).alias("m2"),
        F.least(F.min("_gap"), same_day).alias("shortest"),
        F.greatest(F.max("_gap"), same_day).alias("longest"),
        F.sum("_gap").alias("gaps"),
        F.max("_last").alias("last_date"),
    )
    deviation = F.sqrt(F.try_divide("m2", F.col("charges") - 1))
    variation = F.try_divide(deviation, "amount")
    steady = (
        found.filter(
            (F.col("occurrences") >= min_occurrences)
            & (F.col("charges") >= min_occurrences)
            & (F.col("dated") >= min_occurrences)
            & (F.col("amount") > 0)
        )
        .filter(variation <= max_variance)
        .filter("longest - shortest <= 5 and gaps > 0")
    )
    frequency = F.try_divide(F.col("gaps"), F.col("dated") - 1)
    return steady.withColumn("frequency_days", frequency).select(
        *ids,
        "amount",
        "frequency_days",
        "occurrences",
        "last_date",
        (F.col("amount") * F.try_divide(F.lit(365), "frequency_days")).alias("annual_cost"),
    )


def rec_recurring_charge(charges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    annual = F.col("annual_cost")
    text = _message("recurring_charge", amount_text(F.col("amount"), 2), F.col("description"))
    return _rec(
        charges.filter(annual > 100),
        "recurring_charge",
        keys,
        description=F.col("description"),
        message=text,
        amount=F.round("amount", 2),
        annual_cost=F.round(annual, 2),
        savings_potential=annual * 0.5,
        priority=F.least(F.lit(70.0), annual / 10).cast("int"),
        confidence=F.lit(0.8),
    )


def cashflow(df: DataFrame, keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Mean monthly income and expenses, each over the months that have any, and the savings rate.
    ``rows``, the number of rows of ``df``, sizes the tasks where there are ``keys``."""
    amount = F.col("amount")
    months = df.withColumn("month", month_start(F.col("transaction_date")))
    monthly = _by_groups(months, [*keys, "month"], keys, ["amount"], rows).agg(
        F.sum(expense_of(amount)).alias("spent"),
        F.sum(income_of(amount)).alias("earned"),
        F.count(expense_of(amount)).alias("expenses"),
        F.count(income_of(amount)).alias("incomes"),
    )
    if keys and rows is not None:
        monthly = dealt(monthly, rows, *keys)
    flow = monthly.groupBy(*keys).agg(
        F.avg("spent").alias("monthly_expenses"),
        F.avg("earned").alias("monthly_income"),
        F.sum("expenses").alias("expense_count"),
        F.sum("incomes").alias("income_count"),
    )
    rate = (F.col("monthly_income") - F.col("monthly_expenses")) / F.col("monthly_income") * 100
    return flow.withColumn("savings_rate", F.when(F.col("monthly_income") > 0, rate))


def rec_cashflow(df: DataFrame, keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """A savings rate below 10 %, from more than 10 expenses and at least one income."""
    return rec_cashflow_of(cashflow(df, keys, rows), keys)


def rec_cashflow_of(flow: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``rec_cashflow`` from the cash flow."""
    flow = flow.filter("expense_count > 10 and income_count > 0 and savings_rate < 10")
    needed = F.col("monthly_expenses") - F.col("monthly_income") * 0.8
    rate = F.round("savings_rate", 1)
    shown = F.when(rate > 0, amount_text(F.col("savings_rate"), 1)).otherwise("0")
    return _rec(
        flow,
        "cashflow_improvement",
        keys,
        message=_message("cashflow_improvement", shown, amount_text(needed, 2)),
        savings_potential=F.round(needed, 2),
        priority=F.lit(85),
        confidence=F.lit(0.9),
    )


def rec_habit(
    recs: DataFrame,
    keys: Sequence[str] = (),
    owners: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One general suggestion while there are fewer than three others. With ``keys``, ``owners`` has a
    row for each key value, also for those without any other recommendation; ``rows``, the number of
    rows of both, sizes the tasks."""
    if keys:
        counted = owners.select(*keys, F.lit(0).alias("one")).unionByName(
            recs.select(*keys, F.lit(1).alias("one")))
        few = _by_groups(counted, keys, keys, ["one"], rows).agg(F.sum("one").alias("n")).filter("n < 3")
    else:
        few = recs.limit(3).agg(F.count("*").alias("n")).filter("n < 3")
    return _rec(
        few,
        "financial_habit",
        keys,
        message=F.lit(MESSAGES["financial_habit"]),
        savings_potential=F.lit(100.0),
        priority=F.lit(50),
        confidence=F.lit(0.9),
    )


def all_recommendations(
    df: DataFrame,
    forecasts: DataFrame | None = None,
    mode: str = "signed",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every recommendation with its rule number ``seq``, not ranked or cut. The monthly sums feed
    three rules and the list feeds its own last rule; both are small against the transactions and
    are written out once instead of computed again. With ``keys``, such as ``("account_id",)``, each
    key value is advised on its own transactions, all in one job; rows without a key are left out, and
    the list comes dealt by its keys into tasks sized by rows, for the windows and groups behind it."""
    df = not_null(df, *keys)
    rows = df.count()
    recs = []
    if "category" in df.columns:
        monthly = materialize(monthly_spending_of_all(df, mode, keys, rows))
        patterns = patterns_of(monthly, keys=keys, rows=rows)
        recs += [rec_high_spending(patterns, keys), rec_saving_opportunity(patterns, keys=keys)]
        if forecasts is not None:
            recs.append(rec_spending_trend(patterns, forecasts, keys))
    if "description" in df.columns:
        recs.append(rec_recurring_charge(recurring_charges(df, keys=keys, rows=rows), keys))
    flow = cashflow(df, keys, rows)
    if keys:  # a row for each key value
        flow = materialize(flow)
    recs.append(rec_cashflow_of(flow, keys))
    union = recs[0]
    for more in recs[1:]:
        union = union.unionByName(more)
    union = materialize(union)
    if keys:
        most = union.count() + flow.count()
        habits = rec_habit(union, keys, flow, most)
        union = dealt(union.unionByName(habits), most, *keys)
    else:
        union = union.unionByName(rec_habit(union))
    return union.withColumn("category", F.coalesce("category", F.lit("general")))


def recommendations(
    df: DataFrame,
    forecasts: DataFrame | None = None,
    limit: int = 10,
    mode: str = "signed",
    keys: Sequence[str] = (),
) -> DataFrame:
    """The ``limit`` recommendations of highest priority, with ``keys`` those of each key value; ties
    keep the order of the rules."""
    every = all_recommendations(df, forecasts, mode, keys)
    order = [F.desc("priority"), "seq", "category", "description"]
    if not keys:
        return every.orderBy(*order).limit(limit).drop("seq")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return every.withColumn("_place", place).filter(F.col("_place") <= limit).drop("seq", "_place")


def with_ids(recs: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds a random id and the creation time, as a stored recommendation has them."""
    stamp = now if now is not None else F.current_timestamp()
    return recs.withColumns({"id": F.expr("uuid()"), "created_at": stamp})


def with_stable_ids(recs: DataFrame) -> DataFrame:
    """Adds an id made from type, category and description: a recomputed row keeps its id."""
    parts = [F.coalesce(c, F.lit("")) for c in ("type", "category", "description")]
    return recs.withColumn("id", F.md5(F.concat_ws("|", *parts)))


def top_recommendations(recs: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    order = [F.desc("priority"), "type", "category", "description"]
    if not keys:
        return recs.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return recs.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def recommendation_report(
    recs: DataFrame, k: int = 5, keys: Sequence[str] = (), most: int = 100
) -> DataFrame:
    """One nested row, with ``keys`` one per key value, from a ranked and cut list: the ``k`` best, up
    to ``most`` of each type, and the savings of all saving opportunities."""
    entry = F.struct((-F.col("priority")).alias("order"), "message", "type", "priority", "category",
                     "amount", "percentage")
    place = F.row_number().over(Window.partitionBy(*keys, "type").orderBy(
        F.desc("priority"), "message"))
    by_type = recs.withColumn("_place", place).groupBy(*keys, "type").agg(
        F.sort_array(F.collect_list(F.when(F.col("_place") <= most, entry))).alias("items"),
        F.sum(F.when(F.col("type") == "saving_opportunity", F.col("savings_potential")))
        .alias("savings"),
    )
    ordered = F.slice(F.sort_array(F.flatten(F.collect_list("items"))), 1, k)
    return by_type.groupBy(*keys).agg(
        ordered.alias("top_recommendations"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "items")))).alias(
            "recommendation_by_type"
        ),
        F.coalesce(F.sum("savings"), F.lit(0.0)).alias("savings_potential"),
    )
