"""Filters, lookups, top-k and maintenance of transaction and recommendation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOW = F.current_timestamp


def _all(*conditions: Column | None) -> Column:
    combined = F.lit(True)
    for condition in conditions:
        if condition is not None:
            combined = combined & condition
    return combined


def moment(df: DataFrame, value) -> Column:
    """A point in time in the type of the date column, so that a comparison casts the literal and
    not the column, and still reaches the scan."""
    return F.lit(value).cast(df.schema["transaction_date"].dataType)


def filter_transactions(
    df: DataFrame,
    start=None,
    end=None,
    category: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
) -> DataFrame:
    """All bounds inclusive and combined with AND; they reach the scan as pushed filters."""
    date, amount = F.col("transaction_date"), F.col("amount")
    return df.filter(
        _all(
            date >= moment(df, start) if start else None,
            date <= moment(df, end) if end else None,
            F.col("category") == category if category else None,
            amount >= min_amount if min_amount is not None else None,
            amount <= max_amount if max_amount is not None else None,
        )
    )


def list_transactions(df: DataFrame, skip: int = 0, limit: int = 100, **filters) -> DataFrame:
    """One page, newest first. ``count_transactions`` gives the total before paging."""
    page = filter_transactions(df, **filters).orderBy(F.desc("transaction_date"), "id")
    return page.offset(skip).limit(limit)


def count_transactions(df: DataFrame, **filters) -> DataFrame:
    return filter_transactions(df, **filters).agg(F.count("*").alias("total"))


def get_transaction(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    """Equality lookup; an empty result means not found."""
    return df.filter(F.col(column) == key)


def added(new: DataFrame, now: Column | None = None) -> DataFrame:
    """New rows with an id and a creation time."""
    return new.withColumns(
        {
            "id": F.expr("uuid()"),
            "created_at": now if now is not None else NOW(),
            "updated_at": F.lit(None).cast("timestamp"),
        }
    )


def append_transactions(df: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """The table with new rows, which get an id and a creation time. To store them, ``append_to``
    adds the new rows alone."""
    return df.unionByName(added(new, now), allowMissingColumns=True)


PATCHABLE = ("description", "amount", "transaction_date", "category", "notes")


def update_transactions(df: DataFrame, patches: DataFrame, now: Column | None = None) -> DataFrame:
    """Overwrite the fields that a patch sets; a null field leaves the old value. Several patches of
    one id are merged field by field: of the values that are set, the one with the largest ``seq``
    counts, where ``patches`` have that column, else the largest value."""
    fields = [c for c in PATCHABLE if c in patches.columns and c in df.columns]
    order = (lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", c))) if (
        "seq" in patches.columns) else F.col
    merged = [F.max_by(c, order(c)).alias(f"_new_{c}") for c in fields]
    renamed = patches.groupBy("id").agg(F.first(F.lit(True)).alias("_hit"), *merged)
    updated = df.join(renamed, "id", "left").withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in fields}
    )
    old = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    stamp = F.when(F.col("_hit"), now if now is not None else NOW()).otherwise(old)
    updated = updated.withColumn("updated_at", stamp)
    return updated.drop("_hit", *[f"_new_{c}" for c in fields])


def delete_transactions(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def search_transactions(
    df: DataFrame, query: str = "", start=None, end=None, category: str | None = None
) -> DataFrame:
    """Case-insensitive substring in description or category, newest first."""
    found = filter_transactions(df, start=start, end=end, category=category)
    if query:
        text = query.lower()
        in_text = F.lower("description").contains(text)
        in_category = F.coalesce(F.lower("category").contains(text), F.lit(False))
        found = found.filter(in_text | in_category)
    return found.orderBy(F.desc("transaction_date"), "id")


def similar_transactions(df: DataFrame, description: str, k: int = 3) -> DataFrame:
    """The first ``k`` rows whose description contains the text, newest first."""
    hit = F.lower("description").contains(description.lower())
    return df.filter(hit).orderBy(F.desc("transaction_date"), "id").limit(k)


def recent_transactions(df: DataFrame, k: int = 5) -> DataFrame:
    return df.orderBy(F.desc("transaction_date"), "id").limit(k)


def distinct_categories(df: DataFrame) -> DataFrame:
    return df.filter("category <> ''").select("category").distinct()


def category_counts(df: DataFrame) -> DataFrame:
    counted = df.filter(F.col("category").isNotNull()).groupBy("category")
    return counted.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def filter_recommendations(
    recs: DataFrame,
    min_priority: int | None = None,
    max_priority: int | None = None,
    type: str | None = None,
    category: str | None = None,
) -> DataFrame:
    priority = F.col("priority")
    return recs.filter(
        _all(
            priority >= min_priority if min_priority is not None else None,
            priority <= max_priority if max_priority is not None else None,
            F.col("type") == type if type else None,
            F.col("category") == category if category else None,
        )
    )


def list_recommendations(recs: DataFrame, skip: int = 0, limit: int = 100, **filters) -> DataFrame:
    page = filter_recommendations(recs, **filters).orderBy(F.desc("priority"), "id")
    return page.offset(skip).limit(limit)


def recommendation_filters(recs: DataFrame) -> DataFrame:
    """Choices for a filter form: types, categories and the priority range, 1 to 10 when empty."""
    return recs.agg(
        F.sort_array(F.collect_set("type")).alias("types"),
        F.sort_array(F.collect_set("category")).alias("categories"),
        F.coalesce(F.min("priority"), F.lit(1)).alias("min_priority"),
        F.coalesce(F.max("priority"), F.lit(10)).alias("max_priority"),
    )


def get_recommendation(recs: DataFrame, key: str) -> DataFrame:
    return recs.filter(F.col("id") == key)
