"""The category dimension: defaults, guarded edits and the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import CATEGORY
from tallyframe.session import materialize

# The categories of a new table.
DEFAULT_CATEGORIES = (
    ("food", "Food and dining expenses", "#FF5733", "utensils"),
    ("transport", "Transportation expenses", "#33FF57", "car"),
    ("utilities", "Utility bills", "#3357FF", "bolt"),
    ("entertainment", "Entertainment expenses", "#FF33A8", "film"),
    ("shopping", "Shopping expenses", "#A833FF", "shopping-bag"),
    ("health", "Healthcare expenses", "#33FFF6", "heartbeat"),
    ("housing", "Housing expenses", "#FFC733", "home"),
    ("income", "Income sources", "#57FF33", "dollar-sign"),
    ("other", "Other expenses", "#999999", "question-circle"),
)
BUILT_IN = ("income", "other")


class CategoryError(ValueError):
    """An edit that breaks a rule of the category table."""


def categories_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, None) for row in DEFAULT_CATEGORIES], CATEGORY)


def _has(df: DataFrame, name: str) -> bool:
    return not df.filter(F.col("name") == name).isEmpty()


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise CategoryError(message)


def get_category(df: DataFrame, name: str) -> DataFrame:
    _need(_has(df, name), "Category not found")
    return df.filter(F.col("name") == name)


def add_category(
    df: DataFrame,
    name: str,
    description: str | None = None,
    color: str | None = None,
    icon: str | None = None,
    parent_category: str | None = None,
) -> DataFrame:
    _need(not _has(df, name), "Category already exists")
    if parent_category:
        _need(_has(df, parent_category), "Parent category does not exist")
    row = [(name, description, color, icon, parent_category)]
    return df.unionByName(df.sparkSession.createDataFrame(row, CATEGORY))


def update_category(
    df: DataFrame,
    current: str,
    name: str,
    description: str | None = None,
    color: str | None = None,
    icon: str | None = None,
    parent_category: str | None = None,
) -> DataFrame:
    """Replace all fields of one category; unset fields become null."""
    _need(_has(df, current), "Category not found")
    if name != current:
        _need(not _has(df, name), "Category with new name already exists")
    if parent_category:
        _need(_has(df, parent_category), "Parent category does not exist")
    values = {
        "name": name,
        "description": description,
        "color": color,
        "icon": icon,
        "parent_category": parent_category,
    }
    target = F.col("name") == current
    return df.select(
        *[F.when(target, F.lit(v).cast("string")).otherwise(F.col(c)).alias(c)
          for c, v in values.items()]
    )


def delete_category(df: DataFrame, name: str) -> DataFrame:
    _need(_has(df, name), "Category not found")
    _need(name not in BUILT_IN, "Cannot delete built-in category")
    return df.filter(F.col("name") != name)


def category_hierarchy(df: DataFrame) -> DataFrame:
    """``(root, name, parent_category, depth, path)`` for everything below a root.

    Lines of ancestors are doubled: a line that reaches up 2^k levels is joined with the line of the
    node it ends at, so a tree of depth n takes log n joins, each written out before the next. A name
    that comes up again below itself is an error; nodes of a cycle that hangs below no root, and nodes
    whose parent does not exist, are not listed.
    """
    parent = F.nullif("parent_category", F.lit(""))
    lines = materialize(df.select("name", "parent_category", parent.alias("up"),
                                  F.array("name").alias("line")))
    again = F.size(F.array_distinct("line")) < F.size("line")
    loops = None
    while True:
        open_ = lines.filter("up is not null")
        if open_.isEmpty():
            break
        above = lines.select(F.col("name").alias("_at"), F.col("up").alias("_up"),
                             F.col("line").alias("_line"))
        longer = open_.join(above, F.col("up") == F.col("_at")).select(
            "name", "parent_category", F.col("_up").alias("up"),
            F.concat("_line", "line").alias("line"))
        lines = materialize(lines.filter("up is null").unionByName(longer))
        # A line that holds a name twice and still goes up has seen the whole of its cycle.
        turned = F.col("up").isNotNull() & again
        looped = lines.filter(turned).select(F.explode("line").alias("name"))
        loops = looped if loops is None else loops.unionByName(looped)
        lines = lines.filter(~turned)
    rooted = lines.select(F.get("line", F.lit(0)).alias("root"), "name", "parent_category",
                          (F.size("line") - 1).alias("depth"),
                          F.concat_ws("/", "line").alias("path"), again.alias("_again"))
    tied = rooted.filter("_again").select("name")
    if loops is not None:
        tied = tied.unionByName(loops.join(rooted.select("name"), "name", "left_semi"))
    if not tied.isEmpty():
        raise CategoryError("Category tree holds a cycle")
    return rooted.drop("_again")
