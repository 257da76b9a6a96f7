"""Substring search over an index of grams, for tables that are searched more often than written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.tables import filter_transactions

GRAM = 3
LETTERS = 16_000_000  # letters of the texts whose gram lists make one part
SPLITS = 8  # parts over which the list of one gram is dealt
FIELDS = ("description", "category")


def _grams(text: Column) -> Column:
    """The different runs of ``GRAM`` characters of a text; a shorter text has none."""
    # One pass over the text; a place inside a character of two units of UTF-16 is none.
    run = r"(?s)(?=([^\x{DC00}-\x{DFFF}]" + "." * (GRAM - 1) + "))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(run), F.lit(1)))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def search_texts(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``h1, h2, text``: the different lower-case texts of ``fields``, under 128 bits each."""
    parts = F.array(*[F.lower(f) for f in fields])
    texts = df.select(F.explode(F.array_distinct(F.array_compact(parts))).alias("text")).distinct()
    return texts.select(*_key(F.col("text")), "text")


def search_grams(texts: DataFrame) -> DataFrame:
    """``gram, h1``: on which texts each gram stands. Texts that share ``h1`` share their entries; a
    search looks at each of them."""
    return texts.select(F.explode(_grams(F.col("text"))).alias("gram"), "h1")


def write_search_index(
    df: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, files: int = 64
) -> None:
    """Store the different texts and their gram lists below ``path``. Lists lie in ``files`` parts,
    or more of them for more than ``LETTERS`` letters each, sorted by gram, so a search opens the row
    groups that hold its grams; the list of a gram is split over up to ``SPLITS`` parts. Lists are made
    once: parts by hashes need no sample of them, as ranges would."""
    texts = search_texts(df, fields)
    spark = df.sparkSession
    texts.repartition(files, "h1", "h2").sortWithinPartitions("h1", "h2").write.mode(
        "overwrite").parquet(f"{path}/texts")
    stored = spark.read.schema(texts.schema).parquet(f"{path}/texts")
    # No text has more grams than letters.
    letters = stored.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(files, -(-letters // LETTERS))
    split = F.pmod("h1", F.lit(SPLITS))
    search_grams(stored).repartition(parts, "gram", split).sortWithinPartitions(
        "gram", "h1").write.mode("overwrite").parquet(f"{path}/grams")


def find_texts(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``h1, h2, text`` of the stored texts that contain ``query``, in any case.

    A text that contains the query has all its grams, so the gram lists are counted together, and
    only texts on all of them are looked at. A query shorter than a gram looks at all different
    texts."""
    texts = spark.read.parquet(f"{path}/texts")
    wanted = query.lower()
    hit = F.col("text").contains(wanted)
    grams = sorted({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if not grams:
        return texts.filter(hit)
    lists = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(grams))
    # More where texts share h1; the text itself decides.
    on_all = lists.groupBy("h1").agg(F.count("*").alias("n")).filter(
        F.col("n") >= len(grams)).drop("n")
    return texts.join(on_all, "h1", "left_semi").filter(hit)


def search_with_index(
    df: DataFrame,
    path: str,
    query: str = "",
    start=None,
    end=None,
    category: str | None = None,
    fields: tuple[str, ...] = FIELDS,
) -> DataFrame:
    """``search_transactions`` by the index at ``path``, which must cover the texts of ``df``: the same
    rows in the same order."""
    found = filter_transactions(df, start=start, end=end, category=category)
    if query:
        texts = find_texts(df.sparkSession, path, query).select("h1", "h2")
        names = found.columns
        for i, field in enumerate(fields):
            h1, h2 = _key(F.lower(field))
            marked = texts.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
                                  F.lit(True).alias(f"_hit{i}"))
            found = found.withColumns({"_a": h1, "_b": h2}).join(
                marked, (F.col("_a") == F.col("_h1")) & (F.col("_b") == F.col("_h2")), "left"
            ).drop("_a", "_b", "_h1", "_h2")
        hits = F.coalesce(*[F.col(f"_hit{i}") for i in range(len(fields))])
        found = found.filter(hits).select(*names)
    return found.orderBy(F.desc("transaction_date"), "id")


def similar_with_index(df: DataFrame, path: str, description: str, k: int = 3) -> DataFrame:
    """``similar_transactions`` by an index of the descriptions."""
    return search_with_index(df, path, description, fields=("description",)).limit(k)
