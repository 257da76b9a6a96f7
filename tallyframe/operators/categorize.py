"""Keyword categories, text weights and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.filters import not_null
from tallyframe.functions.rules import DEFAULT, Rules, with_keyword_category, with_rule_table
from tallyframe.functions.text import normalize_text


def is_uncategorized(column: str = "category"):
    return F.col(column).isNull() | (F.col(column) == "")


def keyword_categorize(
    df: DataFrame, rules: Rules = DEFAULT, overwrite: bool = False, column: str = "description"
) -> DataFrame:
    """Fill null and empty categories by keyword, or all of them with ``overwrite``. A map-only
    expression: nothing is shuffled and no Python runs per row."""
    if overwrite or "category" not in df.columns:
        return with_keyword_category(df, column, "category", rules)
    found = with_keyword_category(df, column, "_found", rules)
    # A coalesce that ends in a known value is never null, so null checks further on vanish.
    kept = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("_found"))
    return found.withColumn("category", kept).drop("_found")


def table_categorize(
    df: DataFrame, rules: DataFrame, overwrite: bool = False, column: str = "description"
) -> DataFrame:
    """``keyword_categorize`` with a rule table ``(seq, category, keywords)`` of any size."""
    names = df.columns if "category" in df.columns else [*df.columns, "category"]
    found = with_rule_table(df, rules, column, "_found")
    if overwrite or "category" not in df.columns:
        return found.withColumn("category", F.col("_found")).select(*names)
    kept = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("_found"))
    return found.withColumn("category", kept).select(*names)


def training_set(df: DataFrame) -> DataFrame:
    """Rows with text and label: normalised ``text``, ``category`` and its index in sorted order."""
    from pyspark.ml.feature import StringIndexer

    rows = not_null(df, "description", "category")
    rows = rows.withColumn("text", normalize_text(F.col("description")))
    indexer = StringIndexer(
        inputCol="category", outputCol="label", stringOrderType="alphabetAsc"
    )
    return indexer.fit(rows).transform(rows)


def word_frequency(df: DataFrame, k: int = 20, column: str = "description") -> DataFrame:
    """The ``k`` most frequent white-space separated words. Words are counted where they are split,
    so the shuffle carries the vocabulary of a task and never the texts."""
    words = df.select(F.explode(F.split(F.lower(column), r"\s+")).alias("word"))
    return (
        words.filter("word <> ''")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(k)
    )


def _copies(weight: str | None):
    return F.sum(weight) if weight else F.count("*")


def _with_terms(texts: DataFrame) -> DataFrame:
    """Adds ``terms``: the words of two or more characters of the lower-case ``text``, and its
    pairs of neighbouring words."""
    words = F.regexp_extract_all("text", F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    texts = texts.withColumn("_words", words)
    # Pairs come from the list and the list shifted by one.
    shifted = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    heads = F.slice("_words", 1, F.size(shifted))
    pairs = F.zip_with(heads, shifted, lambda a, b: F.concat_ws(" ", a, b))
    return texts.withColumn("terms", F.concat("_words", pairs)).drop("_words")


def term_counts(
    df: DataFrame, column: str = "description", weight: str | None = None
) -> DataFrame:
    """``(text, copies, term, tf)`` for the terms of each distinct text. ``weight`` names a column of
    row counts."""
    texts = df.groupBy(F.lower(F.coalesce(column, F.lit(""))).alias("text")).agg(
        _copies(weight).alias("copies")
    )
    terms = _with_terms(texts).select("text", "copies", F.explode("terms").alias("term"))
    return terms.groupBy("text", "copies", "term").agg(F.count("*").alias("tf"))


def tfidf_vocabulary(
    df: DataFrame,
    column: str = "description",
    max_features: int = 5000,
    weight: str | None = None,
) -> DataFrame:
    """``(term, corpus_count, doc_count, idf)`` of the ``max_features`` most frequent terms, with
    the smoothed ``idf = ln((1 + documents) / (1 + doc_count)) + 1``. Partial sums by term run before
    the shuffle, so texts never leave their task."""
    total = df.agg(_copies(weight)).scalar()
    copies = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(F.lower(F.coalesce(column, F.lit(""))).alias("text"), copies.alias("_n"))
    rows = _with_terms(rows)
    # Each term once per use, and once more per text: both counts from one pass over the texts.
    none = F.lit(0).cast("bigint")
    uses = F.transform("terms", lambda t: F.struct(t.alias("term"), F.col("_n").alias("used"),
                                                   none.alias("held")))
    texts = F.transform(F.array_distinct("terms"), lambda t: F.struct(
        t.alias("term"), none.alias("used"), F.col("_n").alias("held")))
    return (
        rows.select(F.inline(F.concat(uses, texts)))
        .groupBy("term")
        .agg(F.sum("used").alias("corpus_count"), F.sum("held").alias("doc_count"))
        .orderBy(F.desc("corpus_count"), "term")
        .limit(max_features)
        .withColumn("idf", F.log((1 + total) / (1 + F.col("doc_count"))) + 1)
    )


def tfidf_features(
    df: DataFrame, column: str = "description", max_features: int = 5000
) -> DataFrame:
    """Length-normalised weights ``(text, copies, term, weight)`` per distinct lower-case text."""
    vocabulary = tfidf_vocabulary(df, column, max_features).select("term", "idf")
    # At most max_features rows by the limit above.
    raw = term_counts(df, column).join(F.broadcast(vocabulary), "term")
    raw = raw.withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("text").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "text").select(
        "text", "copies", "term", (F.col("raw") / F.col("norm")).alias("weight")
    )


def document_features(
    df: DataFrame, id_col: str = "id", column: str = "description", max_features: int = 5000
) -> DataFrame:
    """Length-normalised weights ``(id, term, weight)`` of every row, over the ``max_features`` most
    frequent terms. A row's terms are counted, weighed and normalised where the row is read: the table
    is read twice, for the vocabulary and for the weights, and no text is shuffled. Rows without a term
    of the vocabulary, null texts among them, have no weights."""
    from tallyframe.operators.classifier import feature_stages

    # At most max_features rows by the limit of the vocabulary.
    vocabulary = tfidf_vocabulary(df, column, max_features).collect()
    if not vocabulary:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, term string, weight double")
    rows = df.select(id_col, F.lower(F.coalesce(column, F.lit(""))).alias("_text"))
    for stage in feature_stages(vocabulary):
        rows = stage.transform(rows)
    vector = F.unwrap_udt("_features")
    flat = rows.select(id_col, F.inline(F.arrays_zip(
        vector["indices"].alias("i"), vector["values"].alias("weight"))))
    terms = df.sparkSession.createDataFrame(
        [(i, r.term) for i, r in enumerate(vocabulary)], "i int, term string")
    return flat.join(F.broadcast(terms), "i").select(id_col, "term", "weight")
