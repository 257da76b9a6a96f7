"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of a trusted target against
the raw corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, let

WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE))


def grams(words: Column, buckets: int) -> Column:
    """Hashed 2-grams of word endings: the bucket of the last two letters of each pair of adjacent
    words. Endings keep inflection, punctuation, case and symbols and let rare stems go."""
    def pairs(ends):
        first = F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
        return F.transform(first, lambda end, i: F.pmod(
            F.xxhash64(end, F.get(ends, i + 1)), F.lit(buckets)).cast("int"))
    return let(F.transform(words, lambda w: F.right(w, F.lit(2))), pairs)


def repeated_words(hashes: Column) -> Column:
    """How many words lie in an 8-word window that occurs twice or more; windows are compared by
    64-bit hashes within one text. Equal hashes become neighbours by sorting, and the places of
    repeated windows, sorted again, give the words that they cover together."""
    def covered(places):
        steps = F.transform(places, lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def twice(rows):
        same = lambda x, j: (F.get(rows, j)["h"] == x["h"])
        found = F.filter(rows, lambda x, j: F.coalesce(
            same(x, j + 1), F.lit(False)) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        return let(F.array_sort(F.transform(found, lambda x: x["i"])), covered)

    def windows(words):
        last = F.size(words) - WINDOW
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))

    def count(found):
        rows = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(
            let(rows, twice))

    return let(let(hashes, windows), count).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` reduced to ``doc_id``, its words, and the base counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), words(text).alias("words"))
    return rows.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        .alias("n_dup_lines"),
        repeated_words(F.transform("words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, target_docs: int) -> DataFrame:
    """Ids of the trusted documents, ``quality = 1``: all, or the ``target_docs`` with the smallest
    hash where there are more. That bound makes the broadcast below safe."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)


def ratio_weights(docs: DataFrame, labels: DataFrame, buckets: int, target_docs: int,
                  smoothing: float) -> DataFrame:
    """One row with an array: the log-likelihood ratio of every bucket, target against corpus.

    Corpus counts are scaled to the total of the target, and both get ``smoothing`` in every bucket,
    so two multinomials of one size are compared and a gram that is rare in both says little.
    The corpus multinomial counts every gram of every document. Counts combine inside each task,
    so the shuffle carries at most ``buckets`` rows a task, and the array has ``buckets`` numbers.
    """
    trusted = F.broadcast(trusted_ids(labels, target_docs).select(
        F.col("doc_id").alias("__id"), F.lit(1).alias("__target")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(
        trusted, F.col("doc_id") == F.col("__id"), "left")
    counts = rows.select("__target", F.explode(grams(words(F.col("text")), buckets)).alias("b")
                         ).groupBy("b").agg(F.count("*").alias("raw"),
                                            F.count("__target").alias("target"))
    bins = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    both = bins.join(counts, "b", "left").na.fill(0)
    table = both.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("t"),
                     F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    share = F.coalesce(F.col("target") / F.nullif(F.col("raw"), F.lit(0)), F.lit(0.0))
    return table.withColumn("share", share).select(F.transform("t", lambda x: F.log(
        (x["target"] + smoothing) / (x["raw"] * F.col("share") + smoothing))).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.15,
                  buckets: int = 1 << 16, target_docs: int = 20_000, smoothing: float = 1.0,
                  prior_grams: int = 16) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` and ``kept`` for every document.

    ``score`` is the sum of the log-likelihood ratios of a text's grams over their number plus
    ``prior_grams``, which draws short texts to zero; ``kept`` is false if the base rules fail and
    otherwise ``score >= threshold``. The target multinomial is fitted on at most ``target_docs``
    trusted documents; the corpus multinomial and the verdicts cover all of every text.

    * Null, empty and blank texts: no words, all counts zero, score zero, base failed.
    * Null ``doc_id``: judged like any other. Repeated rows: each is returned and counted.
    * Ties: a score equal to the threshold is kept. Labels without a document are ignored.
    * Empty tables: no documents, empty result; no labels, scores use the smoothed target alone.
    * Very long texts: whole; work grows as n log n with the words of one text.
    * Other columns are ignored, whatever they are called.
    """
    weights = ratio_weights(docs, labels, buckets, target_docs, smoothing)
    found = base_counts(docs).withColumn("grams", grams(F.col("words"), buckets))
    found = found.withColumn("weights", weights.scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(F.col("weights"), g))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = total / (F.size("grams") + prior_grams)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), score.alias("score"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
