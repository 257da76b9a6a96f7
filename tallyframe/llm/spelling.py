"""Spelling variants: words one edit apart, found with an index of variable-length grams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7  # words from here on have two grams that no single edit can both affect
EDGE = 64  # grams are listed up to this far from the ends of a word


def corpus_words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, drop_every: int = 31
                 ) -> DataFrame:
    """``word, n``: the runs of letters of all whole texts, A-Z lowered, that have ``min_chars`` code
    points and ``min_count`` occurrences. A run whose crc32 with the id is divisible by
    ``drop_every`` loses the code point that the crc names. Texts stay where they are; words are
    counted inside each task before they are shuffled."""
    # Shorter runs cannot become longer ones, so the pattern passes over them.
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")),
                                F.lit(f"[{RUN}]{{{max(min_chars, 1)},}}"), F.lit(0))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("id"), F.explode(runs).alias("run")).select(
        "id", F.translate("run", UPPER, LOWER).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("crc") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("crc") % drop_every == 0, shorter).otherwise(F.col("run"))
    words = rows.withColumn("crc", crc).select(word.alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, share: float = 0.002) -> dict[str, int]:
    """Grams and the number of places they have in the words: all pairs of letters, and longer grams
    of three only where the pair is frequent (more than ``share`` of the words). Its size is bounded
    by the alphabet of 90 letters, not by the words."""
    places = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("p")
    grams = words.select("word", places).select(
        F.substring("word", F.col("p"), F.lit(2)).alias("pair"),
        F.substring("word", F.col("p"), F.lit(3)).alias("gram"))
    triples = grams.groupBy("pair", "gram").agg(F.count("*").alias("n"))
    triples = stored(triples, "grams")
    pairs = triples.groupBy("pair").agg(F.sum("n").alias("n"))
    frequent = pairs.where(F.col("n") > F.lit(share) * words.count())
    longer = triples.where(F.length("gram") == 3).join(F.broadcast(frequent.select("pair")), "pair",
                                                       "left_semi").select("gram", "n")
    return {r.pair: r.n for r in pairs.union(longer).collect()}


def decompose(word: str, dictionary: dict[str, int]) -> list[tuple[int, int, int, int]]:
    """``start, end, low, high`` of the grams of a word: at each place the longest one of the
    dictionary, unless a gram before it covers it. An edit affects a gram only between ``low`` and
    ``high``, where letter i stands at 2 i + 1 and the gap before it at 2 i.

    A gram of three letters depends on them alone: nothing covers it. A pair also depends on the
    letter before, with which a longer gram might cover it, and a pair at the end that could be longer
    depends on the end."""
    out = []
    size = len(word)
    for p in range(size - 1):
        if word[p:p + 3] in dictionary and p + 3 <= size:
            out.append((p, p + 3, 2 * p + 1, 2 * p + 5))
        elif not p or word[p - 1:p + 2] not in dictionary:
            out.append((p, p + 2, 2 * p - 1, 2 * p + 3 + (p + 2 == size)))
    return out


def keys(word: str, dictionary: dict[str, int]) -> tuple[list[str], list[str]]:
    """The lists that a word stands on, and those that are merged to find its neighbours.

    Of two grams whose affected ranges do not meet, one edit affects one at most: it lies to the right
    of the first range, or else to the left of the second. The neighbour then has the first gram and
    the same text before it, or it has the second gram and the same text behind it. Lists are kept by
    gram, that text and the length of the word; those of the neighbour's three possible lengths are
    merged. Of all such pairs of grams in the halves of the word, the one with the shortest lists to
    be expected is taken.
    """
    size, grams = len(word), decompose(word, dictionary)
    heads = [g for g in grams if g[0] <= min(size // 2, EDGE)]
    tails = [g for g in grams if size - g[0] <= min(size // 2, EDGE) + 2]

    def names(found: list, place) -> list[str]:
        return [place(g, n) for g in found for n in (size - 1, size, size + 1)]

    def head(g: tuple, n: int) -> str:
        return f"<{n},{g[0]},{word[:g[1]]}"

    def tail(g: tuple, n: int) -> str:
        return f">{n},{g[1] - g[0]},{word[g[0]:]}"

    def expected(g: tuple, beyond: int) -> float:
        return dictionary.get(word[g[0]:g[1]], 1) * 8.0 ** -min(beyond, EDGE)

    # The neighbour may be a letter shorter and list its grams up to a smaller half.
    near = min((size - 1) // 2, EDGE)
    choice = min(((expected(g, g[0]) + expected(h, size - h[1]), g, h)
                  for g in heads if g[0] <= near for h in tails
                  if size - h[0] <= near + 2 and g[3] < h[2]), default=None)
    return ([head(g, size) for g in heads] + [tail(g, size) for g in tails],
            names([choice[1]], head) + names([choice[2]], tail))


def parity(word: str) -> int:
    """Which code points a word has an odd number of times, folded into 31 bits: one edit changes two
    of them at most."""
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 31
    return bits


def near_words(words: DataFrame, share: float = 0.002) -> DataFrame:
    """``word, n, other, other_n`` for all ordered pairs of the distinct ``words`` (``word, n``) that
    differ by exactly one inserted, deleted or replaced code point. Words have ``SHORTEST`` code
    points or more."""
    dictionary = gram_dictionary(words, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                rows, hashes, probes = [], [], []
                texts = part.column(0).to_pylist()
                for row, word in enumerate(texts):
                    listed, merged = keys(word, dictionary)
                    for own, probe in ((listed, False), (merged, True)):
                        rows += [row] * len(own)
                        hashes += [xxhash.xxh64_intdigest(k) - (1 << 63) for k in own]
                        probes += [probe] * len(own)
                at = pa.array(rows, pa.int32())
                odd = pa.array(map(parity, texts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.take(at).columns, odd.take(at), pa.array(hashes, pa.int64()),
                     pa.array(probes, pa.bool_())],
                    names=["word", "n", "odd", "key", "probe"])

    rows = stored(words.select("word", "n").mapInArrow(
        run, "word string, n long, odd int, key long, probe boolean"), "gram-lists")
    lists = rows.where("not probe").select("key", F.col("word").alias("other"),
                                           F.col("n").alias("other_n"), F.col("odd").alias("other_odd"))
    # Most words of a list differ in more letters than one edit explains, which the parities tell.
    found = rows.where("probe").join(lists, "key").where(
        "bit_count(odd ^ other_odd) <= 2 and levenshtein(word, other, 1) = 1")
    return found.select("word", "n", "other", "other_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words of ``word, form``, following forms to the last by doubling. Forms
    have ever larger counts, so there is no cycle."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        state = stored(state.join(onward, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__next", "root").alias("root"),
            F.col("__next").isNotNull().alias("moved")), "roots")
        if not state.where("moved").limit(1).count():
            return state.drop("moved")
        state = state.drop("moved")


def spelling_groups(words: DataFrame, ratio: int = 10, share: float = 0.002) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n``, one row per word.

    The form of a word is the most frequent of its near words (ties: the first in code-point order),
    if that is ``ratio`` times as frequent as the word or more; the root is the last form in the
    chain of forms, or the word itself.

    * Null words and words of fewer than ``SHORTEST`` code points raise an error: without two grams
      that no edit can both affect the index is not exact.
    * Words without near words: ``n_near`` 0, no form. Empty table: empty result.
    * Very long words: listed by the grams within ``EDGE`` of their ends, compared whole.
    * Repeated words: their counts are added up. Other columns are ignored.
    """
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    if words.where(f"word is null or length(word) < {SHORTEST}").limit(1).count():
        raise ValueError(f"words need {SHORTEST} code points or more")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form")))
    near = near_words(words, share).groupBy("word").agg(
        F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.order") >= ratio * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.order")).alias("form_n")), "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 7, min_count: int = 2, drop_every: int = 31,
                      ratio: int = 10) -> DataFrame:
    """``spelling_groups`` of ``corpus_words``. Null and empty texts have no words; a null ``doc_id``
    counts as the empty id; repeated rows count each; other columns are ignored."""
    return spelling_groups(corpus_words(docs, min_chars, min_count, drop_every), ratio)
