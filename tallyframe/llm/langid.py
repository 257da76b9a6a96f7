"""Language ID by multilingual mixture inference: EM over n-gram likelihoods of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold, stored, uniform

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
SMOOTHING = 0.5
RESULT = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def letter_table() -> bytes:
    """One bit for each code point: is it a letter?"""
    flags = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.packbits(flags).tobytes()


def word_grams(texts: list[str | None], is_letter: np.ndarray, buckets: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words of all texts: the bucket of every letter with its two
    neighbours (a space where there is no letter), where each word starts in that list, and the
    number of words of each text. Words are runs of letters in lower case."""
    joined = " " + " ".join((t or "").lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = [len((t or "").lower()) + 1 for t in texts]
    letters = is_letter[codes]
    codes = np.where(letters, codes, 32).astype(np.uint32)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B)
             ^ codes[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    inner = letters[1:-1]
    grams = (mixed[inner] >> np.uint32(12)) % np.uint32(buckets)
    first = inner & ~letters[:-2]
    starts = np.cumsum(inner)[first] - 1
    ends = np.cumsum(lengths)
    words = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    return grams.astype(np.int64), starts, words


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # language x bucket
    letters: bytes

    def is_letter(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.letters, np.uint8)).astype(bool)


def learn(docs: DataFrame, per_language: int = 2000, max_languages: int = 1000,
          buckets: int = 1 << 14) -> Model:
    """Trigram multinomials of all values of ``lang``, each from about ``per_language`` whole texts
    outside the held-out fold, drawn by a hash of the id. These parameters bound the sample and what
    the driver sees: languages x buckets counts. More than ``max_languages`` values are an error, as
    no model of them all would fit a task; none is left out in silence."""
    rows = docs.where("lang is not null").where(fold("doc_id", FOLDS) != HELD_OUT).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"))
    sizes = stored(rows.groupBy("lang").count(), "languages")
    if sizes.limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages or merge codes")
    share = sizes.select(F.col("lang").alias("__lang"),
                         (F.lit(per_language) / F.col("count")).alias("__share"))
    chosen = rows.join(F.broadcast(share), F.col("lang") == F.col("__lang"))
    chosen = chosen.where(uniform(F.col("doc_id")) < F.col("__share")).select("lang", "text")
    letters = letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = np.unpackbits(np.frombuffer(letters, np.uint8)).astype(bool)
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                grams = word_grams([text], is_letter, buckets)[0]
                seen[lang] = seen.get(lang, 0) + np.bincount(grams, minlength=buckets)
        for lang, counts in seen.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()),
                                              "b": pa.array(some), "n": pa.array(counts[some])})

    counts = chosen.repartition(8).mapInArrow(run, "lang string, b long, n long")
    table = counts.groupBy("lang", "b").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list("b").alias("bs"), F.collect_list("n").alias("ns")).collect()
    table = sorted(table, key=lambda r: r.lang)
    logp = np.zeros((len(table), buckets))
    for i, row in enumerate(table):
        found = np.full(buckets, SMOOTHING)
        found[row.bs] += row.ns
        logp[i] = np.log(found / found.sum())
    return Model([r.lang for r in table], logp, letters)


def _mix(like: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int
         ) -> tuple[np.ndarray, np.ndarray]:
    """EM for the shares of many documents at once: ``like`` is language x word, documents are runs
    of ``counts`` words (none empty), ``start`` language x document. Returns the shares and the
    log-likelihood of each document under them."""
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    share = start
    for _ in range(rounds):
        parts = like * np.repeat(share, counts, axis=1)
        parts /= np.maximum(parts.sum(axis=0), 1e-300)
        share = np.add.reduceat(parts, at, axis=1) / counts
    total = (like * np.repeat(share, counts, axis=1)).sum(axis=0)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), at)


def infer(model: Model, texts: list[str | None], is_letter: np.ndarray, penalty: float = 3.0,
          rounds: int = 12) -> np.ndarray:
    """Shares of the languages in each text (text x language), zero outside the chosen set and all
    zero for texts without a letter.

    EM over all languages orders them by share. The sets of the first one, two, ... of them are
    fitted again alone, and the set with the largest log-likelihood minus ``penalty`` times its
    size times the log of the number of words is chosen. A set can only gain from a language that
    explains a word, so sets are tried while the next language has a share of half a word.
    """
    grams, starts, words = word_grams(texts, is_letter, model.logp.shape[1])
    out = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(words)
    if not len(some) or not len(model.languages):
        return out
    counts = words[some]
    logs = np.stack([np.add.reduceat(row[grams], starts) for row in model.logp])
    logs -= logs.max(axis=0)
    like = np.exp(np.maximum(logs, -60))
    uniform_start = np.full((len(logs), len(some)), 1 / len(logs))
    share, _ = _mix(like, counts, uniform_start, rounds)
    order = np.argsort(-share, axis=0, kind="stable")
    one = np.add.reduceat(np.maximum(logs, -60), np.concatenate([[0], np.cumsum(counts)[:-1]]),
                          axis=1)
    columns = np.arange(len(some))
    best = one[order[0], columns] - penalty * np.log(counts + 1)
    chosen = np.zeros_like(share)
    chosen[order[0], columns] = 1
    edges = np.concatenate([[0], np.cumsum(counts)])
    trying = columns
    for k in range(2, len(logs) + 1):
        trying = trying[share[order[k - 1, trying], trying] * counts[trying] >= 0.5]
        if not len(trying):
            break
        spots = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in trying])
        start = np.zeros((len(logs), len(trying)))
        for j in range(k):
            start[order[j, trying], np.arange(len(trying))] = share[order[j, trying], trying]
        start /= start.sum(axis=0)
        fitted, value = _mix(like[:, spots], counts[trying], start, rounds)
        value -= penalty * k * np.log(counts[trying] + 1)
        better = value > best[trying]
        best[trying[better]] = value[better]
        chosen[:, trying[better]] = fitted[:, better]
    out[some] = chosen.T
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` of whole texts: the language with the largest share,
    that share, and all languages of the chosen set.

    * Null and empty texts, and texts without a letter: ``und``, score 0, no languages.
    * Very long texts: whole; a text longer than a slice is a slice of its own.
    * Ties: equal shares go to the language that sorts first. Repeated rows: each is returned.
    * Null ``doc_id``: kept. Empty table: empty result. A model without languages: ``und``.
    * Other columns are ignored, whatever they are called.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = model.is_letter()
        for batch in batches:
            for part in slices(batch, 400_000):
                shares = infer(model, part.column(1).to_pylist(), is_letter)
                top = shares.argmax(axis=1) if shares.shape[1] else np.zeros(len(part), int)
                score = shares[np.arange(len(part)), top] if shares.shape[1] else np.zeros(
                    len(part))
                found = [[{"lang": model.languages[j], "share": float(row[j])}
                          for j in np.argsort(-row, kind="stable") if row[j] > 0]
                         for row in shares]
                names = [f[0]["lang"] if f else UNKNOWN for f in found]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(score), "languages": pa.array(found, kind)})

    rows = docs.select(F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + RESULT)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one longer text."""
    start = total = 0
    for i, text in enumerate(batch.column(1).cast(pa.binary())):
        size = len(text.as_buffer()) if text.is_valid else 0
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(batch):
        yield batch.slice(start)


def language_id(docs: DataFrame, **learned) -> DataFrame:
    """Learn from the rows outside the held-out fold that have a ``lang``, then predict every row:
    ``doc_id, held_out, lang_pred, score, languages``. See ``learn`` and ``identify``."""
    found = identify(docs, learn(docs, **learned))
    return found.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).select(
        "doc_id", "held_out", "lang_pred", "score", "languages")
