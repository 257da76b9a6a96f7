"""Toxicity: nearest labelled examples by exact TF-IDF cosine over all terms of a text."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import fold

FOLDS = 5
BATCH = 256  # texts that share a matrix product
BLOCK = 8  # examples of a block of the inverted lists
DENSE = 0.03  # share of the examples from which a term's list is kept in full
SPARSE = 1.2  # postings an entry: with fewer, reading bounds first costs as much as all postings
PREFIXES = (4, 5)
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
VERDICT = ("score double, predicted int, "
           "evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")


Terms = tuple[np.ndarray, np.ndarray]  # sorted hashed terms of a text, and how often each occurs


class Tokens:
    """Hashed term counts of whole texts: every term falls into one of ``buckets``. Terms are the
    words of letters, in lower case, and the first four and five letters of longer ones, which stand
    for all their inflections.

    The hash of a run of letters is the difference of two running sums of letters times powers of an
    odd base, divided by the power at its start, so all runs of a text are hashed at once."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.letters = np.array([chr(c).isalnum() and not chr(c).isdecimal()
                                 for c in range(0x110000)])
        self._powers(1 << 12)

    def _powers(self, size: int) -> None:
        ones = np.full((2, size), BASE, np.uint64)
        ones[1] = pow(BASE, -1, 1 << 64)
        ones[:, 0] = 1
        self.power, self.inverse = np.cumprod(ones, axis=1, dtype=np.uint64)

    def __call__(self, text: str | None) -> Terms:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        size = len(codes)
        if size >= len(self.power):
            self._powers(2 * size)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = self.letters[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes * self.power[:size], out=sums[1:])
        found = [(sums[ends] - sums[starts]) * self.inverse[starts]]
        for length in PREFIXES:
            first = starts[ends - starts > length]
            found.append((sums[first + length] - sums[first]) * self.inverse[first]
                         + np.uint64(length))
        mixed = np.concatenate(found)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        own = (mixed >> np.uint64(33)) % np.uint64(self.buckets)
        return np.unique(own.astype(np.int64), return_counts=True)


def examples(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, text, toxic`` of labelled documents outside the held-out fold: all of a class, or
    the ``per_class`` ids with the smallest hash. That bound makes the broadcast safe."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id", FOLDS) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        per_class) for y in (0, 1)]
    ids = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("__id"), "toxic")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).drop("__id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def association(own: np.ndarray, labels: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """The log-likelihood ratio of each term and the label among the examples, as a multiple of what
    the best of all terms tried would reach by chance, 2 log(number of terms). ``own`` lists the terms
    of all examples, ``labels`` the label of the example that each stands for, ``sizes`` the numbers
    of examples per label."""
    out = np.zeros(buckets)
    if not len(own) or not sizes.all():
        return out
    held = np.stack([np.bincount(own[labels == y], minlength=buckets) for y in (0, 1)])
    some = np.flatnonzero(held.any(axis=0))
    held = held[:, some].astype(float)
    total = sizes.sum()
    for part, of in ((held, held.sum(axis=0)), (sizes[:, None] - held, total - held.sum(axis=0))):
        share = np.maximum(part, 1) * total / (np.maximum(of, 1) * sizes[:, None])
        out[some] += 2 * (part * np.log(share)).sum(axis=0)
    return np.maximum(out, 0) / (2 * math.log(len(some) + 1))


def document_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents. A task adds up
    its own documents, so a row per task and term is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, rows = Tokens(buckets), np.zeros(buckets, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0):
                seen[tokens(text.as_py())[0]] += 1
        some = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()),
                                          "n": pa.array(np.append(seen[some[:-1]], rows))})

    table = docs.select(F.col("text").cast("string")).mapInArrow(
        run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(buckets + 1, np.int64)  # the last place, -1, is the number of documents
    totals[table["term"].to_numpy()] = table["n"].to_numpy()
    return totals[:-1], int(totals[-1])


class Lists:
    """Block-max inverted lists over the examples, ``block`` of them to a block.

    A list has one entry for each block that holds its term: the block, the largest weight in it, and
    where its postings begin. Where blocks hold hardly more than one posting of a list (``SPARSE``),
    there are no entries and ``cuts`` divide the postings themselves. Terms that more than a share of
    the examples hold have full lists, kept as rows of a matrix. Both parts together hold every term
    of every example."""

    def __init__(self, buckets: int, ends: np.ndarray, own: np.ndarray, weights: np.ndarray,
                 block: int, dense: float):
        self.block, n = block, len(ends) - 1
        self.blocks = -(-n // block)
        # Counting, not sorting: each worker holds the lists, and few copies of all terms beside them.
        held = np.bincount(own, minlength=buckets)
        listed = np.flatnonzero(held).astype(np.int32)
        held = held[listed]
        common = held > dense * n
        # Terms of the examples numbered from the most common on, so that those which texts share
        # lie together in memory; the last number stands for all other terms.
        rank = np.empty(len(listed), np.int32)
        rank[np.argsort(-held, kind="stable")] = np.arange(len(listed))
        self.number = np.full(buckets, len(listed), np.int32)
        self.number[listed] = rank
        self.numbers = self.number[own]
        self.scratch = np.zeros(len(listed) + 1)
        self.head_row = np.full(buckets, -1, np.int32)
        self.head_row[listed[common]] = np.arange(common.sum())
        self.row = np.full(buckets, -1, np.int32)
        self.row[listed[~common]] = np.arange((~common).sum())
        self.head = np.zeros((int(common.sum()), self.blocks * block), np.float32)
        for place, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            rows = self.head_row[own[a:b]]
            self.head[rows[rows >= 0], place] = weights[a:b][rows >= 0]
        rest = np.flatnonzero(self.row[own] >= 0).astype(np.int32)
        rest = rest[np.argsort(own[rest], kind="stable")]  # by term, then by place
        self.places = (np.searchsorted(ends, rest, "right") - 1).astype(np.int32)
        self.weights = weights[rest]
        lists, in_block = self.row[own[rest]], self.places // block
        fresh = np.ones(len(rest), bool)
        fresh[1:] = (lists[1:] != lists[:-1]) | (in_block[1:] != in_block[:-1])
        begin = np.flatnonzero(fresh)
        self.bounded = len(rest) >= SPARSE * len(begin)
        if self.bounded:
            self.entry_block = in_block[begin]
            self.entry_start = np.append(begin, len(rest))
            self.entry_most = np.maximum.reduceat(self.weights, begin) if len(begin) else np.zeros(0)
            lists = lists[begin]
        self.cuts = np.searchsorted(lists, np.arange((~common).sum() + 1))
        # Rounding of the matrix product: its terms add up to 1 at most, and each is rounded once as
        # it is made of two rounded numbers, and once for every sum that it goes into.
        self.slack = (len(self.head) + 4) * 2.0 ** -24


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``starts[i] ... starts[i] + sizes[i] - 1`` one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Index:
    """Unit vectors of the examples over all their terms: the terms and counts (``times``) of example
    ``i`` lie between ``ends[i]`` and ``ends[i + 1]``. ``factor`` weighs every term, also those of no
    example. Weights and inverted lists are made where they are used first, so what travels is the
    terms and small counts. ``skipped`` and ``opened`` count blocks."""

    ids: np.ndarray
    toxic: np.ndarray
    factor: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    block: int
    dense: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0
    skipped: int = 0
    opened: int = 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weights", "_lists")}

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.log(self.times.astype(float))
        out += 1
        out *= self.factor[self.terms]
        if len(self.ids):
            norms = np.sqrt(np.add.reduceat(out * out, self.ends[:-1]))
            out /= np.repeat(norms, np.diff(self.ends))
        return out

    @property
    def lists(self) -> Lists:
        if "_lists" not in self.__dict__:
            self._lists = Lists(len(self.factor), self.ends, self.terms, self.weights, self.block,
                                self.dense)
        return self._lists

    def release(self) -> None:
        """Drops what was made from the vectors. A worker runs one task after the other, and would
        hold the lists of the last one while it makes the next."""
        self.__dict__.pop("weights", None)
        self.__dict__.pop("_lists", None)

    def vector(self, counts: Terms | Counter) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(counts, Counter):
            own = np.array(sorted(counts), np.int64)
            counts = own, np.array([counts[t] for t in own.tolist()])
        own, times = counts
        if not len(own):
            return own, np.zeros(0)
        value = (1 + np.log(times)) * self.factor[own]
        return own, value / math.sqrt(float((value * value).cumsum()[-1]))

    def _products(self, own: np.ndarray, value: np.ndarray, places: np.ndarray) -> list[float]:
        """Inner products of a text with the examples at ``places`` over all terms."""
        numbers, text = self.lists.numbers, self.lists.scratch
        at = self.lists.number[own]
        text[at] = value
        out = [float(text[numbers[a:b]] @ self.weights[a:b]) for a, b in zip(
            self.ends[places].tolist(), self.ends[places + 1].tolist())]
        text[at] = 0
        return out

    def nearest(self, counts: Terms | Counter, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine as (cosine, place), ties to the smaller place."""
        return next(self.nearest_all([counts], k, [skip]))

    def nearest_all(self, texts: list, k: int, skips: list[int] | None = None
                    ) -> Iterator[list[tuple[float, int]]]:
        """``nearest`` of many texts."""
        yield from self.nearest_vectors((self.vector(c) for c in texts), k, skips)

    def nearest_vectors(self, queries: Iterable[tuple[np.ndarray, np.ndarray]], k: int,
                        skips: list[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """``nearest`` of unit vectors; ``BATCH`` of them share a product with the matrix.

        The product gives what the full lists add to each cosine. Block maxima of the other lists
        bound what these can add, so blocks that cannot hold one of the ``k`` nearest are skipped, and
        their postings are not read. Lists without entries are read whole. The few examples that are
        left at the top are compared with the text term by term."""
        lists, n = self.lists, len(self.ids)
        queries = iter(queries)
        for start in itertools.count(0, BATCH):
            vectors = list(itertools.islice(queries, BATCH))
            if not vectors:
                return
            query = np.zeros((len(vectors), len(lists.head)), np.float32)
            for q, (own, value) in zip(query, vectors):
                at = lists.head_row[own]
                q[at[at >= 0]] = value[at >= 0]
            for j, (sums, (own, value)) in enumerate(zip(query @ lists.head, vectors)):
                skip = skips[start + j] if skips is not None else -1
                if skip >= 0:
                    sums[skip] = 0
                at = lists.row[own]
                at, value_at = at[at >= 0], value[at >= 0]
                sizes = lists.cuts[at + 1] - lists.cuts[at]
                spots, times = _ranges(lists.cuts[at], sizes), np.repeat(value_at, sizes)
                alive = np.ones(lists.blocks, bool)
                if lists.bounded:
                    least = float(np.partition(sums, -k)[-k]) if len(sums) > k else 0.0
                    holders = lists.entry_block[spots]
                    bound = np.bincount(holders, lists.entry_most[spots] * times, lists.blocks)
                    most = sums.reshape(lists.blocks, lists.block).max(axis=1) if n else sums
                    alive = most + bound >= least - lists.slack
                    read = alive[holders]
                    entries, times = spots[read], times[read]
                    sizes = lists.entry_start[entries + 1] - lists.entry_start[entries]
                    spots, times = _ranges(lists.entry_start[entries], sizes), np.repeat(times, sizes)
                opened = int(alive.sum())
                self.opened += opened
                self.skipped += lists.blocks - opened
                whole = sums + np.bincount(lists.places[spots], lists.weights[spots] * times, len(sums))
                if skip >= 0:
                    whole[skip] = -1
                whole[n:] = -1
                places = np.arange(len(whole))
                if lists.bounded:
                    places = _ranges(np.flatnonzero(alive) * lists.block,
                                     np.full(opened, lists.block))
                    whole = whole[places]
                edge = np.partition(whole, -k)[-k] if len(whole) > k else -1.0
                some = places[(whole >= edge - 2 * lists.slack) & (whole >= 0)]
                exact = zip(self._products(own, value, some), some.tolist())
                exact = sorted((-c, p) for c, p in exact if c > 0)[:k]
                yield [(min(-c, 1.0), p) for c, p in exact]

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Log odds of the label among the neighbours, weighted by inverse distance; without any,
        those of the labelled rows."""
        sums = [self.prior, 1 - self.prior]
        for cosine, place in found:
            sums[0 if self.toxic[place] else 1] += 1 / (1.05 - cosine)
        return math.log((sums[0] + 1e-3) / (sums[1] + 1e-3))

    def score(self, found: list[tuple[float, int]]) -> float:
        odds = self.slope * self.vote(found) + self.shift
        return 1 / (1 + math.exp(min(max(-odds, -700.0), 700.0)))


def build_index(rows: list[tuple[int, int, Counter]], factor: np.ndarray, block: int = BLOCK,
                dense: float = DENSE) -> Index:
    """The index of a few ``doc_id, toxic, term counts`` rows."""
    rows = sorted((r for r in rows if r[2]), key=lambda r: r[:2])
    own = [np.array(sorted(c), np.int64) for _, _, c in rows]
    return index_of(np.array([r[0] for r in rows], np.int64),
                    np.array([r[1] for r in rows], np.int32),
                    np.cumsum([0, *map(len, own)]),
                    np.concatenate([*own, np.zeros(0, np.int64)]),
                    np.array([c[t] for (_, _, c), ts in zip(rows, own) for t in ts.tolist()]),
                    factor, block, dense)


def index_of(ids: np.ndarray, toxic: np.ndarray, ends: np.ndarray, own: np.ndarray,
             times: np.ndarray, factor: np.ndarray, block: int = BLOCK, dense: float = DENSE) -> Index:
    """The index of examples whose terms and counts lie between ``ends``, none of them empty."""
    small = np.min_scalar_type(int(times.max())) if len(times) else np.uint8
    return Index(ids, toxic, factor, ends, own.astype(np.int32), times.astype(small), block, dense)


def calibrate(votes: Iterable[float], labels: Iterable[int], weights: Iterable[float]
              ) -> tuple[float, float]:
    """Slope and shift of a logistic curve from votes to labels, by damped Newton steps."""
    x, y, w = (np.array(list(v), float) for v in (votes, labels, weights))
    beta = np.array([1.0, 0.0])
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    design = np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        slope = design @ (w * (y - p)) - 1e-3 * (beta - [1.0, 0.0])
        curve = (design * (w * p * (1 - p))) @ design.T + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(max(beta[0], 0.05)), float(beta[1])


def left_out_votes(spark: SparkSession, index: Index, k: int) -> list[float]:
    """The vote of every example by its neighbours among the others. Tasks build the lists and search
    them, so the driver gets a number for each example and never holds the lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            own = ((index.terms[a:b], index.weights[a:b]) for a, b in (
                index.ends[p:p + 2].tolist() for p in places))
            votes = [index.vote(f) for f in index.nearest_vectors(own, k, places)]
            yield pa.RecordBatch.from_pydict({"place": batch.column(0),
                                              "vote": pa.array(votes, pa.float64())})
        index.release()

    if not len(index.ids):
        return []
    places = spark.range(0, len(index.ids), 1, -(-len(index.ids) // (4 * BATCH)))
    votes = places.mapInArrow(run, "place long, vote double").collect()
    return [v for _, v in sorted(votes)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, buckets: int = 1 << 20,
        floor: float = 0.02, k: int = 15, block: int = BLOCK) -> Index:
    """Calibrated index. Labels come from a bounded sample of labelled rows; document frequencies
    come from all documents. No term is dropped: each is weighed by its idf times ``floor`` plus its
    ``association`` with the label. What reaches the driver is bounded by the parameters: a term and
    a count for each of at most ``buckets`` different terms of at most ``per_class`` texts a class."""
    found = examples(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(buckets)
        for batch in batches:
            own = [tokens(t) for t in batch.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(t) for t, _ in own)]), pa.int32())
            flat = [np.concatenate([x[i] for x in own]).astype(np.int32) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]],
                names=["doc_id", "toxic", "terms", "counts"])

    table = found.select("doc_id", "toxic", "text").mapInArrow(
        run, "doc_id long, toxic int, terms array<int>, counts array<int>").where(
        "size(terms) > 0").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    ids, toxic = (table[c].to_numpy() for c in ("doc_id", "toxic"))
    sizes_of = pc.list_value_length(table["terms"]).to_numpy()
    own, times = (np.concatenate([np.zeros(0, np.int32), *(
        x.flatten().to_numpy() for x in table[c].chunks)]) for c in ("terms", "counts"))
    del table
    ends = np.append(0, np.cumsum(sizes_of))
    sizes = np.bincount(toxic, minlength=2).astype(float)
    df, total = document_counts(docs, buckets) if len(ids) else (np.zeros(buckets), 0)
    factor = association(own, np.repeat(toxic.astype(np.int8), sizes_of), sizes, buckets) + floor
    factor *= np.log((1 + total) / (1 + df)) + 1
    index = index_of(ids, toxic, ends, own, times, factor, block)
    del df, own, times
    # The classes are sampled apart, so their real sizes weigh the curve and the prior.
    real = dict(labels.where("toxic in (0, 1)").where(fold("doc_id", FOLDS) != 0)
                .groupBy("toxic").count().collect())
    index.prior = real.get(1, 0) / (sum(real.values()) + 1)
    share = [real.get(y, 0) / max(sizes[y], 1) for y in (0, 1)]
    index.slope, index.shift = calibrate(left_out_votes(docs.sparkSession, index, k), toxic,
                                         [share[y] for y in toxic.tolist()])
    return index


def verdict(text: Column, index: Index, k: int = 15) -> Column:
    """Score, prediction and evidence of a text column, in Arrow batches and without a shuffle."""
    @F.arrow_udf(VERDICT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Tokens(len(index.factor))
        for batch in batches:
            scores, places, cosines, ends = [], [], [], [0]
            for start in range(0, len(batch), BATCH):
                texts = batch.slice(start, BATCH).to_pylist()
                for found in index.nearest_all([tokens(t) for t in texts], k):
                    scores.append(index.score(found))
                    cosines += [c for c, _ in found]
                    places += [p for _, p in found]
                    ends.append(len(places))
            at, scores = np.array(places, np.int64), np.array(scores, float)
            nearest = pa.StructArray.from_arrays(
                [pa.array(index.ids[at]), pa.array(cosines, pa.float64()),
                 pa.array(index.toxic[at], pa.int32())], names=["doc_id", "cosine", "toxic"])
            yield pa.StructArray.from_arrays(
                [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nearest)],
                names=["score", "predicted", "evidence"])
        index.release()

    return run(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, k: int = 15, **fitted) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs``.

    Each whole text is compared with labelled examples (``fit`` documents their bound) by the exact
    cosine of TF-IDF vectors over all terms, in which those that tell the labels apart weigh more;
    the ``k`` nearest vote with the inverse of their distance, and a logistic curve fitted on
    leave-one-out votes turns the vote into a probability. ``evidence`` lists the neighbours.

    * Null and empty texts, and texts without a term of any example: no neighbours, the
      calibrated prior.
    * Null ``doc_id``: scored like any other, not held out unless the crc of the empty text says so.
    * Repeated rows: each is returned; repeated labels count once, toxic if one of them says so.
    * Ties: equal cosines go to the example that stands first in the index.
    * Empty tables: no documents, empty result; no usable labels, score 0 and no evidence;
      no toxic label, score 0.
    * Other columns are ignored, whatever they are called.
    """
    index = fit(docs, labels, k=k, **fitted)
    if not index.prior:
        index.slope, index.shift = 1.0, -1e3
    rows = docs.select(F.col("doc_id").cast("long"),
                       verdict(F.col("text"), index, k).alias("v"))
    return rows.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "v.*")


def drop_toxic(docs: DataFrame, labels: DataFrame, k: int = 15, **fitted) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns and no shuffle."""
    index = fit(docs, labels, k=k, **fitted)
    if not index.prior:
        return docs
    judged = docs.withColumn("__verdict", verdict(F.col("text"), index, k))
    return judged.where("__verdict.predicted = 0").drop("__verdict")
