"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import let, stored, uniform
from tallyframe.llm.quality import words

MARGINS = ("source", "lang", "topic")
TOPICS = 8
#: Exponent of the observed token share of a value, by margin: below 1 lifts small values.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}


def topic_of(tokens: Column, topics: int = TOPICS) -> Column:
    """The most frequent hash bucket of a text's longer words (six code points or more, in lower
    case), ties to the smaller; -1 if there is none. Buckets stand for topics where the corpus
    names none."""
    digits = F.transform(F.filter(tokens, lambda w: F.length(w) >= 6), lambda w: F.pmod(
        F.xxhash64(F.lower(w)), F.lit(topics)).cast("string"))

    def most(joined):
        counts = F.array(*[F.struct((F.length(joined) - F.length(F.replace(
            joined, F.lit(str(t)), F.lit("")))).alias("n"), F.lit(-t).alias("t"))
            for t in range(topics)])
        return F.when(joined == "", -1).otherwise(-F.array_max(counts)["t"])
    if not 1 <= topics <= 10:
        raise ValueError("topics are single digits: 1 to 10")
    return let(F.array_join(digits, ""), most).cast("int")


def with_facts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__source``, ``__lang``, ``__topic`` and ``__tokens`` (words)."""
    tokens = let(words(F.col("text").cast("string")), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), topic_of(w).alias("topic")))
    return docs.withColumns({"__source": F.col("source").cast("string"),
                             "__lang": F.col("lang").cast("string"), "__facts": tokens}
                            ).withColumns({"__topic": F.col("__facts.topic"),
                                           "__tokens": F.col("__facts.n")}).drop("__facts")


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None) -> DataFrame:
    """``margin, target``: the wanted share of all tokens of each value."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if wanted is None:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(POWERS[margin]))
    else:
        pairs = [F.lit(x) for kv in wanted.items() for x in (str(kv[0]), float(kv[1]))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        raw = F.coalesce(F.try_element_at(table, F.coalesce(F.col(margin).cast("string"),
                                                            F.lit(""))), F.lit(0.0))
    found = sums.select(margin, F.when(F.col("tokens") > 0, raw).otherwise(0.0).alias("raw"))
    total = found.agg(F.sum("raw")).first()[0] or 1.0
    return stored(found.select(margin, (F.col("raw") / total).alias("target")), "targets")


def rake(cells: DataFrame, wanted: Mapping[str, Mapping[str, float]] | None = None,
         tolerance: float = 1e-6, sweeps: int = 100) -> DataFrame:
    """``cells`` (the margins and their ``tokens``) with ``factor``, the raked weight of a token, and
    ``error``, by how much the share of a value misses its target at most.

    Each step scales the weights of a margin's values to their targets: one aggregate, joined back,
    and stored, so that the plan of a step stays as small as that. A sweep does so for all margins. It
    ends when no share is off by more than ``tolerance``, after ``sweeps``, or when the error no longer
    falls: targets that no weights can meet stay off by that ``error``. The table of cells is as large
    as the number of combinations that occur. Only the error reaches the driver.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("factor", F.lit(1.0))
    for margin in MARGINS:
        target = _targets(cells, margin, (wanted or {}).get(margin)).withColumnsRenamed(
            {margin: "__m", "target": f"target_{margin}"})
        state = state.join(target, F.col(margin).eqNullSafe(F.col("__m"))).drop("__m")
    state = stored(state, "cells")
    least, idle, worst = math.inf, 0, 0.0
    for _ in range(sweeps if total else 0):
        for margin in MARGINS:
            weight = F.sum(F.col("tokens") * F.col("factor"))
            now = state.groupBy(F.col(margin).alias("__m")).agg((weight / total).alias("__now"))
            now_is, wanted_is = F.col("__now"), F.col(f"target_{margin}")
            ratio = F.when(now_is > 0, wanted_is / now_is).otherwise(1.0)
            state = stored(state.join(now, F.col(margin).eqNullSafe(F.col("__m"))).withColumns({
                "factor": F.col("factor") * ratio, f"off_{margin}": F.abs(now_is - wanted_is),
            }).drop("__m", "__now"), "cells")
        worst = state.agg(F.greatest(*[F.max(f"off_{m}") for m in MARGINS])).first()[0] or 0.0
        idle = 0 if worst < 0.99 * least else idle + 1
        least = min(least, worst)
        if worst <= tolerance or idle == 2:
            break
    return state.select(*cells.columns, "factor", F.lit(float(worst)).alias("error"))


def calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with ``probability``: ``min(1, rate * factor)`` with the one rate at which the
    expected number of tokens is ``keep`` times all. The rate is narrowed down by sums of the cells
    at 32 trial rates at a time."""
    top = cells.agg(F.sum("tokens"), F.min(F.when(F.col("factor") > 0, F.col("factor")))).first()
    total, least = top[0] or 0, top[1] or 1.0
    low, high = 0.0, 1.0 / least
    for _ in range(6 if total else 0):
        trials = [low + (high - low) * (i + 1) / 32 for i in range(32)]
        sums = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * t)
                                 ).alias(f"t{i}") for i, t in enumerate(trials)]).first()
        reach = next((i for i, s in enumerate(sums) if s >= keep * total), 31)
        low, high = trials[reach] - (high - low) / 32, trials[reach]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * high))


def weighed(docs: DataFrame, keep: float = 0.5,
            wanted: Mapping[str, Mapping[str, float]] | None = None, **raking) -> DataFrame:
    """``docs`` with ``__source, __lang, __topic, __tokens, __weight, __probability, __error, __kept``.

    Tokens (words) are counted by source, language and topic, token weights are raked to the target
    share of every value of these margins, and a document is kept with the calibrated probability of
    its combination, by a number drawn from its id and text. ``wanted`` gives target shares by
    margin and value; other margins get the observed shares to the power in ``POWERS``. Values whose
    target needs more tokens than there are are kept whole.

    * Null source or language: a value of its own. Null and empty texts: no tokens, topic -1.
    * Null ``doc_id``: drawn by its text. Repeated rows: drawn alike.
    * Ties between topics: the smaller. Very long texts: whole.
    * Empty table: empty result. Other columns are passed on.
    """
    facts = with_facts(docs)
    cells = stored(facts.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(
        F.sum("__tokens").alias("tokens")), "cells")
    table = calibrated(rake(cells, wanted, **raking), keep).select(
        *[F.col(m).alias(f"__cell_{m}") for m in MARGINS], F.col("factor").alias("__weight"),
        F.col("probability").alias("__probability"), F.col("error").alias("__error"))
    table = stored(table, "probabilities")
    on = [F.col(f"__{m}").eqNullSafe(F.col(f"__cell_{m}")) for m in MARGINS]
    drawn = uniform(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = facts.join(table, on[0] & on[1] & on[2], "left").withColumn(
        "__kept", drawn < F.coalesce("__probability", F.lit(1.0)))
    return joined.drop(*[f"__cell_{m}" for m in MARGINS])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of ``docs``, with their own columns; see ``weighed``."""
    return weighed(docs, **options).where("__kept").select(*docs.columns)


def mixing_weights(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept, error`` of every document;
    see ``weighed``. ``error`` is by how much a share misses its target at most."""
    names = {"__source": "source", "__lang": "lang", "__topic": "topic", "__tokens": "n_tokens",
             "__weight": "weight", "__probability": "probability", "__kept": "kept",
             "__error": "error"}
    return weighed(docs, **options).select(
        F.col("doc_id").cast("long"), *[F.col(a).alias(b) for a, b in names.items()])
