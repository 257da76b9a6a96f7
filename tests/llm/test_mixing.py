"""Raking against numpy, and the calibration of the probabilities."""

import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import mixing


def test_raking_like_numpy(spark):
    rng = np.random.default_rng(6)
    n = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    n[0, 1, 0] = 0
    cells = spark.createDataFrame(
        [(f"s{i}", None if j == 2 else f"l{j}", k, int(n[i, j, k]))
         for i in range(4) for j in range(3) for k in range(2)],
        "source string, lang string, topic int, tokens long")
    wanted = {"topic": {"0": 0.8, "1": 0.2}}
    got = {(r.source, r.lang, r.topic): r.factor for r in mixing.rake(
        cells, wanted, tolerance=1e-9).collect()}
    w, total = n.copy(), n.sum()
    targets = [n.sum((1, 2)) ** 0.5, n.sum((0, 2)) ** 0.7, np.array([0.8, 0.2])]
    for _ in range(200):
        for axis, target in enumerate(targets):
            now = w.sum(tuple({0, 1, 2} - {axis}))
            shape = [1, 1, 1]
            shape[axis] = -1
            w *= (target / target.sum() * total / now).reshape(shape)
    for i in range(4):
        for j in range(3):
            for k in range(2):
                factor = got[(f"s{i}", None if j == 2 else f"l{j}", k)]
                assert factor * n[i, j, k] == pytest.approx(w[i, j, k], rel=1e-6)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = mixing.mixing_weights(docs, keep=0.5).collect()
    assert len(rows) == docs.count()
    total = sum(r.n_tokens for r in rows)
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert expected == pytest.approx(0.5 * total, rel=1e-4)
    drawn = sum(r.n_tokens for r in rows if r.kept)
    assert abs(drawn - expected) < 0.15 * total
    for margin, power in mixing.POWERS.items():
        seen, raked = {}, {}
        for r in rows:
            seen[r[margin]] = seen.get(r[margin], 0) + r.n_tokens
            raked[r[margin]] = raked.get(r[margin], 0) + r.n_tokens * r.weight
        scale = sum(v ** power for v in seen.values())
        for value, weight in raked.items():
            assert weight / total == pytest.approx(seen[value] ** power / scale, abs=1e-5)
    again = mixing.mixing_weights(docs.repartition(7), keep=0.5)
    assert {(r.doc_id, r.kept) for r in again.collect()} == {(r.doc_id, r.kept) for r in rows}
    kept = mixing.mix(docs, keep=0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (None, "some words only here", "en", None),
            (3, "wonderful " * 60_000, "en", "a"), (4, "same text", "en", "b"),
            (4, "same text", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"
                                 ).withColumn("topic", F.lit("x")).withColumn("factor", F.lit(1))
    got = mixing.mixing_weights(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert {r.topic for r in got if r.doc_id in (1, 2)} == {-1}
    assert len({r.kept for r in got if r.doc_id == 4}) == 1
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixing_weights(docs.limit(0)).collect() == []
    assert len(mixing.mixing_weights(docs.where("doc_id < 3")).collect()) == 2


def slow_topic(text):
    """The most frequent bucket of the longer words, by Spark's own hash of each."""
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") if len(w) >= 6]


def test_topics_rate_and_draw(spark, sf_dir):
    """Topic, calibrated probability and draw of every document, worked out again in Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in mixing.mixing_weights(docs, keep=0.4).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = sorted({w for t in texts.values() for w in slow_topic(t)})
    hashes = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", F.pmod(F.xxhash64("w"), F.lit(mixing.TOPICS)).alias("b")).collect()}
    for i, text in texts.items():
        seen = Counter(hashes[w] for w in slow_topic(text))
        want = min(seen, key=lambda b: (-seen[b], b)) if seen else -1
        assert rows[i].topic == want
    total = sum(r.n_tokens for r in rows.values())
    factors = {(r.source, r.lang, r.topic): r.weight for r in rows.values()}
    low, high = 0.0, 1 / min(f for f in factors.values() if f > 0)
    for _ in range(100):
        rate = (low + high) / 2
        reached = sum(r.n_tokens * min(1, rate * r.weight) for r in rows.values())
        low, high = (low, rate) if reached >= 0.4 * total else (rate, high)
    for r in rows.values():
        assert r.probability == pytest.approx(min(1, high * r.weight), rel=1e-6)
    drawn = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select(
        "doc_id", mixing.uniform(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("u"))
    for r in drawn.collect():
        assert rows[r.doc_id].kept == (r.u < rows[r.doc_id].probability)


def test_targets_that_cannot_be_met_end_soon(spark):
    """One source has one language alone, so no weights meet both wanted shares."""
    cells = spark.createDataFrame([("a", "x", 0, 50), ("b", "y", 0, 50), ("b", "y", 1, 20)],
                                  "source string, lang string, topic int, tokens long")
    wanted = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}}
    began = time.time()
    got = mixing.rake(cells, wanted).collect()
    assert time.time() - began < 60
    assert all(r.error > 0.1 and math.isfinite(r.factor) for r in got)
    fine = mixing.rake(cells, {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.3, "y": 0.7},
                               "topic": {"0": 0.8, "1": 0.2}}).collect()
    assert all(r.error <= 1e-6 for r in fine)


def test_a_step_plans_one_aggregate_and_one_join(spark, monkeypatch):
    """What a job of the raking plans does not grow with the steps before it."""
    seen = []

    def spied(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if name == "cells":
            seen.append((plan.count("Aggregate "), plan.count("Join ")))
        return stored(df, name)

    stored = mixing.stored
    monkeypatch.setattr(mixing, "stored", spied)
    cells = spark.createDataFrame([("a", "x", 0, 50), ("b", None, 0, 50), ("b", "y", 1, 20)],
                                  "source string, lang string, topic int, tokens long")
    got = mixing.rake(cells)
    assert got.columns == [*cells.columns, "factor", "error"] and got.count() == 3
    assert len(seen) > 3 and seen[0] == (0, 3) and set(seen[1:]) == {(1, 1)}
