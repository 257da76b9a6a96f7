"""Toxicity: the index against brute force, the scores against held-out labels."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import toxicity


def test_index_is_exact():
    rng = random.Random(4)
    idf = np.array([rng.uniform(1, 5) for _ in range(30)])
    rows = [(i, rng.randrange(2), Counter(rng.choices(range(30), k=rng.randint(0, 9))))
            for i in range(300)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(40)]
    index = toxicity.build_index(rows, idf, block=8)
    vectors = {i: dict(zip(*(x.tolist() for x in index.vector(c)))) for i, _, c in rows}
    for _ in range(60):
        query = Counter(rng.choices(range(30), k=rng.randint(0, 6)))
        own = dict(zip(*(x.tolist() for x in index.vector(query))))
        every = []
        for place, i in enumerate(index.ids.tolist()):
            cosine = sum(own[t] * vectors[i].get(t, 0.0) for t in own)
            if cosine > 0:
                every.append((-cosine, place))
        want = sorted(every)[:15]
        got = index.nearest(query, 15)
        assert np.allclose([c for c, _ in got], [-c for c, _ in want])
        # Equal cosines may differ in the last bit between the two sums.
        edge = want[-1][0] if len(want) == 15 else 0
        assert {p for c, p in got if c > -edge + 1e-9} == {p for c, p in want if c < edge - 1e-9}


def test_calibration_follows_votes():
    slope, shift = toxicity.calibrate([-3, -2, -1, 1, 2, 3], [0, 0, 0, 1, 1, 1], [1] * 6)
    assert slope > 0 and abs(shift) < 1
    assert toxicity.calibrate([1, 2], [1, 1], [1, 1]) == (1.0, 0.0)


def test_held_out(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    found = toxicity.toxicity(docs, labels)
    rows = found.join(labels, "doc_id").collect()
    assert found.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    toxic = [r for r in rows if r.toxic == 1 and r.held_out and r.doc_id in english]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert any(e.toxic == 1 for r in toxic for e in r.evidence)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in found.where("predicted = 1").collect()}
    assert gone and {r.doc_id for r in kept.collect()} == {
        r.doc_id for r in docs.collect()} - gone


def test_edges(spark):
    texts = ["you stupid fool word%d" % i if i % 2 else "a fine day word%d" % i
             for i in range(160)]
    rows = [(i, t) for i, t in enumerate(texts)] + [
        (500, None), (501, ""), (None, "stupid fool"), (502, "stupid " * 30_000), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "score", F.lit(1)).withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(160)] + [(1, 0), (2, None), (None, 1), (999, 1)],
        "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r for r in got}
    assert named[502].predicted == 1 and named[None].predicted == 1 and named[3].predicted == 1
    assert named[2].predicted == 0 and named[500].evidence == [] == named[501].evidence
    assert named[500].score == named[501].score
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.score < 1e-9 and not r.evidence for r in none)
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_no_term_is_dropped(spark, sf_dir):
    """Every text that shares any word with an example has neighbours, with the cosine of whole
    vectors, and toxic documents are found in every language."""
    where = sf_dir.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    index = toxicity.fit(docs, labels)
    tokens = toxicity.Tokens(len(index.factor))
    own, value = index.vector(tokens("stupid weather in the qqqq mountains"))
    assert len(own) == 6 + 6 and (value > 0).all()  # words, and prefixes of the long ones
    judged = docs.select("doc_id", "lang", toxicity.verdict(F.col("text"), index).alias("v"))
    rows = judged.join(labels, "doc_id").where(toxicity.fold("doc_id", 5) == 0).collect()
    assert all(r.v.evidence for r in rows)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.v.predicted for r in clean) <= 0.01 * len(clean)
    for lang in ("de", "en", "es", "fr"):
        toxic = [r.v.predicted for r in rows if r.toxic == 1 and r.lang == lang]
        print(lang, sum(toxic), len(toxic))
        assert len(toxic) > 3 and sum(toxic) >= 0.7 * len(toxic), lang
    print("clean", sum(r.v.predicted for r in clean), len(clean))
