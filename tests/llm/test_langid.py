"""Language ID: the grams and EM against plain loops, predictions against held-out languages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import langid


@pytest.fixture(scope="module")
def learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    return docs, langid.learn(docs)


def test_words_and_grams():
    letters = np.unpackbits(np.frombuffer(langid.letter_table(), np.uint8)).astype(bool)
    texts = ["Ab c1d", None, "", "12 !!", "é", "ab c d"]
    grams, starts, words = langid.word_grams(texts, letters, 1 << 14)
    assert words.tolist() == [3, 0, 0, 0, 1, 3] and len(starts) == 7
    assert len(grams) == 4 + 1 + 4 and grams[:4].tolist() == grams[5:].tolist()


def test_em_like_plain_loops():
    rng = np.random.default_rng(1)
    like = rng.uniform(0.01, 1, (3, 40))
    share, value = langid._mix(like, np.array([25, 15]), np.full((3, 2), 1 / 3), 30)
    for d, part in enumerate((like[:, :25], like[:, 25:])):
        pi = [1 / 3] * 3
        for _ in range(30):
            new = [0.0] * 3
            for w in range(part.shape[1]):
                total = sum(pi[k] * part[k, w] for k in range(3))
                for k in range(3):
                    new[k] += pi[k] * part[k, w] / total / part.shape[1]
            pi = new
        assert np.allclose(share[:, d], pi)
        assert value[d] == pytest.approx(sum(
            math.log(sum(pi[k] * part[k, w] for k in range(3))) for w in range(part.shape[1])))


def test_held_out(learned):
    docs, model = learned
    found = langid.identify(docs, model).join(docs, "doc_id").where(
        langid.fold("doc_id", 3) == 1).collect()
    hits = [r.lang == r.lang_pred for r in found if r.lang]
    assert len(hits) > 200 and sum(hits) / len(hits) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_mixture(spark, learned):
    docs, model = learned
    long = docs.where("n_chars between 800 and 3000")
    en = long.where("lang = 'en'").first().text
    fr = long.where("lang = 'fr'").first().text
    rows = spark.createDataFrame([(1, en + " " + fr), (2, en)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert {x.lang for x in got[1].languages} == {"en", "fr"}
    assert sum(x.share for x in got[1].languages) == pytest.approx(1)
    assert got[2].lang_pred == "en"


def test_edges(spark, learned):
    _, model = learned
    rows = [(1, None), (2, ""), (3, "123 !! 4"), (None, "the and of"), (4, "the " * 200_000),
            (5, "the and of"), (5, "the and of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "lang", F.lit(None).cast("string")).withColumn("score", F.lit("x"))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3))
    assert by_id[4].lang_pred == by_id[None].lang_pred == "en"
    assert langid.identify(docs.limit(0), model).collect() == []
    unlearned = langid.language_id(docs).collect()
    assert {r.lang_pred for r in unlearned} == {"und"} and len(unlearned) == len(rows)


def test_every_language_is_learned_or_refused(spark):
    rows = [(i, f"l{i % 230}", f"wort{i % 230}a text{i % 230}b {chr(97 + i % 26) * 5}")
            for i in range(230 * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert len(langid.learn(docs).languages) == 230
    with pytest.raises(ValueError):
        langid.learn(docs, max_languages=229)
