"""Keyword rules, text weights and the classifier."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.rules import RULE_SETS, rules_from_table, with_keyword_category
from tallyframe.operators import categorize as ops
from tallyframe.operators import classifier as ml


def category(spark, text, rules="default"):
    df = spark.createDataFrame([(text,)], "d string")
    return with_keyword_category(df, "d", "c", RULE_SETS[rules]).first().c


@pytest.mark.parametrize("text, expected", [
    ("Corner GROCERY store", "food"),
    ("natural gas", "transport"),
    ("Business lunch", "transport"),
    ("water bill", "utilities"),
    ("Monthly rental", "housing"),
    ("payment received", "income"),
    ("nothing known", "other"),
    ("", "other"),
    (None, "other"),
])
def test_first_rule_with_a_substring_wins(spark, text, expected):
    assert category(spark, text) == expected


@pytest.mark.parametrize("rules, text, expected", [
    ("report", "credit note", "income"),
    ("train", "NEFT to bank", "transfer"),
    ("train", "buy now", "shopping"),
    ("forecast", "salary", "other"),
    ("ui", "coffee", "food"),
    ("ui", "payroll", "income"),
])
def test_rule_sets(spark, rules, text, expected):
    assert category(spark, text, rules) == expected


def test_quotes_in_keywords(spark):
    df = spark.createDataFrame([("joe's\\diner",)], "d string")
    rules = (("food", ("joe's\\d",)),)
    assert with_keyword_category(df, "d", "c", rules).first().c == "food"


def test_only_empty_categories_are_filled(spark):
    df = spark.createDataFrame([("uber", None), ("uber", ""), ("uber", "kept")],
                               "description string, category string")
    assert [r.category for r in ops.keyword_categorize(df).collect()] == [
        "transport", "transport", "kept"]
    forced = ops.keyword_categorize(df, overwrite=True)
    assert {r.category for r in forced.collect()} == {"transport"}


def test_categorize_is_map_only(spark):
    df = spark.createDataFrame([("uber", None)], "description string, category string")
    plan = ops.keyword_categorize(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rule_table_is_bounded(spark):
    table = spark.createDataFrame([(2, "b", ["x"]), (1, "a", ["x"])],
                                  "seq int, category string, keywords array<string>")
    assert rules_from_table(table) == [("a", ("x",)), ("b", ("x",))]
    with pytest.raises(ValueError):
        rules_from_table(table, limit=1)


def test_word_frequency_counts_copies(spark):
    df = spark.createDataFrame([("A b",), ("A b",), (" a ",), (None,)], "description string")
    assert [tuple(r) for r in ops.word_frequency(df).collect()] == [("a", 3), ("b", 2)]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("red car",), ("red bus",), ("red bus",), ("a",)],
                               "description string")
    vocabulary = {r.term: r for r in ops.tfidf_vocabulary(df).collect()}
    assert set(vocabulary) == {"red", "car", "bus", "red car", "red bus"}
    assert vocabulary["red"].corpus_count == 3
    assert vocabulary["car"].idf == pytest.approx(math.log(5 / 2) + 1)
    weights = {(r.text, r.term): r.weight for r in ops.tfidf_features(df).collect()}
    parts = [vocabulary[t].idf for t in ("red", "car", "red car")]
    norm = math.sqrt(sum(p * p for p in parts))
    assert weights["red car", "car"] == pytest.approx(parts[1] / norm)


def test_vocabulary_limit_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("bb aa",)], "description string")
    assert [r.term for r in ops.tfidf_vocabulary(df, max_features=2).collect()] == ["aa", "bb"]


@pytest.fixture(scope="module")
def labelled(spark):
    texts = {"food": ["GROCERY STORE {}", "PIZZA PLACE {}"], "transport": ["UBER RIDE {}", "TRAIN {}"]}
    data = [(f"{c}{t[:2]}{i}", t.format(i), c) for c, ts in texts.items() for t in ts for i in range(30)]
    return spark.createDataFrame(data, "id string, description string, category string")


def test_classifier(spark, labelled, tmp_path):
    model, accuracy = ml.train_categorizer(labelled)
    assert accuracy > 0.15
    new = spark.createDataFrame(
        [("1", "uber ride home", None), ("2", "grocery", ""), ("3", None, "kept")],
        "id string, description string, category string",
    )
    got = {r.id: r.prediction for r in ml.predict_categories(model, new).collect()}
    assert got["1"] == "transport" and got["2"] == "food"
    filled = {r.id: (r.category, r.was_predicted) for r in ml.categorize_missing(model, new).collect()}
    assert filled == {"1": ("transport", True), "2": ("food", True), "3": ("kept", False)}
    assert ml.categorize_table(model, new).filter("category is null").count() == 0
    ml.save_categorizer(model, str(tmp_path / "model"))
    again = ml.load_categorizer(spark, str(tmp_path / "model"))
    before = ml.predict_categories(model, labelled).select("id", "prediction")
    assert before.exceptAll(ml.predict_categories(again, labelled).select("id", "prediction")).isEmpty()


def test_classifier_errors(spark, labelled):
    with pytest.raises(ValueError, match="at least 10"):
        ml.train_categorizer(labelled.limit(5))
    with pytest.raises(RuntimeError):
        ml.predict_categories(None, labelled)


def test_training_set_labels_are_sorted(spark, labelled):
    labels = ops.training_set(labelled).select("category", "label").distinct().orderBy("label")
    assert [tuple(r) for r in labels.collect()] == [("food", 0.0), ("transport", 1.0)]


def test_vocabulary_of_whole_texts(spark, tmp_path):
    import re
    from collections import Counter

    import __spark_entry__ as contract

    texts = ["Größe über 42 Straßen", "été à l'école été", "El niño comió 3 piñas", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    want, held = Counter(), Counter()
    for text in texts:
        words = re.findall(r"\w\w+", (text or "").lower())
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        want.update(terms)
        held.update(set(terms))
    rows = contract.queries()["tfidf_vocabulary_documents_whole"](spark, str(tmp_path)).collect()
    assert {r.term: (r.corpus_count, r.doc_count) for r in rows} == {
        t: (n, held[t]) for t, n in want.items()}
    assert {"größe", "été", "42", "niño comió"} <= set(want)
