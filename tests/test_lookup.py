"""Rule tables, the search index, the category tree, document weights and the table profile."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import rules as rule_tables
from tallyframe.functions.rules import DEFAULT, with_rule_table
from tallyframe.operators import categorize, search, tables
from tallyframe.operators import categories as cats
from tallyframe.operators.aggregates import profile_table
from tallyframe.operators.timeseries import series_of_freqs, to_time_series
from tallyframe.schemas import CATEGORY


def rules(spark, rows):
    return spark.createDataFrame(rows, "seq long, category string, keywords array<string>")


def slow_rules(text, rows):
    if text:
        for _, category, words in sorted(rows, key=lambda r: r[:2]):
            if any(w and w in text.lower() for w in words):
                return category
    return "other"


def test_rule_table_equals_the_plain_rules(spark):
    rng = random.Random(1)
    words = ["a", "be", "gas", "taxi", "uber eats", "ééé", "grocery store", "bus", ""]
    rows = [(rng.randrange(6), f"c{i}", rng.sample(words, rng.randrange(4))) for i in range(12)]
    texts = [" ".join(rng.choices(["GAS", "Taxi", "Uber", "EATS", "ÉÉÉ", "x", "Grocery", "store"],
                                  k=rng.randrange(5))) for _ in range(80)] + [None, "", "BE"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string")
    got = {r.id: r.c for r in with_rule_table(df, rules(spark, rows), "description", "c").collect()}
    assert got == {i: slow_rules(t, rows) for i, t in enumerate(texts)}
    none = with_rule_table(df, rules(spark, rows).limit(0), "description", "c")
    assert none.count() == len(texts) and none.filter("c <> 'other'").isEmpty()
    same = categorize.keyword_categorize(df, overwrite=True).collect()
    table = rules(spark, [(i, c, list(w)) for i, (c, w) in enumerate(DEFAULT)])
    joined = categorize.table_categorize(df, table, overwrite=True).collect()
    assert sorted(map(str, same)) == sorted(map(str, joined))


def test_a_hundred_thousand_rules(spark):
    many = spark.range(100_000).select(
        F.col("id").alias("seq"), F.concat(F.lit("c"), F.col("id") % 9).alias("category"),
        F.array(F.format_string("merchant %06d", "id")).alias("keywords"))
    df = spark.range(500).select("id", F.format_string(
        "PAID TO MERCHANT %06d OK", F.col("id") * 211).alias("description")).withColumn(
        "category", F.when(F.col("id") % 2 == 0, "kept"))
    got = {r.id: r.category for r in categorize.table_categorize(df, many).collect()}
    assert got == {i: "kept" if i % 2 == 0 else (
        f"c{i * 211 % 9}" if i * 211 < 100_000 else "other") for i in range(500)}


def test_keywords_across_pieces(spark):
    long = "x" * 70 + "é\n𝄞" + "y" * 70
    rows = [(1, "long", [long]), (2, "note", ["𝄞 b"]), (2, "aa", ["a\nb"]), (3, "short", ["z"]), (4, "q", None)]
    texts = ["p" * k + t for k in (0, 1, 62, 63, 64, 65, 127, 300)
             for t in (long.upper(), "𝄞 B", "A\nb", "z", "𝄞", "xxxxx")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string")
    table = rules(spark, rows)
    got = {r.id: r.c for r in with_rule_table(df, table, "description", "c").collect()}
    assert got == {i: slow_rules(t, [(s, c, w or []) for s, c, w in rows])
                   for i, t in enumerate(texts)}


@pytest.mark.parametrize("small", [True, False])
def test_rules_that_begin_alike_are_joined_by_whole_keywords(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(rule_tables, "SMALL", 0)
    many = spark.range(3000).select(
        F.col("id").alias("seq"), F.concat(F.lit("c"), F.col("id") % 9).alias("category"),
        F.array(F.format_string("customer#%06d", "id")).alias("keywords"))
    df = spark.range(3000).select("id", F.format_string("BY CUSTOMER#%06d", "id").alias("description"))
    out = with_rule_table(df, many, "description", "c")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.id: r.c for r in out.collect()} == {i: f"c{i % 9}" for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = out._jdf.queryExecution().explainString(mode)
    assert "Join [_word" in plan and "Join [_gram" not in plan
    # Rules of a checked size go to the texts; windows of texts then travel nowhere.
    assert ("BroadcastHashJoin [_word" in plan) == small


@pytest.mark.parametrize("query", ["gas", "GAS st", "o", "aa", "tat", "ré", "nothing here", ""])
def test_search_by_index_equals_the_scan(spark, tmp_path, query):
    rng = random.Random(query)
    parts = ["GAS", "station", "aaaa", "Ré", "so", "Foo Bar", "tatata", "o"]
    rows = [(str(i), " ".join(rng.choices(parts, k=rng.randrange(4))) if i % 9 else None,
             rng.choice(["food", None, "Gas", ""]), f"2024-01-{i % 28 + 1:02d}") for i in range(150)]
    df = spark.createDataFrame(
        rows, "id string, description string, category string, day string").withColumn(
        "transaction_date", F.to_timestamp("day")).drop("day")
    path = str(tmp_path / "index")
    search.write_search_index(df, path, files=3)
    want = [r.id for r in tables.search_transactions(df, query, "2024-01-05").collect()]
    got = [r.id for r in search.search_with_index(df, path, query, "2024-01-05").collect()]
    assert got == want
    if query:
        few = search.write_search_index(df, f"{path}-d", fields=("description",), files=2)
        assert few is None
        near = [r.id for r in search.similar_with_index(df, f"{path}-d", query, 4).collect()]
        assert near == [r.id for r in tables.similar_transactions(df, query, 4).collect()]


def test_search_reads_lists_and_not_all_texts(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.range(500).select(F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias(
        "description"))
    search.write_search_index(df, path, fields=("description",), files=4)
    plan = search.find_texts(spark, path, "5d41402a")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "In(gram" in plan.replace("IN(", "In(") and "LeftSemi" in plan


def test_grams_of_odd_texts(spark):
    texts = ["", "ab", "abc", "a\nb\r\n c", "𝄞𝄞é𝄞 x𝄞", "aaaaa", None, "\u2028ab\x00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h1 int, text string")
    got = sorted(map(tuple, search.search_grams(df).collect()))
    assert got == sorted((g, i) for i, t in enumerate(texts) if t
                         for g in {t[k:k + 3] for k in range(len(t) - 2)})


def test_gram_lists_are_made_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "LETTERS", 2000)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(gram):
        made.add(1)
        return gram

    plain = search.search_grams
    monkeypatch.setattr(search, "search_grams", lambda t: plain(t).withColumn("gram", seen("gram")))
    df = spark.range(300).select(F.concat(F.lit("abcde "), F.md5(F.col("id").cast("string"))).alias(
        "description"))
    path = str(tmp_path / "index")
    search.write_search_index(df, path, fields=("description",), files=2)
    lists = spark.read.parquet(f"{path}/grams")
    assert made.value == lists.count() == lists.select("gram", "h1").distinct().count()
    parts = lists.select(F.input_file_name().alias("f"), "gram").distinct().groupBy("gram").count()
    # More parts than asked for, and the list of a gram that all texts have is dealt over several.
    assert 2 < lists.select(F.input_file_name()).distinct().count() <= 6
    assert parts.filter("gram = 'abc'").first()["count"] > 1
    assert search.find_texts(spark, path, "CDE").count() == 300


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    rows = [(f"n{i}", None, None, None, f"n{i - 1}" if i else None) for i in range(1000)]
    rounds = []
    plain = cats.materialize
    monkeypatch.setattr(cats, "materialize", lambda df: rounds.append(1) or plain(df))
    tree = cats.category_hierarchy(spark.createDataFrame(rows, CATEGORY)).collect()
    assert len(tree) == 1000 and len(rounds) <= 15
    assert {(r.root, r.name, r.depth) for r in tree} == {("n0", f"n{i}", i) for i in range(1000)}


def test_cycles(spark):
    def tree(*pairs):
        rows = [(n, None, None, None, p) for n, p in pairs]
        return cats.category_hierarchy(spark.createDataFrame(rows, CATEGORY))

    assert tree(("a", None), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")).count() == 1
    for loop in ([("a", None), ("b", "a"), ("c", "b"), ("b", "c")], [("a", None), ("a", "a")],
                 [("r", None), ("a", "r"), ("a", "d"), ("b", "a"), ("c", "b"), ("d", "c")]):
        with pytest.raises(cats.CategoryError):
            tree(*loop)
    # Two parents: listed below both.
    both = tree(("a", None), ("b", ""), ("c", "a"), ("c", "b"), ("d", "c")).collect()
    assert sorted(r.path for r in both) == ["a", "a/c", "a/c/d", "b", "b/c", "b/c/d"]


def test_document_features(spark):
    df = spark.createDataFrame([(1, "Red red fox"), (2, "blue FOX"), (3, None), (4, "x")],
                               "id long, description string")
    got = categorize.document_features(df).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, {})[r.term] = r.weight
    assert set(by_id) == {1, 2} and set(by_id[1]) == {"red", "fox", "red red", "red fox"}
    assert sum(w * w for w in by_id[1].values()) == pytest.approx(1)
    assert by_id[1]["red"] > by_id[1]["red red"] > by_id[1]["fox"]
    plan = categorize.document_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert categorize.document_features(df.limit(0)).collect() == []


def test_profile_reads_the_table_three_times(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.5, 2.5, float(i)]), f"t{i % 7}") for i in range(4001)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "a int, b double, c string").write.parquet(path)
    table, passes = spark.read.parquet(path), []
    first = type(table).first
    monkeypatch.setattr(type(table), "first", lambda df: passes.append(1) or first(df))
    profile = profile_table(table)
    assert len(passes) == 2
    assert str(profile._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    got = {r.column_name: r for r in profile.collect()}
    assert (got["a"].q25, got["a"].q50, got["a"].q75) == (1000.0, 2000.0, 3000.0)
    known = sorted(b for _, b, _ in rows if b is not None)
    assert got["b"].n_nulls == sum(b is None for _, b, _ in rows)
    middle = (len(known) - 1) / 2
    low, high = known[int(middle)], known[-int(-middle // 1)]
    assert got["b"].q50 == pytest.approx(low + (high - low) * (middle % 1))
    assert got["c"].q50 is None and got["c"].n_rows == 4001


def test_series_of_freqs_equals_each_frequency(spark):
    df = spark.range(400).select(
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id)").alias("transaction_date"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("category"),
        F.col("id").cast("double").alias("amount"))
    every = series_of_freqs(df)
    for f in "DWM":
        got = every.filter(F.col("freq") == f).drop("freq")
        want = to_time_series(df, f)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(
            map(str, want.collect()))
    assert str(every._jdf.queryExecution().executedPlan()).count("Exchange hash") == 1
