"""Table maintenance, category edits, writers and the upload stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import categories as cats
from tallyframe.operators import tables as ops
from tallyframe.operators.aggregates import budget_usage, top_spending
from tallyframe.plans.jobs import map_partitions, process_transactions, series_tables
from tallyframe.schemas import CATEGORY
from tallyframe.session import materialize, shared_dir
from tallyframe.sources import writers
from tallyframe.streaming.ingest import ingest_stream, ingest_upload

TX = "id string, transaction_date timestamp, description string, amount double, category string"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(str(i), dt.datetime(2022, 1, 1 + i), f"Shop {i}", -10.0 * i, "food" if i % 2 else None)
            for i in range(10)]
    return spark.createDataFrame(rows, TX)


def ids(df):
    return [r.id for r in df.collect()]


def test_bounds_are_inclusive_and_pages_slice(df):
    got = ops.list_transactions(df, start="2022-01-03", end="2022-01-08", min_amount=-70.0, max_amount=-20.0)
    assert ids(got) == ["7", "6", "5", "4", "3", "2"]
    assert ids(ops.list_transactions(df, skip=2, limit=3)) == ["7", "6", "5"]
    assert ops.count_transactions(df, category="food").first().total == 5


def test_filters_are_pushed_to_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderdate").alias("transaction_date"), F.col("o_totalprice").alias("amount"))
    for bounds, pushed in (({"start": "1996-01-01"}, "GreaterThanOrEqual(o_orderdate"),
                           ({"max_amount": 5.0}, "LessThanOrEqual(o_totalprice")):
        plan = ops.filter_transactions(orders, **bounds)._jdf.queryExecution().executedPlan()
        assert pushed in plan.toString()


def test_lookup_and_search(df):
    assert ids(ops.get_transaction(df, "3")) == ["3"] and ops.get_transaction(df, "x").isEmpty()
    assert ids(ops.search_transactions(df, "FOOD")) == ["9", "7", "5", "3", "1"]
    assert ids(ops.similar_transactions(df, "shop")) == ["9", "8", "7"]
    assert ids(ops.recent_transactions(df, 2)) == ["9", "8"]


def test_append_update_delete(spark, df):
    new = spark.createDataFrame([(dt.datetime(2023, 1, 1), "new", 5.0)],
                                "transaction_date timestamp, description string, amount double")
    added = ops.append_transactions(df, new).filter("description = 'new'").first()
    assert len(added.id) == 36 and added.created_at is not None and added.updated_at is None
    patches = spark.createDataFrame([("1", None, 99.0), ("2", "renamed", None)],
                                    "id string, description string, amount double")
    got = {r.id: r for r in ops.update_transactions(df, patches).collect()}
    assert (got["1"].description, got["1"].amount) == ("Shop 1", 99.0)
    assert (got["2"].description, got["2"].amount) == ("renamed", -20.0)
    assert got["1"].updated_at is not None and got["3"].updated_at is None
    assert len(ids(ops.delete_transactions(df, patches))) == 8


def test_recommendation_filters_default(spark):
    empty = spark.createDataFrame([], "id string, type string, category string, priority int")
    row = ops.recommendation_filters(empty).first()
    assert (row.types, row.min_priority, row.max_priority) == ([], 1, 10)


def test_category_edits(spark):
    base = cats.categories_table(spark)
    assert base.count() == 9
    more = cats.add_category(base, "pets", parent_category="food")
    for call in (
        lambda: cats.add_category(base, "food"),
        lambda: cats.add_category(base, "x", parent_category="none"),
        lambda: cats.get_category(base, "none"),
        lambda: cats.update_category(base, "none", "x"),
        lambda: cats.update_category(base, "food", "health"),
        lambda: cats.update_category(base, "food", "food", parent_category="none"),
        lambda: cats.delete_category(base, "income"),
        lambda: cats.delete_category(base, "other"),
        lambda: cats.delete_category(base, "none"),
    ):
        with pytest.raises(cats.CategoryError):
            call()
    renamed = cats.update_category(more, "pets", "animals", icon="paw")
    row = cats.get_category(renamed, "animals").first()
    assert (row.icon, row.parent_category) == ("paw", None)
    assert cats.delete_category(renamed, "animals").count() == 9


def test_hierarchy_skips_orphans_and_stops_on_deep_trees(spark):
    rows = [(n, None, None, None, p) for n, p in
            (("a", None), ("b", "a"), ("c", "b"), ("d", ""), ("lost", "none"), ("x", "y"), ("y", "x"))]
    tree = cats.category_hierarchy(spark.createDataFrame(rows, CATEGORY))
    assert {(r.name, r.depth, r.path) for r in tree.collect()} == {
        ("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c"), ("d", 0, "d")}
    again = rows + [("b", None, None, None, "c")]
    with pytest.raises(cats.CategoryError):
        cats.category_hierarchy(spark.createDataFrame(again, CATEGORY))


def test_budget_usage(spark, df):
    budgets = spark.createDataFrame([("food", 277.0), ("none", 10.0), ("zero", 0.0)], "category string, budget double")
    got = {r.category: (r.spent, r.percentage, r.alert) for r in budget_usage(df, budgets).collect()}
    assert got["food"] == (250.0, 90, False) and got["none"] == (0.0, 0, False)
    assert got["zero"][1] is None or got["zero"][0] == 0.0
    assert [r.category for r in top_spending(df).collect()] == ["food", "other"]


def test_writers(spark, df, tmp_path):
    fc = spark.createDataFrame([("My Model", "Eating Out", dt.date(2022, 1, 1), 1.0)],
                               "forecaster string, category string, ds date, amount double")
    writers.write_forecasts(fc, str(tmp_path / "fc"))
    assert (tmp_path / "fc" / "forecaster=my_model" / "category=eating_out").is_dir()
    writers.write_series({"D": fc, "W": fc}, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("freq=*")} == {"freq=D", "freq=W"}
    writers.write_transactions(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 10


def test_upload_and_stream_take_new_files_only(spark, tmp_path):
    def statement(name, day):
        lines = ["DATE,TRANSACTION DETAILS, WITHDRAWAL AMT , DEPOSIT AMT ",
                 f"2022-01-{day},UBER,10.5,", f"2022-01-{day},,,100", "bad,X,1,"]
        path = tmp_path / "in" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    first = statement("a.csv", "01")
    count, sample = ingest_upload(spark, first, str(tmp_path / "table"))
    assert count == 2 and {(r.category, r.amount) for r in sample.collect()} == {("transport", -10.5), ("other", 100.0)}
    assert process_transactions(spark, first).count() == 2
    for name, day, total in (("a.csv", "01", 2), ("b.csv", "02", 4)):
        statement(name, day)
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == total


def test_map_partitions_and_series_tables(df):
    out = map_partitions(df.select("id", "amount"), lambda p: p.assign(twice=p.amount * 2),
                         "id string, amount double, twice double")
    assert out.filter("twice <> amount * 2").isEmpty() and out.count() == 10
    assert set(series_tables(df)) == {"D", "W", "M"}


def test_materialize_cuts_lineage_in_the_shared_folder(spark, df):
    small = materialize(df.groupBy("category").count())
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and spark.sparkContext.getCheckpointDir() is not None
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
