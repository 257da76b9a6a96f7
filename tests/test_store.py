"""Stored tables: buckets, lists, conflicts, and what a cut-off job leaves."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators.cleaning import dedupe_transactions
from tallyframe.sources import readers, store, writers
from tallyframe.streaming.ingest import ingest_stream, ingest_upload


def rows(spark, n=200):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("d"), F.col("id")).alias("description"),
        F.col("id").cast("double").alias("amount"), F.lit("food").alias("category"),
        F.lit(None).cast("timestamp").alias("updated_at"))


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.glob("data/*/bucket=*/*.parquet")}


def test_an_update_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create_store(rows(spark, 2000), path, buckets=64)
    before = files(tmp_path / "t")
    assert len({p.parent.name for p in before}) == 64
    patch = spark.createDataFrame([("7", -1.0)], "id string, amount double")
    writers.update_in(path, patch)
    after = files(tmp_path / "t")
    fresh = set(after) - set(before)
    assert set(before) < set(after) and {p.parent.name for p in fresh} == {
        f"bucket={spark.range(1).select(F.pmod(F.xxhash64(F.lit('7')), F.lit(64))).first()[0]}"}
    got = {r.id: r.amount for r in readers.read_transactions_table(spark, path).collect()}
    assert got == {str(i): -1.0 if i == 7 else float(i) for i in range(2000)}
    writers.delete_from(path, spark.createDataFrame([("9",), ("9",)], "id string"))
    assert store.read_store(spark, path).count() == 1999
    assert len(set(files(tmp_path / "t")) - set(after)) == 1
    writers.delete_from(path, spark.createDataFrame([], "id string"))
    assert store.read_store(spark, path).count() == 1999


def test_a_cut_off_change_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.create_store(rows(spark), path, buckets=4)
    whole = store.read_store(spark, path)

    def fail(*_):
        raise KeyboardInterrupt

    publish = store._publish
    monkeypatch.setattr(store, "_publish", fail)
    with pytest.raises(KeyboardInterrupt):
        store.delete_store(path, rows(spark, 50))
    with pytest.raises(KeyboardInterrupt):
        store.create_store(rows(spark, 3), path)
    monkeypatch.setattr(store, "_publish", publish)
    assert store.read_store(spark, path).count() == 200
    store.delete_store(path, rows(spark, 50))
    # Rows that were read before keep their files until these are cleaned away.
    assert store.read_store(spark, path).count() == 150 and whole.count() == 200
    gone = store.clean_store(spark, path, keep=1)
    assert len(gone) >= 2 and store.read_store(spark, path).count() == 150


def test_two_writers_do_not_lose_a_change(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.create_store(rows(spark), path, buckets=4)
    written = store._written

    def overtaken(df, *args):
        out = written(df, *args)
        monkeypatch.setattr(store, "_written", written)
        store.delete_store(path, spark.createDataFrame([("1",)], "id string"))
        return out

    monkeypatch.setattr(store, "_written", overtaken)
    with pytest.raises(store.StoreConflict):
        store.update_store(path, spark.createDataFrame([("2", 5.0)], "id string, amount double"))
    got = {r.id: r.amount for r in store.read_store(spark, path).collect()}
    assert "1" not in got and got["2"] == 2.0 and len(got) == 199


def test_a_store_replaces_itself_and_merges_crowded_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create_store(rows(spark, 40), path, buckets=2)
    store.create_store(store.read_store(spark, path).filter("amount < 20"), path, buckets=2)
    assert store.read_store(spark, path).count() == 20
    for i in range(store.CROWDED + 2):
        store.append_store(path, rows(spark, 6).drop("id"))
    assert store.read_store(spark, path).count() == 20 + 6 * (store.CROWDED + 2)
    store.update_store(path, spark.createDataFrame([("3", 1.5)], "id string, amount double"))
    held = store._load(spark, path)["held"]
    assert all(len(marks) == 1 for marks in held.values())
    assert store.read_store(spark, path).count() == 20 + 6 * (store.CROWDED + 2)


def test_a_replacement_cut_off_between_its_renames_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_transactions(rows(spark, 5), path)
    rows(spark, 7).write.parquet(f"{path}-new-abc")
    (tmp_path / "t").rename(tmp_path / "t-old-abc")
    assert writers.recover(spark, path) and spark.read.parquet(path).count() == 7
    assert not writers.recover(spark, path)


def test_first_rows_make_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_to(path, rows(spark, 3).drop("id", "updated_at"))
    writers.append_to(path, rows(spark, 2).drop("id", "updated_at"))
    table = readers.read_transactions_table(spark, path)
    assert table.count() == 5 and table.filter("id is null or created_at is null").isEmpty()


def test_patches_of_one_id_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_transactions(rows(spark, 3), path)
    patches = spark.createDataFrame([("1", 5.0, None, 1), ("1", None, "x", 2), ("1", 9.0, None, 0)],
                                    "id string, amount double, category string, seq int")
    writers.update_in(path, patches)
    got = {r.id: (r.amount, r.category) for r in spark.read.parquet(path).collect()}
    assert got == {"0": (0.0, "food"), "1": (5.0, "x"), "2": (2.0, "food")}


def test_dedupe_keeps_rows_without_ids(spark):
    data = [(None, "a", 1.0, "x"), ("5", "b", 1.0, None), (None, "b", 1.0, "y"), (None, "a", 1.0, "z")]
    df = spark.createDataFrame(data, "id string, description string, amount double, category string")
    out = dedupe_transactions(df, ("description", "amount")).collect()
    assert sorted((r.id or "", r.description, r.category or "") for r in out) == [
        ("", "a", "x"), ("5", "b", "")]


def test_uploads(spark, tmp_path):
    text = "DATE,TRANSACTION DETAILS, WITHDRAWAL AMT , DEPOSIT AMT \n2024-01-02,UBER RIDE,5.5,\n"
    drop = tmp_path / "drop"
    drop.mkdir()
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    for name, more in (("a", "2024-01-02,UBER RIDE,5.5,\n2024-01-03,UBER RIDE,5.5,\n"),
                       ("b", ""), ("c", "2019-05-05,LATE RENT,7,\n")):
        (drop / f"{name}.csv").write_text(text + more)
        ingest_stream(spark, str(drop), table, progress, dedupe="10 days").awaitTermination()
    got = spark.read.parquet(table)
    assert got.columns == ["transaction_date", "description", "amount", "category"]
    assert sorted((str(r.transaction_date)[:10], r.amount) for r in got.collect()) == [
        ("2019-05-05", -7.0), ("2024-01-02", -5.5), ("2024-01-03", -5.5)]
    n, sample = ingest_upload(spark, str(drop / "a.csv"), str(tmp_path / "batch"))
    assert n == 3 and sample.columns == got.columns


def test_scratch_tables_are_deleted(spark, tmp_path):
    kept = session.new_path(spark, "kept")
    rows(spark, 2).write.parquet(kept)
    with session.scratch(spark):
        inner = session.new_path(spark, "inner")
        rows(spark, 3).write.parquet(inner)
        spark.read.parquet(inner).write.parquet(str(tmp_path / "out"))
        assert spark.read.parquet(inner).count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert spark.read.parquet(kept).count() == 2
    with pytest.raises(AnalysisException):
        spark.read.parquet(inner)
    session.drop_path(spark, kept)
