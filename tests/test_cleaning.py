"""Small hand-checked tables for the cleaning rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.text import amount_text, normalize_text, parse_currency
from tallyframe.operators import cleaning as ops
from tallyframe.sources.readers import (
    from_records, read_delimited, read_transactions, read_transactions_table,
)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_last_alias_wins_and_old_columns_stay(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "memo string, debit double, credit double, "
                                                       "transaction_amount double")
    out = ops.canonicalize_columns(df)
    assert out.columns == ["memo", "debit", "credit", "transaction_amount", "description", "amount"]
    assert rows(out.select("description", "amount")) == [("a", 3.0)]


def test_alias_overwrites_existing_standard_column(spark):
    df = spark.createDataFrame([(1.0, 9.0)], "amount double, amt double")
    assert rows(ops.canonicalize_columns(df).select("amount")) == [(9.0,)]


def test_names_that_differ_only_in_case(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string").toDF("DATE", "date")
    assert rows(ops.canonicalize_columns(df).select("transaction_date")) == [("y",)]


def test_map_columns_keeps_existing(spark):
    df = spark.createDataFrame([("old", "new")], "a string, b string").toDF("DATE", "transaction_date")
    assert ops.map_columns_if_missing(df).columns == ["DATE", "transaction_date"]


def test_derive_amount_bad_text_counts_zero(spark):
    df = spark.createDataFrame(
        [("10.5", None), ("x", "3"), (None, None), ("1,000", "5")], "w string, d string"
    ).toDF(" WITHDRAWAL AMT ", " DEPOSIT AMT ")
    assert [r.amount for r in ops.derive_amount(df).collect()] == [-10.5, 3.0, 0.0, 5.0]


def test_parse_currency(spark):
    texts = ["$1,234.56", "-$5", "abc", "", None, "1d", "NaN", " 7 ", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_currency(F.col("t"))).collect()]
    assert got == [1234.56, -5.0, None, None, None, None, None, 7.0, 1000.0]


def test_coerce_dates_formats(spark):
    texts = ["2020-02-29", "29-Jun-17", "bad", None, "2020-13-01", "03/04/2021"]
    df = spark.createDataFrame([(t,) for t in texts], "transaction_date string")
    got = [r[0] for r in ops.coerce_dates(df).collect()]
    assert got == [dt.datetime(2020, 2, 29), dt.datetime(2017, 6, 29), None, None, None,
                   dt.datetime(2021, 3, 4)]


def test_missing_columns_error(spark):
    with pytest.raises(ValueError, match=r"Required columns missing: \['amount'\]"):
        ops.clean_transactions(spark.createDataFrame([("2020-01-01", "a")], "date string, memo string"))


def test_clean_drops_critical_nulls_and_adds_category(spark):
    df = spark.createDataFrame(
        [("2020-01-01", None, "$5"), ("bad", "b", "1"), ("2020-01-02", "c", "x")],
        "date string, memo string, amt string",
    )
    out = ops.clean_transactions(df).select("description", "amount", "category")
    assert rows(out) == [("Unknown", 5.0, None)]


def test_clean_has_no_shuffle(spark):
    df = spark.createDataFrame([("2020-01-01", "a", "1")], "date string, memo string, amt string")
    assert "Exchange" not in ops.clean_transactions(df)._jdf.queryExecution().toString()


def test_validate_splits(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1), "a", 1.0), (None, None, float("nan"))],
        "transaction_date timestamp, description string, amount double",
    )
    good, bad = ops.validate_transactions(df)
    assert good.count() == 1
    assert bad.first().errors == ["transaction_date", "description", "amount"]


def test_select_expenses_modes(spark):
    signed = spark.createDataFrame([(-5.0,), (3.0,), (0.0,)], "amount double")
    assert rows(ops.select_expenses(signed).select("spending")) == [(5.0,)]
    assert rows(ops.select_expenses(signed, "auto").select("spending")) == [(5.0,)]
    positive = spark.createDataFrame([(5.0, 2.0), (3.0, 0.0)], "amount double, withdrawal double")
    assert rows(ops.select_expenses(positive, "auto").select("spending")) == [(2.0,)]
    plain = spark.createDataFrame([(5.0,), (0.0,)], "amount double")
    assert rows(ops.select_expenses(plain, "auto").select("spending")) == [(5.0,), (0.0,)]
    only = spark.createDataFrame([(4.0,), (0.0,)], "withdrawal double")
    assert rows(ops.select_expenses(only).select("spending")) == [(4.0,)]
    with pytest.raises(ValueError):
        ops.select_expenses(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        ops.select_expenses(plain, "other")


def test_dedupe_keeps_smallest_id(spark):
    df = spark.createDataFrame([("2", "x", 1.0), ("1", "x", 1.0), ("3", "y", 1.0)],
                               "id string, description string, amount double")
    out = ops.dedupe_transactions(df, ("description", "amount"))
    assert sorted(r.id for r in out.collect()) == ["1", "3"]
    assert out.columns == df.columns


def test_dedupe_without_id(spark):
    df = spark.createDataFrame([("x", 1.0, "b"), ("x", 1.0, "a"), ("y", 1.0, None)],
                               "description string, amount double, note string")
    out = ops.dedupe_transactions(df, ("description", "amount"))
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [("x", 1.0, "a"), ("y", 1.0, None)]
    assert ops.dedupe_transactions(df, df.columns).count() == 3


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(1, 300, 2**40, 0.5, 123456789.123, "a"), (-5, 2, 1, 1.5, 0.1, "a"), (3, 2, 1, 1.5, 0.1, "a")],
        "a long, b long, c long, d double, e double, f string",
    )
    assert dict(ops.narrow_types(df).dtypes)["d"] == "double"
    assert dict(ops.narrow_types(df, lossy=True).dtypes) == {
        "a": "tinyint", "b": "smallint", "c": "bigint", "d": "float", "e": "double", "f": "string"
    }
    flags = {r.column_name: r.dictionary_friendly for r in ops.profile_types(df).collect()}
    assert flags["f"] is True and flags["a"] is None


def test_normalize_text(spark):
    texts = ["UBER *TRIP 1234!", "  a_b\t12c 12 ", None, "Café №5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(normalize_text(F.col("t"))).collect()]
    assert got == ["uber trip NUM", "a b 12c NUM", "", "café №NUM"]


def test_amount_text(spark):
    df = spark.createDataFrame([(12.0,), (12.3,), (12.345,), (-0.5,), (12345678.9,)], "x double")
    got = [r[0] for r in df.select(amount_text(F.col("x"), 2)).collect()]
    assert got == ["12.0", "12.3", "12.35", "-0.5", "12345678.9"]


def test_readers(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported file format"):
        read_transactions(spark, "statement.txt")
    path = tmp_path / "t.csv"
    path.write_text("date,memo,amt\n2020-01-01,a,1.5\n")
    assert dict(read_transactions(spark, str(path)).dtypes)["amt"] == "double"
    path = tmp_path / "s.csv"
    path.write_text("a;b\n1;x\n")
    assert rows(read_delimited(spark, str(path))) == [(1, "x")]
    empty = read_transactions_table(spark, str(tmp_path / "none.parquet"))
    assert empty.count() == 0 and len(empty.columns) == 9


def test_from_records(spark):
    df = from_records(spark, [{"TRANSACTION DETAILS": "a", "amount": 1.0}])
    assert df.first().description == "a"
    with pytest.raises(ValueError, match="description"):
        from_records(spark, [{"amount": 1.0}])
