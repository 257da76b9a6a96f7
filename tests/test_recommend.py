"""Recommendation and report rules on small tables, with brute-force comparisons."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import recommend as ops
from tallyframe.operators import reports
from tallyframe.operators.aggregates import category_stats, monthly_summary, transaction_stats

TX = "transaction_date timestamp, description string, amount double, category string"


def t(*args):
    return dt.datetime(*args)


def brute_force_charges(frame, min_occurrences=3, max_variance=0.1):
    """The rule as stated: all neighbouring dates of a description, in whole days."""
    found = {}
    for name, group in frame.groupby("description"):
        charges = -group.amount[group.amount < 0]
        if len(group) < min_occurrences or len(charges) < min_occurrences:
            continue
        if charges.std() / charges.mean() > max_variance:
            continue
        dates = sorted(group.transaction_date)
        gaps = [(b - a).days for a, b in zip(dates, dates[1:])]
        if max(gaps) - min(gaps) > 5 or sum(gaps) == 0:
            continue
        every = sum(gaps) / len(gaps)
        found[name] = (charges.mean(), every, len(group), dates[-1], charges.mean() * 365 / every)
    return found


@pytest.fixture(scope="module")
def messy():
    """Steady, unsteady, crowded and same-day descriptions; one holds a third of all rows."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        step, at = rng.choice([1, 7, 14, 30, 31]), t(2022, 1, 1 + k % 28, rng.randrange(24))
        for _ in range(rng.randrange(1, 14)):
            rows.append((at, f"d{k}", -round(20 + k + rng.uniform(-1, 1) * rng.choice([0, 1, 9]), 2), "c"))
            at += dt.timedelta(days=step + rng.choice([0, 0, 1, -1 if step > 1 else 0, 3]),
                               minutes=rng.randrange(-300, 300))
        if k % 9 == 0:
            rows.append((at, f"d{k}", 500.0, "income"))
    hot = t(2022, 1, 1)
    for _ in range(200):
        rows.append((hot, "hot", -9.99, "c"))
        hot += dt.timedelta(hours=rng.randrange(1, 60))
    rows += [(t(2022, 3, 3, 5), "same instant", -5.0, "c")] * 4
    rows += [(t(2022, 3, 3, h), "one day", -5.0, "c") for h in range(4)]
    return rows


def test_recurring_charges_match_brute_force(spark, messy):
    want = brute_force_charges(pd.DataFrame(messy, columns=["transaction_date", "description", "amount", "c"]))
    df = spark.createDataFrame(messy, TX).repartition(7)
    got = {r.description: (r.amount, r.frequency_days, r.occurrences, r.last_date, r.annual_cost)
           for r in ops.recurring_charges(df).collect()}
    assert set(got) == set(want) and "hot" in got and len(got) > 5
    for name, values in want.items():
        assert got[name][3] == values[3]
        np.testing.assert_allclose([v for i, v in enumerate(got[name]) if i != 3],
                                   [v for i, v in enumerate(values) if i != 3])


def test_recurring_needs_an_amount(spark):
    with pytest.raises(ValueError):
        ops.recurring_charges(spark.createDataFrame([("a",)], "description string"))


def test_recurring_uses_withdrawals(spark):
    rows = [(t(2022, m, 1), "gym", 30.0) for m in range(1, 6)]
    df = spark.createDataFrame(rows, "transaction_date timestamp, description string, withdrawal double")
    assert ops.recurring_charges(df).first().amount == 30.0


@pytest.fixture(scope="module")
def year(spark):
    rows = []
    for m in range(1, 13):
        rows += [(t(2022, m, 5), "Groceries", -(400.0 if m < 10 else 700.0), "food")] * 2
        rows += [(t(2022, m, 1), "Rent", -900.0, "housing"), (t(2022, m, 1), "Salary", 2500.0, "income")]
    return spark.createDataFrame(rows, TX)


def test_patterns(year):
    got = {r.category: r for r in ops.spending_patterns(year).collect()}
    food = got["food"]
    assert (food.avg_spending, food.median_spending, food.recent_spending) == (950.0, 800.0, 1400.0)
    assert food.threshold == pytest.approx(950.0) and food.months_count == 12
    assert got["housing"].recent_trend == 1.0


def test_recent_months_are_global(spark):
    rows = [(t(2022, m, 1), "x", -10.0, "a") for m in range(1, 7)] + [(t(2022, 1, 1), "y", -5.0, "b")]
    got = {r.category: r.recent_spending for r in ops.spending_patterns(spark.createDataFrame(rows, TX)).collect()}
    assert got == {"a": 10.0, "b": 0.0}


def test_recommendations_text_and_order(year):
    recs = ops.recommendations(year).collect()
    assert [r.priority for r in recs] == sorted((r.priority for r in recs), reverse=True)
    assert {r.type for r in recs} == {"recurring_charge", "saving_opportunity", "high_spending"}
    high = next(r for r in recs if r.type == "high_spending")
    assert high.message == ("You've spent 47.4% more on food than usual. Consider limiting this to "
                            "save $450.0 next month.")
    assert (high.amount, high.savings_potential, high.priority, high.confidence) == (47.4, 450.0, 47, 0.8)
    rent = next(r for r in recs if r.description == "Rent")
    assert rent.message == ("We noticed a recurring charge of $900.0 for Rent. "
                            "Do you still use this service?")
    assert rent.priority == 70 and rent.category == "general"
    saving = next(r for r in recs if r.type == "saving_opportunity")
    assert saving.action in ops.SAVINGS_ACTIONS[saving.category] and saving.action in saving.message
    for r in recs:
        assert r.savings_potential >= 0 and 0 <= r.confidence <= 1 and r.message


def test_limit(year):
    assert ops.recommendations(year, limit=2).count() == 2


def test_cashflow_message_never_shows_a_negative_rate(spark):
    rows = [(t(2022, 1, d), f"x{d}", -100.0, None) for d in range(1, 13)] + [(t(2022, 1, 1), "in", 500.0, None)]
    rec = ops.rec_cashflow(spark.createDataFrame(rows, TX)).first()
    assert rec.message == ("Your current savings rate is only 0%. Reduce monthly expenses by $800.0 "
                           "to reach a healthier 20% savings rate.")
    assert (rec.priority, rec.savings_potential) == (85, 800.0)


def test_habit_fills_short_lists(spark):
    df = spark.createDataFrame([(t(2022, 1, 1), "x", -1.0, "food")], TX)
    recs = ops.recommendations(df).collect()
    assert [(r.type, r.priority, r.savings_potential) for r in recs] == [("financial_habit", 50, 100.0)]


def test_trend_rule(spark, year):
    fc = spark.createDataFrame([("food", -1500.0), ("food", -1300.0), ("housing", -950.0), ("new", -9.0)],
                               "category string, amount double")
    recs = ops.rec_spending_trend(ops.spending_patterns(year), fc).collect()
    assert [(r.category, r.percentage, r.priority, r.savings_potential) for r in recs] == [
        ("food", 47.4, 47, 225.0)]
    assert recs[0].message == "Your spending on food has increased by 47.4% over the last next month."


def test_patterns_by_account(spark):
    rows = [("a", t(2022, m, 1), -10.0, "food") for m in (1, 2, 3, 4)] + [("b", t(2020, 1, 1), -7.0, "food")]
    df = spark.createDataFrame(rows, "account_id string, transaction_date timestamp, amount double, category string")
    got = {r.account_id: r.recent_spending for r in ops.spending_patterns(df, keys=("account_id",)).collect()}
    assert got == {"a": 10.0, "b": 7.0}


def test_recommendation_report(year):
    recs = ops.recommendations(year)
    row = ops.recommendation_report(recs, k=2).first()
    assert len(row.top_recommendations) == 2
    assert row.savings_potential == pytest.approx(950 * 0.15 + 900 * 0.15)
    assert set(row.recommendation_by_type) == {"high_spending", "saving_opportunity", "recurring_charge"}


def test_report_summary(year):
    row = reports.report_summary(year).first()
    assert (row.days, row.transaction_count) == (338, 48)
    assert row.total_income == 30000.0 and row.monthly_income == pytest.approx(30000 / 11)
    assert row.recent_expenses == 3700.0 and row.recent_income == 2500.0


def test_recent_window_cuts_within_a_day(spark):
    rows = [(t(2022, 1, 1, 9), "x", -1.0, "a"), (t(2022, 1, 1, 11), "x", -2.0, "a"),
            (t(2022, 1, 31, 10), "x", -4.0, "a")]
    assert reports.report_summary(spark.createDataFrame(rows, TX)).first().recent_expenses == 6.0


def test_stability_and_trend(spark, year):
    row = reports.monthly_stability(year, "expense").first()
    assert row.stability == "stable" and row.months == 12
    assert reports.monthly_stability(year, "income").first().stability == "very stable"
    short = year.filter("month(transaction_date) < 3")
    assert reports.monthly_stability(short, "income").first().stability == "insufficient data"
    assert reports.monthly_trend(year, "income").isEmpty()
    trend = reports.monthly_trend(year, "expense").first()
    assert trend.interpretation == "increasing" and trend.percent_change == pytest.approx(600 / 1700 * 100)


def test_sections_skip_tiny_and_fold(spark):
    rows = [(t(2022, m, 1), "x", -a, c) for m in (1, 3) for c, a in
            (("big", 960.0), ("mid", 30.0), ("small", 9.4), ("tiny", 0.6))]
    df = spark.createDataFrame(rows, TX)
    got = {r.category: r for r in reports.category_section(df).collect()}
    assert set(got) == {"big", "mid"} and got["big"].month_to_month_change == 0.0
    assert {r.slice: round(r.percentage, 1) for r in reports.pie_buckets(df).collect()} == {
        "big": 96.0, "mid": 3.0, "Other": 1.0}
    assert {r.category for r in reports.expense_categories(df).collect()} == {"big", "mid"}


def test_null_categories_count_in_totals_only(spark):
    df = spark.createDataFrame([(t(2022, 1, 1), "x", -75.0, None), (t(2022, 1, 1), "x", -25.0, "a")], TX)
    assert [(r.category, r.percentage) for r in reports.expense_categories(df).collect()] == [("a", 25.0)]


def test_forecast_section(spark, year):
    fc = spark.createDataFrame([("food", -1600.0), ("food", -1480.0), ("Income", 9.0), ("new", 5.0)],
                               "category string, amount double")
    got = {r.category: r for r in reports.forecast_section(fc, year).collect()}
    assert set(got) == {"food", "new"}
    assert (got["food"].percentage_change, got["food"].direction) == (10.0, "increase")
    assert got["new"].direction is None and got["food"].forecast_period_days == 2


def test_financial_report_is_one_nested_row(spark, year):
    recs = ops.recommendations(year)
    text = reports.financial_report(year, recs).select(F.to_json(F.struct("*"))).collect()
    report = json.loads(text[0][0])
    assert report["summary"]["transaction_count"] == 48
    assert report["income_analysis"]["stability"]["stability"] == "very stable"
    assert [c["category"] for c in report["category_breakdown"]] == ["food", "housing"]
    assert "forecasts" not in report
    plain = reports.financial_report(year.drop("category"))
    assert "category_breakdown" not in plain.columns


def test_category_stats_of_an_absent_category(year):
    row = category_stats(year, "none", "2022-12-31").first()
    assert (row.transaction_count, row.total_amount, row.month_to_month_change) == (0, 0.0, None)
    food = category_stats(year, "food", "2022-12-31", "2022-01-01").first()
    assert food.month_to_month_change == 0.0 and food.average_transaction == 475.0


def test_transaction_stats_map(year):
    row = transaction_stats(year, "2022-12-31").first()
    assert row.categories == {"food": -1400.0, "housing": -900.0, "income": 2500.0}
    assert row.net_cashflow == 200.0


def test_monthly_summary_nesting(year):
    row = monthly_summary(year, k=1).orderBy("month").first()
    assert row.month == "2022-01" and len(row.top_categories) == 1
    assert row.top_categories[0].category == "housing" and row.top_categories[0]["count"] == 1


def test_tasks_are_sized_by_rows(spark, monkeypatch):
    rows = [(str(i), f"a{i % 5}", f"2024-{i % 4 + 1:02d}-{i % 7 + 1:02d}", f"shop {i % 9}",
             float(-10 - i % 3), "food" if i % 2 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, account_id string, day string, description string, "
                               "amount double, category string")
    df = df.withColumn("transaction_date", F.to_timestamp("day")).drop("day")
    keys = ("account_id",)
    jobs = {
        "charges": lambda: ops.recurring_charges(df, max_variance=9.0),
        "charges by key": lambda: ops.recurring_charges(df, max_variance=9.0, keys=keys),
        "patterns by key": lambda: ops.spending_patterns(df, keys=keys),
        "cashflow by key": lambda: ops.cashflow(df, keys, df.count()),
        "all by key": lambda: ops.all_recommendations(df, keys=keys),
    }

    def rounded(df):
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r])
                      for r in df.collect())

    want = {name: rounded(job()) for name, job in jobs.items()}
    monkeypatch.setattr(session, "ROWS", 10)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    for name, job in jobs.items():
        got = job()
        assert rounded(got) == want[name], name
        if name != "all by key":
            assert ", 12), REPARTITION_BY_NUM" in got._jdf.queryExecution().explainString(mode), name


def test_sums_and_lists_are_dealt_by_rows_not_by_the_session(spark, monkeypatch):
    rows = [(f"2024-{i % 4 + 1:02d}-{i % 7 + 1:02d}", f"a{i % 9}", f"shop {i % 9}", float(-10 - i % 3),
             "food") for i in range(120)]
    df = spark.createDataFrame(rows, "day string, account_id string, description string, "
                               "amount double, category string")
    df = df.withColumn("transaction_date", F.to_timestamp("day")).drop("day")
    keys = ("account_id",)
    monkeypatch.setattr(session, "ROWS", 10)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    ranked = ops.recommendations(df, keys=keys)
    jobs = {
        "charges": ops.recurring_charges(df),
        "ranked": ranked,
        "top": ops.top_recommendations(ranked, 2, keys),
        "report": ops.recommendation_report(ranked, keys=keys),
    }
    for name, got in jobs.items():
        plan = got._jdf.queryExecution().explainString(mode)
        assert plan.count("REPARTITION_BY_NUM") == 2, name
        assert "ENSURE_REQUIREMENTS" not in plan, name
    assert jobs["report"].count() == 9
