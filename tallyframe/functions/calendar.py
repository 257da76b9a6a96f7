"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency code -> (date_trunc unit, step of the dense spine).
FREQUENCIES = {
    "D": ("DAY", "interval 1 day"),
    "W": ("WEEK", "interval 7 days"),
    "M": ("MONTH", "interval 1 month"),
    "Q": ("QUARTER", "interval 3 months"),
    "Y": ("YEAR", "interval 1 year"),
}


def _unit(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"Unknown frequency: {freq}")
    return FREQUENCIES[freq][0]


def period_start(ts: Column, freq: str) -> Column:
    """First day of the period that holds ``ts``, whatever the session's time zone."""
    unit = _unit(freq)
    return F.to_date(ts) if unit == "DAY" else F.trunc(F.to_date(ts), unit)


def period_end(start: Column, freq: str) -> Column:
    """Last day of the period that begins on ``start``."""
    unit = _unit(freq)
    if unit == "DAY":
        return start
    if unit == "WEEK":
        return F.date_add(start, 6)
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
    return F.date_sub(F.add_months(start, months), 1)


def period_label(ts: Column, freq: str) -> Column:
    """Label of the period: the day itself, the closing Sunday, or the last day."""
    return period_end(period_start(ts, freq), freq)


def month_start(ts: Column) -> Column:
    return period_start(ts, "M")


def weekday(ts: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(ts)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days from ``earlier`` to ``later``, not calendar days."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def season(ts: Column) -> Column:
    month = F.month(ts)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.between(3, 5), "spring")
        .when(month.between(6, 8), "summer")
        .otherwise("fall")
    )


def is_holiday(ts: Column) -> Column:
    """1 January, 4 July, 25 December."""
    return F.date_format(ts, "MM-dd").isin("01-01", "07-04", "12-25").cast("int")
