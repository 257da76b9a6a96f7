"""Row filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in all columns. Plain null checks, which the optimizer drops for columns
    that cannot be null and pushes to the scan for the others; ``dropna`` hides them from it."""
    if not columns:
        return df
    return df.filter(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in columns]))
