"""Guarded statistics, and exact quantiles that never gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window


def share(part: Column, whole: Column) -> Column:
    """Percentage with a null for a zero whole."""
    return F.try_divide(part, whole) * 100


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent, null unless the old value is positive."""
    return F.when(old > 0, (new - old) / old * 100)


def correlation(y: str, x: str | Column) -> Column:
    """Pearson correlation of two columns without nulls; null, not an error, without variance."""
    spread = F.stddev_pop(y) * F.stddev_pop(x)
    return F.try_divide(F.covar_pop(y, x), spread)


def slope(y: str, x: str | Column) -> Column:
    """Least-squares slope; null, not an error, for a single point."""
    return F.try_divide(F.regr_sxy(y, x), F.regr_sxx(y, x))


def expense_of(amount: Column) -> Column:
    return F.when(amount < 0, -amount)


def income_of(amount: Column) -> Column:
    return F.when(amount > 0, amount)


ACCURACY = 10_000


class _Target:
    """One wanted quantile: its rank, and the value range that is known to hold it."""

    def __init__(self, column: str, prob: float, count: int):
        self.column, self.prob = column, prob
        position = prob * (count - 1)
        self.low_rank = int(position)
        self.part = position - self.low_rank
        self.high_rank = min(self.low_rank + 1, count - 1) if self.part else self.low_rank
        self.low, self.high, self.below, self.inside = -math.inf, math.inf, 0, count
        self.room = 3 / ACCURACY

    def grid(self) -> list[float]:
        """Shares of the rows in range between which both ranks lie, with room for the sketch."""
        first = (self.low_rank - self.below) / self.inside - self.room
        last = (self.high_rank - self.below + 1) / self.inside + self.room
        return [max(first, 0.0), min(last, 1.0)]

    def value(self) -> Column:
        return F.col(f"`{self.column}`").cast("double")

    def in_range(self) -> Column:
        return (self.value() >= self.low) & (self.value() <= self.high)


def _narrow(df: DataFrame, targets: list[_Target], small: int) -> None:
    """Close in on every target until few rows are left in its range. A round is two passes that
    return a few numbers: a sketch for a tighter range, then exact counts below and inside it."""
    open_targets = [t for t in targets if t.inside > small]
    while open_targets:
        before = [(t.low, t.high, t.below, t.inside) for t in open_targets]
        shared: dict[tuple, list[_Target]] = {}
        for target in open_targets:
            shared.setdefault((target.column, target.low, target.high), []).append(target)
        # Targets that still have the same range share one sketch.
        sketches = df.agg(
            *[
                F.percentile_approx(
                    F.when(group[0].in_range(), group[0].value()),
                    [share for target in group for share in target.grid()],
                    ACCURACY,
                )
                for group in shared.values()
            ]
        ).first()
        for group, found in zip(shared.values(), sketches):
            for i, target in enumerate(group):
                target.low, target.high = found[2 * i], found[2 * i + 1]
        counts = df.agg(
            *[F.count_if(t.value() < t.low) for t in open_targets],
            *[F.count_if(t.in_range()) for t in open_targets],
        ).first()
        again = []
        for i, (target, old) in enumerate(zip(open_targets, before)):
            target.below, target.inside = counts[i], counts[i + len(open_targets)]
            end = target.below + target.inside
            if not target.below <= target.low_rank <= target.high_rank < end:
                # The sketch was off by more than its bound: take the old range with more room.
                target.low, target.high, target.below, target.inside = old
                target.room *= 4
                if target.room < 1:
                    again.append(target)
            elif small < target.inside < old[-1] and target.low < target.high:
                again.append(target)
        open_targets = again


def _plain(column: str) -> Column:
    return F.nullif(F.col(f"`{column}`").cast("double"), F.lit(math.nan))


def quantile_sketch(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Aggregates that ``exact_quantiles`` starts from, to be taken along in a pass that is made
    anyway: the known values of each column, and a sketch of the ranges that hold the quantiles."""
    room = 3 / ACCURACY
    grid = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-room, room)]
    return [a for i, c in enumerate(columns) for a in (
        F.count(_plain(c)).alias(f"_known{i}"),
        F.percentile_approx(_plain(c), grid, ACCURACY).alias(f"_sketch{i}"))]


def _count(df: DataFrame, targets: list[_Target]) -> None:
    """Exact numbers below and inside the range of every target, in one pass. A range that turns out
    not to hold its ranks is opened again."""
    if not targets:
        return
    counts = df.agg(*[F.count_if(t.value() < t.low) for t in targets],
                    *[F.count_if(t.in_range()) for t in targets]).first()
    for i, target in enumerate(targets):
        below, inside = counts[i], counts[i + len(targets)]
        if below <= target.low_rank <= target.high_rank < below + inside:
            target.below, target.inside = below, inside
        else:
            target.low, target.high = -math.inf, math.inf


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    small: int = 100_000,
    sketch: Row | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of numeric columns as rows ``(column_name, prob, quantile)``.

    A sketch only tells where to look; the counts that follow are exact. The rows left in a range
    are grouped by value before they are ordered, so the ordered part has at most ``small`` rows
    per quantile, or one when a single value fills the range, however large the table is. ``sketch``
    is the row of ``quantile_sketch`` where the caller has it already; then two passes are left, and
    two more for each round that a range of more than ``small`` rows takes.
    """
    numbers = df.select(*[_plain(c).alias(c) for c in columns])
    if sketch is None:
        sketch = numbers.agg(*quantile_sketch(columns, probs)).first()
    targets = []
    for i, column in enumerate(columns):
        for j, prob in enumerate(probs if sketch[f"_known{i}"] else ()):
            target = _Target(column, prob, sketch[f"_known{i}"])
            target.low, target.high = sketch[f"_sketch{i}"][2 * j:2 * j + 2]
            targets.append(target)
    _count(numbers, targets)
    _narrow(numbers, targets, small)
    schema = "column_name string, prob double, low_rank long, high_rank long, part double, " \
             "low double, high double, below long"
    wanted = df.sparkSession.createDataFrame(
        [(t.column, t.prob, t.low_rank, t.high_rank, t.part, t.low, t.high, t.below)
         for t in targets], schema,
    )
    kept = []
    for column in columns:
        mine = [t.in_range() for t in targets if t.column == column]
        if mine:
            value = F.when(reduce(or_, mine), F.col(f"`{column}`"))
            kept.append(F.struct(F.lit(column).alias("column_name"), value.alias("value")))
    rows = numbers.select(F.inline(F.array(*kept))).filter("value is not null")
    counted = rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    near = counted.join(F.broadcast(wanted), "column_name").filter("value between low and high")
    order = Window.partitionBy("column_name", "prob").orderBy("value")
    near = near.withColumn("end", F.col("below") + F.sum("n").over(order))
    weight = F.when(F.expr("low_rank >= end - n and low_rank < end"), 1 - F.col("part")).otherwise(
        0.0
    ) + F.when(F.expr("high_rank >= end - n and high_rank < end"), F.col("part")).otherwise(0.0)
    return (
        near.withColumn("weight", weight)
        .filter("weight > 0")
        .groupBy("column_name", "prob")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("quantile"))
    )
