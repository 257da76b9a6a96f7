"""Least squares of many small models inside the JVM.

A regression needs the sums of products of its columns and nothing else. ``gram`` sums them for each
series as one aggregate; sums combine before the shuffle and no row leaves the JVM. What follows works
on one row per series: sub-models are picked from the same sums, solved by elimination over arrays,
and rolled forward.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this share of its column's own sum of squares counts as zero: the column is a
#: combination of earlier ones, and its coefficient is zero.
SINGULAR = 1e-11


def zero() -> Column:
    return F.lit(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def gram(columns: Sequence[Column], where: Column | None = None) -> Column:
    """Sums of products of all pairs of ``columns`` as a matrix, over the rows that have ``where``.
    The target stands last; a first column of ones makes the constant."""
    def total(x: Column, y: Column) -> Column:
        product = x * y if where is None else F.when(where, x * y)
        return F.coalesce(F.sum(product), zero())

    sums = {(i, j): total(columns[i], columns[j])
            for i in range(len(columns)) for j in range(i + 1)}
    return F.array(*[F.array(*[sums[max(i, j), min(i, j)] for j in range(len(columns))])
                     for i in range(len(columns))])


def inner(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero(), lambda s, x: s + x)


def system(sums: Column, places: Column, target: Column, penalty: Column | float = 0.0,
           free: int = 0) -> Column:
    """The normal equations of the columns ``places`` (from 0) for the column ``target``: rows of
    coefficients with the right side at the end. ``penalty`` is added to the diagonal of all but the
    first ``free`` columns."""
    ridge = penalty if isinstance(penalty, Column) else F.lit(float(penalty))

    def row(i: Column, n: Column) -> Column:
        def cell(j: Column, m: Column) -> Column:
            extra = F.when((m == n) & (n >= free), ridge).otherwise(zero())
            return F.get(F.get(sums, i), j) + extra

        return F.concat(F.transform(places, cell), F.array(F.get(F.get(sums, i), target)))

    return F.transform(places, row)


def solve(equations: Column) -> Column:
    """The solution of symmetric positive equations, by elimination. A column that depends on earlier
    ones gets the coefficient zero."""
    def of(rows: Column) -> Column:
        size = F.size(rows)
        steps = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
            F.array().cast("array<int>"))
        return let(F.transform(rows, lambda row, i: F.get(row, i)), lambda scale: F.transform(
            F.aggregate(steps, rows, lambda m, k: eliminate(m, k, scale)),
            lambda row: F.get(row, size)))

    def eliminate(rows: Column, k: Column, scale: Column) -> Column:
        pivot = F.get(F.get(rows, k), k)
        usable = F.abs(pivot) > SINGULAR * F.abs(F.get(scale, k))
        factor = F.when(usable, 1.0 / pivot).otherwise(zero())
        lead = let(factor, lambda f: F.transform(F.get(rows, k), lambda v: v * f))
        return let(lead, lambda own: F.transform(rows, lambda row, i: F.when(i == k, own).otherwise(
            let(F.get(row, k), lambda times: F.zip_with(row, own, lambda a, b: a - times * b)))))

    return let(equations, of)


def inverse_diagonal(equations: Column, place: int) -> Column:
    """The element at ``place`` of the diagonal of the inverse of the left side."""
    unit = F.transform(equations, lambda row, i: F.concat(
        F.slice(row, 1, F.size(row) - 1),
        F.array(F.when(i == place, F.lit(1.0)).otherwise(zero()))))
    return F.get(solve(unit), F.lit(place))


def residual_squares(sums: Column, places: Column, target: Column, coefs: Column) -> Column:
    """Sum of squared residuals of any coefficients, also of penalised ones; never negative."""
    whole = F.get(F.get(sums, target), target)
    own = inner(coefs, F.transform(places, lambda i: F.get(F.get(sums, i), target)))
    fitted = inner(coefs, F.transform(places, lambda i: inner(coefs, F.transform(
        places, lambda j: F.get(F.get(sums, i), j)))))
    return F.greatest(whole - 2 * own + fitted, zero())


def roll_forward(constant: Column, coefs: Column, last: Column, steps: int) -> Column:
    """The next ``steps`` values of ``x[t] = constant + coefs[0] x[t-1] + coefs[1] x[t-2] + ...``.
    ``last`` holds the latest known values, the newest first, as many as there are coefficients."""
    width = F.size(coefs)

    def step(state: Column, _: Column) -> Column:
        value = constant + inner(coefs, F.slice(state, 1, width))
        return F.concat(F.array(value), state)

    known = F.slice(last, 1, width)
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), known, step)
    return F.reverse(F.slice(whole, 1, steps))


def shock_weights(coefs: Column, steps: int) -> Column:
    """Weights of a shock 0, 1, ... steps later in the same recursion."""
    start = F.transform(coefs, lambda c: c * 0.0)
    return F.concat(F.array(F.lit(1.0)), roll_forward(zero(), coefs, F.concat(
        F.array(F.lit(1.0)), start), steps - 1)) if steps > 1 else F.array(F.lit(1.0))


def running(values: Column) -> Column:
    """Running sums of an array."""
    start = F.struct(zero().alias("sum"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct(
        (s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")),
        lambda s: s["out"])


def integrated(coefs: Column, order: Column, most: int = 2) -> Column:
    """Coefficients for the values themselves, from those for their differences of ``order`` at most
    ``most``: the product of both lag polynomials."""
    def once(c: Column) -> Column:
        # (1 - c1 B - c2 B^2 ...)(1 - B)
        left = F.concat(F.array(F.lit(1.0)), F.transform(c, lambda x: -x))
        both = F.zip_with(F.concat(left, F.array(zero())), F.concat(F.array(zero()), left),
                          lambda a, b: b - a)
        return F.slice(both, 2, F.size(c) + 1)

    def if_from(k: int) -> Callable[[Column], Column]:
        return lambda c: F.when(order >= k, once(c)).otherwise(c)

    for k in range(1, most + 1):
        coefs = let(coefs, if_from(k))
    return coefs


def stable(coefs: Column, radius: float = 0.999) -> Column:
    """Do all roots of ``z^k = c1 z^(k-1) + c2 z^(k-2) + ...`` lie inside the circle of ``radius``?
    Step-down recursion: the order is taken down one by one, and the last coefficient of every order
    on the way must lie between -1 and 1."""
    scaled = F.transform(coefs, lambda c, i: c / F.pow(F.lit(radius), i + 1))

    def down(state: Column, _: Column) -> Column:
        own, last = state["c"], F.element_at(state["c"], -1)
        head = F.slice(own, 1, F.size(own) - 1)
        lower = F.zip_with(head, F.reverse(head), lambda a, b: (a + last * b) / (1 - last * last))
        fine = state["ok"] & (F.abs(last) < 1)
        return F.struct(F.when(fine, lower).otherwise(head).alias("c"), fine.alias("ok"))

    # One pass for each coefficient; the place of the element is not used.
    return F.aggregate(scaled, F.struct(scaled.alias("c"), F.lit(True).alias("ok")), down,
                       lambda s: s["ok"])


#: The error function's part of the normal distribution after Abramowitz and Stegun
#: 26.2.17, with an error below 7.5e-8.
_NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """Share of the normal distribution below ``x``."""
    k = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    powers = zero()
    for c in reversed(_NORMAL):
        powers = (powers + c) * k
    tail = powers * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(x > 0, 1 - tail).otherwise(tail)
