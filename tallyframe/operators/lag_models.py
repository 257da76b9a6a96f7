"""Forecasts and tests by least squares, for all series at once and without Python.

Each series is summed into the products of its regression columns in one aggregate; solving, choosing
an order and rolling forward are array expressions on one row per series.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import least_squares as ls
from tallyframe.operators.timeseries import CATEGORY

MIN_POINTS = 10
Z95 = 1.96
ADF_MIN_POINTS = 20
# Response surface of the p-value of a unit-root test with a constant: limits of the
# statistic, the point where the two polynomials meet, and their coefficients.
ADF_LOW, ADF_HIGH, ADF_MIDDLE = -18.83, 2.74, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def _known(columns: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def _span(a: Column, b: Column) -> Column:
    """The numbers a to b, none if b is smaller."""
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def _days_ahead(rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Forecast rows from one row ``(*keys, last, point, reach)`` with arrays per series."""
    steps = F.posexplode(F.arrays_zip("point", "reach")).alias("step", "at")
    return rows.select(*keys, "last", steps).select(
        F.lit(name).alias("forecaster"), *keys,
        F.date_add("last", F.col("step") + 1).alias("ds"),
        F.col("at.point").alias("amount"),
        (F.col("at.point") - F.col("at.reach")).alias("lower_bound"),
        (F.col("at.point") + F.col("at.reach")).alias("upper_bound"))


def forecast_lag_orders(
    series: DataFrame,
    days: int = 30,
    keys: Sequence[str] = CATEGORY,
    orders: Sequence[tuple[int, int, int]] = ((1, 0, 0),),
    alpha: float = 0.05,
) -> DataFrame:
    """ARIMA without moving averages: the order ``(p, d, 0)`` of least AIC for each series of
    ``MIN_POINTS`` points or more, point forecasts and an interval from the shock weights.

    All orders of a series are fitted on the same values, those that each of them can explain. Only
    undifferenced series have a constant. Orders whose recursion is not stable are passed over; where
    none is left, the mean with one sample deviation stands in. Points without a value take no part;
    where one of the latest values is unknown, so are the forecasts.
    """
    keys, orders = list(keys), list(dict.fromkeys((p, d) for p, d, q in orders))
    most_p, most_d = max(p for p, _ in orders), max(d for _, d in orders)
    own = Window.partitionBy(*keys)
    by_date = own.orderBy("date")
    rows = series.select(*keys, "date", F.col("amount").cast("double").alias("_w0")).withColumns(
        {"_n": F.count("*").over(own), "_i": F.row_number().over(by_date),
         "_mean": F.avg("_w0").over(own)})
    rows = rows.filter(F.col("_n") >= MIN_POINTS)
    for d in range(1, most_d + 1):
        rows = rows.withColumn(f"_w{d}", F.col(f"_w{d - 1}") - F.lag(f"_w{d - 1}").over(by_date))
    reach = {d: most_p if d else most_p + most_d for d in range(most_d + 1)}
    rows = rows.withColumns({f"_w{d}_{k}": F.lag(f"_w{d}", k).over(by_date)
                             for d in range(most_d + 1) for k in range(1, reach[d] + 1)})
    usable = [F.when(F.col("_n") - d > p + 3, F.lit(p + d)).otherwise(0) for p, d in orders]
    start = F.greatest(F.lit(0), *usable)
    sums = {}
    for d in range(most_d + 1):
        names = [*[f"_w{d}_{k}" for k in range(1, most_p + 1)], f"_w{d}"]
        # Without its mean, an undifferenced series loses no digits in the sums.
        values = [F.col(c) - F.col("_mean") if d == 0 else F.col(c) for c in names]
        # Orders of fewer lags than the largest explain early points too, so lags may be missing.
        ready = (F.col("_i") > start) & F.col(f"_w{d}").isNotNull()
        sums[d] = ls.gram([F.lit(1.0), *[F.coalesce(v, ls.zero()) for v in values]], ready)
    newest = F.array(F.col("_w0"), *[F.col(f"_w0_{k}") for k in range(1, reach[0] + 1)])
    fitted = rows.groupBy(*keys).agg(
        F.max("date").alias("last"), F.first("_n").alias("n"), F.first("_mean").alias("mean"),
        F.stddev_samp("_w0").alias("std"), F.max_by(newest, "date").alias("newest"),
        *[sums[d].alias(f"_sums{d}") for d in sums])
    tries = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("p"), F.lit(d).alias("d"),
                               F.col(f"_sums{d}").alias("sums")) for i, (p, d) in enumerate(orders)])
    tried = fitted.select(*keys, "last", "n", "mean", "std", "newest", F.explode(tries).alias("o")
                          ).select("*", "o.*").drop("o")
    target, first = F.lit(most_p + 1), F.when(F.col("d") == 0, 0).otherwise(1)
    tried = tried.withColumn("places", _span(first, F.col("p")))
    tried = tried.withColumn("coefs", ls.solve(ls.system(F.col("sums"), F.col("places"), target)))
    tried = tried.withColumns({
        "m": F.get(F.get("sums", F.lit(0)), F.lit(0)),
        "rss": ls.residual_squares(F.col("sums"), F.col("places"), target, F.col("coefs")),
        "ar": F.slice("coefs", 2 - first, F.col("p"))})
    variance = F.try_divide("rss", "m")
    aic = F.col("m") * (F.log(2 * math.pi * F.greatest(variance, F.lit(1e-12))) + 1) + 2 * (
        F.col("p") + 1 + (1 - first))
    fine = (F.col("n") - F.col("d") > F.col("p") + 3) & (
        F.col("m") > F.size("places") + 1) & ls.stable(F.col("ar"))
    shift = F.when(F.col("d") == 0, F.get("coefs", F.lit(0)) + F.col("mean") * (
        1 - F.aggregate("ar", ls.zero(), lambda a, b: a + b))).otherwise(ls.zero())
    choice = F.struct(aic.alias("aic"), "at", variance.alias("variance"), shift.alias("shift"),
                      ls.integrated(F.col("ar"), F.col("d"), most_d).alias("coefs"))
    best = tried.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("last", "mean", "std", "newest")],
        F.min(F.when(fine, choice)).alias("best"))
    spread = F.transform(ls.running(F.transform(
        ls.shock_weights(F.col("best.coefs"), days), lambda w: w * w)),
        lambda s: F.sqrt(F.col("best.variance") * s) * NormalDist().inv_cdf(1 - alpha / 2))
    flat = F.array_repeat
    out = best.withColumns({
        "point": F.when(F.col("best").isNull(), flat("mean", days)).otherwise(ls.roll_forward(
            F.col("best.shift"), F.col("best.coefs"), F.col("newest"), days)),
        "reach": F.when(F.col("best").isNull(), flat("std", days)).otherwise(spread)})
    return _days_ahead(out, "arima", keys)


def forecast_autoregressive(
    series: DataFrame,
    days: int = 30,
    keys: Sequence[str] = CATEGORY,
    n: int = 10,
    ridge: float = 1e-3,
) -> DataFrame:
    """One-step model on the last ``n`` values, scaled to their range and fitted with a ridge on all
    but the constant, rolled forward on its own predictions, for series of at least ``3 n`` points;
    95 % interval from the residuals of one step."""
    keys = list(keys)
    own = Window.partitionBy(*keys)
    by_date = own.orderBy("date")
    rows = series.select(*keys, "date", F.col("amount").cast("double").alias("y")).withColumns(
        {"n": F.count("*").over(own), "low": F.min("y").over(own), "high": F.max("y").over(own)})
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    rows = rows.filter(F.col("n") >= 3 * n).withColumn("span", span).withColumn(
        "x", (F.col("y") - F.col("low")) / F.col("span"))
    rows = rows.withColumns({f"x{k}": F.lag("x", k).over(by_date) for k in range(1, n + 1)})
    columns = [F.lit(1.0), *[F.col(f"x{k}") for k in range(1, n + 1)], F.col("x")]
    newest = F.array("x", *[f"x{k}" for k in range(1, n)])
    fitted = rows.groupBy(*keys).agg(
        F.max("date").alias("last"), F.first("low").alias("low"), F.first("span").alias("span"),
        F.max_by(newest, "date").alias("newest"),
        ls.gram(columns, _known(columns)).alias("sums"))
    places, target = F.sequence(F.lit(0), F.lit(n)), F.lit(n + 1)
    fitted = fitted.withColumn("places", places)
    fitted = fitted.withColumn("coefs", ls.solve(
        ls.system(F.col("sums"), F.col("places"), target, ridge, free=1)))
    m = F.get(F.get("sums", F.lit(0)), F.lit(0))
    rest = F.get(F.get("sums", F.lit(0)), target) - ls.inner(
        F.col("coefs"), F.slice(F.get("sums", F.lit(0)), 1, n + 1))
    squares = ls.residual_squares(F.col("sums"), F.col("places"), target, F.col("coefs"))
    std = F.sqrt(F.greatest(squares - rest * rest / m, ls.zero()) / (m - 1)) * F.col("span")
    point = ls.roll_forward(F.get("coefs", F.lit(0)), F.slice("coefs", 2, n), F.col("newest"), days)
    out = fitted.withColumns({"std": std, "point": F.transform(
        point, lambda v: v * F.col("span") + F.col("low"))})
    return _days_ahead(out.withColumn("reach", F.array_repeat(Z95 * F.col("std"), days)),
                       "autoregressive", keys)


def _waves(day: Column, period: float, order: int) -> list[Column]:
    angle = [day * F.lit(2 * math.pi * k / period) for k in range(1, order + 1)]
    return [f(a) for a in angle for f in (F.sin, F.cos)]


def _at(columns: Sequence[Column], coefs: Column, places: Column) -> Column:
    """Value of a fitted model whose ``coefs`` belong to the ``places`` of ``columns``."""
    return ls.let(F.array(*columns), lambda x: ls.inner(
        coefs, F.transform(places, lambda i: F.get(x, i))))


def forecast_fourier(
    series: DataFrame,
    days: int = 30,
    keys: Sequence[str] = CATEGORY,
    weekly: int = 3,
    yearly: int = 2,
    changepoints: int = 4,
    penalty: float = 0.05,
    form: str = "additive",
    floor: float = 0.1,
) -> DataFrame:
    """A trend with changes of slope, and weekly and yearly waves, with a 95 % interval from the
    residuals, for series of ``MIN_POINTS`` points or more.

    The trend is linear with ``changepoints`` possible changes of slope, spread evenly over the first
    four fifths of the history; ``weekly`` and ``yearly`` are numbers of sine and cosine pairs, the
    latter for series of two years or more. ``penalty``, as a share of the number of points, shrinks
    all but the level and the first slope.

    ``form="multiplicative"`` fits the trend first and then the waves as shares of it. The trend that
    it divides by is kept above ``floor`` times the mean absolute value, so a series that falls to
    zero does not blow up its season; series that are negative on average are fitted additively.
    """
    if form not in ("additive", "multiplicative"):
        raise ValueError(f"Unknown form: {form}")
    keys = list(keys)
    own = Window.partitionBy(*keys)
    rows = series.select(*keys, "date", F.col("amount").cast("double").alias("y")).withColumns({
        "n": F.count("y").over(own), "first": F.min("date").over(own),
        "last": F.max("date").over(own), "mean": F.avg("y").over(own),
        "scale": F.avg(F.abs("y")).over(own)})
    rows = rows.filter(F.col("n") >= MIN_POINTS).withColumns({
        "days": F.datediff("last", "first"),
        "scale": F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)})
    rows = rows.withColumn("y", F.col("y") / F.col("scale"))
    t = F.datediff("date", "first") / F.greatest(F.col("days"), F.lit(1))
    turns = [0.8 * (j + 1) / (changepoints + 1) for j in range(changepoints)]
    trend = [F.lit(1.0), t, *[F.greatest(t - c, ls.zero()) for c in turns]]
    day = F.unix_date("date").cast("double")
    waves = [*_waves(day, 7.0, weekly), *_waves(day, 365.25, yearly)]
    ends = {"last": F.max("date"), **{c: F.first(c) for c in ("first", "days", "mean", "scale")}}
    size = F.when(F.col("days") >= 730, len(waves)).otherwise(2 * weekly).cast("int")

    def fit(table: DataFrame, columns: list[Column], free: int, width: Column) -> DataFrame:
        whole = [*columns, F.col("y")]
        out = table.groupBy(*keys).agg(*[a.alias(c) for c, a in ends.items()],
                                       ls.gram(whole, F.col("y").isNotNull()).alias("sums"))
        out = out.withColumn("places", _span(F.lit(0), width.cast("int") - 1))
        # The sum of squares of the first column: the number of points, where that is the constant.
        ridge = penalty * F.get(F.get("sums", F.lit(0)), F.lit(0))
        return out.withColumn("coefs", ls.solve(ls.system(
            F.col("sums"), F.col("places"), F.lit(len(columns)), ridge, free))).drop("sums")

    def with_values(models: DataFrame, name: str, columns: list[Column], table: DataFrame
                    ) -> DataFrame:
        found = models.select(*[F.col(k).alias(f"_{k}") for k in keys], "places", "coefs")
        same = functools.reduce(lambda a, b: a & b,
                                [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        joined = table.join(found, same)
        return joined.withColumn(name, _at(columns, F.col("coefs"), F.col("places"))).drop(
            "places", "coefs", *[f"_{k}" for k in keys])

    ahead = rows.groupBy(*keys).agg(
        *[a.alias(c) for c, a in ends.items()]).withColumns({
            "date": F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days))),
            "y": F.lit(None).cast("double")})
    columns = ["date", "y", "first", "days", "mean", "scale"]
    rows = rows.select(*keys, *columns).unionByName(ahead.select(*keys, *columns))
    if form == "additive":
        whole = trend + waves
        models = fit(rows.where("y is not null"), whole, 2, F.lit(len(trend)) + size)
        rows = with_values(models, "fit", whole, rows)
    else:
        level = with_values(fit(rows.where("y is not null"), trend, 2, F.lit(len(trend))), "level",
                            trend, rows)
        guarded = F.when(F.col("mean") > 0, F.greatest(F.col("level"), F.lit(floor))).otherwise(1.0)
        level = level.withColumns({"base": guarded, "seen": F.col("y")}).withColumn(
            "y", (F.col("seen") - F.col("level")) / F.col("base"))
        columns = [F.lit(1.0), *waves]
        models = fit(level.where("y is not null"), columns, 1, F.lit(1) + size)
        rows = with_values(models, "share", columns, level)
        rows = rows.withColumns({"fit": F.col("level") + F.col("base") * F.col("share"),
                                 "y": F.col("seen")})
    rows = rows.withColumn("std", F.stddev_samp(F.col("y") - F.col("fit")).over(own))
    point, reach = (F.col(c) * F.col("scale") for c in ("fit", "std"))
    return rows.filter("y is null and fit is not null and date > first + days").select(
        F.lit("fourier").alias("forecaster"), *keys, F.col("date").alias("ds"),
        point.alias("amount"), (point - Z95 * reach).alias("lower_bound"),
        (point + Z95 * reach).alias("upper_bound"))


def unit_root_p_value(t: Column) -> Column:
    """Share of random walks with a smaller statistic, from the response surface for a constant."""
    def polynomial(coefs: Sequence[float]) -> Column:
        return functools.reduce(lambda acc, c: acc * t + c, reversed(coefs), ls.zero())

    inner = ls.normal_cdf(F.when(t <= ADF_MIDDLE, polynomial(ADF_SMALL)).otherwise(
        polynomial(ADF_LARGE)))
    return F.when(t < ADF_LOW, 0.0).when(t > ADF_HIGH, 1.0).otherwise(inner)


def augmented_test(
    series: DataFrame,
    keys: Sequence[str] = CATEGORY,
    max_lags: int = 4,
    level: float = 0.05,
) -> DataFrame:
    """Augmented Dickey-Fuller test of each series and of its first and second difference:
    ``t_stat_i, lags_i, p_value_i``, whether the series is stationary, and the order ``d``.

    The change is regressed on a constant, the level and 0 to ``max_lags`` earlier changes. All these
    are fitted on the same points, those that the longest can explain, and the number of earlier
    changes with the least AIC is taken. A series below 20 points counts as not stationary.
    """
    keys = list(keys)
    by_date = Window.partitionBy(*keys).orderBy("date")
    rows = series.select(*keys, "date", F.col("amount").cast("double").alias("y0"))
    for i in range(1, 4):
        rows = rows.withColumn(f"y{i}", F.col(f"y{i - 1}") - F.lag(f"y{i - 1}").over(by_date))
    rows = rows.withColumns({f"p{i}": F.lag(f"y{i}").over(by_date) for i in range(3)})
    rows = rows.withColumns({f"c{i}_{k}": F.lag(f"y{i + 1}", k).over(by_date)
                             for i in range(3) for k in range(1, max_lags + 1)})
    middle = Window.partitionBy(*keys)
    rows = rows.withColumns({f"p{i}": F.col(f"p{i}") - F.avg(f"p{i}").over(middle)
                             for i in range(3)})
    sums = []
    for i in range(3):
        columns = [F.lit(1.0), F.col(f"p{i}"), *[F.col(f"c{i}_{k}") for k in range(
            1, max_lags + 1)], F.col(f"y{i + 1}")]
        sums.append(ls.gram(columns, _known(columns)))
    fitted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    tries = F.flatten(F.transform("sums", lambda s, i: F.transform(
        F.sequence(F.lit(0), F.lit(max_lags)), lambda k: F.struct(
            i.alias("i"), k.alias("k"), s.alias("sums")))))
    tried = fitted.select(*keys, "n", F.explode(tries).alias("o")).select(*keys, "n", "o.*")
    target = F.lit(max_lags + 2)
    tried = tried.withColumn("places", F.sequence(F.lit(0), F.col("k") + 1))
    tried = tried.withColumn("left", ls.system(F.col("sums"), F.col("places"), target))
    tried = tried.withColumn("coefs", ls.solve(F.col("left")))
    m = F.get(F.get("sums", F.lit(0)), F.lit(0))
    rss = ls.residual_squares(F.col("sums"), F.col("places"), target, F.col("coefs"))
    spare = m - F.size("places")
    error = F.sqrt(F.try_divide(rss, spare) * ls.inverse_diagonal(F.col("left"), 1))
    aic = m * F.log(F.greatest(F.try_divide(rss, m), F.lit(1e-300))) + 2 * F.size("places")
    t_stat = F.try_divide(F.get("coefs", F.lit(1)), error)
    # A series below 20 points decides nothing; regressions need a point more than coefficients.
    usable = spare > 0
    best = tried.groupBy(*keys, "i").agg(
        F.first("n").alias("n"),
        F.min(F.when(usable, F.struct(aic.alias("aic"), "k", t_stat.alias("t")))).alias("b"))
    named = F.map_from_entries(F.collect_list(F.struct("i", F.struct(
        F.col("b.t").alias("t"), F.col("b.k").alias("k")))))
    tests = best.groupBy(*keys).agg(F.first("n").alias("n"), named.alias("by"))
    out = tests.select(*keys, "n", *[c for i in range(3) for c in (
        F.try_element_at("by", F.lit(i))["t"].alias(f"t_stat_{i}"),
        F.try_element_at("by", F.lit(i))["k"].cast("int").alias(f"lags_{i}"))])
    out = out.withColumns({f"p_value_{i}": unit_root_p_value(F.col(f"t_stat_{i}"))
                           for i in range(3)})
    steady = [F.coalesce((F.col("n") - i >= ADF_MIN_POINTS) & (F.col(f"p_value_{i}") < level),
                         F.lit(False)) for i in range(3)]
    order = F.when(steady[0], 0).when(steady[1], 1).when(steady[2], 2).otherwise(1)
    return out.withColumns({"is_stationary": steady[0], "d": order})
