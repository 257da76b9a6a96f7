"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import neighbours


def slow(rows, is_query, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, x in ok:
        if is_query(q):
            scores = []
            for i, y in ok:
                if i != q and len(x) == len(y):
                    total = 0.0
                    for a, b in zip(x, y):
                        total += a * b
                    scores.append((-total, i))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def check(spark, rows, k=5, **blocks):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "r", F.lit("x")).withColumn("size", F.lit(9))
    got = neighbours.nearest(df, F.col("vec_id") % 4 == 0, k, **blocks).collect()
    assert {tuple(r) for r in got} == slow(rows, lambda i: i % 4 == 0, k)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})


def test_random(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 8)))]
    rows += [(200 + i, rows[4][1]) for i in range(30)]  # many copies of one vector
    check(spark, rows, query_block=16, block=32)
    check(spark, rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [1.0, None]), (6, []), (7, [1.0, 2.0]), (8, [1e-300, 1e300]), (9, [3.0, -1.0]),
            (None, [1.0, 1.0]), (7, [1.0, 2.0]), (12, [1.0, 2.0, 3.0]), (13, [0.0, 1.0, 0.0])]
    check(spark, rows)
    check(spark, rows[:1])
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(empty, F.col("vec_id") % 4 == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 16)) * rng.uniform(0.01, 100, (50, 1))
    a, s, lost, norm = neighbours.quantise(x)
    rough = neighbours.products(a, a) * s[:, None] * s
    slack = norm[:, None] * lost + lost[:, None] * norm + lost[:, None] * lost
    assert (np.abs(rough - x @ x.T) <= slack * (1 + 1e-9) + 1e-9).all()
    assert np.abs(a).max() <= 127
