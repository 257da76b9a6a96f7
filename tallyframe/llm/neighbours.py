"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors
recomputed in double precision, heaps merged."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

QUERY_BLOCK, BLOCK = 2048, 8192  # rows of a tile's two sides
FOUND = "query_id long, vec_id long, score double"


def _vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` with doubles; vectors that are null, empty, zero or hold a null or
    non-finite component are left out."""
    vector = F.col("embedding").cast("array<double>")
    odd = lambda x: (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long"), vector.alias("embedding")).where(
        F.col("embedding").isNotNull() & ~F.exists("embedding", odd)
        & F.exists("embedding", lambda x: x != 0))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as int8 times a scale: the integers (as float32, whose products and sums up to 2**24
    are exact), the scales, the norms of what is lost, and the norms of the vectors."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    whole = np.rint(vectors / scale[:, None])
    lost = np.sqrt(((vectors - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.float32), scale, lost, np.sqrt((vectors ** 2).sum(axis=1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: float32 up to 1,000 dimensions, float64 beyond."""
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return left.astype(kind) @ right.astype(kind).T


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
         ) -> list[tuple[int, int, float]]:
    """The ``k`` best candidates of every query within one tile, exactly.

    With x = sX + e, the product of two vectors differs from that of their integers by at most
    |q||e| + |f||x| + |e||f| for the lost parts e and f. Candidates whose upper bound is under the
    k-th largest lower bound cannot be among the k best; the others are recomputed.
    """
    a, sa, fa, na = quantise(queries)
    b, sb, fb, nb = quantise(vectors)
    found = []
    for start in range(0, len(queries), 256):
        rows = slice(start, start + 256)
        rough = products(a[rows], b).astype(np.float64) * sa[rows, None] * sb
        slack = (na[rows, None] * fb + fa[rows, None] * nb + fa[rows, None] * fb) * (1 + 1e-9) + (
            1e-12 * na[rows, None] * nb)
        own = query_ids[rows, None] == ids
        low = np.where(own, -np.inf, rough - slack)
        if len(ids) > k:
            floor = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            floor = np.full(len(low), -np.inf)
        alive = (rough + slack >= floor[:, None]) & ~own
        for i in range(len(low)):
            at = np.flatnonzero(alive[i])
            # Sums run from the first component to the last, so equal vectors get equal scores.
            exact = np.cumsum(vectors[at] * queries[start + i], axis=1)[:, -1]
            best = np.lexsort((ids[at], -exact))[:k]
            found += [(int(query_ids[start + i]), int(ids[at[j]]), float(exact[j])) for j in best]
    return found


def nearest(rows: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK,
            block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of largest inner product for every
    row of ``rows`` (``vec_id, embedding``) where ``is_query`` holds, against all other rows.

    Queries and candidates are dealt to blocks by a hash of their id, about ``query_block`` and
    ``block`` rows each whatever the size of the table, and every query block meets every candidate
    block in one task. A tile returns at most ``k`` rows a query; heaps merge them. The result is
    exact: quantisation only spares work.

    * Vectors that are null, empty, zero, or hold null or non-finite components take no part, and
      neither do rows without an id. Vectors of different lengths do not meet.
    * Ties: the smaller ``vec_id`` comes first. A query's own row is every row with its id.
    * Repeated rows (same id and vector) count once; of different vectors under one id, each counts.
    * Fewer than ``k`` candidates: all of them. Empty tables: empty result.
    * Other columns are ignored, whatever they are called.
    """
    clean = _vectors(rows.where("vec_id is not null")).distinct()
    clean = stored(clean.withColumn("size", F.size("embedding")), "vectors")
    chosen = clean.where(is_query)
    total, asked = clean.count(), chosen.count()
    across, down = math.ceil(total / block) or 1, math.ceil(asked / query_block) or 1
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast(
        "int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chosen.withColumn("r", deal(down, "query")).withColumn("c", cells(across))
    right = clean.withColumn("c", deal(across, "candidate")).withColumn("r", cells(down))
    # Both sides come from one table: names of their own keep the columns of the tasks apart.
    right = right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns])

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        pairs = tile(queries["vec_id"].to_numpy(), np.stack(queries["embedding"].to_numpy()),
                     candidates["other_vec_id"].to_numpy(),
                     np.stack(candidates["other_embedding"].to_numpy()), k)
        return pd.DataFrame(pairs, columns=["query_id", "vec_id", "score"])

    keys = ["r", "c", "size"]
    found = left.groupBy(*keys).cogroup(
        right.groupBy(*[f"other_{c}" for c in keys])).applyInPandas(meet, FOUND)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        pairs = zip((-part["score"]).tolist(), part["vec_id"].tolist())
        best = heapq.nsmallest(k, dict.fromkeys(pairs))
        return pd.DataFrame({"query_id": part["query_id"].iloc[0],
                             "rank": range(1, len(best) + 1), "vec_id": [v for _, v in best],
                             "score": [-s for s, _ in best]})

    return found.groupBy("query_id").applyInPandas(
        merge, "query_id long, rank int, vec_id long, score double")


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs) WHERE rank <= 20
"""
