"""Nearest neighbours by a block matrix join.

Queries and rows are dealt into large blocks, in their own type, and every query block meets every row block once. In a task, int8 codes
of a tile are multiplied exactly and scaled to estimates of the cosine; the residuals of the codes bound each estimate's error.
Only pairs whose upper bound reaches the best lower bounds are computed again from the original vectors in double precision,
and heaps keep each query's best. No candidate is lost: the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import saved

K, PAIRS = 5, 100_000
#: Numbers of a query block and of a row block (a row block has at least LEAST_ROWS rows while tasks are idle); queries and rows of a tile.
QUERY_BLOCK, ROW_BLOCK, LEAST_ROWS, QUERY_TILE, TILE = 500_000, 2_000_000, 2048, 1024, 2048
#: Components up to which sums of products of codes are whole numbers in float32.
FLOAT_COMPONENTS = 1000


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as doubles, each times the power of two that brings its greatest component near 1, which is exact and leaves cosines as they are."""
    vectors = np.array([np.asarray(x, np.float64) for x in column], np.float64).reshape(len(column), -1)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


class Codes:
    """int8 codes of unit vectors with a scale for each, and the length of what the codes miss."""

    def __init__(self, vectors: np.ndarray):
        unit = vectors / np.abs(vectors).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        scale = np.abs(unit).max(1, keepdims=True) / 127
        codes = np.rint(unit / scale)
        self.codes, self.scale = codes.astype(np.int8), scale[:, 0]
        self.missed = np.sqrt(((unit - codes * scale) ** 2).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, summed component by component from the first."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row indexes that suffice: rows repeated whole once, and of equal vectors the K + 1 smallest ids, which beat all the others."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8)))[:, 0], return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    new = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
    order, s = order[new], s[new]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[place <= K]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> list[list[tuple[float, int]]]:
    """Each query's k best (cosine, -id) of the rows with another id, best first."""
    keep = _distinct(ids, vectors)
    ids, vectors = ids[keep], vectors[keep]
    out = []
    for at in range(0, len(query_ids), QUERY_TILE):
        out += _search_tiles(query_ids[at : at + QUERY_TILE], queries[at : at + QUERY_TILE], ids, vectors, k)
    return out


def _search_tiles(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    exact = np.float32 if vectors.shape[1] <= FLOAT_COMPONENTS else np.float64
    q, heaps = Codes(queries), [[] for _ in query_ids]
    reached = np.full(len(query_ids), -np.inf)
    for at in range(0, len(ids), TILE):
        own, rows = ids[at : at + TILE], vectors[at : at + TILE]
        c = Codes(rows)
        estimate = (q.codes.astype(exact) @ c.codes.astype(exact).T) * q.scale[:, None] * c.scale
        bound = (1 + q.missed[:, None]) * c.missed + q.missed[:, None] + 1e-9
        lower, upper = estimate - bound, estimate + bound
        itself = query_ids[:, None] == own
        lower[itself] = upper[itself] = -np.inf
        if len(own) >= k:
            reached = np.maximum(reached, np.partition(lower, len(own) - k, 1)[:, len(own) - k])
        left, right = np.nonzero((upper >= reached[:, None]) & ~itself)
        for part in range(0, len(left), PAIRS):
            x, y = left[part : part + PAIRS], right[part : part + PAIRS]
            for n, score, vec in zip(x.tolist(), cosines(queries[x], rows[y]).tolist(), own[y].tolist(), strict=True):
                item = (score, -vec)
                if item in heaps[n]:
                    continue
                if len(heaps[n]) < k:
                    heapq.heappush(heaps[n], item)
                elif item > heaps[n][0]:
                    heapq.heapreplace(heaps[n], item)
        reached = np.array([max(r, h[0][0] - 1e-9) if len(h) == k else r for r, h in zip(reached, heaps, strict=True)])
    return [sorted(h, reverse=True) for h in heaps]


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query row of ``embeddings`` (vec_id, embedding), by cosine.

    Ties go to the smaller vec_id. Vectors that are null, zero, or hold null or non-finite components, and rows without a vec_id, take no part;
    only vectors of one length are compared. Rows that repeat a vec_id at the same score count once, wherever they lie; a query id with several
    vectors asks with the least of them. A pair of vectors of any length is held whole in one task, with its block. Fewer rows than k give all of them; an empty table gives none; extra columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    queries = saved(rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    number, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    longest = max(1, longest or 1)
    tasks = min(embeddings.sparkSession.sparkContext.defaultParallelism, -(-number // LEAST_ROWS))
    query_blocks = max(1, -(-queries.count() * longest // QUERY_BLOCK))
    row_blocks = max(1, tasks, -(-number * longest // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    length = F.size("embedding").alias("length")
    asked = queries.select(length, F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("qb"), every(row_blocks).alias("rb"), "vec_id", "embedding")
    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(row_blocks)).alias("rb")  # other vectors under one id lie elsewhere
    there = rows.select(length, every(query_blocks).alias("qb"), place, "vec_id", "embedding")

    def tile(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = q["vec_id"].to_numpy()
        best = search_block(ids, _matrix(q["embedding"]), r["vec_id"].to_numpy(), _matrix(r["embedding"]), k)
        return pd.DataFrame([(i, -v, s) for i, found in zip(ids.tolist(), best, strict=True) for s, v in found], columns=["query_id", "vec_id", "score"])

    key = ["length", "qb", "rb"]
    found = asked.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: op1 over all pairs.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2])) / (q.norm * r.norm) AS score
  FROM n q JOIN n r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
