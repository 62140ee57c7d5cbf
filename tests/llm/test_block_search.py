import math
import random

import numpy as np
from pyspark.sql import functions as F

from chronotile.llm import block_search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, qb string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "r", "q") for i, v in rows], SCHEMA)


def brute(rows, step=50, k=5):
    ok = {(i, tuple(map(float, np.float32(v)))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in sorted({i: min(v for j, v in ok if j == i) for i, _ in ok if i % step == 0}.items()):
        found = sorted((-block_search.cosines(np.array([a]), np.array([b]))[0], i) for i, b in ok if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def got(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_matches_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(block_search, "ROW_BLOCK", 800)
    monkeypatch.setattr(block_search, "QUERY_BLOCK", 24)
    monkeypatch.setattr(block_search, "QUERY_TILE", 2)
    monkeypatch.setattr(block_search, "TILE", 30)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)] + [(1000, [1.0] * 8)]
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (2200, []), (2250, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2300, [1.0, 2.0])]
    rows += [(3000, [2.0] * 8), (3001, [1e-30] * 8), (3050, [-1.0] * 8)]
    assert got(block_search.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert got(block_search.nearest(table(spark, rows), F.col("vec_id") == 0)) == brute(rows)
    assert got(block_search.nearest(table(spark, []), F.col("vec_id") == 0)) == []


def test_driver_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(block_search.nearest(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_very_large_and_small_components(spark):
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, [x * 10.0 ** rng.choice((-200, 0, 200)) for x in v]) for i, v in enumerate(base)]
    far = [(i, [x * s for x in v]) for (i, v), s in zip(enumerate(base), [1e250, 1e-250] * 20, strict=True)]
    shape = "vec_id long, embedding array<double>"
    near = {(q, n): i for q, n, i, _ in got(block_search.nearest(spark.createDataFrame(list(enumerate(base)), shape), F.col("vec_id") % 5 == 0))}
    assert {(q, n): i for q, n, i, _ in got(block_search.nearest(spark.createDataFrame(far, shape), F.col("vec_id") % 5 == 0))} == near
    assert all(math.isfinite(s) for *_, s in got(block_search.nearest(spark.createDataFrame(rows, shape), F.col("vec_id") % 5 == 0)))


def test_many_components_stay_exact():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 4000))
    found = block_search.search_block(np.arange(5), vectors[:5], np.arange(60), vectors, 3)
    cos = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    np.fill_diagonal(cos, -2)
    assert [[-i for _, i in f] for f in found] == np.argsort(-cos[:5], axis=1)[:, :3].tolist()


def test_rows_that_repeat_over_many_blocks(spark, monkeypatch):
    """Every row twice, some under two vectors of one direction, in blocks of a few rows and in one: each neighbour once, the same either way."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += rows + [(k, [4 * x for x in v]) for k, v in rows[:40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for least in (20, 2048):
        monkeypatch.setattr(block_search, "LEAST_ROWS", least)
        monkeypatch.setattr(block_search, "ROW_BLOCK", 200 if least == 20 else 2_000_000)
        got = {}
        for r in block_search.nearest(df.repartition(7), F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert sorted(got) == list(range(0, 400, 50))
        for q, found in got.items():
            order = np.argsort(-(unit @ unit[q]), kind="stable")
            assert [v for _, v in sorted(found)] == [int(k) for k in order if k != q][:5]
