"""Every query of the library against its SQL, on the smallest tables, and the queries that SQL cannot express against brute force."""

import glob
from pathlib import Path

import duckdb
import numpy as np
import pytest

from chronotile import plans
from chronotile.operators import masks as operators
from chronotile.plans import bridges
from scripts.compare import rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {Path(path).stem} as select * from read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def test_region_pipeline_of_every_run(spark):
    """R28 and R29 by plain loops over all runs."""
    runs = {}
    for r in bridges.regions(tables(spark)("lineitem"), tables(spark)("part")).collect():
        fill = r.area / (r.w * r.h)
        if r.area >= 1000 and fill >= 0.15 and not (r.w * r.h > 7500000 and fill < 0.35) and (r.confidence >= 0.24 or r.area >= 3000):
            runs.setdefault(r.run_id, []).append(r)
    want = set()
    for run, rows in runs.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.area, r.region_id)):
            near = []
            for k in kept:
                both = max(0, min(r.x + r.w, k.x + k.w) - max(r.x, k.x)) * max(0, min(r.y + r.h, k.y + k.h) - max(r.y, k.y))
                near.append(both / (r.w * r.h + k.w * k.h - both))
            if max(near, default=0) <= 0.45:
                kept.append(r)
        want |= {(run, n + 1, r.area, r.x, r.y, r.object_type) for n, r in enumerate(kept[:60])}
    got = {(r.run_id, r.id, r.area, r.x, r.y, r.object_type) for r in QUERIES["r29_region_pipeline"](spark, SF).collect()}
    assert got == want


def test_shifts_of_every_pair(spark):
    """P6 by whole-image phase correlation of all pairs."""
    images = {}
    for r in bridges.gray_pairs(tables(spark)("embeddings")).collect():
        images.setdefault(r.pair_id, np.zeros((2, 8, 8)))[:, r.y, r.x] = r.g1, r.g2
    got = {r.pair_id: (r.dy, r.dx) for r in QUERIES["p06_phase_shift"](spark, SF).collect()}
    assert got.keys() == images.keys()
    for pair, (a, b) in images.items():
        cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
        response = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        dy, dx = got[pair]
        assert response[dy % 8, dx % 8] >= response.max() - 1e-9


def test_cleaning_of_every_mask(spark):
    """M8 by array operations on all masks."""
    masks = {}
    for r in bridges.gray_pairs(tables(spark)("embeddings")).collect():
        masks.setdefault(r.pair_id, np.zeros((8, 8), bool))[r.y, r.x] = r.g1 >= 140

    def around(m, f):
        p = np.pad(m, 1, mode="edge")
        return f([p[a : a + 8, b : b + 8] for a in range(3) for b in range(3)], 0)

    def crossed(m, f):
        p = np.pad(m, 1, mode="edge")
        return f([p[1 + a : 9 + a, 1 + b : 9 + b] for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))], 0)

    def parts(m, reach=2):
        left, out = {tuple(v) for v in np.argwhere(m).tolist()}, []
        while left:
            todo, part = [left.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) <= reach} & left
                left -= near
                todo += near
            out.append(part)
        return out

    want = {}
    for pair, m in masks.items():
        m = around(m, np.sum) >= 5
        m = crossed(crossed(crossed(crossed(m, np.min), np.max), np.max), np.min)
        for part in parts(~m, 1):
            if all(0 < y < 7 and 0 < x < 7 for y, x in part):
                for y, x in part:
                    m[y, x] = True
        m = crossed(crossed(m, np.min), np.max)
        total = 0
        for part in parts(m):
            ys, xs = zip(*part, strict=True)
            w, h, n = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)
            drawn_out = (2 * (w + h)) ** 2 / (max(w * h, 1) + 1e-8) > 80 and n < 6 or max(w, h) / (min(w, h) + 1e-8) > 12 and n < 4
            total += n if n >= 2 and not drawn_out else 0
        want[pair] = total
    on = bridges.gray_pairs(tables(spark)("embeddings")).selectExpr("pair_id", "y", "x", "int(g1 >= 140) AS on")
    got = {r.pair_id: r.changed_pixels for r in operators.run_statistics(operators.clean(on, 0, 2)).collect()}
    assert got == want


def test_every_query_is_named_by_its_operator():
    assert len(QUERIES) > 120 and all("_" in n for n in QUERIES)
