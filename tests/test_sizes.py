"""Results and costs that show only on larger or odd tables."""

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronotile.functions import geodesy
from chronotile.functions import scalars as X
from chronotile.operators import masks as M
from chronotile.operators import registration


def test_compact_numbers_beyond_a_thousand_millions(spark):
    rows = spark.createDataFrame([(950,), (1250,), (999_999,), (1_006_300_000,), (6_144_000_000_000,)], "n long")
    assert [r.c for r in rows.select("n", X.compact_number(F.col("n")).alias("c")).orderBy("n").collect()] == ["950", "1.2K", "1000.0K", "1006.3M", "6144000.0M"]


def test_log2_of_zero(spark):
    rows = spark.createDataFrame([(0.0,), (8.0,), (None,)], "v double").select(F.round(X.log2(F.col("v")), 6).alias("b"))
    assert [r.b for r in rows.collect()] == [-math.inf, 3.0, None]


def test_bounds_of_many_images_in_seconds(spark):
    k = F.col("id")
    code = F.element_at(F.array(*(F.lit(c) for c in (32643, 32760, 25832, 3857, 4326, 99, None))), (k % 7 + 1).cast("int"))
    plain = code.isNull() | (code == 4326)
    x, y, px = F.when(plain, k % 180).otherwise(300000 + k % 400000), F.when(plain, k % 80).otherwise(2000000 + k * 7919 % 5000000), F.when(plain, 0.001).otherwise(30.0)
    images = spark.range(60_000).select("id", code.alias("epsg"), F.array(px, px / 10, x.cast("double"), px / 20, -px, y.cast("double")).alias("t")).cache()
    start = time.time()
    found = images.select("id", geodesy.bounds(F.col("t"), F.lit(40), F.lit(30), F.col("epsg")).alias("b")).select("id", "b.*").cache()
    assert found.filter("west is null").count() == images.filter("epsg = 99").count()
    assert time.time() - start < 25
    # the same by plain columns, point by point
    few = images.filter("id % 1999 = 0").select("id", "epsg", "t", F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for s in (n / 22 for n in range(23)) for u, v in ((s, 0.0), (s, 1.0), (0.0, s), (1.0, s))))).alias("p"))
    px, py, t = F.col("p.u") * 40, F.col("p.v") * 30, F.col("t")
    places = few.select("id", geodesy.lng_lat(t[0] * px + t[1] * py + t[2], t[3] * px + t[4] * py + t[5], F.col("epsg")).alias("at"))
    want = places.groupBy("id").agg(F.min("at.lng").alias("w"), F.min("at.lat").alias("s"), F.max("at.lng").alias("e"), F.max("at.lat").alias("n"))
    off = F.greatest(F.abs(F.col("w") - F.col("west")), F.abs(F.col("s") - F.col("south")), F.abs(F.col("e") - F.col("east")), F.abs(F.col("n") - F.col("north")))
    assert want.join(found, "id").filter((off > 1e-10) | (F.col("w").isNull() != F.col("west").isNull())).count() == 0


def test_world_file_is_read_once(spark):
    rows = spark.createDataFrame([("0.5\n0\n0\n-0.25\n100\n50",), ("1 2 3",), ("a 0 0 1 2 3",), (None,)], "t string")
    out = rows.select(X.world_file(F.col("t"), F.lit(10), F.lit(10)).alias("f"))
    assert [r.f and (r.f.a, r.f.west, r.f.north, r.f.east, r.f.south) for r in out.collect()] == [(0.5, 99.75, 50.125, 104.75, 47.625), None, None, None]
    assert out._jdf.queryExecution().executedPlan().toString().count("split(") <= 2  # was once for each use of a number


def test_inliers_of_many_hypotheses_without_a_row_for_each():
    random = np.random.default_rng(1)
    rows = pd.DataFrame(random.random((5000, 4)), columns=["x1", "y1", "x2", "y2"]).assign(unit1=10.0)
    h = np.vstack([random.random((40, 8)), [0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 1, 0, -2, 0]])
    w = rows.x2.to_numpy()[:, None] * h[:, 6] + rows.y2.to_numpy()[:, None] * h[:, 7] + 1
    x, y = ((rows.x2.to_numpy()[:, None] * h[:, k] + rows.y2.to_numpy()[:, None] * h[:, k + 1] + h[:, k + 2]) / w for k in (0, 3))
    want = ((x - rows.x1.to_numpy()[:, None]) ** 2 + (y - rows.y1.to_numpy()[:, None]) ** 2 <= 0.16).sum(0)
    assert registration._near(rows, h, 4.0, 700).tolist() == want.tolist()


def test_many_small_tiles_in_one_call(spark):
    on = spark.range(3000).select(F.col("id").alias("pair_id"), F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (1, 1), (1, 3), (2, 4), (600, 600))))).alias("p")).select("pair_id", "p.*")
    calls = []

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        calls.append(rows.groupby("k").size().tolist())
        return rows

    frame = pd.DataFrame({"k": np.repeat(np.arange(50), 7)})
    for batch in (1, 6, 7, 100, 1000):
        calls.clear()
        got = list(M.by_whole_groups(whole, ["k"])(frame.iloc[n : n + batch] for n in range(0, len(frame), batch)))
        assert pd.concat(got)["k"].tolist() == frame["k"].tolist() and {n for sizes in calls for n in sizes} == {7}
    assert len(calls) == 2 or len(calls) == 1  # not one a group
    labels = M.components(on)
    assert labels.groupBy("pair_id").agg(F.count_distinct("label").alias("n")).filter("n != 3").count() == 0 and labels.count() == 15000


def test_slug_goes_through_its_patterns_once(spark):
    rows = spark.createDataFrame([("  Caf\u00e9 -- No. 7_",), ("",), ("--",), ("Cache",), (None,), ("x" * 100,)], "t string").select(X.slug(F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == ["cafe_no_7", "node", "node", "cache_1", "node", "x" * 64]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
