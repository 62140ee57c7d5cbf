"""Neighbourhoods in tiles: the same as over whole arrays, wherever the borders of the tiles run, with one shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronotile.operators import crops, masks, pixels, regions, signals
from tests.test_operators import scene


def table(spark, *images):
    rows = [(k, y, x, float(v)) for k, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "pair_id long, y int, x int, v double")


def arrays(rows, column, *shapes):
    out = [np.full(s, np.nan) for s in shapes]
    for r in rows:
        out[r.pair_id][r.y, r.x] = r[column]
    return out


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


SHAPES = (19, 23), (7, 8), (1, 9), (6, 1), (16, 8)


@pytest.mark.parametrize("tile", [8, 512])
def test_neighbourhoods_across_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    images = [rng.integers(0, 255, s).astype(float) for s in SHAPES]
    kernel = pixels.gaussian(11, 1.5)

    def f(at, v):
        return {"blur": at.blurred(v["v"], kernel), "most": np.maximum.reduce(at.square(v["v"], repeat_edge=True)), "right": at.inside("x", 1).astype(float)}

    got = pixels.near(table(spark, *images), ["v"], 5, f, dict.fromkeys(("blur", "most", "right"), DoubleType()), tile=tile)
    assert shuffles(got) == 1
    rows = got.collect()
    assert len(rows) == sum(i.size for i in images)
    for image, blur, most, right in zip(images, *(arrays(rows, c, *SHAPES) for c in ("blur", "most", "right")), strict=True):
        p = np.pad(image, 5, mode="reflect")
        p = sum(w * p[k : k + image.shape[0]] for k, w in enumerate(kernel))
        assert blur == pytest.approx(sum(w * p[:, k : k + image.shape[1]] for k, w in enumerate(kernel)), abs=1e-9)
        q = np.pad(image, 1, mode="edge")
        assert (most == np.max([q[a : a + image.shape[0], b : b + image.shape[1]] for a in range(3) for b in range(3)], 0)).all()
        assert (right[:, -1] == 0).all() and (right[:, :-1] == 1).all()


def test_a_stencil_is_one_shuffle(spark):
    df = table(spark, np.arange(48.0).reshape(6, 8))
    on = df.select("pair_id", "y", "x", (F.col("v") % 3 == 0).cast("int").alias("on"))
    for out in (pixels.blur(df, ["v"], pixels.gaussian(5)), pixels.upscale(df, ["v"]), masks.dilate(on), masks.morphed(on, 5, F.greatest), masks.median3(on), signals.dissimilarity(df.withColumn("w", F.col("v") * 2), "v", "w", 5)):
        assert shuffles(out) == 1  # one for each axis before


def test_features_of_both_images_meet_their_pixels_once(spark):
    """gradients, patterns, contrast and likeness of both images had stencils and joins of pixels of their own."""
    random = np.random.default_rng(4)
    both = scene(spark, *(random.integers(0, 255, (9, 12, 3)).astype(np.uint8) for _ in range(2)))
    plan = regions._gradients(signals.coloured(both), ("1", "2"), True)
    assert shuffles(plan) == 1 and "lambda" not in plan._jdf.queryExecution().executedPlan().toString()
    assert shuffles(regions._summaries(both, ("1", "2"), True)) <= 6


@pytest.mark.parametrize("reach", [0, 1])
def test_labels_of_noise(reach):
    """Labels by arrays against a flood, many tiles at once."""
    import pandas as pd

    grid = np.random.default_rng(reach).random((6, 20, 31)) < 0.55
    p, y, x = np.nonzero(grid)
    got = masks._label(pd.DataFrame({"pair_id": p // 2, "ty": 0, "tx": p % 2, "y": y, "x": x, "mark": np.arange(len(p))}), reach)
    assert got["mark"].tolist() == list(range(len(p)))
    label = dict(zip(zip(p.tolist(), y.tolist(), x.tolist(), strict=True), got["label"].tolist(), strict=True))
    seen = set()
    for start in label:
        if start not in seen:
            seen.add(start)
            todo = [start]
            while todo:
                k, a, b = todo.pop()
                assert label[k, a, b] == start[1] << 32 | start[2]
                for da, db in ((0, 1), (0, -1), (1, 0), (-1, 0), *(((1, 1), (1, -1), (-1, 1), (-1, -1)) if reach else ())):
                    n = k, a + da, b + db
                    if n in label and n not in seen:
                        seen.add(n)
                        todo.append(n)


def test_hulls_across_tiles(spark):
    random = np.random.default_rng(8)
    images = [random.integers(60, 200, s).astype(float) for s in ((21, 30), (9, 9), (1, 5))]
    df = table(spark, *images)
    assert {r.pair_id: r.hull for r in crops.hull_ratios(df, tile=7).collect()} == {r.pair_id: r.hull for r in crops.hull_ratios(df).collect()}


def test_scenes_are_made_once(spark):
    """full scenes were found by making the pixels a second time; and boxes made the scenes again."""
    from chronotile import plans
    from chronotile.plans.bridges import scenes

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    vectors = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*(((F.col("id") * 7 + k * 13) % 90 / 100 - 0.45).cast("float") for k in range(64))).alias("embedding"))
    made = scenes(vectors)
    assert plan(made).count("posexplode") == 1
    assert {(r.pair_id, r["count"]) for r in made.groupBy("pair_id").count().collect()} == {(0, 1024), (1, 1024)}
    # counts of on pixels before and after come from the scenes that the features come from
    assert "parquet" not in plan(plans.queries()["r14_strip_components"](spark, "/root/testdata/sf0.001"))


def test_channels_of_score_and_confidence_are_made_once(spark, monkeypatch):
    """the hybrid method made four of the five channels twice. F10: both images go through the edges together."""
    from chronotile.operators import methods

    random = np.random.default_rng(6)
    both = scene(spark, *(random.integers(0, 255, (12, 12, 3)).astype(np.uint8) for _ in range(2)))
    calls, thin, edges = [], signals.thin_edges, signals.edge_change
    monkeypatch.setattr(signals, "edge_change", lambda df: calls.append("edge") or edges(df))
    monkeypatch.setattr(signals, "thin_edges", lambda *a: calls.append("thin") or thin(*a))
    got = methods.detect(both, "Hybrid AI", border=0, least=2)
    assert calls == ["edge", "thin"] and got.count() == 144
    want = {(r.y, r.x): r.confidence for r in signals.confidence_map(both).collect()}
    again = {(r.y, r.x): r.confidence for r in signals.confidence_map(both, channels=signals.signal_channels(both)).collect()}
    assert want == again


def test_small_pictures_are_dealt_once(spark):
    """pixels of small pictures went to the tiles before the first as well, a picture of 5 by 5 four times over."""
    small = table(spark, np.zeros((5, 5)), np.zeros((5, 5)))
    assert pixels.dealt(small, ["v"], 5).count() == 50
    wide = table(spark, np.zeros((3, 20)))
    assert {(r.ty, r.tx, r["count"]) for r in pixels.dealt(wide, ["v"], 2, tile=8).groupBy("ty", "tx").count().collect()} == {(0, 0, 30), (0, 1, 36), (0, 2, 18)}


@pytest.mark.parametrize("tile", [7, 512])
def test_sums_of_tiles(spark, tile):
    """features came from pixels that went to Python and back; now a tile gives one row, and lines over several tiles keep their ends."""
    rng = np.random.default_rng(tile)
    images = [rng.integers(0, 255, s).astype(float) for s in ((19, 23), (7, 7), (1, 9), (6, 1))]
    sums = pixels.tile_sums(table(spark, *images), ["v"], 5, lambda at, v: {"v": v["v"], "right": at.inside("x", 1).astype(float)}, ["v", "right"], ["v"], tile).cache()
    assert shuffles(sums) == 1
    assert sums.filter("pair_id = 0").count() == (12 if tile == 7 else 1)
    whole = sums.groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in ("n", "v", "right", "wrap_v"))).join(regions._wrapped(sums, ("1",)), "pair_id", "left").na.fill(0.0)
    for r in whole.collect():
        v = images[r.pair_id]
        assert (r.n, r.v, r.right) == (v.size, v.sum(), v.shape[0] * (v.shape[1] - 1))
        assert r.wrap_v + r.w1 == ((v[:, 0] - v[:, -1]) ** 2).sum() + ((v[0] - v[-1]) ** 2).sum()


def test_colours_of_arrays(spark):
    rng = np.random.default_rng(3)
    rgb = np.vstack([rng.integers(0, 256, (4000, 3)), np.repeat(np.arange(256)[:, None], 3, 1), [[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 0], [255, 0, 1]]])
    df = spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(rgb)], "k long, r int, g int, b int")
    c = [F.col(x) for x in "rgb"]
    rows = df.select("k", pixels.gray(*c).alias("gray"), pixels.lab(*c).alias("lab"), pixels.hsv(*c).alias("hsv")).orderBy("k").select("gray", "lab.*", "hsv.*").collect()
    found = pixels.colour_arrays(*rgb.T)
    for name in ("gray", *"labhsv"):
        assert found[name].tolist() == [r[name] for r in rows]


def test_corners_of_many_crops_at_once():
    """corners were sought crop by crop."""
    import pandas as pd

    def one(gray, apart=5):
        p = np.pad(gray.astype(float), 1, mode="reflect")
        h, w = gray.shape
        s = [p[a : a + h, b : b + w] for a in range(3) for b in range(3)]
        dx, dy = signals.gradient(s)

        def around(v):
            q = np.pad(v, 1, mode="reflect")
            return [q[a : a + h, b : b + w] for a in range(3) for b in range(3)]

        xx, yy, xy = (sum(around(v)) for v in (dx * dx, dy * dy, dx * dy))
        least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        good = (least > least.max() * 0.05) & (least == np.max(around(least), 0)) & (least > 0)
        good[[0, -1], :] = good[:, [0, -1]] = False
        taken = []
        for _, y, x in sorted((-least[y, x], y, x) for y, x in zip(*np.nonzero(good), strict=True)):
            if len(taken) < 100 and all((y - a) ** 2 + (x - b) ** 2 >= apart * apart for a, b in taken):
                taken.append((y, x))
        return len(taken)

    rng = np.random.default_rng(9)
    crops_ = [rng.integers(0, 256, (int(h), int(w))) for h, w in rng.integers(1, 30, (60, 2))] + [np.full((9, 9), 3), rng.integers(0, 256, (90, 80))]
    rows = pd.concat([pd.DataFrame({"pair_id": k, "ty": 0, "tx": 0, "y": y.ravel(), "x": x.ravel(), "g": v.ravel()}) for k, v in enumerate(crops_) for y, x in [np.indices(v.shape)]], ignore_index=True)
    got = regions._corner_counts(pixels.Near(rows), rows["y"].to_numpy(), rows["x"].to_numpy(), rows["g"].to_numpy())
    assert got.tolist() == [0 if min(v.shape) < 5 else one(v) for v in crops_] and got.max() == 100


@pytest.mark.parametrize("tile", [16, 512])
def test_channels_in_one_pass(spark, monkeypatch, tile):
    """each channel had stencils and a join of pixels of its own, and half and quarter images were tables."""
    random = np.random.default_rng(tile)
    rgb = [np.kron(random.integers(0, 255, (10, 11, 3)), np.ones((4, 4, 1)))[:37, :42] * 0.8 + random.integers(0, 50, (37, 42, 3)) for _ in range(2)]
    both = scene(spark, *(c.astype(np.uint8) for c in rgb)).cache()
    got = {(r.y, r.x): r for r in signals.signal_channels(both, tile).collect()}
    assert len(got) == 37 * 42
    for df, name in ((signals.colour_change(both), "colour"), (signals.structural_change(both), "dssim"), (signals.texture_change(both), "texture"), (signals.change_vectors(both), "cva"), (signals.edge_change(both), "edge")):
        assert max(abs(got[r.y, r.x][name] - r[name]) for r in df.collect()) < 1e-12
    factors = signals.vegetation_masks(both).join(signals.shadow_factors(both), ["y", "x"]).select("y", "x", (signals.vegetation_factor(F.col("veg1"), F.col("veg2")) * F.col("shadow")).alias("factor"))
    assert max(abs(got[r.y, r.x].factor - r.factor) for r in factors.collect()) < 1e-12
    calls = []
    monkeypatch.setattr(signals, "near", lambda *a, **k: calls.append(a[1]) or pixels.near(*a, **k))
    signals.signal_channels(both)
    assert len(calls) == 2  # the edges' and one for all others
