"""Alignment of an image pair: shift by phase correlation, descriptor matches with a ratio test, and the policy over candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions.lineage import cut


def _surface(rows: pd.DataFrame) -> pd.DataFrame:
    """Phase correlation of one tile: for each shift its response."""
    y, x = rows["y"] - rows["y"].min(), rows["x"] - rows["x"].min()
    h, w = int(y.max()) + 1, int(x.max()) + 1
    a, b = np.zeros((h, w)), np.zeros((h, w))
    a[y, x], b[y, x] = rows["g1"], rows["g2"]
    cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    dy, dx = np.divmod(np.arange(h * w), w)
    shifts = {"dy": np.where(dy > h // 2, dy - h, dy).astype("int32"), "dx": np.where(dx > w // 2, dx - w, dx).astype("int32")}
    return pd.DataFrame({"pair_id": int(rows["pair_id"].iloc[0]), **shifts, "v": peak.ravel() * h * w, "share": np.where(np.arange(h * w) == 0, h * w, 0)})


def _tile_shifts(gray: DataFrame, tile: int) -> DataFrame:
    """The shift on which the tiles of each pair agree best, each counting by its size; of equal responses the smaller shift."""
    cell = [F.floor(F.col(c) / tile).alias(n) for c, n in (("y", "ty"), ("x", "tx"))]
    tiles = gray.select("pair_id", "y", "x", "g1", "g2", *cell).groupBy("pair_id", "ty", "tx")
    surfaces = tiles.applyInPandas(_surface, "pair_id long, dy int, dx int, v double, share int")
    total = surfaces.groupBy("pair_id", "dy", "dx").agg(F.sum("v").alias("v"), F.sum("share").alias("share"))
    order = F.struct(F.round("v", 9).alias("v"), (-F.abs("dy") - F.abs("dx")).alias("near"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"))
    best = total.groupBy("pair_id").agg(F.max(order).alias("b"), F.sum("share").alias("n"))
    return best.select("pair_id", (-F.col("b.y")).alias("dy"), (-F.col("b.x")).alias("dx"), (F.col("b.v") / F.col("n")).alias("response"))


def shifts(gray: DataFrame, tile: int = 512) -> DataFrame:
    """Whole-pixel shift of g2 against g1 in each pair.

    An image that exceeds a tile is shrunk to one first, which tells large shifts; then it is moved back by that and its tiles are correlated
    on their own, which tells the rest. No task holds more than a tile.
    """
    side = gray.groupBy("pair_id").agg(F.ceil((F.greatest(F.max("y"), F.max("x")) + 1) / tile).cast("int").alias("_f"))
    sized = gray.join(side, "pair_id")
    small = sized.groupBy("pair_id", "_f", F.floor(F.col("y") / F.col("_f")).alias("y"), F.floor(F.col("x") / F.col("_f")).alias("x")).agg(F.avg("g1").alias("g1"), F.avg("g2").alias("g2"))
    coarse = _tile_shifts(small, tile).join(side, "pair_id")
    coarse = cut(coarse.select("pair_id", (F.col("dy") * F.col("_f")).alias("dy"), (F.col("dx") * F.col("_f")).alias("dx"), "response", "_f"))
    large = coarse.filter("_f > 1")
    moved = shifted_back(gray.join(large, "pair_id", "left_semi"), large)
    fine = _tile_shifts(moved, tile).select("pair_id", F.col("dy").alias("_dy"), F.col("dx").alias("_dx"), F.col("response").alias("_r"))
    out = coarse.join(fine, "pair_id", "left")
    return out.select("pair_id", (F.col("dy") + F.coalesce("_dy", F.lit(0))).alias("dy"), (F.col("dx") + F.coalesce("_dx", F.lit(0))).alias("dx"), F.coalesce("_r", "response").alias("response"))


def shifted_back(gray: DataFrame, moves: DataFrame) -> DataFrame:
    """g2 moved by its shift; pixels without a source are left out, pairs without a shift unchanged."""
    second = gray.join(moves, "pair_id").select("pair_id", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "g2")
    return gray.select("pair_id", "y", "x", "g1").join(second, ["pair_id", "y", "x"])


def ratio_matches(a: DataFrame, b: DataFrame, ratio: float = 0.7, part: int = 2000) -> DataFrame:
    """Each descriptor of ``a`` (pair_id, id, v) with its nearest of all of ``b``, if clearly nearer than the second; ties go to the smaller id.

    Descriptors of a pair meet in parts of about ``part`` from either side, as matrices; each part gives two candidates, of which the best
    two of all parts count.
    """
    parts = lambda df: df.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / part).alias("n"))
    size = parts(a).withColumnRenamed("n", "na").join(parts(b).withColumnRenamed("n", "nb"), "pair_id")
    own, every = (lambda n: F.pmod(F.xxhash64("id"), n)), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    left = a.select("pair_id", "id", "v").join(size, "pair_id").select("pair_id", own("na").alias("pa"), every("nb").alias("pb"), "id", "v")
    right = b.select(*[F.col(c).alias(c) for c in ("pair_id", "id", "v")]).join(size, "pair_id")
    right = right.select(F.col("pair_id").alias("pair"), every("na").alias("qa"), own("nb").alias("qb"), F.col("id").alias("id"), F.col("v").alias("v"))

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(x) and len(y):
            y = y.sort_values("id")
            there, ids = np.stack(y["v"]).astype(float), y["id"].to_numpy()
            for pair, k, v in zip(x["pair_id"].tolist(), x["id"].tolist(), x["v"], strict=True):
                d = np.sqrt(((there - v) ** 2).sum(1))
                rows += [(pair, k, int(ids[n]), float(d[n])) for n in np.argsort(d, kind="stable")[:2]]
        return pd.DataFrame(rows, columns=["pair_id", "id", "other", "d"])

    d = left.groupBy("pair_id", "pa", "pb").cogroup(right.groupBy("pair", "qa", "qb")).applyInPandas(nearest, "pair_id long, id long, other long, d double")
    w = Window.partitionBy("pair_id", "id").orderBy("d", "other")
    near = d.withColumns({"place": F.row_number().over(w), "second": F.lead("d").over(w)}).filter("place = 1")
    return near.filter(F.col("second").isNotNull() & (F.col("d") < ratio * F.col("second"))).select("pair_id", "id", "other", "d")


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many systems at once; not-a-numbers where one has none."""
    out = np.full(b.shape, np.nan)
    sound = np.isfinite(a).all((1, 2))
    sound[sound] = np.linalg.cond(a[sound]) < 1e12
    out[sound] = np.linalg.solve(a[sound], b[sound][..., None])[..., 0]
    return out


def _from_samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The homography through four matches of each row (x2, y2 to x1, y1: arrays of 4), its last number being 1."""
    for rows in batches:
        x2, y2, x1, y1 = (np.stack(rows[c]) if len(rows) else np.zeros((0, 4)) for c in ("x2", "y2", "x1", "y1"))
        a, one, zero = np.zeros((len(rows), 8, 8)), np.ones_like(x2), np.zeros_like(x2)
        a[:, ::2] = np.stack([x2, y2, one, zero, zero, zero, -x1 * x2, -x1 * y2], 2)
        a[:, 1::2] = np.stack([zero, zero, zero, x2, y2, one, -y1 * x2, -y1 * y2], 2)
        h = _solved(a, np.stack([x1, y1], 2).reshape(len(rows), 8))
        good = np.isfinite(h).all(1)
        yield pd.DataFrame({"pair_id": rows["pair_id"][good], "trial": rows["trial"][good], "h": list(h[good])})


def _moved(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Where a homography (array of 8, the ninth is 1) takes a place."""
    w = h[6] * x + h[7] * y + 1
    w = F.when(F.abs(w) > 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def _near(rows: pd.DataFrame, h: np.ndarray, reach: float, block: int = 16384) -> np.ndarray:
    """For each homography (rows of 8) how many matches of one pair it takes to within ``reach`` pixels, in the operations of ``_moved``."""
    x1, y1, x2, y2 = (np.ascontiguousarray(rows[c], float) for c in ("x1", "y1", "x2", "y2"))
    level, n = (reach / float(rows["unit1"].iloc[0])) ** 2, np.zeros(len(h), int)
    w, at, product = np.empty((3, block))

    def linear(m: np.ndarray, last: float, u: np.ndarray, v: np.ndarray, out: np.ndarray) -> np.ndarray:
        np.multiply(u, m[0], out)
        np.add(out, np.multiply(v, m[1], product[: len(u)]), out)
        return np.add(out, last, out)

    with np.errstate(all="ignore"):
        for start in range(0, len(rows), block):
            u1, v1, u2, v2 = (c[start : start + block] for c in (x1, y1, x2, y2))
            size = len(u1)
            far = np.empty(size)
            for k, m in enumerate(h):
                below = linear(m[6:8], 1.0, u2, v2, w[:size])
                for c, (moved, there) in enumerate(((m[0:3], u1), (m[3:6], v1))):
                    d = linear(moved, moved[2], u2, v2, at[:size])
                    np.subtract(np.divide(d, below, d), there, d)
                    if c:
                        np.add(far, np.multiply(d, d, d), far)
                    else:
                        np.multiply(d, d, far)
                near = far <= level
                if near.any():
                    near &= np.abs(below, at[:size]) > 1e-12
                n[k] += np.count_nonzero(near)
    return n


def consensus(matches: DataFrame, trials: int = 512, reach: float = 4.0, least: int = 8, part: int = 50_000) -> DataFrame:
    """The homography from image 2 to image 1 on which most matches (pair_id, id, x1, y1, x2, y2) of a pair agree, within ``reach`` pixels.

    pair_id, matches, inliers, ratio, h (array of 9). Samples of four matches are drawn by hashes of pair and trial, so reruns agree; each
    gives a hypothesis, inliers are counted in parts of ``part`` matches that meet all hypotheses of their pair, the first of the best stays, and
    is fitted again to all its inliers by sums of products. A map that shrinks or grows areas more than tenfold, counts as none: null h and ratio 0. Pairs of fewer than ``least`` matches are left out.
    """
    order = Window.partitionBy("pair_id").orderBy("id", "x1", "y1", "x2", "y2")
    size = matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matches"), *(F.greatest(F.max(F.abs(f"x{k}")), F.max(F.abs(f"y{k}")), F.lit(1.0)).alias(f"unit{k}") for k in (1, 2))).filter(F.col("matches") >= least)
    unit = {c: F.col(c) / F.col(f"unit{c[1]}") for c in ("x1", "y1", "x2", "y2")}
    points = cut(matches.join(size, "pair_id").withColumns({"place": F.row_number().over(order) - 1} | unit).select("pair_id", "place", "x1", "y1", "x2", "y2", "unit1", "unit2"))
    drawn = size.select("pair_id", "matches", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    drawn = drawn.withColumn("places", F.array(*(F.pmod(F.xxhash64("pair_id", "trial", F.lit(k)), F.col("matches")).cast("int") for k in range(4)))).filter(F.size(F.array_distinct("places")) == 4)
    samples = drawn.select("pair_id", "trial", F.posexplode("places").alias("k", "place")).join(points, ["pair_id", "place"])
    listed = samples.groupBy("pair_id", "trial").agg(F.sort_array(F.collect_list(F.struct("k", "x1", "y1", "x2", "y2"))).alias("s"))
    listed = listed.select("pair_id", "trial", *(F.col(f"s.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    guesses = listed.mapInPandas(_from_samples, "pair_id long, trial int, h array<double>")
    guesses = cut(guesses)
    x, y = _moved(F.col("h"), F.col("x2"), F.col("y2"))
    near = F.pow(x - F.col("x1"), F.lit(2)) + F.pow(y - F.col("y1"), F.lit(2)) <= F.pow(reach / F.col("unit1"), F.lit(2))
    parts = points.withColumn("part", F.floor(F.col("place") / part).cast("int"))
    asked = size.select("pair_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("matches") - 1) / part).cast("int"))).alias("part")).join(guesses, "pair_id").select(F.col("pair_id").alias("pair"), F.col("part").alias("of"), F.col("trial").alias("trial"), F.col("h").alias("h"))

    def counted(rows: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        n = _near(rows, np.stack(h["h"]), reach) if len(rows) and len(h) else np.zeros(len(h), int)
        return pd.DataFrame({"pair_id": h["pair"], "trial": h["trial"], "inliers": n})

    partial = parts.groupBy("pair_id", "part").cogroup(asked.groupBy("pair", "of")).applyInPandas(counted, "pair_id long, trial int, inliers long")
    votes = partial.groupBy("pair_id", "trial").agg(F.sum("inliers").alias("inliers")).join(guesses, ["pair_id", "trial"])
    best = cut(votes.groupBy("pair_id").agg(F.max(F.struct("inliers", (-F.col("trial")).alias("t"), "h")).alias("b")).select("pair_id", "b.inliers", "b.h"))
    agreeing = points.join(best, "pair_id").filter(near)
    one, zero = F.lit(1.0), F.lit(0.0)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = [([x2, y2, one, zero, zero, zero, -x1 * x2, -x1 * y2], x1), ([zero, zero, zero, x2, y2, one, -y1 * x2, -y1 * y2], y1)]
    normal = F.array(*(F.sum(sum((r[i] * r[j] for r, _ in rows), F.lit(0.0))) for i in range(8) for j in range(8)))
    right = F.array(*(F.sum(sum((r[i] * v for r, v in rows), F.lit(0.0))) for i in range(8)))
    sums = agreeing.groupBy("pair_id").agg(normal.alias("a"), right.alias("b"), F.first("unit1").alias("unit1"), F.first("unit2").alias("unit2"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            a = np.stack(part["a"]).reshape(-1, 8, 8) if len(part) else np.zeros((0, 8, 8))
            b = np.stack(part["b"]) if len(part) else np.zeros((0, 8))
            h = np.stack([np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(a, b, strict=True)]) if len(part) else b
            u, v = (part[c].to_numpy()[:, None] for c in ("unit1", "unit2"))
            h = h * np.hstack([u / v, u / v, u, u / v, u / v, u, 1 / v, 1 / v])
            yield pd.DataFrame({"pair_id": part["pair_id"], "h": list(np.hstack([h, np.ones_like(u)]))})

    fits = sums.mapInPandas(fitted, "pair_id long, h array<double>")
    grows = F.abs(F.col("h")[0] * F.col("h")[4] - F.col("h")[1] * F.col("h")[3])
    sound = grows.between(0.1, 10.0)
    out = size.select("pair_id", "matches").join(best.select("pair_id", "inliers"), "pair_id", "left").join(fits, "pair_id", "left")
    return out.select("pair_id", "matches", F.coalesce("inliers", F.lit(0).cast("long")).alias("inliers"), F.when(sound, F.col("inliers") / F.col("matches")).otherwise(0.0).alias("ratio"), F.when(sound, F.col("h")).alias("h"))


def warped(gray: DataFrame, maps: DataFrame) -> DataFrame:
    """g2 as image 1 sees it: ``maps`` (pair_id, h) from image 2 to image 1 turned round, bilinear between the four pixels where a place
    comes from; places from beyond the frame are 0. Pairs without a map are left out."""
    m = [F.col("h")[k] for k in range(9)]
    back = F.array(
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4], m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6],
        m[2] * m[3] - m[0] * m[5], m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    )
    turned = maps.filter("h is not null").select("pair_id", back.alias("_b")).select("pair_id", F.transform("_b", lambda v: v / F.col("_b")[8]).alias("_b"))
    x, y = _moved(F.col("_b"), F.col("x").cast("double"), F.col("y").cast("double"))
    source = gray.select("pair_id", "y", "x", "g1").join(turned, "pair_id").select("pair_id", "y", "x", "g1", x.alias("sx"), y.alias("sy"))
    u, v = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    corner = lambda dy, dx, weight: F.struct((F.floor("sy") + dy).cast("int").alias("fy"), (F.floor("sx") + dx).cast("int").alias("fx"), weight.alias("weight"))
    four = F.array(corner(0, 0, (1 - u) * (1 - v)), corner(0, 1, u * (1 - v)), corner(1, 0, (1 - u) * v), corner(1, 1, u * v))
    asked = source.select("pair_id", "y", "x", "g1", F.explode(four).alias("c")).select("pair_id", "y", "x", "g1", "c.*")
    there = gray.select("pair_id", F.col("y").alias("fy"), F.col("x").alias("fx"), "g2")
    return asked.join(there, ["pair_id", "fy", "fx"], "left").groupBy("pair_id", "y", "x").agg(F.first("g1").alias("g1"), F.sum(F.coalesce("g2", F.lit(0)) * F.col("weight")).alias("g2"))


def policy(candidates: DataFrame) -> DataFrame:
    """Method and verdict of each pair from (pair_id, first_ratio, second_ratio, ncc_matched, ncc_direct), ratios null where a method found nothing.

    The first method stands at an inlier share of 0.25; below it the second is tried and kept only if better. From 0.35 the match decides, and is
    sound at a correlation of 0.55; else the direct method, sound at 0.50.
    """
    first, second = F.coalesce("first_ratio", F.lit(0.0)), F.coalesce("second_ratio", F.lit(0.0))
    use_second = (first < 0.25) & (second > first)
    ratio = F.when(use_second, second).otherwise(first)
    name = F.when(use_second, "second").otherwise("first")
    matched = ratio >= 0.35
    sound = F.when(matched, F.col("ncc_matched") >= 0.55).otherwise(F.col("ncc_direct") >= 0.50)
    method = F.when(matched & (F.col("ncc_matched") >= 0.55), name).when(matched, F.concat(name, F.lit("_rejected"))).otherwise("direct")
    return candidates.select("pair_id", method.alias("method"), F.coalesce(sound, F.lit(False)).alias("ok"))
