"""Per-pixel signals of change between two colour images (DataFrame expressions over a pixel table with r1..b1, r2..b2)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronotile.functions.lineage import cut
from chronotile.operators.pixels import KEY, Near, around, blur, clip, colour_arrays, gaussian, gray, hsv, lab, near, shrink, upscale

TINY = 1e-8


def coloured(df: DataFrame) -> DataFrame:
    """The pixel table with gray, LAB and HSV of both images."""
    add = {}
    for k in ("1", "2"):
        rgb = [F.col(c + k) for c in "rgb"]
        add |= {f"gray{k}": gray(*rgb), f"lab{k}": lab(*rgb), f"hsv{k}": hsv(*rgb)}
    return df.withColumns(add)


def excess_green(r: Column, g: Column, b: Column) -> Column:
    """2 g - r - b of the channels' shares, 0..1."""
    total = r + g + b + 1e-6
    return clip(2.0 * g / total - r / total - b / total, 0.0, 1.0)


def vegetation(r: Column, g: Column, b: Column, colour: Column) -> Column:
    """C2 before its blur: 0.4 green over red, 0.3 excess green, 0.3 green hue."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return 0.4 * one((g - r) / (g + r + 1e-6) > 0.08) + 0.3 * one(excess_green(r, g, b) > 0.05) + 0.3 * one(colour["h"].between(35, 85) & (colour["s"] > 30))


def vegetation_masks(df: DataFrame) -> DataFrame:
    """veg1, veg2 of each pixel, 0..1, blurred."""
    rgb = lambda k: [F.col(c + k) for c in "rgb"]
    raw = df.select(*KEY, *[vegetation(*rgb(k), hsv(*rgb(k))).alias(f"veg{k}") for k in ("1", "2")])
    return blur(raw, ["veg1", "veg2"], gaussian(11))


def vegetation_factor(veg1: Column, veg2: Column) -> Column:
    """Below 1 where both are green, above 1 where one is."""
    return (1 - 0.7 * F.least(veg1, veg2)) * (1 + 0.3 * F.abs(veg1 - veg2))


def shadow_factors(df: DataFrame) -> DataFrame:
    """C4: ``shadow``, 1 for real change down to 0.2 where only lightness moved."""
    c = coloured(df)
    d = lambda f: F.abs(F.col("lab1")[f] - F.col("lab2")[f])
    only = c.select(*KEY, F.when((d("l") > 18) & (d("a") + d("b") < 12), 1.0).otherwise(0.0).alias("shadow"))
    return blur(only, ["shadow"], gaussian(9)).withColumn("shadow", 1 - 0.8 * F.col("shadow"))


def scaled_to(df: DataFrame, column: str, q: float) -> DataFrame:
    """``column`` over its q-quantile in each pair, clipped to 0..1; left alone where the quantile is nothing."""
    top = df.groupBy("pair_id").agg(F.percentile(column, F.lit(q)).alias("_top"))
    return df.join(top, "pair_id").withColumn(column, F.when(F.col("_top") > TINY, clip(F.col(column) / F.col("_top"), 0.0, 1.0)).otherwise(F.col(column))).drop("_top")


def change_vectors(df: DataFrame) -> DataFrame:
    """``cva``, length of the LAB change vector, lowered where lightness makes most of it, over its 99.5 % quantile."""
    c = coloured(df)
    dl, da, db = ((F.col("lab2")[f] - F.col("lab1")[f]) / s for f, s in (("l", 100.0), ("a", 128.0), ("b", 128.0)))
    size, chroma = F.sqrt(dl * dl + da * da + db * db), F.sqrt(da * da + db * db)
    return scaled_to(c.select(*KEY, (size * clip(chroma / (size + TINY) * 2.5, 0.15, 1.0)).alias("cva")), "cva", 0.995)


def dissimilar(at, a: np.ndarray, b: np.ndarray, window: int, sigma: float) -> np.ndarray:
    """(1 - SSIM) / 2 of each pixel of two gray images under a Gaussian window."""
    a, b, kernel = a.astype(float), b.astype(float), gaussian(window, sigma)
    m1, m2, x11, x22, x12 = (at.blurred(v, kernel) for v in (a, b, a * a, b * b, a * b))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    v1, v2 = np.maximum(x11 - m1 * m1, 0.0), np.maximum(x22 - m2 * m2, 0.0)
    ssim = (2 * m1 * m2 + c1) * (2 * (x12 - m1 * m2) + c2) / ((m1 * m1 + m2 * m2 + c1) * (v1 + v2 + c2) + 1e-12)
    return np.clip((1 - ssim) / 2, 0.0, 1.0)


def dissimilarity(df: DataFrame, a: str, b: str, window: int, name: str = "dssim", sigma: float | None = None) -> DataFrame:
    """(1 - SSIM) / 2 under a Gaussian window (a sixth of it as deviation if none is given), five blurred products in one pass."""
    f = lambda at, v: {name: dissimilar(at, v[a], v[b], window, window / 6 if sigma is None else sigma)}
    return near(df, [a, b], window // 2, f, {name: DoubleType()})


def structural_change(df: DataFrame, window: int = 11) -> DataFrame:
    """``dssim``, 0.6 of the dissimilarity at full and 0.4 at half size."""
    grays = coloured(df).select(*KEY, F.col("gray1").cast("double").alias("gray1"), F.col("gray2").cast("double").alias("gray2"))
    half = dissimilarity(shrink(grays, ["gray1", "gray2"], 2), "gray1", "gray2", max(3, window // 2) | 1, "half")
    return dissimilarity(grays, "gray1", "gray2", window).join(upscale(half, ["half"]), list(KEY)).select(*KEY, (0.6 * F.col("dssim") + 0.4 * F.col("half")).alias("dssim"))


def binary_pattern(square: Column) -> Column:
    """Share of the 8 neighbours that are at least the centre."""
    return F.aggregate(F.transform(square, lambda v, i: F.when((i != 4) & (v >= square[4]), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v) / 8


def pattern_share(square: list) -> np.ndarray:
    """C8 over the arrays of ``Near.square``."""
    return sum((v >= square[4] for i, v in enumerate(square) if i != 4), np.zeros(len(square[4]))) / 8


def texture_change(df: DataFrame) -> DataFrame:
    """``texture``, difference of the two binary patterns; edges repeat beyond the frame."""
    share = lambda at, v: pattern_share(at.square(v, repeat_edge=True))
    f = lambda at, v: {"texture": np.abs(share(at, v["gray1"]) - share(at, v["gray2"]))}
    return near(coloured(df), ["gray1", "gray2"], 1, f, {"texture": DoubleType()})


def sobel(square: Column) -> Column:
    """struct<dx, dy> of a 3 x 3 square."""
    s = square
    return F.struct((s[2] + 2 * s[5] + s[8] - s[0] - 2 * s[3] - s[6]).alias("dx"), (s[6] + 2 * s[7] + s[8] - s[0] - 2 * s[1] - s[2]).alias("dy"))


def gradient(s: list) -> tuple:
    """``sobel`` over the arrays of ``Near.square``: dx, dy."""
    return s[2] + 2 * s[5] + s[8] - s[0] - 2 * s[3] - s[6], s[6] + 2 * s[7] + s[8] - s[0] - 2 * s[1] - s[2]


def thin_edges(df: DataFrame, column: str) -> DataFrame:
    """C10, first half: ``strength`` of local maxima of the gradient across its direction, 0 elsewhere, and the pair's ``low`` and ``high`` bounds from its median."""
    bounds = df.groupBy("pair_id").agg(F.median(column).alias("m")).select("pair_id", F.floor(F.greatest(F.lit(0.0), 0.67 * F.col("m"))).alias("low"), F.floor(F.least(F.lit(255.0), 1.33 * F.col("m"))).alias("high"))

    def thinned(at, v: dict) -> dict:
        dx, dy = gradient(at.square(v[column], repeat_edge=True))
        ax, ay = np.abs(dx), np.abs(dy)
        size = ax + ay
        n = at.square(size, repeat_edge=True)
        pairs = [np.maximum(n[a], n[b]) for a, b in ((3, 5), (1, 7), (0, 8), (2, 6))]
        across = np.select([ay <= ax * 0.4142, ax <= ay * 0.4142, dx * dy > 0], pairs[:3], pairs[3])
        return {"strength": np.where(size >= across, size, 0)}

    return near(df, [column], 2, thinned, {"strength": df.schema[column].dataType}).join(bounds, "pair_id")


def edge_change(df: DataFrame) -> DataFrame:
    """``edge``, 1 where only one image has an edge within a pixel."""
    from chronotile.operators.masks import dilate, hysteresis

    sides = F.inline(F.array(*(F.struct((F.col("pair_id") * 2 + k).alias("pair_id"), "y", "x", F.col(f"gray{k + 1}").alias("g")) for k in (0, 1))))
    e = cut(thin_edges(cut(coloured(df).select(sides)), "g"))  # both images as pictures of their own
    kept = hysteresis(e.select(*KEY, F.col("strength").alias("score"), F.greatest("low", "high").alias("high"), F.least("low", "high").alias("low")).filter("score > 0"))
    on = dilate(e.select(*KEY).join(kept.withColumn("on", F.lit(1)), list(KEY), "left").na.fill(0, ["on"]))
    change = F.sum(F.when(F.col("pair_id") % 2 == 0, F.col("on")).otherwise(-F.col("on")))
    return on.groupBy(F.floor(F.col("pair_id") / 2).alias("pair_id"), "y", "x").agg(F.abs(change).cast("double").alias("edge"))


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """C11: extremes, mean, population deviation and quantiles of each pair, to 4 places."""
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    s = df.groupBy("pair_id").agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), q.alias("q"))
    return s.select("pair_id", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")], *[F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("p50", "p90", "p99"))])


def signal_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each channel of each pair, mean of its top 5 % over the deviation of its lower half (plus 1e-8); 0 if the 95 % quantile is nothing.

    The formula is kept as it is: a channel whose lower half is constant outweighs all others.
    """
    cuts = df.groupBy("pair_id").agg(*[F.percentile(c, F.array(F.lit(0.95), F.lit(0.5))).alias(f"_{c}") for c in columns])
    j = df.join(cuts, "pair_id")
    top = lambda c: F.avg(F.when(F.col(c) >= F.col(f"_{c}")[0], F.col(c)))
    low = lambda c: F.stddev_pop(F.when(F.col(c) <= F.col(f"_{c}")[1], F.col(c)))
    return j.groupBy("pair_id").agg(*[(F.when(F.max(F.col(f"_{c}")[0]) > TINY, top(c)).otherwise(0.0) / (low(c) + TINY)).alias(c) for c in columns])


def weighted_channels(df: DataFrame, weights: DataFrame, columns: list[str], name: str = "fused") -> DataFrame:
    """C14: channels weighted by their pair's weights, which are made to sum to 1."""
    w = weights.select("pair_id", *[F.col(c).alias(f"w_{c}") for c in columns])
    total = reduce(lambda a, b: a + b, [F.col(f"w_{c}") for c in columns]) + TINY
    value = reduce(lambda a, b: a + b, [F.col(c) * (F.col(f"w_{c}") / total) for c in columns])
    return df.join(w, "pair_id").withColumn(name, value).drop(*[f"w_{c}" for c in columns])


def confidence_map(df: DataFrame, model: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """C14: ``confidence``, 0..1: colour, structure, texture and edge change weighted by 0.30, 0.25, 0.15 and 0.10, and 0.40 of the model's score
    (pair_id, y, x, score) where there is one; structure and texture over their pair's greatest. ``channels`` are those of ``signal_channels``
    if they are there already."""
    if channels is None:
        channels = signal_channels(df)
    weights = {"cva": 0.30, "dssim": 0.25, "texture": 0.15, "edge": 0.10}
    if model is not None:
        channels = channels.join(model.select(*KEY, F.col("score").alias("model")), list(KEY), "left").na.fill(0.0, ["model"])
        weights["model"] = 0.40
    scaled = over_maximum(cut(channels), ["dssim", "texture"])
    value = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]) / sum(weights.values())
    return scaled.select(*KEY, clip(value, 0.0, 1.0).alias("confidence"))


def over_maximum(df: DataFrame, columns: list[str]) -> DataFrame:
    top = df.groupBy("pair_id").agg(*[F.max(c).alias(f"_{c}") for c in columns])
    return df.join(top, "pair_id").withColumns({c: F.col(c) / (F.col(f"_{c}") + TINY) for c in columns}).drop(*[f"_{c}" for c in columns])


def colour_change(df: DataFrame) -> DataFrame:
    """C13's first channel: LAB distance at full, half and quarter size, averaged. Images must be at least 4 pixels wide and high."""
    planes = ["l1", "a1", "b1", "l2", "a2", "b2"]
    lab_planes = coloured(df).select(*KEY, *[F.col(f"lab{p[1]}")[p[0]].cast("double").alias(p) for p in planes])
    d = lambda c, s: (F.col(f"{c}1") - F.col(f"{c}2")) / s
    distance = F.sqrt(F.pow(d("l", 100.0), F.lit(2)) + F.pow(d("a", 128.0), F.lit(2)) + F.pow(d("b", 128.0), F.lit(2)))
    full = lab_planes.select(*KEY, distance.alias("c1"))
    half = upscale(shrink(lab_planes, planes, 2).select(*KEY, distance.alias("c2")), ["c2"])
    quarter = upscale(upscale(shrink(lab_planes, planes, 4).select(*KEY, distance.alias("c4")), ["c4"]), ["c4"])
    return full.join(half, list(KEY)).join(quarter, list(KEY)).select(*KEY, ((F.col("c1") + F.col("c2") + F.col("c4")) / 3).alias("colour"))


CHANNELS = ["colour", "dssim", "texture", "edge", "cva"]


def _blocks(rows: pd.DataFrame, values: dict[str, np.ndarray], factor: int) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """``shrink`` of the pixels of many tiles: the blocks' own places, and means of ``values``."""
    small = rows[["pair_id", "ty", "tx"]].assign(y=rows["y"] // factor, x=rows["x"] // factor)
    of, first = _placed(small)
    count = np.bincount(of)
    return small.iloc[first], {c: np.bincount(of, v) / count for c, v in values.items()}


def _placed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of its pixel in the order of tile, y and x; and a row of each pixel."""
    tile = np.cumsum(np.append(0, np.logical_or.reduce([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in ("pair_id", "ty", "tx")])))[: len(rows)]
    y, x = (rows[c].to_numpy().astype("int64") - int(rows[c].min()) for c in "yx")
    _, first, of = np.unique((tile * (int(y.max()) + 1) + y) * (int(x.max()) + 1) + x, return_index=True, return_inverse=True)
    return of, first


def _doubled(rows: pd.DataFrame, v: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """``upscale`` of the pixels of many tiles."""
    at = Near(rows)
    half = lambda a, axis, k: 0.75 * a + 0.25 * a[at.place(axis, 1, True)] if k else 0.25 * a[at.place(axis, -1, True)] + 0.75 * a
    four = [(p, q) for p in (0, 1) for q in (0, 1)]
    new = pd.concat([rows.assign(y=rows["y"] * 2 + p, x=rows["x"] * 2 + q, _v=half(half(v, "y", p), "x", q)) for p, q in four]).sort_values(["pair_id", "ty", "tx", "y", "x"], ignore_index=True)
    return new.drop(columns="_v"), new["_v"].to_numpy()


def _taken(rows: pd.DataFrame, others: pd.DataFrame, v: np.ndarray) -> np.ndarray:
    """Of ``others``, the values of the pixels in ``rows``; both hold the same tiles."""
    keys = ["pair_id", "ty", "tx", "y", "x"]
    return rows[keys].merge(others[keys].assign(_v=v), on=keys, how="left")["_v"].to_numpy()


def _all_channels(at: Near, v: dict) -> dict:
    """colour, dssim, texture and cva (before its quantile), and ``factor``, C3 times C4, of the pixels of many tiles."""
    one, two = (colour_arrays(*(v[f"{x}{k}"] for x in "rgb")) for k in "12")
    apart = lambda a, b: np.sqrt(sum(((a[n] - b[n]) / s) ** 2 for n, s in (("l", 100.0), ("a", 128.0), ("b", 128.0))))
    size, chroma = apart(one, two), np.sqrt(sum(((one[n] - two[n]) / 128.0) ** 2 for n in "ab"))
    both = {f"{n}{k}": c[n] for k, c in ((1, one), (2, two)) for n in ("l", "a", "b", "gray")}
    side = lambda small, k: {n: small[f"{n}{k}"] for n in "lab"}
    half_rows, half = _blocks(at.rows, both, 2)
    rows, half_colour = _doubled(half_rows, apart(side(half, 1), side(half, 2)))
    _, half_dssim = _doubled(half_rows, dissimilar(Near(half_rows), half["gray1"], half["gray2"], 5, 5 / 6))
    quarter_rows, quarter = _blocks(at.rows, both, 4)
    quarter_colour = _doubled(*_doubled(quarter_rows, apart(side(quarter, 1), side(quarter, 2))))
    share = lambda c: pattern_share(at.square(c["gray"], repeat_edge=True))
    green = lambda c, r, g: 0.4 * ((g - r) / (g + r + 1e-6) > 0.08) + 0.3 * (c["exg"] > 0.05) + 0.3 * ((c["h"] >= 35) & (c["h"] <= 85) & (c["s"] > 30))
    veg1, veg2 = (at.blurred(green(c, v[f"r{k}"].astype(float), v[f"g{k}"].astype(float)), gaussian(11)) for k, c in ((1, one), (2, two)))
    only = (np.abs(one["l"] - two["l"]) > 18) & (np.abs(one["a"] - two["a"]) + np.abs(one["b"] - two["b"]) < 12)
    return {
        "colour": (size + _taken(at.rows, rows, half_colour) + _taken(at.rows, *quarter_colour)) / 3,
        "dssim": 0.6 * dissimilar(at, one["gray"], two["gray"], 11, 11 / 6) + 0.4 * _taken(at.rows, rows, half_dssim),
        "texture": np.abs(share(one) - share(two)),
        "cva": size * np.clip(chroma / (size + TINY) * 2.5, 0.15, 1.0),
        "factor": (1 - 0.7 * np.minimum(veg1, veg2)) * (1 + 0.3 * np.abs(veg1 - veg2)) * (1 - 0.8 * at.blurred(only.astype(float), gaussian(9))),
    }


def signal_channels(df: DataFrame, tile: int = 512) -> DataFrame:
    """The five CHANNELS of each pixel, and ``factor``, C3 times C4. All but the edges come from one pass over tiles; images of half and quarter
    size reach 8 pixels beyond a tile, whose side is a multiple of 4."""
    names = ["colour", "dssim", "texture", "cva", "factor"]
    found = near(df, [f"{x}{k}" for k in "12" for x in "rgb"], 8, _all_channels, dict.fromkeys(names, DoubleType()), tile=tile)
    return cut(scaled_to(cut(found.join(edge_change(df), list(KEY))), "cva", 0.995))


def classical_score(df: DataFrame, registered: bool = True, channels: DataFrame | None = None) -> DataFrame:
    """``score``, 0..1: five channels weighted by C12, times C3 and C4, over the 99.5 % quantile, to the power 0.85, blurred."""
    df = cut(df) if channels is None else df
    scaled = over_maximum(signal_channels(df) if channels is None else channels, ["colour", "dssim", "texture"])
    if not registered:
        scaled = scaled.withColumns({"dssim": F.col("dssim") * 0.45, "edge": F.col("edge") * 0.45})
    fused = weighted_channels(scaled, signal_weights(scaled, CHANNELS), CHANNELS)
    fused = cut(fused.select(*KEY, (F.col("fused") * F.col("factor")).alias("score")))
    top = fused.groupBy("pair_id").agg(F.percentile("score", F.lit(0.995)).alias("q"), F.max("score").alias("m"))
    level = F.when(F.col("q") > TINY, F.col("q")).otherwise(F.col("m") + TINY) + TINY
    powered = fused.join(top, "pair_id").select(*KEY, F.pow(clip(F.col("score") / level, 0.0, 1.0), F.lit(0.85)).alias("score"))
    return blur(powered, ["score"], gaussian(5))


def gradient_features(df: DataFrame, column: str) -> DataFrame:
    """Gradient and contrast of each pixel of one gray column, for region features."""
    s = around(df, column, repeat_edge=True, keep=(column,))
    return s.select(*KEY, column, sobel(F.col("around")).alias("d"), binary_pattern(F.col("around")).alias("lbp"))


