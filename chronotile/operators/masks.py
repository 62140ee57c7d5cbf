"""Thresholds, fusion, morphology and connected components of masks.

A mask table has a row for each pixel with ``on`` (0 or 1), or only the rows that are on where a function says so.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from chronotile.functions.lineage import cut
from chronotile.operators.graph import components as linked
from chronotile.operators.pixels import KEY, by_whole_groups, clip, in_whole_groups, near  # noqa: F401


def otsu(df: DataFrame, column: str) -> DataFrame:
    """M1: pair_id, otsu: the byte level that parts the histogram with the greatest variance between the parts; the first of equals."""
    counts = df.groupBy("pair_id", F.col(column).alias("v")).count()
    w = Window.partitionBy("pair_id")
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n, s = F.sum("count").over(upto), F.sum(F.col("count") * F.col("v")).over(upto)
    all_n, all_s = F.sum("count").over(w), F.sum(F.col("count") * F.col("v")).over(w)
    parts = counts.select("pair_id", "v", n.alias("n"), s.alias("s"), all_n.alias("an"), all_s.alias("as"))
    spread = F.when(F.col("n") < F.col("an"), F.pow(F.col("s") * F.col("an") - F.col("as") * F.col("n"), F.lit(2)) / (F.col("n") * (F.col("an") - F.col("n")).cast("double"))).otherwise(0.0)
    best = parts.select("pair_id", F.struct(F.round(spread, 3).alias("spread"), (-F.col("v")).alias("v")).alias("b")).groupBy("pair_id").agg(F.max("b").alias("b"))
    return best.select("pair_id", F.when(F.col("b.spread") > 0, -F.col("b.v")).otherwise(0).alias("otsu"))


def robust_thresholds(df: DataFrame, column: str, floor: int = 25, sensitivity: float = 0.5) -> DataFrame:
    """M1: pair_id, threshold: the greatest of floor, Otsu and median + 3 MAD, shifted by the sensitivity, 0..255."""
    m = df.groupBy("pair_id").agg(F.median(column).alias("m"))
    mad = df.join(m, "pair_id").groupBy("pair_id").agg(F.first("m").alias("m"), F.median(F.abs(F.col(column) - F.col("m"))).alias("mad"))
    shift = int((0.5 - min(1.0, max(0.0, sensitivity))) * 24)
    level = F.greatest(F.lit(float(floor)), F.col("otsu").cast("double"), F.col("m") + 3 * F.col("mad")) + shift
    return mad.join(otsu(df, column), "pair_id").select("pair_id", clip(level.cast("int"), 0, 255).alias("threshold"))


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the least node that the links (u, v) lead to: roots hang on lesser ones, then paths are shortened."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _label(rows: pd.DataFrame, reach: int = 1) -> pd.DataFrame:
    """Components of the pixels of some tiles (pair_id, ty, tx), each tile on its own, 8-connected, or 4-connected with a reach of 0: union of
    runs of neighbouring rows; the label tells the first pixel."""
    rows = rows.sort_values(["pair_id", "ty", "tx", "y", "x"], ignore_index=True)
    pair, ty, tx, y, x = (rows[c].to_numpy() for c in ("pair_id", "ty", "tx", "y", "x"))
    other = (pair[1:] != pair[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])
    fresh = np.append(True, other | (y[1:] != y[:-1]))[: len(y)]  # a new line
    first = np.flatnonzero(fresh | np.append(True, x[1:] != x[:-1] + 1)[: len(y)])
    last = np.append(first[1:], len(y)) - 1
    line = np.cumsum(fresh)[first]
    heads = np.flatnonzero(fresh)
    tile = np.cumsum(np.append(0, other))[: len(y)][heads]
    follows = np.append(False, (tile[1:] == tile[:-1]) & (y[heads][1:] == y[heads][:-1] + 1))[: len(heads)]
    low = x.min() if len(x) else 0
    wide = int(x.max() - low) + 4 if len(x) else 1
    start, end = x[first].astype("int64") - low + 1, x[last].astype("int64") - low + 1
    # The runs of the line above that a run touches stand next to each other.
    above = np.searchsorted(line * wide + end, (line - 1) * wide + start - reach, "left")
    upto = np.searchsorted(line * wide + start, (line - 1) * wide + end + reach, "right")
    many = np.where(follows[line - 1], np.maximum(upto - above, 0), 0)
    own = np.repeat(np.arange(len(first)), many)
    met = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(above, many)
    label = first[_joined(len(first), met, own)]
    label = y[label].astype("int64") << 32 | x[label]
    return rows.drop(columns=["ty", "tx"]).assign(label=np.repeat(label, last - first + 1))


def components(on: DataFrame, tile: int = 512, diagonal: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """M9: pair_id, y, x, label of the pixels in ``on``, 8-connected within their pair, or 4-connected without ``diagonal`` steps; columns of
    ``keep`` are passed on.

    Tiles are labelled on their own, many small ones at once; then pixels that touch across the border of two tiles link the labels on both sides. No task holds more
    than a batch and a tile.
    """
    place = [F.floor(F.col(c) / tile).alias(n) for c, n in (("y", "ty"), ("x", "tx"))]
    schema = ", ".join(["pair_id long, y int, x int", *(f"{c} {on.schema[c].dataType.simpleString()}" for c in keep), "label long"])
    labels = cut(in_whole_groups(on.select(*KEY, *keep, *place), ["pair_id", "ty", "tx"], lambda rows: _label(rows, int(diagonal)), schema))
    rim = lambda c: (F.col(c) % tile).isin(0, tile - 1)
    border = labels.filter(rim("y") | rim("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), *([(1, -1), (1, 1)] if diagonal else []))])
    ahead = border.select("pair_id", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("label").alias("l"), F.explode(steps).alias("s"))
    ahead = ahead.withColumns({"y": F.col("y0") + F.col("s.dy"), "x": F.col("x0") + F.col("s.dx")})
    crossing = (F.floor(F.col("y") / tile) != F.floor(F.col("y0") / tile)) | (F.floor(F.col("x") / tile) != F.floor(F.col("x0") / tile))
    node = lambda c: F.struct("pair_id", F.col(c).alias("label"))
    links = ahead.filter(crossing).join(border, list(KEY)).select(node("l").alias("u"), node("label").alias("v")).distinct()
    links = cut(links)
    if links.isEmpty():
        return labels
    joined = cut(linked(links).select(F.col("node.pair_id").alias("pair_id"), F.col("node.label").alias("label"), F.col("component.label").alias("_c")))
    return labels.join(joined, ["pair_id", "label"], "left").select(*KEY, *keep, F.coalesce("_c", "label").alias("label"))


def component_stats(labels: DataFrame) -> DataFrame:
    """Area, box and centre of each component."""
    return labels.groupBy("pair_id", "label").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def hysteresis(scores: DataFrame) -> DataFrame:
    """Pixels of (pair_id, y, x, score, low, high) in components of score >= low that hold a seed of score >= high."""
    low = scores.filter(F.col("score") >= F.least("low", "high")).select(*KEY, (F.col("score") >= F.col("high")).alias("seed"))
    labels = components(low, keep=("seed",))
    seeded = labels.filter("seed").select("pair_id", "label").distinct()
    return labels.join(seeded, ["pair_id", "label"], "left_semi").select(*KEY)


def _square(df: DataFrame, column: str, f) -> DataFrame:
    return near(df, [column], 1, lambda at, v: {column: f.reduce(at.square(v[column], repeat_edge=True))}, {column: df.schema[column].dataType})


def dilate(df: DataFrame, column: str = "on") -> DataFrame:
    return _square(df, column, np.fmax)


def erode(df: DataFrame, column: str = "on") -> DataFrame:
    return _square(df, column, np.fmin)


def ellipse(size: int) -> list[tuple[int, int]]:
    """M8: an elliptical element of ``size`` (odd) as runs of rows: (dy, pixels on either side of the middle); of size 3 it is a cross."""
    half = size // 2
    return [(dy, round(math.sqrt(half * half - dy * dy))) for dy in range(-half, half + 1)]


def morphed(df: DataFrame, size: int, f, column: str = "on") -> DataFrame:
    """M8: dilation (``f`` = F.greatest) or erosion (F.least) by an elliptical element; pixels beyond the frame do not count.

    The runs of the element are taken along rows, once for each length, then put together down the columns: one shuffle for any element.
    """
    runs = ellipse(size)
    pick = (np.fmax if f is F.greatest else np.fmin).reduce

    def shaped(at, v: dict) -> dict:
        wide = {w: pick([v[column][at.place("x", k, True)] for k in range(-w, w + 1)]) for _, w in runs}
        return {column: pick([wide[w][at.place("y", dy, True)] for dy, w in runs])}

    return near(df, [column], size // 2, shaped, {column: df.schema[column].dataType})


def element_sizes(sensitivity: float) -> tuple[int, int]:
    """M8: sizes of the opening and the closing element."""
    s = min(1.0, max(0.0, sensitivity))
    return max(3, int(4 * (1 - s * 0.5)) | 1), max(3, int(5 * (1 - s)) | 1)


def median3(df: DataFrame, column: str = "on") -> DataFrame:
    return near(df, [column], 1, lambda at, v: {column: (sum(at.square(v[column], repeat_edge=True)) >= 5).astype(int)}, {column: IntegerType()})


def without_border(df: DataFrame, margin: int, column: str = "on") -> DataFrame:
    size = df.groupBy("pair_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    inside = F.col("y").between(margin, F.col("_y") - margin) & F.col("x").between(margin, F.col("_x") - margin)
    return df.join(size, "pair_id").select(*KEY, F.when(inside, F.col(column)).otherwise(0).alias(column))


def filled(df: DataFrame, column: str = "on", diagonal: bool = True) -> DataFrame:
    """Holes set on: components of off pixels that do not touch the frame. Without ``diagonal`` steps a hole may be shut in by a diagonal
    line, as it is within a contour."""
    size = df.groupBy("pair_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    labels = cut(components(df.filter(F.col(column) == 0), diagonal=diagonal))
    outer = labels.join(size, "pair_id").filter((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("_y")) | (F.col("x") == F.col("_x"))).select("pair_id", "label").distinct()
    holes = labels.join(outer, ["pair_id", "label"], "left_anti").select(*KEY, F.lit(1).alias("_hole"))
    return df.join(holes, list(KEY), "left").select(*KEY, F.coalesce("_hole", column).alias(column))


def large_components(df: DataFrame, least: int | None, column: str = "on") -> DataFrame:
    """Only components of at least ``least`` pixels (without one, 0.005 % of the image and at least 120) that are not small and drawn out."""
    labels = cut(components(df.filter(F.col(column) == 1)))
    s = component_stats(labels)
    if least is None:
        s = s.join(df.groupBy("pair_id").agg(F.greatest(F.lit(120), F.floor(F.count(F.lit(1)) * 0.00005)).alias("_least")), "pair_id")
    floor = F.col("_least") if least is None else F.lit(least)
    long_, short = F.greatest("w", "h"), F.least("w", "h")
    round_ = F.pow(2.0 * (F.col("w") + F.col("h")), F.lit(2)) / (F.greatest(F.col("w") * F.col("h"), F.lit(1)) + 1e-8)
    drop = (F.col("area") < floor) | ((round_ > 80) & (F.col("area") < 3 * floor)) | ((long_ / (short + 1e-8) > 12) & (F.col("area") < 2 * floor))
    kept = labels.join(s.filter(~drop).select("pair_id", "label"), ["pair_id", "label"], "left_semi").select(*KEY, F.lit(1).alias("_on"))
    return df.select(*KEY).join(kept, list(KEY), "left").select(*KEY, F.coalesce("_on", F.lit(0)).alias(column))


def clean(df: DataFrame, border: int = 12, least: int | None = 120, sensitivity: float = 0.5) -> DataFrame:
    """M8: border off, median, opening and closing by elements that shrink as the sensitivity grows, contours filled, thin bridges broken, small
    components dropped."""
    opening, closing = element_sizes(sensitivity)
    m = median3(without_border(cut(df.select(*KEY, "on")), border) if border else df)
    m = cut(morphed(morphed(m, opening, F.least), opening, F.greatest))
    m = cut(morphed(morphed(m, closing, F.greatest), closing, F.least))
    m = cut(morphed(morphed(filled(m, diagonal=False), 3, F.least), 3, F.greatest))
    return large_components(m, least)


def quantile_cuts(scores: DataFrame, column: str, high: float, low: float) -> DataFrame:
    cut = scores.groupBy("pair_id").agg(F.percentile(column, F.array(F.lit(high), F.lit(low))).alias("q"))
    return scores.join(cut, "pair_id").select(*KEY, F.col(column).alias("score"), F.col("q")[0].alias("high"), F.col("q")[1].alias("low"))


def core_mask(scores: DataFrame, sensitivity: float = 0.5, border: int = 12, least: int = 120) -> DataFrame:
    """M5: hysteresis between two quantiles of the classical score, cleaned."""
    s = min(1.0, max(0.0, sensitivity))
    q = min(0.96, max(0.86, 0.94 - (s - 0.5) * 0.06))
    on = hysteresis(quantile_cuts(scores, "score", q, min(q, max(0.78, q - 0.06))))
    mask = scores.select(*KEY).join(on.withColumn("on", F.lit(1)), list(KEY), "left").na.fill(0, ["on"])
    return clean(mask, border, least, s)


def gated_score(df: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """M6: ``score`` from ``model`` and ``classical`` scores and ``exg1``, ``exg2``: a mean, or the greater where both are sure or the green changes."""
    q = min(0.98, max(0.92, 0.96 - (min(1.0, max(0.0, sensitivity)) - 0.5) * 0.04))
    cut = df.groupBy("pair_id").agg(F.percentile("classical", F.lit(q)).alias("t"))
    model, rule, t = F.col("model"), F.col("classical"), F.col("t")
    mean = F.when((model >= 0.35) & (rule >= 0.7 * t), F.greatest(model, rule)).otherwise(0.65 * model + 0.35 * rule)
    green = (F.abs(F.col("exg2") - F.col("exg1")) > 0.04) & (rule >= 0.8 * t)
    return df.join(cut, "pair_id").select(*KEY, F.when(green, F.greatest(mean, rule)).otherwise(mean).alias("score"))


def gated_bounds(sensitivity: float) -> tuple[float, float]:
    high = 0.45 + (1 - sensitivity) * 0.15
    return max(0.25, high - 0.12), high


def smart_union(df: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """M7: on pixels where ``model_on`` and ``rule_on`` agree, or one of them is sure by ``model`` or ``classical``."""
    s = min(1.0, max(0.0, sensitivity))
    cut = df.groupBy("pair_id").agg(F.percentile("classical", F.lit(min(0.94, max(0.88, 0.92 - (s - 0.5) * 0.03)))).alias("q"), F.max("classical").alias("m"))
    floor = F.when(F.col("m") > 1e-6, F.col("q")).otherwise(0.38)
    model, rule = F.col("model_on") == 1, F.col("rule_on") == 1
    keep = (model & rule) | (model & (F.col("model") >= 0.36 + (1 - s) * 0.10)) | (rule & (F.col("classical") >= floor))
    return df.join(cut, "pair_id").filter(keep).select(*KEY)


def hybrid_on(feature: Column, model: Column, sensitivity: float = 0.5) -> Column:
    """0.3 of the feature mask and 0.7 of the model mask, both 0..255, over a threshold of 60..150."""
    return 0.30 * feature + 0.70 * model > min(150, max(60, 98 + int((0.5 - sensitivity) * 36)))


def hybrid_model_on(model_on: Column, classical_on: Column, confidence: Column, sensitivity: float = 0.5, with_model: bool = True) -> Column:
    """0.7 of the model mask and 0.3 of the classical one (without a model all of it), weighed by confidence, as bytes over a threshold."""
    share = 0.7 if with_model else 0.0
    fused = (share * model_on + (1 - share) * classical_on) * 255 * (0.6 + 0.4 * clip(1.5 * confidence, 0.0, 1.0))
    return F.floor(fused + 1e-6) > max(88, int(132 - (sensitivity - 0.5) * 55))


def united(masks: list[DataFrame]) -> DataFrame:
    """Pixels that are on in any of the masks (on rows only)."""
    out = masks[0].select(*KEY)
    for m in masks[1:]:
        out = out.unionByName(m.select(*KEY))
    return out.distinct()


def run_statistics(mask: DataFrame) -> DataFrame:
    """Pixels, changed pixels and their share in percent for each pair."""
    return mask.groupBy("pair_id").agg(F.count(F.lit(1)).alias("total_pixels"), F.count_if(F.col("on") == 1).alias("changed_pixels")).withColumn("change_percentage", F.round(100.0 * F.col("changed_pixels") / F.col("total_pixels"), 2))
