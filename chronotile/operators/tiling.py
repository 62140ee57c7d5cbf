"""Windows over large images: grids of overlapping tiles, scoring by a pluggable function, blending, flips and scales."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(length: Column, size: int, step: int) -> Column:
    """Tile offsets along one side: every ``step``, the last one moved in so that it ends at the frame; one at 0 for short sides."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda k: k <= last), F.array(last)))


def window_grid(images: DataFrame, size: int = 512, overlap: float = 0.25) -> DataFrame:
    """A row (y0, x0, h, w) per window of each image (height, width); windows of at least 64, at most half overlapping."""
    size, overlap = max(64, size), min(0.5, max(0.0, overlap))
    step = max(1, round(size * (1 - overlap)))
    rows = images.withColumn("y0", F.explode(starts(F.col("height"), size, step))).withColumn("x0", F.explode(starts(F.col("width"), size, step)))
    return rows.withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y0"))).withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x0")))


def ramp(at: Column, size: int, edge: int) -> Column:
    """Weight along one side of a tile: a ramp of ``edge`` pixels at both ends, the outermost 0 and the innermost 1."""
    near = F.least(at, F.lit(size - 1) - at)
    return F.when(near < edge, near / float(max(1, edge - 1))).otherwise(1.0)


def mirrored(pixels: DataFrame, size: int) -> DataFrame:
    """Images grown at their lower and right edge to whole multiples of ``size`` by reflection, as often as that takes; ``height`` and
    ``width`` tell the size before, ``full_h`` and ``full_w`` the size after."""
    frame = pixels.groupBy("pair_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    up = lambda c: (F.ceil(F.col(c) / size) * size).cast("int")
    frame = frame.withColumns({"full_h": up("height"), "full_w": up("width")})

    def places(at: str, n: str, full: str) -> Column:
        """Where a pixel lies in the grown image: itself and its reflections, one up and one down in each period of 2 (n - 1) pixels."""
        period = F.greatest(2 * (F.col(n) - 1), F.lit(1))
        turns = F.sequence(F.lit(0), F.ceil(F.col(full) / period).cast("int"))
        both = F.flatten(F.transform(turns, lambda k: F.array(k * period + F.col(at), k * period - F.col(at))))
        return F.explode(F.array_distinct(F.filter(both, lambda v: (v >= 0) & (v < F.col(full)))))

    grown = pixels.join(frame, "pair_id").withColumn("_y", places("y", "height", "full_h")).withColumn("_x", places("x", "width", "full_w"))
    return grown.drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def overlapping_tiles(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """The pixels of all tiles of ``size`` (pair_id, y, x, y0, x0, th, tw and the others), every ``size - overlap`` pixels over the mirrored image."""
    overlap = max(0, min(overlap, size // 2))
    grown = mirrored(pixels, size)
    frame = grown.select("pair_id", "height", "width", "full_h", "full_w").distinct()
    step = max(1, size - overlap)
    grid = frame.withColumn("y0", F.explode(starts(F.col("full_h"), size, step))).withColumn("x0", F.explode(starts(F.col("full_w"), size, step)))
    return tiles_of(grown, grid.withColumns({"h": F.lit(size), "w": F.lit(size)}), size)

def tiles_of(pixels: DataFrame, grid: DataFrame, size: int) -> DataFrame:
    """Pixels of each tile: an equi-join of pixels with the tiles that cover their grid cell, not a join by inequality over all."""
    cell = lambda c: F.floor(F.col(c) / size)
    reach = lambda at, n: F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + F.col(n) - 1) / size))
    g = grid.select("pair_id", "y0", "x0", F.col("h").alias("th"), F.col("w").alias("tw")).withColumn("cy", F.explode(reach("y0", "th"))).withColumn("cx", F.explode(reach("x0", "tw")))
    p = pixels.withColumn("cy", cell("y")).withColumn("cx", cell("x"))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("th")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("tw"))
    return p.join(g, ["pair_id", "cy", "cx"]).filter(inside).drop("cy", "cx")


def blended(scored: DataFrame, size: int, edge: int) -> DataFrame:
    """(pair_id, y, x, y0, x0, score) of overlapping tiles to one score per pixel, weighted by ramps; the sum of weights counts at least 1e-6.

    With ``height`` and ``width`` columns, as ``overlapping_tiles`` gives them, pixels beyond the image are left out.
    """
    if "height" in scored.columns:
        scored = scored.filter("y < height and x < width")
    w = ramp(F.col("y") - F.col("y0"), size, edge) * ramp(F.col("x") - F.col("x0"), size, edge)
    return scored.withColumn("_w", w).groupBy("pair_id", "y", "x").agg((F.sum(F.col("score") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias("score"))


def _shrunk(at: Column, size: Column, less: Column) -> Column:
    """Where pixel ``at`` of a side of ``size`` comes to lie on ``less`` pixels: array of struct<k, share>, its parts of each by length."""
    first, last = at * less / size, (at + 1) * less / size
    every = F.sequence(F.floor(first + 1e-9), F.greatest(F.floor(first + 1e-9), F.ceil(last - 1e-9) - 1))
    return F.transform(every, lambda k: F.struct(k.cast("int").alias("k"), (F.least(last, k + 1) - F.greatest(first, k)).alias("share")))


def _hanning(k: Column, n: Column) -> Column:
    return F.when(n > 2, 0.5 - 0.5 * F.cos(2 * F.pi() * (k + 1) / (n + 1))).otherwise(1.0)


def on_canvas(scored: DataFrame, canvas_h: int, canvas_w: int) -> DataFrame:
    """Scores of the windows of large images, brought together on a canvas that is no larger than the image.

    ``scored`` has a row (pair_id, height, width, y0, x0, h, w, y, x, score) for each pixel of each window. A window shrinks by area
    to its share of the canvas; windows are blended there with Hanning weights of at least 0.001, so the frame counts too. One shuffle for
    shrinking and one for blending, on canvas pixels; no window or image is held as a whole.
    """
    sy, sx = canvas_h / F.col("height"), canvas_w / F.col("width")
    dy0, dx0 = F.bround(F.col("y0") * sy).cast("int"), F.bround(F.col("x0") * sx).cast("int")
    dh, dw = F.greatest(F.lit(1), F.bround(F.col("h") * sy)).cast("int"), F.greatest(F.lit(1), F.bround(F.col("w") * sx)).cast("int")
    sized = scored.withColumns({"dy0": dy0, "dx0": dx0, "dh": F.least(dh, canvas_h - dy0), "dw": F.least(dw, canvas_w - dx0)}).filter("dh > 0 and dw > 0")
    parts = sized.withColumn("cy", F.explode(_shrunk(F.col("y") - F.col("y0"), F.col("h"), F.col("dh"))))
    parts = parts.withColumn("cx", F.explode(_shrunk(F.col("x") - F.col("x0"), F.col("w"), F.col("dw"))))
    window = ["pair_id", "y0", "x0", "dy0", "dx0", "dh", "dw"]
    share = F.col("cy.share") * F.col("cx.share")
    small = parts.groupBy(*window, F.col("cy.k").alias("ky"), F.col("cx.k").alias("kx")).agg((F.sum(F.col("score") * share) / F.sum(share)).alias("score"))
    weight = F.greatest(_hanning(F.col("ky"), F.col("dh")) * _hanning(F.col("kx"), F.col("dw")), F.lit(1e-3))
    rows = small.select("pair_id", (F.col("dy0") + F.col("ky")).alias("y"), (F.col("dx0") + F.col("kx")).alias("x"), "score", weight.alias("weight"))
    return rows.groupBy("pair_id", "y", "x").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"))


#: A scorer takes two byte arrays (n, h, w, 3), before and after, and gives probabilities (n, h, w).
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def difference_scorer(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A deterministic stand-in for a trained network: mean absolute difference of the channels."""
    return np.abs(before.astype(np.float64) - after).mean(-1) / 255


def flips(kind: str) -> tuple[tuple[int, ...], ...]:
    """Axes of each pass: none, and for "hflip" and "full" also mirrored ones."""
    return {"off": ((),), "hflip": ((), (2,)), "full": ((), (2,), (1,))}[kind]


def averaged(scorer: Scorer, kind: str = "off") -> Scorer:
    """Mean over flipped passes, each flipped back; a pass that fails is left out, and an error only if all fail."""

    def score(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        done = []
        for axes in flips(kind):
            try:
                done.append(np.flip(scorer(np.flip(before, axes), np.flip(after, axes)), axes) if axes else scorer(before, after))
            except (ValueError, RuntimeError):
                continue
        if not done:
            raise RuntimeError("no pass of the scorer succeeded")
        return np.mean(done, 0)

    return score


def scored_tiles(tiles: DataFrame, scorer: Scorer = difference_scorer, batch: int = 16) -> DataFrame:
    """(pair_id, y0, x0, h, w, before, after) with binary RGB tiles to the same with ``scores`` (row-major doubles).

    The scorer runs in Arrow batches on tiles of one shape at a time; load a model lazily inside it, once per worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (h, w), group in rows.groupby(["h", "w"]):
                for at in range(0, len(group), batch):
                    some = group.iloc[at : at + batch]
                    image = lambda c, some=some, h=h, w=w: np.stack([np.frombuffer(x, np.uint8).reshape(h, w, 3) for x in some[c]])
                    yield some[["pair_id", "y0", "x0", "h", "w"]].assign(scores=[x.ravel() for x in scorer(image("before"), image("after"))])

    return tiles.select("pair_id", "y0", "x0", "h", "w", "before", "after").mapInPandas(run, "pair_id long, y0 int, x0 int, h int, w int, scores array<double>")


def packed(pixels: DataFrame) -> DataFrame:
    """One tile per pair from a pixel table with r1..b2."""
    rgb = lambda k: F.array(*[F.col(f"{c}{k}") for c in "rgb"])
    rows = pixels.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", rgb(1).alias("a"), rgb(2).alias("b")))).alias("p"), F.max("y").alias("my"), F.max("x").alias("mx"))
    raw = lambda f: F.unhex(F.array_join(F.transform(F.flatten(F.col(f"p.{f}")), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return rows.select("pair_id", F.lit(0).alias("y0"), F.lit(0).alias("x0"), (F.col("my") + 1).alias("h"), (F.col("mx") + 1).alias("w"), raw("a").alias("before"), raw("b").alias("after"))


def unpacked(scored: DataFrame) -> DataFrame:
    """Pixels (pair_id, y, x, score) of scored tiles."""
    return scored.select("pair_id", "y0", "x0", "w", F.posexplode("scores").alias("k", "score")).select("pair_id", (F.col("y0") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("k") % F.col("w")).cast("int").alias("x"), "score", "y0", "x0")


def over_scales(scores: list[DataFrame], threshold: float) -> DataFrame:
    """Greatest score of each pixel over scales, and whether it reaches the threshold."""
    out = scores[0].select("pair_id", "y", "x", "score")
    for s in scores[1:]:
        out = out.unionByName(s.select("pair_id", "y", "x", "score"))
    return out.groupBy("pair_id", "y", "x").agg(F.max("score").alias("score")).withColumn("on", (F.col("score") >= threshold).cast("int"))
