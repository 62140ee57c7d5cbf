"""Regions of image pairs as pictures of their own: features of each, what they decide, and the votes of their parts.

Boxes of a pair overlap, and a pixel belongs to every box that covers it. Boxes and pixels meet on grid cells by an equi-join; the pixels of
a box then form a picture under the number of the box, counted from its corner, so that everything that works on image pairs works on
regions. The number of pixels grows with the area of the boxes, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronotile.functions.lineage import cut
from chronotile.functions.scalars import vehicle_area_limit
from chronotile.operators import rules
from chronotile.operators.masks import component_stats, components
from chronotile.operators.pixels import KEY, dealt, in_whole_groups, near
from chronotile.operators.regions import compared_features, corners, features_and_likeness, sub_boxes, vote
from chronotile.operators.signals import coloured

COLOURS = ("r1", "g1", "b1", "r2", "g2", "b2")
#: R2: gradients below this are noise, as are segments filled below DENSE; a gradient's direction is one of SECTORS.
LEAST_GRADIENT, DENSE, SECTORS = 5.2, 0.7, 8


def crops(pixels: DataFrame, boxes: DataFrame, pad: int, cell: int = 64) -> tuple[DataFrame, DataFrame]:
    """``boxes`` (pair_id, x, y, w, h and more) with ``crop``, a number of each, and ``image_area`` of its pair; and the pixels (pair_id being
    the crop, y, x from its corner, colours) of each box grown by ``pad`` within the frame. Boxes outside the frame have no pixels."""
    frame = pixels.groupBy("pair_id").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    numbered = boxes.join(frame, "pair_id").withColumn("image_area", (F.col("_mx") + 1) * (F.col("_my") + 1)).withColumn("crop", F.monotonically_increasing_id())
    numbered = cut(numbered)  # the numbers are fixed here
    own = numbered.select(
        "pair_id", "crop",
        F.greatest(F.lit(0), F.col("x") - pad).alias("x0"), F.least("_mx", F.col("x") + F.col("w") - 1 + pad).alias("x1"),
        F.greatest(F.lit(0), F.col("y") - pad).alias("y0"), F.least("_my", F.col("y") + F.col("h") - 1 + pad).alias("y1"),
    ).filter("x0 <= x1 and y0 <= y1")
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    cells = own.withColumn("cx", reach("x0", "x1")).withColumn("cy", reach("y0", "y1"))
    placed = pixels.select(*KEY, *COLOURS, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    inside = placed.join(cells, ["pair_id", "cx", "cy"]).filter("x between x0 and x1 and y between y0 and y1")
    cropped = inside.select(F.col("crop").alias("pair_id"), (F.col("y") - F.col("y0")).cast("int").alias("y"), (F.col("x") - F.col("x0")).cast("int").alias("x"), *COLOURS)
    return numbered.drop("_mx", "_my"), cropped


def _enclosed(rows: pd.DataFrame) -> pd.DataFrame:
    """``area`` that each on pixel of many tiles (sorted by tile, y, x) brings to its component: the share of the 2 x 2 square that begins with
    it, or that ends with it if it begins with an off pixel of three on ones; 1 for a full square, a half for one of three."""
    keys = [rows[c].to_numpy() for c in ("pair_id", "ty", "tx")]
    tile = np.cumsum(np.append(0, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))[: len(rows)]
    y, x = (rows[c].to_numpy().astype("int64") - int(rows[c].min()) + 1 for c in "yx")
    high, wide = int(y.max()) + 2, int(x.max()) + 2
    code = (tile * high + y) * wide + x

    def on(dy: int, dx: int) -> np.ndarray:
        want = code + dy * wide + dx
        return code[np.minimum(np.searchsorted(code, want), len(code) - 1)] == want

    east, south, both = on(0, 1), on(1, 0), on(1, 1)
    three = np.where(east.astype(int) + south + both == 2, 0.5, 0.0)
    return rows.assign(area=np.where(east & south & both, 1.0, three) + np.where(on(-1, 0) & on(0, -1) & ~on(-1, -1), 0.5, 0.0))


def hull_ratios(pictures: DataFrame, level: int = 128, tile: int = 512) -> DataFrame:
    """pair_id, ``hull``: of the pixels (pair_id, y, x, v) above ``level``, the area within the largest outer contour over its box; 0 without one.

    The contour runs through pixel centres. Whatever is not 4-connected to the frame through lower pixels lies within a contour, holes and
    all; of its 2 x 2 squares a full one adds 1 to the area and one of three pixels a half, which is the area that the contour encloses.
    """
    size = cut(pictures.groupBy("pair_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x")))
    off = components(pictures.filter(F.col("v") <= level), diagonal=False)
    reach = off.groupBy("pair_id", "label").agg(*(f(c).alias(n + c) for c in "yx" for f, n in ((F.min, "_a"), (F.max, "_b"))))
    shut = reach.join(size, "pair_id").filter("_ay > 0 and _ax > 0 and _by < _y and _bx < _x").select("pair_id", "label")
    solid = pictures.filter(F.col("v") > level).select(*KEY).unionByName(off.join(shut, ["pair_id", "label"], "left_semi").select(*KEY))
    labels = components(solid)
    own = lambda rows: _enclosed(rows)[(rows["y"] // tile == rows["ty"]) & (rows["x"] // tile == rows["tx"])].drop(columns=["ty", "tx"])
    parts = in_whole_groups(dealt(labels, ["label"], 1, tile), ["pair_id", "ty", "tx"], own, "pair_id long, y int, x int, label long, area double", ["y", "x"])
    box = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    found = parts.groupBy("pair_id", "label").agg(F.sum("area").alias("area"), box.alias("box")).filter("area > 0")
    largest = found.groupBy("pair_id").agg(F.max_by(F.col("area") / F.col("box"), F.struct("area", -F.col("label"))).alias("hull"))
    return size.join(largest, "pair_id", "left").select("pair_id", F.coalesce("hull", F.lit(0.0)).alias("hull"))


def line_segments(pictures: DataFrame) -> DataFrame:
    """R2: one row per straight edge of the pictures (pair_id, y, x, v): pair_id, n, length, width, angle.

    Neighbouring pixels whose gradients have about one direction support an edge; its rectangle follows from the moments of its pixels. It
    counts if it is longer than chance makes it in a picture of that size and mostly filled. Directions are SECTORS wide fields around
    the axes and diagonals, so an edge that runs between two of them may come in pieces.
    """

    def slopes(at, v: dict) -> dict:
        a = v["v"].astype(float)
        b, c = a[at.place("x", 1)], a[at.place("y", 1)]
        d = b[at.place("y", 1)]
        whole = at.inside("x", 1) & at.inside("y", 1)
        return {"gx": np.where(whole, (b + d - a - c) / 2, 0.0), "gy": np.where(whole, (c + d - a - b) / 2, 0.0)}

    square = near(pictures, ["v"], 1, slopes, dict.fromkeys(("gx", "gy"), DoubleType()))
    steep = square.filter(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) > LEAST_GRADIENT)
    sector = F.pmod(F.round(F.atan2("gy", "gx") / (2 * F.pi() / SECTORS)).cast("long"), F.lit(SECTORS))
    labels = components(steep.select((F.col("pair_id") * SECTORS + sector).alias("pair_id"), "y", "x"))
    s = labels.groupBy("pair_id", "label").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    half, rest = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.col("xy") * F.col("xy"))
    spread = lambda v: F.sqrt(12 * F.greatest(v, F.lit(0.0)) + 1)
    s = s.select(F.floor(F.col("pair_id") / SECTORS).alias("pair_id"), "n", spread(half + rest).alias("length"), spread(half - rest).alias("width"), (F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("angle"))
    size = pictures.groupBy("pair_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x")).filter("_y >= 4 and _x >= 4")
    least = (2.5 * (F.log10(F.col("_y") + 1) + F.log10(F.col("_x") + 1)) + F.log10(F.lit(11.0))) / F.log10(F.lit(float(SECTORS)))
    return s.join(size, "pair_id").filter((F.col("n") >= least) & (F.col("n") >= DENSE * F.col("length") * F.col("width"))).drop("_y", "_x")


def shape_counts(gray: DataFrame) -> DataFrame:
    """R2-R4 of both images (pair_id, y, x, g1, g2): pair_id, corners, lines, line_length and hull of the image after, b_ of the one before."""
    sides = F.array(F.struct(F.lit(0).alias("k"), F.col("g1").alias("v")), F.struct(F.lit(1).alias("k"), F.col("g2").alias("v")))
    pictures = cut(gray.select("pair_id", "y", "x", F.explode(sides).alias("_p")).select((F.col("pair_id") * 2 + F.col("_p.k")).alias("pair_id"), "y", "x", "_p.v"))
    found = line_segments(pictures).groupBy("pair_id").agg(F.count(F.lit(1)).cast("int").alias("lines"), F.sum("length").alias("line_length"))
    every = hull_ratios(pictures).join(found, "pair_id", "left").na.fill(0, ["lines", "line_length"])
    side = lambda k, mark: every.filter(F.col("pair_id") % 2 == k).select(F.floor(F.col("pair_id") / 2).alias("pair_id"), *(F.col(c).alias(mark + c) for c in ("hull", "lines", "line_length")))
    return corners(gray).join(side(0, "b_"), "pair_id").join(side(1, ""), "pair_id")


def described(pixels: DataFrame) -> DataFrame:
    """R1-R5 of the pairs in ``pixels``."""
    pixels = cut(pixels)
    gray = coloured(pixels).select(*KEY, F.col("gray1").alias("g1"), F.col("gray2").alias("g2"))
    return compared_features(*features_and_likeness(pixels), shape_counts(gray))


def region_features(pixels: DataFrame, boxes: DataFrame, pad: int) -> DataFrame:
    """R1-R6, R8, R10 by region: ``boxes`` (pair_id, x, y, w, h, perhaps area, and keys of the caller's) with all features of the box grown by
    ``pad``, and asp, fill, compact, vehicle_limit, structural and permanent, as ``rules`` reads them. Boxes outside the frame are left out."""
    numbered, cropped = crops(pixels, boxes, pad)
    box = F.col("w") * F.col("h")
    area = F.col("area") if "area" in boxes.columns else box
    numbered = numbered.withColumns({
        "area": area, "fill": area / F.greatest(box, F.lit(1)),
        "asp": F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1)),
        "compact": 4 * F.pi() * area / (F.pow(2.0 * (F.col("w") + F.col("h")), F.lit(2)) + 1e-6),
        "vehicle_limit": vehicle_area_limit(F.col("image_area")),
    })
    out = numbered.join(described(cropped).withColumnRenamed("pair_id", "crop"), "crop").drop("crop", "image_area")
    return cut(out.withColumns({"structural": rules.total(rules.STRUCTURAL, cap=True), "permanent": rules.total(rules.PERMANENT, cap=True)}))


def suppressed() -> Column:
    """Whether a region with the columns of ``region_features`` is to be left out as a passing object."""
    return rules.predicate(rules.SUPPRESSED, "vehicle_limit")


def strip_transients(on: DataFrame, pixels: DataFrame, pad: int = 2) -> DataFrame:
    """The on pixels (pair_id, y, x) without the components that show passing objects by the features of their boxes in ``pixels``."""
    labels = cut(components(on))
    boxes = component_stats(labels).select("pair_id", "label", F.col("x0").alias("x"), F.col("y0").alias("y"), "w", "h", "area")
    gone = region_features(pixels, boxes, pad).filter(suppressed()).select("pair_id", "label")
    return labels.join(gone, ["pair_id", "label"], "left_anti").select(*KEY)


def part_classes(pixels: DataFrame, boxes: DataFrame, pad: int = 5, single: bool = False) -> DataFrame:
    """R15 of each box and its parts (``boxes``: pair_id, region_id, x, y, w, h): pair_id, region_id, part, name, score; a null name marks a
    passing object, parts outside the frame have no class. ``single`` looks at the image after alone and has rules of its own."""
    parts = boxes.select("pair_id", "region_id", F.posexplode(sub_boxes(*(F.col(c) for c in "xywh"))).alias("part", "box")).select("pair_id", "region_id", "part", "box.*")
    parts = cut(parts)
    f = region_features(pixels, parts, pad)
    if single:
        f = f.withColumns({c: F.lit(v) for c, v in rules.SINGLE_VALUES.items()} | {"permanent": F.lit(0.0)})
        f = f.withColumn("structural", rules.total(rules.STRUCTURAL[-2:], cap=True))
    f = f.withColumn("c", rules.classified("vehicle_limit", rules.SINGLE_RULES if single else rules.CLASS_RULES))
    passing = rules.predicate(rules.PASSING, "vehicle_limit") | suppressed()
    keys = ["pair_id", "region_id", "part"]
    found = f.select(*keys, F.struct(F.when(~passing, F.col("c.name")).alias("name"), F.when(~passing, F.col("c.score")).otherwise(0.0).alias("score")).alias("_c"))
    none = F.struct(F.lit("Unclassified").alias("name"), F.lit(0.0).alias("score"))
    return parts.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("_c", none).alias("_c")).select(*keys, "_c.*")


def decided(parts: DataFrame) -> DataFrame:
    """Name and score of each region by the votes of its ``part_classes``; where no part has a class, the whole box decides."""
    keys = ["pair_id", "region_id"]
    whole = parts.filter("part = 0").select(*keys, F.col("name").alias("_name"), F.col("score").alias("_score"))
    named = parts.groupBy(*keys).agg(F.count_if(F.col("name").isNotNull() & (F.col("name") != "Unclassified")).alias("_named"))
    out = vote(parts, keys).join(whole, keys).join(named, keys)
    alone = (F.col("_named") == 0) & F.col("name").isNotNull()
    return out.select(*keys, F.when(alone, F.col("_name")).otherwise(F.col("name")).alias("name"), F.when(alone, F.col("_score")).otherwise(F.col("score")).alias("score"))


def ensemble(pixels: DataFrame, boxes: DataFrame, pad: int = 5, single: bool = False) -> DataFrame:
    """pair_id, region_id, name, score of each box (pair_id, region_id, x, y, w, h) by itself and its parts."""
    return decided(cut(part_classes(pixels, boxes, pad, single)))
