"""Features, suppression, ranking and enrichment of change regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions.lineage import cut
from chronotile.functions.scalars import change_type, overlap, severity
from chronotile.operators.pixels import Near, colour_arrays, in_whole_groups, tile_sums
from chronotile.operators.signals import coloured, dissimilar, gradient, pattern_share

FEATURES = ("ndvi", "exg", "texture", "lbp", "edge", "entropy", "contrast", "homog", "bright", "green", "blue", "red", "sat", "hue")


def _gradients(c: DataFrame, sides: tuple[str, ...], ssim: bool) -> DataFrame:
    """Sums over the pixels of each tile, by ``tile_sums``, of what R1 of images ``sides`` is made of, numbered as the images, and with ``ssim`` of
    ``dssim`` and ``lab``, the distance of the colours. One shuffle for all of them, and no pixel comes back."""

    def measured(at, v: dict) -> dict:
        out, colours = {}, {}
        for k in sides:
            rgb = [v[f"{x}{k}"].astype(float) for x in "rgb"]
            colours[k] = c = colour_arrays(*rgb)
            tone = c["gray"]
            dx, dy = gradient(at.square(tone))
            steps = [np.where(at.inside(axis, -1), (tone - tone[at.place(axis, -1)]) ** 2, 0.0) for axis in "xy"]
            eighths = 8 * pattern_share(at.square(tone, repeat_edge=True))
            angle = np.minimum(np.floor((np.arctan2(dy, dx + 1e-8) + np.pi) / (2 * np.pi) * 8), 7)
            plain = {"red": rgb[0], "green": rgb[1], "blue": rgb[2], "tone": tone, "eighths": eighths}
            found = plain | {f"{n}_2": x * x for n, x in plain.items()} | {"exg": c["exg"], "edge": np.sqrt(dx * dx + dy * dy), "n2": steps[0] + steps[1]}
            found |= {n: c[n] for n in "labsh"} | {f"bin{n}": (angle == n).astype(float) for n in range(8)}
            out |= {f"{n}_{k}": x for n, x in found.items()}
        if ssim:
            one, two = colours["1"], colours["2"]
            out |= {"dssim": dissimilar(at, one["gray"], two["gray"], 11, 1.5), "lab": np.sqrt(sum((two[n] - one[n]) ** 2 for n in "lab"))}
        return out

    plain = ("red", "green", "blue", "tone", "eighths")
    names = [f"{n}_{k}" for k in sides for n in (*plain, *(f"{n}_2" for n in plain), "exg", "edge", "n2", *"labsh", *(f"bin{n}" for n in range(8)))]
    return tile_sums(c, [f"{x}{k}" for k in sides for x in "rgb"], 5 if ssim else 1, measured, names + ["dssim", "lab"] * ssim, [f"tone_{k}" for k in sides])


def _wrapped(tiles: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """pair_id, w1, w2: the ``wrap_`` of the pictures that lie in several tiles, from the first and last values of their lines in each."""
    ends = tiles.select("pair_id", F.explode("ends").alias("e")).select("pair_id", "e.*")
    lines = ends.groupBy("pair_id", "axis", "at").agg(F.min_by("first", "lo").alias("a"), F.max_by("last", "hi").alias("b"))
    return lines.groupBy("pair_id").agg(*(F.sum(F.pow(F.col("a")[n] - F.col("b")[n], F.lit(2))).alias(f"w{k}") for n, k in enumerate(sides)))


def _variance(s: Column, s2: Column, n: Column) -> Column:
    """Population variance from whole sums of values and of their squares, exact up to the last division."""
    exact = lambda c: c.cast("decimal(18,0)")
    return (exact(n) * exact(s2) - exact(s) * exact(s)).cast("double") / (n * n)


def _summaries(df: DataFrame, sides: tuple[str, ...], alike: bool = False) -> DataFrame:
    """R1 of images ``sides`` of each pair, numbered as they are, and, if ``alike``, the columns of ``likeness``; pixels meet once."""
    tiles = cut(_gradients(df, sides, alike))
    sums = [c for c in tiles.columns if c not in ("pair_id", "y", "x", "ends")]
    found = tiles.groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in sums), F.max("y").alias("_y"), F.max("x").alias("_x")).join(_wrapped(tiles, sides), "pair_id", "left")
    n, out = F.col("n"), [F.col("pair_id")]
    for k in sides:
        at = lambda c: F.col(f"{c}_{k}")  # noqa: B023, E731
        deviation = lambda c: F.sqrt(_variance(at(c), at(f"{c}_2"), n))  # noqa: B023, E731
        r, gr, b = (at(c) / n for c in ("red", "green", "blue"))
        total = r + gr + b + 1e-6
        share = [at(f"bin{m}") / n for m in range(8)]
        values = {
            "ndvi": (gr - r) / (gr + r + 1e-6), "exg": at("exg") / n, "texture": deviation("tone"), "lbp": _variance(at("eighths"), at("eighths_2"), n) / 64, "edge": at("edge") / n,
            "entropy": sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0)), "contrast": (at("n2") + F.col(f"wrap_tone_{k}") + F.coalesce(f"w{k}", F.lit(0.0))) / n,
            "homog": (deviation("red") + deviation("green") + deviation("blue")) / 3, "bright": at("l") / n, "green": gr / total, "blue": b / total, "red": r / total,
            "sat": at("s") / n, "hue": at("h") / n, "mean_lab": F.struct(*((at(f) / n).alias(f) for f in "lab")),
        }
        out += [v.alias(f"{c}_{k}") for c, v in values.items()]
    if alike:
        out += [(F.col("lab") / n).alias("lab"), F.when((F.col("_y") >= 6) & (F.col("_x") >= 6), 1 - 2 * (F.col("dssim") / n)).otherwise(1.0).alias("ssim")]
    return found.select(*out)


def image_features(df: DataFrame, k: str) -> DataFrame:
    """One row per pair of the features of image ``k`` ("1" or "2"), from means, deviations and gradients over its pixels.

    The direction histogram has 8 bins; neighbour contrast wraps around the frame, as it always has.
    """
    return _of_image(_summaries(df, (k,)), k)


def _of_image(found: DataFrame, k: str) -> DataFrame:
    return found.select("pair_id", *(F.col(f"{f}_{k}").alias(f) for f in (*FEATURES, "mean_lab")))


def features_and_likeness(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R1 of both images and ``likeness``, from one pass over the pixels."""
    found = cut(_summaries(df, ("1", "2"), alike=True))
    return _of_image(found, "1"), _of_image(found, "2"), found.select("pair_id", "ssim", "lab")


def greenness(df: DataFrame, k: str) -> DataFrame:
    """R17, first half: ndvi, green_ratio and mean_saturation of image ``k`` of each pair; the regularity of its texture is R1's ``entropy``."""
    c = coloured(df)
    r, g, b = (F.avg(f"{x}{k}") for x in "rgb")
    ndvi, share = (g - r) / (g + r + 1e-6), g / (r + g + b + 1e-6)
    return c.groupBy("pair_id").agg(ndvi.alias("ndvi"), share.alias("green_ratio"), F.avg(f"hsv{k}.s").alias("mean_saturation"))


def _corner_counts(at: Near, y: np.ndarray, x: np.ndarray, gray: np.ndarray, most: int = 100, quality: float = 0.05, apart: int = 5) -> np.ndarray:
    """``strong_corners`` of each of many crops, the tiles of ``at``, at once."""
    dx, dy = gradient(at.square(gray.astype(float)))
    xx, yy, xy = (sum(at.square(v)) for v in (dx * dx, dy * dy, dx * dy))
    least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    level = np.maximum.reduceat(least, at.first)[at.tile] * quality
    good = (least > level) & (least == np.maximum.reduce(at.square(least))) & (least > 0)
    for axis in "yx":
        good &= at.inside(axis, -1) & at.inside(axis, 1)
    sizes = [np.maximum.reduceat(v, at.first) - np.minimum.reduceat(v, at.first) + 1 for v in (y, x)]
    good &= (np.minimum(*sizes) >= 5)[at.tile]
    found = np.flatnonzero(good)
    found = found[np.lexsort((x[found], y[found], -least[found], at.tile[found]))]
    counts = np.bincount(at.tile[found], minlength=len(at.first))
    begin = np.cumsum(counts) - counts
    for k in np.flatnonzero(counts > 1).tolist():
        own = found[begin[k] : begin[k] + counts[k]]
        taken: list[tuple[int, int]] = []
        for a, b in zip(y[own].tolist(), x[own].tolist(), strict=True):
            if len(taken) == most:
                break
            if all((a - c) ** 2 + (b - d) ** 2 >= apart * apart for c, d in taken):
                taken.append((a, b))
        counts[k] = len(taken)
    return counts


def strong_corners(gray: np.ndarray, most: int = 100, quality: float = 0.05, apart: int = 5) -> int:
    """Corners of a gray crop by the smaller eigenvalue of its gradients' 3 x 3 sums: at least ``quality`` of the best, greatest among
    their neighbours, taken strongest first if no taken one is nearer than ``apart`` pixels."""
    y, x = (v.ravel() for v in np.indices(gray.shape))
    at = Near(pd.DataFrame({"pair_id": 0, "ty": 0, "tx": 0, "y": y, "x": x}))
    return int(_corner_counts(at, y, x, gray.ravel(), most, quality, apart)[0])


def corners(gray: DataFrame) -> DataFrame:
    """pair_id, ``b_corners`` and ``corners`` of the gray crops (pair_id, y, x, g1, g2), many crops of regions at once."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        at = Near(rows.assign(ty=0, tx=0))
        y, x = (rows[c].to_numpy().astype("int64") for c in "yx")
        before, after = (_corner_counts(at, y, x, rows[g].to_numpy()) for g in ("g1", "g2"))
        return pd.DataFrame({"pair_id": rows["pair_id"].to_numpy()[at.first], "b_corners": before, "corners": after})

    return in_whole_groups(gray.select("pair_id", "y", "x", "g1", "g2"), ["pair_id"], count, "pair_id long, b_corners int, corners int", ["y", "x"])


def likeness(df: DataFrame) -> DataFrame:
    """pair_id, ``ssim``, the mean under an 11 x 11 window (1 for images with a side under 7), and ``lab``, the mean distance of the
    colours of a pixel."""
    return features_and_likeness(df)[2]


def compared_features(before: DataFrame, after: DataFrame, alike: DataFrame, counts: DataFrame) -> DataFrame:
    """Features of the image after, b_ of the one before, d_ differences, the columns of ``likeness``, and those of ``counts`` (pair_id
    and, with b_ for the image before, corners of R3, lines and line_length of R2, hull of R4)."""
    b = before.select("pair_id", *[F.col(f).alias(f"b_{f}") for f in FEATURES])
    out = after.drop("mean_lab").join(b, "pair_id").join(alike, "pair_id").join(counts, "pair_id")
    return out.withColumns({f"d_{f}": F.col(f) - F.col(f"b_{f}") for f in (*FEATURES, "corners", "lines", "line_length")})


def vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, name or null for a passing object, score) to name and score of each region.

    Most parts passing: null. Else the class with the greatest sum of scores, the first of equals by its first part; its mean score, raised by 15 % when 60 % agree.
    """
    named = F.col("name").isNotNull() & (F.col("name") != "Unclassified")
    by_name = votes.filter(named).groupBy(*keys, "name").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"), F.min("part").alias("first"))
    top = by_name.groupBy(*keys).agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("first")).alias("first"), "name", "n")).alias("t"), F.sum("n").alias("all"))
    passing = votes.groupBy(*keys).agg(F.count_if(F.col("name").isNull()).alias("passing"), F.count(F.lit(1)).alias("parts"))
    mean = F.col("t.s") / F.col("t.n")
    agreed = F.when(F.col("t.n") / F.col("all") >= 0.6, F.least(F.lit(1.0), mean * 1.15)).otherwise(mean)
    gone = F.col("passing") > F.floor(F.col("parts") / 2)
    return passing.join(top, keys, "left").select(*keys, F.when(gone, None).otherwise(F.coalesce("t.name", F.lit("Unclassified"))).alias("name"), F.when(gone, 0.0).otherwise(F.coalesce(agreed, F.lit(0.0))).alias("score"))


def sub_boxes(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box and, if both sides exceed 20, its quarters and centre."""
    hw, hh = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    whole = box(x, y, w, h)
    parts = [box(x, y, hw, hh), box(x + hw, y, hw, hh), box(x, y + hh, hw, hh), box(x + hw, y + hh, hw, hh), box(x + F.floor(w / 4).cast("int"), y + F.floor(h / 4).cast("int"), hw, hh)]
    return F.when((w > 20) & (h > 20), F.array(whole, *parts)).otherwise(F.array(whole))


def _kept(limit: float, cell: int = 64):
    """Over rows in order of run and falling area: those that overlap no kept row of their run.

    The state is the current run's kept boxes by grid cell, so a box meets only those near it.
    """

    def cells(x: int, y: int, w: int, h: int) -> list[tuple[int, int]]:
        return [(a, b) for a in range(x // cell, (x + w - 1) // cell + 1) for b in range(y // cell, (y + h - 1) // cell + 1)]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, kept = None, {}
        for rows in batches:
            chosen = []
            for k, (r, x, y, w, h) in enumerate(zip(*(rows[c].tolist() for c in ("run_id", "x", "y", "w", "h")), strict=True)):
                if r != run:
                    run, kept = r, {}
                own = cells(x, y, w, h)
                for a, b, c, d in {box for place in own for box in kept.get(place, ())}:
                    both = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
                    if both and both / (w * h + c * d - both) > limit:
                        break
                else:
                    for place in own:
                        kept.setdefault(place, []).append((x, y, w, h))
                    chosen.append(k)
            yield rows.iloc[chosen]

    return stream


def suppress_overlaps(regions: DataFrame, limit: float = 0.45) -> DataFrame:
    """Greedy, largest first: a region stays unless it overlaps one that stays. One shuffle by run; rows stream through in order."""
    ordered = regions.repartition("run_id").sortWithinPartitions("run_id", F.col("area").desc(), "region_id")
    return ordered.mapInPandas(_kept(limit), regions.schema)


def overlapping_pairs(regions: DataFrame, limit: float = 0.45, cell: int = 64) -> DataFrame:
    """Pairs of a run's regions whose overlap exceeds ``limit``, by an equi-join on grid cells instead of all pairs."""
    reach = lambda at, size: F.sequence(F.floor(at / cell), F.floor((at + size - 1) / cell))
    box = F.struct("x", "y", "w", "h")
    cells = regions.select("run_id", "region_id", box.alias("box"), F.explode(reach(F.col("x"), F.col("w"))).alias("cx"), "y", "h").select("run_id", "region_id", "box", "cx", F.explode(reach(F.col("y"), F.col("h"))).alias("cy"))
    a = cells.withColumnsRenamed({"region_id": "a", "box": "box_a"})
    b = cells.withColumnsRenamed({"region_id": "b", "box": "box_b"})
    corner = (F.col("cx") == F.floor(F.greatest("box_a.x", "box_b.x") / cell)) & (F.col("cy") == F.floor(F.greatest("box_a.y", "box_b.y") / cell))
    iou = overlap(F.col("box_a"), F.col("box_b"))
    return a.join(b, ["run_id", "cx", "cy"]).filter((F.col("a") < F.col("b")) & corner & (iou > limit)).select("run_id", "a", "b", F.round(iou, 6).alias("iou"))


def largest(regions: DataFrame, n: int = 60) -> DataFrame:
    """L2, SO2, W1: the n largest regions of each run, numbered from 1; region_id decides between equals."""
    order = Window.partitionBy("run_id").orderBy(F.col("area").desc(), "region_id")
    return regions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def plausible(regions: DataFrame, image_area: int, least_area: int | None = None, registered: bool = True) -> DataFrame:
    """Regions that pass the floor of area, the filters of sparse and of nearly full frames, and that of small unsure ones.

    A region of a passing object (a null object_type) stays as general change if it is large and well filled.
    """
    floor = least_area if least_area is not None else int(min(1000, max(250, image_area * 0.00009)))
    floor = floor if registered else int(floor * 1.4)
    box = F.col("w") * F.col("h")
    fill = F.col("area") / box
    sparse = (fill < 0.15) | ((box > (0.75 if registered else 0.92) * image_area) & (fill < 0.35))
    unnamed = F.col("object_type").isNull()
    general = (F.col("area") >= max(2 * floor, 900)) & (fill >= 0.20)
    named = regions.filter((F.col("area") >= floor) & ~sparse & (~unnamed | general)).withColumns({
        "confidence": F.when(unnamed, F.greatest(F.lit(0.2), F.least(F.lit(0.5), fill))).otherwise(F.col("confidence")),
        "object_type": F.coalesce("object_type", F.lit("Unclassified Ground Change")),
    })
    return named.filter((F.col("confidence") >= 0.24) | (F.col("area") >= 3 * floor))


def region_pipeline(regions: DataFrame, image_area: int, least_area: int | None = None, registered: bool = True) -> DataFrame:
    """R29 from classified regions on: the filters, overlaps, the 60 largest, numbers, severity and report type."""
    kept = largest(suppress_overlaps(plausible(regions, image_area, least_area, registered)))
    level = severity(F.col("object_type"), F.col("area"), F.col("confidence"), F.lit(image_area))
    named = change_type(F.col("object_type")).alias("change_type")
    return kept.select("run_id", F.col("place").alias("id"), "area", "x", "y", "w", "h", "object_type", "confidence", level.alias("severity"), named)


def tight_box(pixels_on: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes`` (region_id, x, y, w, h) with ``area``, the on pixels (region_id, y, x) within; where over 100 of them fill less than a
    fifth of the box, it shrinks to what they really fill."""
    inside = pixels_on.join(boxes.withColumnsRenamed({"x": "bx", "y": "by"}), "region_id").filter("x between bx and bx + w - 1 and y between by and by + h - 1")
    s = inside.groupBy("region_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))
    thin = (F.col("area") > 100) & (F.col("area") / (F.col("w") * F.col("h")) < 0.20)
    tight = {"x": F.col("x0"), "y": F.col("y0"), "w": F.col("x1") - F.col("x0") + 1, "h": F.col("y1") - F.col("y0") + 1}
    out = boxes.join(s, "region_id", "left").na.fill(0, ["area"])
    return out.select("region_id", *(F.when(thin, v).otherwise(F.col(c)).alias(c) for c, v in tight.items()), "area")


def _crosses(df: DataFrame) -> DataFrame:
    """Each position with its four neighbours, as rows x, y; other columns stay."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return df.withColumn("_s", F.explode(steps)).withColumns({"x": F.col("x") + F.col("_s.dx"), "y": F.col("y") + F.col("_s.dy")}).drop("_s")


def shadows(gray: DataFrame, boxes: DataFrame, grow: float = 0.6, cell: int = 64) -> DataFrame:
    """New shadow around each box (pair_id, region_id, x, y, w, h), from pixels (pair_id, y, x, g1, g2).

    The box grows by a share of its sides on every side, within the frame. Pixels of it, without the box itself, that darkened by more than
    25 and 1.5 deviations are opened with a cross of 3 x 3; their number and extents remain. Pixels meet boxes on grid cells.
    """
    dx, dy = F.floor(F.col("w") * grow).cast("int"), F.floor(F.col("h") * grow).cast("int")
    frame = gray.groupBy("pair_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    own = boxes.withColumnsRenamed({"x": "bx", "y": "by"}).join(frame, "pair_id").select(
        "pair_id", "region_id", "bx", "by", (F.col("bx") + F.col("w") - 1).alias("ex"), (F.col("by") + F.col("h") - 1).alias("ey"),
        F.greatest(F.lit(0), F.col("bx") - dx).alias("x0"), F.least("mx", F.col("bx") + F.col("w") + dx - 1).alias("x1"),
        F.greatest(F.lit(0), F.col("by") - dy).alias("y0"), F.least("my", F.col("by") + F.col("h") + dy - 1).alias("y1"),
    )
    reach = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = own.filter("x0 <= x1 and y0 <= y1").withColumn("cx", F.explode(reach("x0", "x1"))).withColumn("cy", F.explode(reach("y0", "y1")))
    placed = gray.select("pair_id", "x", "y", (F.col("g1") - F.col("g2")).alias("d"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    near = placed.join(cells, ["pair_id", "cx", "cy"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    key = ["pair_id", "region_id"]
    level = near.groupBy(*key).agg(F.greatest(F.lit(25.0), 1.5 * F.stddev_pop("d")).alias("level"))
    inside = F.col("x").between(F.col("bx"), F.col("ex")) & F.col("y").between(F.col("by"), F.col("ey"))
    on = near.join(level, key).filter(~inside & (F.col("d") > F.col("level"))).select(*key, "x", "y", "x0", "x1", "y0", "y1")
    spot = [*key, "x0", "x1", "y0", "y1", "x", "y"]
    around_it = 1 + sum((c.cast("int") for c in (F.col("x") > F.col("x0"), F.col("x") < F.col("x1"), F.col("y") > F.col("y0"), F.col("y") < F.col("y1"))), F.lit(0))
    eroded = _crosses(on).groupBy(*spot).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == around_it).drop("n")
    within = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    opened = _crosses(eroded).filter(within).select(*key, "x", "y").distinct()
    extents = [F.count(F.lit(1)).alias("shadow_px"), (F.max("x") - F.min("x")).alias("spread_x"), (F.max("y") - F.min("y")).alias("spread_y")]
    return opened.groupBy(*key).agg(*extents)
