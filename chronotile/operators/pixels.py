"""Colour conversion, stencils and pre-processing on pixel tables (DataFrame expressions).

A pixel table has a row per pixel: pair_id, y, x and value columns. Stencils work on tiles that know the pixels around them, one shuffle
for any number of columns, or on whole image lines, one shuffle per axis. Beyond the frame pixels are mirrored without repeating the edge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

KEY = ("pair_id", "y", "x")


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def to_byte(v: Column) -> Column:
    """Any number to 0..255, fractions cut."""
    return clip(v, 0, 255).cast("int")


def to_unit(v: Column) -> Column:
    """0..255 to 0..1."""
    return v / F.lit(255.0)


def gray(r: Column, g: Column, b: Column) -> Column:
    """P5: 8-bit luma."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """P5: struct<h, s, v>, hue 0..179, the others 0..255."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    hue = F.when(d == 0, 0.0).when(v == r, 60.0 * (g - b) / d).when(v == g, 120 + 60.0 * (b - r) / d).otherwise(240 + 60.0 * (r - g) / d)
    half = F.round(F.when(hue < 0, hue + 360).otherwise(hue) / 2).cast("int")
    return F.struct(F.when(half == 180, 0).otherwise(half).alias("h"), F.when(v == 0, 0).otherwise(F.round(255.0 * d / v)).cast("int").alias("s"), v.alias("v"))


def lab(r: Column, g: Column, b: Column) -> Column:
    """P5: struct<l, a, b> of sRGB under D65, each scaled to 0..255."""

    def linear(c: Column) -> Column:
        u = c / 255.0
        return F.when(u > 0.04045, F.pow((u + 0.055) / 1.055, F.lit(2.4))).otherwise(u / 12.92)

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return F.struct(F.round(light * 255 / 100).cast("int").alias("l"), F.round(500 * (bent(x) - bent(y)) + 128).cast("int").alias("a"), F.round(200 * (bent(y) - bent(z)) + 128).cast("int").alias("b"))


def colour_arrays(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """P5 over arrays: ``gray``, and ``l``, ``a``, ``b`` of ``lab`` and ``h``, ``s``, ``v`` of ``hsv``, as whole floats; and C1's ``exg``."""
    r, g, b = (c.astype(float) for c in (r, g, b))
    near_to = lambda x: np.floor(x + 0.5)
    linear = lambda u: np.where(u > 0.04045, np.power((u + 0.055) / 1.055, 2.4), u / 12.92)
    root = lambda t: np.power(t, 1 / 3)
    bent = lambda t: np.where(t > 0.008856, root(t), 7.787 * t + 16 / 116)
    lr, lg, lb = (linear(c / 255.0) for c in (r, g, b))
    x, y, z = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    middle = bent(y)
    light = np.where(y > 0.008856, 116 * root(y) - 16, 903.3 * y)
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = v - low
    some = np.where(d == 0, 1.0, d)
    hue = np.select([d == 0, v == r, v == g], [0.0, 60.0 * (g - b) / some, 120 + 60.0 * (b - r) / some], 240 + 60.0 * (r - g) / some)
    half = near_to(np.where(hue < 0, hue + 360, hue) / 2)
    total = r + g + b + 1e-6
    return {
        "gray": near_to(0.299 * r + 0.587 * g + 0.114 * b), "l": near_to(light * 255 / 100), "a": near_to(500 * (bent(x) - middle) + 128), "b": near_to(200 * (middle - bent(z)) + 128),
        "h": np.where(half == 180, 0.0, half), "s": np.where(v == 0, 0.0, near_to(255.0 * d / np.where(v == 0, 1.0, v))), "v": v,
        "exg": np.clip(2.0 * g / total - r / total - b / total, 0.0, 1.0),
    }


def gaussian(size: int, sigma: float = 0.0) -> list[float]:
    """Normalised kernel; without a sigma, binomial up to 7 taps and 0.3 ((size - 1) / 2 - 1) + 0.8 beyond."""
    fixed = {3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}
    if sigma <= 0 and size in fixed:
        return fixed[size]
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((k - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / sum(raw) for x in raw]


def _mirrored(i: Column, n: Column) -> Column:
    """0-based index folded into 0..n-1 without repeating the edge; one fold, so stencils must be narrower than the image."""
    return F.when(n == 1, F.lit(0)).otherwise(F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i))


def _clamped(i: Column, n: Column) -> Column:
    return F.when(i < 0, F.lit(0)).when(i >= n, n - 1).otherwise(i)


def along(df: DataFrame, axis: str, columns: dict[str, tuple[str, object]], keep: tuple[str, ...] = (), border=_mirrored) -> DataFrame:
    """Replace values by a function of the line they lie on.

    ``columns``: name to (source column, f(at)), where at(k) is the source value k pixels further on along ``axis``. Columns of
    ``keep`` are passed on.
    """
    across = "x" if axis == "y" else "y"
    sources = sorted({s for s, _ in columns.values()} | set(keep))
    lines = df.groupBy("pair_id", across).agg(F.sort_array(F.collect_list(F.struct(axis, *sources))).alias("line"))

    def cell(_: Column, i: Column) -> Column:
        def at(source: str):
            return lambda k: F.col("line")[border(i + k, F.size("line"))][source]

        return F.struct(F.col("line")[i][axis].alias(axis), *[F.col("line")[i][k].alias(k) for k in keep], *[f(at(s)).alias(n) for n, (s, f) in columns.items()])

    return lines.select("pair_id", across, F.inline(F.transform("line", cell)))


def by_whole_groups(f, keys: list[str]):
    """For ``mapInPandas`` over rows that are dealt and sorted by ``keys``: ``f`` of the rows of many groups at once, never of a part of one."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            final = np.logical_and.reduce([rows[k].to_numpy() == rows[k].iloc[-1] for k in keys])
            at = len(rows) - int(final.sum())  # the last group may go on
            if held and any(held[-1][k].iloc[-1] != rows[k].iloc[0] for k in keys):
                yield f(pd.concat(held, ignore_index=True))
                held = []
            if at:
                yield f(pd.concat([*held, rows.iloc[:at]], ignore_index=True))
                held = []
            held.append(rows.iloc[at:])
        if held:
            yield f(pd.concat(held, ignore_index=True))

    return stream


def in_whole_groups(df: DataFrame, keys: list[str], f, schema: str | StructType, order: list[str] | None = None) -> DataFrame:
    """``f`` of a frame with the rows of many groups, as groups by ``keys`` are mostly small, sorted by ``keys`` and ``order``; one shuffle."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(by_whole_groups(f, keys), schema)


class Near:
    """Neighbours of the rows of many tiles (pair_id, ty, tx, y, x, sorted so): where their values stand, along both axes."""

    def __init__(self, rows: pd.DataFrame):
        keys = [rows[c].to_numpy() for c in ("pair_id", "ty", "tx")]
        self.rows = rows
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        tile = np.cumsum(np.append(0, new))[: len(y)]
        self.tile, self.first = tile, np.flatnonzero(np.append(True, new)[: len(y)])
        self.lines, self.found = {}, {}
        for axis, order, across in (("x", np.arange(len(y)), y), ("y", np.lexsort((y, x, tile)), x)):
            t, a = tile[order], across[order]
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (a[1:] != a[:-1]))[: len(y)])
            size = np.diff(np.append(first, len(y)))
            place = [np.repeat(first, size), np.arange(len(y)) - np.repeat(first, size), np.repeat(size, size)]
            self.lines[axis] = order, place

    def place(self, axis: str, step: int, repeat_edge: bool = False) -> np.ndarray:
        """Of each row: the row ``step`` pixels further on along ``axis``; beyond the frame mirrored, or the last one."""
        key = axis, step, repeat_edge
        if key not in self.found:
            order, (first, at, size) = self.lines[axis]
            if repeat_edge:
                to = np.clip(at + step, 0, size - 1)
            else:
                to = (at + step) % np.maximum(2 * (size - 1), 1)
                to = np.where(to < size, to, 2 * (size - 1) - to)
            self.found[key] = np.empty(len(order), np.int64)
            self.found[key][order] = order[first + to]
        return self.found[key]

    def inside(self, axis: str, step: int) -> np.ndarray:
        """Whether there is a pixel ``step`` further on."""
        order, (_, at, size) = self.lines[axis]
        out = np.empty(len(order), bool)
        out[order] = (at + step >= 0) & (at + step < size)
        return out

    def square(self, v: np.ndarray, repeat_edge: bool = False) -> list[np.ndarray]:
        """The 3 x 3 values around each pixel, row by row."""
        rows = [v[self.place("y", k, repeat_edge)] for k in (-1, 0, 1)]
        return [r[self.place("x", k, repeat_edge)] for r in rows for k in (-1, 0, 1)]

    def blurred(self, v: np.ndarray, kernel: list[float]) -> np.ndarray:
        for axis in "yx":
            v = sum((w * v[self.place(axis, k - len(kernel) // 2)] for k, w in enumerate(kernel)), np.zeros(len(v)))
        return v


def dealt(df: DataFrame, columns: list[str], reach: int, tile: int = 512) -> DataFrame:
    """pair_id, y, x and ``columns`` of each pixel under its tile (ty, tx) and under the tiles whose border is within ``reach``. Pixels are counted
    from 0, so there is no tile before the first."""
    first = lambda c: F.floor((F.col(c) - reach) / tile)
    around_it = lambda c: F.explode(F.sequence(F.when(F.col(c) >= 0, F.greatest(first(c), F.lit(0))).otherwise(first(c)), F.floor((F.col(c) + reach) / tile)))
    return df.select(*KEY, *columns, around_it("y").alias("ty")).select("*", around_it("x").alias("tx"))


def near(df: DataFrame, columns: list[str], reach: int, f, fields: dict[str, DataType], keep: tuple[str, ...] = (), tile: int = 512) -> DataFrame:
    """pair_id, y, x, ``keep`` and ``fields`` of each pixel, a function of the pixels of ``columns`` at most ``reach`` around it.

    Pixels are dealt to tiles, those within ``reach`` of a border to the next tile as well, so no task holds more than a batch and a tile and
    one shuffle serves for all columns. ``f`` (Near, values by column) to arrays by field, for the pixels of many small tiles at once.
    """

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*KEY, *keep]].assign(**f(Near(rows), {c: rows[c].to_numpy() for c in columns}))
        return out[(rows["y"] // tile == rows["ty"]) & (rows["x"] // tile == rows["tx"])]

    schema = StructType([StructField(c, df.schema[c].dataType) for c in (*KEY, *keep)] + [StructField(n, t) for n, t in fields.items()])
    return in_whole_groups(dealt(df, list(dict.fromkeys([*columns, *keep])), reach, tile), ["pair_id", "ty", "tx"], whole, schema, ["y", "x"])


def tile_sums(df: DataFrame, columns: list[str], reach: int, f, fields: list[str], ends: list[str], tile: int = 512) -> DataFrame:
    """One row for each tile: pair_id, n, its pixels, ``y`` and ``x``, their greatest, and the sums of ``fields`` over them, which ``f`` makes as
    for ``near``, so that pixels need not come back. Pictures are rectangles without gaps.

    ``wrap_`` of each of the ``ends``, which ``f`` makes too: the sum of the squared differences between the first and last value of each line
    and column. Where a picture goes on beyond the tile it is 0 and ``ends`` tells the first and last value of the tile's lines (axis 0) and columns.
    """

    def line_ends(own: pd.DataFrame) -> list[dict]:
        out = []
        for k, (axis, across) in enumerate((("x", "y"), ("y", "x"))):
            groups = own.sort_values([across, axis]).groupby(across)
            a, b = groups.first(), groups.last()
            for at, lo, hi, first, last in zip(a.index.tolist(), a[axis].tolist(), b[axis].tolist(), a[ends].to_numpy(float).tolist(), b[ends].to_numpy(float).tolist(), strict=True):
                out.append({"axis": k, "at": at, "lo": lo, "hi": hi, "first": first, "last": last})
        return out

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        at = Near(rows)
        values = f(at, {c: rows[c].to_numpy() for c in columns})
        own = ((rows["y"] // tile == rows["ty"]) & (rows["x"] // tile == rows["tx"])).to_numpy()
        total = lambda v: np.add.reduceat(np.where(own, v, 0.0), at.first)
        most = lambda c: np.maximum.reduceat(np.where(own, rows[c].to_numpy(), -1), at.first)
        split = np.add.reduceat(~own, at.first) > 0
        out = {"pair_id": rows["pair_id"].to_numpy()[at.first], "n": total(1.0), "y": most("y"), "x": most("x")} | {c: total(values[c]) for c in fields}
        for c in ends:
            apart = np.zeros(len(at.first))
            for order, (first, place, size) in at.lines.values():
                head = place == 0
                a, b = order[first[head]], order[(first + size - 1)[head]]
                apart += np.bincount(at.tile[a], (values[c][a] - values[c][b]) ** 2, len(apart))
            out[f"wrap_{c}"] = np.where(split, 0.0, apart)
        lists = [[] for _ in at.first]
        for k in np.flatnonzero(split).tolist():
            mine = own & (at.tile == k)
            lists[k] = line_ends(rows.loc[mine, ["y", "x"]].assign(**{c: values[c][mine] for c in ends}))
        return pd.DataFrame(out).assign(ends=lists)[out["n"] > 0]

    schema = ", ".join(["pair_id long, n double, y int, x int", *(f"{c} double" for c in fields), *(f"wrap_{c} double" for c in ends), "ends array<struct<axis: int, at: int, lo: int, hi: int, first: array<double>, last: array<double>>>"])
    return in_whole_groups(dealt(df, columns, reach, tile), ["pair_id", "ty", "tx"], whole, schema, ["y", "x"])


def blur(df: DataFrame, columns: list[str], kernel: list[float], keep: tuple[str, ...] = ()) -> DataFrame:
    """Separable blur of ``columns``: one shuffle for all of them."""
    f = lambda at, v: {c: at.blurred(v[c], kernel) for c in columns}
    return near(df, columns, len(kernel) // 2, f, dict.fromkeys(columns, DoubleType()), keep)


def around(df: DataFrame, column: str, keep: tuple[str, ...] = (), repeat_edge: bool = False, name: str = "around") -> DataFrame:
    """``name``: the 3 x 3 square of ``column`` around each pixel as an array of 9, row by row; two shuffles."""
    border = _clamped if repeat_edge else _mirrored
    step = {"_col": (column, lambda at: F.array(at(-1), at(0), at(1)))}
    tall = along(df, "y", step, keep, border)
    square = {name: ("_col", lambda at: F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda r: F.array(at(-1)[r], at(0)[r], at(1)[r]))))}
    return along(tall, "x", square, keep, border)


def upscale(df: DataFrame, columns: list[str]) -> DataFrame:
    """P4 (linear) by 2: new pixels lie a quarter pixel beside the old ones' centres."""

    def quarters(at: Near, v: dict) -> dict:
        half = lambda a, axis, k: 0.75 * a + 0.25 * a[at.place(axis, 1, True)] if k else 0.25 * a[at.place(axis, -1, True)] + 0.75 * a
        return {f"{c}_{p}{q}": half(half(v[c], "y", p), "x", q) for c in columns for p in (0, 1) for q in (0, 1)}

    four = near(df, columns, 1, quarters, {f"{c}_{p}{q}": DoubleType() for c in columns for p in (0, 1) for q in (0, 1)})
    cells = [F.struct((F.col("y") * 2 + p).alias("y"), (F.col("x") * 2 + q).alias("x"), *(F.col(f"{c}_{p}{q}").alias(c) for c in columns)) for p in (0, 1) for q in (0, 1)]
    return four.select("pair_id", F.inline(F.array(*cells)))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """pair_id, ncc of two gray columns; 0 for fewer than 64 pixels or where it is not defined."""
    ncc = F.corr(a, b)
    return df.groupBy("pair_id").agg(F.when(F.count(F.lit(1)) < 64, 0.0).otherwise(F.coalesce(F.nanvl(ncc, F.lit(0.0)), F.lit(0.0))).alias("ncc"))


def match_histogram(df: DataFrame, source: str, reference: str, name: str = "matched") -> DataFrame:
    """``source`` values moved so that their distribution follows ``reference`` in each pair.

    A value goes to the place of its cumulative share on the reference's cumulative curve, with linear interpolation. Curves have at most 256
    points a pair, so the lookup joins pairs of curves, not pixels.
    """
    from pyspark.sql import Window

    def curve(c: str) -> DataFrame:
        counts = df.groupBy("pair_id", F.col(c).alias("v")).count()
        w = Window.partitionBy("pair_id")
        return counts.select("pair_id", "v", (F.sum("count").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(w)).alias("q"))

    ref = curve(reference).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("q", "v"))).alias("ref"))
    s = curve(source).join(ref, "pair_id")
    ends = s.withColumn("lo", F.try_element_at(F.filter("ref", lambda p: p["q"] <= F.col("q")), F.lit(-1))).withColumn("hi", F.try_element_at(F.filter("ref", lambda p: p["q"] >= F.col("q")), F.lit(1)))
    value = F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).when(F.col("hi.q") == F.col("lo.q"), F.col("hi.v")).otherwise(F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col("q") - F.col("lo.q")) / (F.col("hi.q") - F.col("lo.q")))
    return df.join(ends.select("pair_id", F.col("v").alias(source), value.cast("double").alias(name)), ["pair_id", source])


def fitted(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """P3, P4 (area): images whose longer side exceeds ``most`` shrunk to it by area, parts of pixels counting by their share; others stay."""
    size = df.groupBy("pair_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    scale = most / F.greatest("_h", "_w")
    to = lambda n: F.when(scale < 1, F.greatest(F.lit(1), F.floor(F.col(n) * scale + 1e-9))).otherwise(F.col(n)).cast("int")
    placed = df.select(*KEY, *columns).join(size.withColumns({"_th": to("_h"), "_tw": to("_w")}), "pair_id")

    def parts(at: str, n: str, less: str) -> Column:
        first, last = F.col(at) * F.col(less) / F.col(n), (F.col(at) + 1) * F.col(less) / F.col(n)
        every = F.sequence(F.floor(first + 1e-9), F.greatest(F.floor(first + 1e-9), F.ceil(last - 1e-9) - 1))
        return F.explode(F.transform(every, lambda k: F.struct(k.cast("int").alias("k"), (F.least(last, k + 1) - F.greatest(first, k)).alias("share"))))

    cut_up = placed.withColumn("_py", parts("y", "_h", "_th")).withColumn("_px", parts("x", "_w", "_tw"))
    share = F.col("_py.share") * F.col("_px.share")
    return cut_up.groupBy("pair_id", F.col("_py.k").alias("y"), F.col("_px.k").alias("x")).agg(*(((F.sum(F.col(c) * share)) / F.sum(share)).alias(c) for c in columns))


def bilateral(df: DataFrame, columns: list[str], size: int = 5, colour: float = 50.0, space: float = 50.0) -> DataFrame:
    """Each pixel becomes the mean of the round neighbourhood of ``size`` pixels, weighted by distance and by likeness of all ``columns``
    together (the sum of their differences); whole numbers. Two shuffles for all columns."""
    half = size // 2
    steps = range(-half, half + 1)
    wide = along(df.select(*KEY, F.array(*(F.col(c).cast("double") for c in columns)).alias("_v")), "x", {"_row": ("_v", lambda at: F.array(*(at(k) for k in steps)))})
    near = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * space * space))) for dy in steps for dx in steps if math.hypot(dy, dx) <= half]

    def mixed(at) -> Column:
        middle = at(0)[half]
        some = F.array(*(F.struct(F.lit(w).alias("w"), at(dy)[dx + half].alias("v")) for dy, dx, w in near))
        apart = lambda v: F.aggregate(F.zip_with(v, middle, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d)
        weighed = F.transform(some, lambda n: F.struct((n["w"] * F.exp(-F.pow(apart(n["v"]), F.lit(2)) / (2 * colour * colour))).alias("w"), n["v"].alias("v")))
        zero = F.struct(F.lit(0.0).alias("w"), F.array(*(F.lit(0.0) for _ in columns)).alias("v"))
        add = lambda s, n: F.struct((s["w"] + n["w"]).alias("w"), F.zip_with(s["v"], n["v"], lambda a, b: a + b * n["w"]).alias("v"))
        return F.aggregate(weighed, zero, add, lambda s: F.transform(s["v"], lambda v: F.bround(v / s["w"]).cast("int")))

    out = along(wide, "y", {"_v": ("_row", mixed)})
    return out.select(*KEY, *(F.col("_v")[k].alias(c) for k, c in enumerate(columns)))


def prepared(df: DataFrame, columns: list[str], most: int = 2048, sharp: bool = False, soft_below: float = 60.0) -> DataFrame:
    """Colour images (``columns``: red, green, blue) shrunk to ``most`` pixels a side and, unless ``sharp``, smoothed by a small Gaussian; the soft
    ones among them, by the variance of their Laplacian, also by the bilateral filter, which runs on these alone."""
    small = fitted(df, columns, most).select(*KEY, *(F.bround(c).cast("int").alias(c) for c in columns))
    if sharp:
        return small
    smooth = blur(small, columns, gaussian(3 if most >= 3000 else 5)).select(*KEY, *(F.bround(F.round(F.col(c), 6)).cast("int").alias(c) for c in columns))
    tone = smooth.select(*KEY, gray(*(F.col(c) for c in columns)).alias("_tone"))
    soft = sharpness(tone, "_tone").filter(F.col("sharpness") < soft_below).select("pair_id")
    return smooth.join(soft, "pair_id", "left_anti").unionByName(bilateral(smooth.join(soft, "pair_id", "left_semi"), columns))


def equalise(df: DataFrame, column: str, tiles: int = 8, limit: float = 2.0) -> DataFrame:
    """Contrast-limited adaptive equalisation of a byte ``column``: pair_id, y, x and the column, all others stay.

    Each image is laid out in ``tiles`` by ``tiles``; where one side does not divide, both grow to the next multiple, mirrored at the lower and
    right edge. A tile's histogram is cut off at
    ``limit`` times the even height, what is cut off is spread evenly, and its cumulative share maps the values. A pixel mixes the maps of
    the four tiles whose centres surround it; pixels meet these four maps by one equi-join on the cell between the centres.
    """
    size = df.groupBy("pair_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    size = size.withColumn("_off", (F.col("_h") % tiles != 0) | (F.col("_w") % tiles != 0))
    for side in ("h", "w"):
        size = size.withColumn(f"_t{side}", (F.floor(F.col(f"_{side}") / tiles) + F.col("_off").cast("int")).cast("int"))
    placed = df.join(size, "pair_id")

    def tile_of(axis: str, side: str) -> Column:
        """Tiles of a pixel: its own, and the one where its mirror image beyond the edge lies."""
        beyond = 2 * (F.col(f"_{side}") - 1) - F.col(axis)
        fits = F.col("_off") & (beyond >= F.col(f"_{side}")) & (beyond < tiles * F.col(f"_t{side}"))
        tile = F.col(f"_t{side}")
        return F.explode(F.array_compact(F.array(F.floor(F.col(axis) / tile).cast("int"), F.when(fits, F.floor(beyond / tile).cast("int")))))

    dealt = placed.withColumn("_ty", tile_of("y", "h")).withColumn("_tx", tile_of("x", "w"))
    counts = dealt.groupBy("pair_id", "_ty", "_tx", F.col(column).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("_th") * F.col("_tw")).alias("area"))
    tile = counts.groupBy("pair_id", "_ty", "_tx").agg(F.first("area").alias("area"), F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("n"))
    most = F.greatest(F.floor(limit * F.col("area") / 256), F.lit(1)).cast("long")
    tile = tile.withColumn("_most", most).withColumn("bins", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.try_element_at("n", v), F.lit(0).cast("long"))))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    tile = tile.withColumn("_over", total(F.transform("bins", lambda n: F.greatest(n - F.col("_most"), F.lit(0).cast("long")))))
    each, rest = F.floor(F.col("_over") / 256), F.col("_over") % 256
    step = F.greatest(F.floor(256 / F.greatest(rest, F.lit(1))), F.lit(1))
    spread = lambda n, k: F.least(n, F.col("_most")) + each + F.when((k % step == 0) & (F.floor(k / step) < rest), 1).otherwise(0)
    tile = tile.withColumn("bins", F.transform("bins", spread))
    running = F.aggregate("bins", F.array().cast("array<long>"), lambda a, n: F.concat(a, F.array(n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")))))
    maps = tile.select("pair_id", "_ty", "_tx", F.transform(running, lambda c: clip(F.bround(c * (255 / F.col("area"))), 0.0, 255.0)).alias("map"))

    cells = [F.struct(F.lit(a).alias("cy"), F.lit(b).alias("cx"), F.lit(clipped(a, tiles)).alias("y0"), F.lit(clipped(a + 1, tiles)).alias("y1"), F.lit(clipped(b, tiles)).alias("x0"), F.lit(clipped(b + 1, tiles)).alias("x1")) for a in range(-1, tiles) for b in range(-1, tiles)]
    quads = maps.select("pair_id").distinct().select("pair_id", F.explode(F.array(*cells)).alias("c")).select("pair_id", "c.*")
    for name, ty, tx in (("m00", "y0", "x0"), ("m01", "y0", "x1"), ("m10", "y1", "x0"), ("m11", "y1", "x1")):
        quads = quads.join(maps.select("pair_id", F.col("_ty").alias(ty), F.col("_tx").alias(tx), F.col("map").alias(name)), ["pair_id", ty, tx])
    quads = quads.select("pair_id", F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), "m00", "m01", "m10", "m11")
    fy, fx = F.col("y") / F.col("_th") - 0.5, F.col("x") / F.col("_tw") - 0.5
    mixed = placed.withColumns({"_cy": F.floor(fy).cast("int"), "_cx": F.floor(fx).cast("int"), "_u": fy - F.floor(fy), "_v": fx - F.floor(fx)}).join(quads, ["pair_id", "_cy", "_cx"])
    at = lambda m: F.col(m)[F.col(column).cast("int")]
    upper, lower = at("m00") * (1 - F.col("_v")) + at("m01") * F.col("_v"), at("m10") * (1 - F.col("_v")) + at("m11") * F.col("_v")
    value = clip(F.bround(upper * (1 - F.col("_u")) + lower * F.col("_u")), 0.0, 255.0).cast("int")
    return mixed.withColumn(column, value).select(*df.columns)


def clipped(k: int, n: int) -> int:
    return min(max(k, 0), n - 1)


def normalise(df: DataFrame, ours: str, theirs: str, name: str) -> DataFrame:
    """``theirs`` with mean and deviation of ``ours`` in each pair; unchanged where it has no spread. Byte range."""
    stats = df.groupBy("pair_id").agg(F.avg(ours).alias("m1"), F.stddev_pop(ours).alias("s1"), F.avg(theirs).alias("m2"), F.stddev_pop(theirs).alias("s2"))
    moved = F.when(F.col("s2") > 1e-6, (F.col(theirs) - F.col("m2")) * (F.col("s1") / F.col("s2")) + F.col("m1")).otherwise(F.col(theirs).cast("double"))
    return df.join(stats, "pair_id").withColumn(name, clip(moved, 0.0, 255.0)).drop("m1", "s1", "m2", "s2")


def shrink(df: DataFrame, columns: list[str], factor: int) -> DataFrame:
    """P4 (area) and the size cap of P3: means over factor x factor blocks."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return df.groupBy("pair_id", block("y"), block("x")).agg(*[F.avg(c).alias(c) for c in columns])


def nearest(df: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """P4 (nearest): each new pixel takes the old one at floor(new * old size / new size)."""
    grid = lambda n, old, new, name: F.explode(F.filter(F.sequence(F.lit(0), F.lit(new - 1)), lambda k: F.floor(k * old / new).cast("int") == F.col(n))).alias(name)
    return df.select("*", grid("y", height, to_height, "y_")).select("*", grid("x", width, to_width, "x_")).drop("y", "x").withColumnsRenamed({"y_": "y", "x_": "x"})


def sharpness(df: DataFrame, column: str) -> DataFrame:
    """pair_id, variance of the Laplacian, by which a picture is called noisy or soft."""
    d2 = lambda at: at(-1) - 2 * at(0) + at(1)
    v = along(df.select(*KEY, F.col(column).cast("double").alias("v")), "y", {"vy": ("v", d2)}, keep=("v",))
    h = along(v, "x", {"vx": ("v", d2)}, keep=("vy",))
    return h.groupBy("pair_id").agg(F.var_pop(F.col("vx") + F.col("vy")).alias("sharpness"))
