"""Map coordinates to WGS84 degrees, as column arithmetic (edges of images in Arrow batches): UTM zones by the transverse Mercator series, Web Mercator, and degrees as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid, and scale and offsets of UTM.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
#: First and last EPSG code of UTM zones, the code before zone 1, and whether they lie south of the equator. ETRS89 and NAD83 are
#: taken as WGS84, as transformations without a grid do.
UTM_CODES = ((32601, 32660, 32600, False), (32701, 32760, 32700, True), (25828, 25838, 25800, False), (26901, 26923, 26900, False))
WEB_MERCATOR, DEGREES = (3857, 900913, 102100), (4326, 4258, 4269)

_N = FLATTENING / (2 - FLATTENING)
#: Coefficients of n, n^2, ... n^6 of the inverse series (rectifying to conformal sphere, conformal to geodetic latitude).
_TO_SPHERE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
_TO_LATITUDE = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175),
    (0, 0, 0, 0, 4174 / 315, -144838 / 6237),
    (0, 0, 0, 0, 0, 601676 / 22275),
)


def series(table: tuple) -> list[float]:
    """Values of a table of coefficients for the ellipsoid's third flattening."""
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in table]


#: Length of the rectifying radius.
RECTIFYING = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, which keeps the expressions of the series small."""
    return F.transform(F.array(value), body)[0]


def utm_zone(epsg: Column) -> Column:
    """struct<zone, north>: zone number and the northing of its equator; null for codes that are no UTM zone."""
    out = F.when(F.lit(False), F.struct(F.lit(0).alias("zone"), F.lit(0.0).alias("north")))
    for first, last, before, south in UTM_CODES:
        out = out.when(epsg.between(first, last), F.struct((epsg - before).cast("int").alias("zone"), F.lit(FALSE_NORTH if south else 0.0).alias("north")))
    return out


def utm_lng_lat(east: Column, north: Column, zone: Column) -> Column:
    """struct<lng, lat> of a place in a UTM zone (``utm_zone``), to a millionth of a second within 3,000 km of its meridian."""
    unit = UTM_SCALE * RECTIFYING

    def on_sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for k, c in enumerate(series(_TO_SPHERE), 1):
            xi, eta = xi - c * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"]), eta - c * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def on_earth(q: Column) -> Column:
        lng = F.degrees(F.atan2(F.sinh(q["eta"]), F.cos(q["xi"]))) + (6 * zone["zone"] - 183)
        return F.struct(lng.alias("lng"), let(F.asin(F.sin(q["xi"]) / F.cosh(q["eta"])), geodetic).alias("lat"))

    def geodetic(conformal: Column) -> Column:
        return F.degrees(sum((c * F.sin(2 * k * conformal) for k, c in enumerate(series(_TO_LATITUDE), 1)), conformal))

    rectified = F.struct(((north - zone["north"]) / unit).alias("xi"), ((east - FALSE_EAST) / unit).alias("eta"))
    return let(let(rectified, on_sphere), on_earth)


def lng_lat(x: Column, y: Column, epsg: Column) -> Column:
    """struct<lng, lat> in WGS84 of map coordinates by their EPSG code; no code counts as degrees, one that is not known gives null."""
    mercator = F.struct(F.degrees(x / RADIUS).alias("lng"), F.degrees(F.atan(F.sinh(y / RADIUS))).alias("lat"))
    plain = F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat"))
    utm = let(utm_zone(epsg), lambda zone: F.when(zone.isNotNull(), utm_lng_lat(x, y, zone)))
    return F.when(epsg.isNull() | epsg.isin(*DEGREES), plain).when(epsg.isin(*WEB_MERCATOR), mercator).otherwise(utm)


def pixel_lng_lat(x: Column, y: Column, t: Column, epsg: Column, scale_x: Column, scale_y: Column) -> Column:
    """struct<lng, lat> of the centre of a detection pixel: scaled to native pixels, through the transform array a..f, to WGS84."""
    px, py = x * scale_x + 0.5, y * scale_y + 0.5
    return lng_lat(t[0] * px + t[1] * py + t[2], t[3] * px + t[4] * py + t[5], epsg)


def _zone(epsg: int) -> tuple[int, float] | None:
    """Zone number and the northing of its equator, as ``utm_zone``."""
    for first, last, before, south in UTM_CODES:
        if first <= epsg <= last:
            return epsg - before, FALSE_NORTH if south else 0.0
    return None


def _multiples(c: np.ndarray, s: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(Hyperbolic) cosines and sines of an angle's multiples, from those of the angle itself."""
    c0, s0, c1, s1 = np.ones_like(c), np.zeros_like(s), c, s
    for _ in range(n):
        yield c1, s1
        c0, s0, c1, s1 = c1, s1, 2 * c * c1 - c0, 2 * c * s1 - s0


def _extremes(x: np.ndarray, y: np.ndarray, epsg: int) -> list[np.ndarray]:
    """West, south, east and north of each row of places; latitudes grow with y or with the sine of the sphere's, so only the extreme ones
    go through their series."""
    if epsg in DEGREES:
        return [np.fmin.reduce(x, 1), np.fmin.reduce(y, 1), x.max(1), y.max(1)]
    if epsg in WEB_MERCATOR:
        lat = lambda v: np.degrees(np.arctan(np.sinh(v / RADIUS)))
        return [np.degrees(np.fmin.reduce(x, 1) / RADIUS), lat(np.fmin.reduce(y, 1)), np.degrees(x.max(1) / RADIUS), lat(y.max(1))]
    number, equator = _zone(epsg)
    xi, eta = (y - equator) / (UTM_SCALE * RECTIFYING), (x - FALSE_EAST) / (UTM_SCALE * RECTIFYING)
    grow = np.exp(2 * eta)
    turns, growths = _multiples(np.cos(2 * xi), np.sin(2 * xi), 6), _multiples((grow + 1 / grow) / 2, (grow - 1 / grow) / 2, 6)
    for c, (cos, sin), (cosh, sinh) in zip(series(_TO_SPHERE), turns, growths, strict=True):
        xi, eta = xi - c * sin * cosh, eta - c * cos * sinh
    grow = np.exp(eta)
    lng = np.arctan2((grow - 1 / grow) / 2, np.cos(xi))
    sines = np.sin(xi) / ((grow + 1 / grow) / 2)

    def lat(v: np.ndarray) -> np.ndarray:
        chi = np.arcsin(v)
        return np.degrees(chi + sum(c * np.sin(2 * k * chi) for k, c in enumerate(series(_TO_LATITUDE), 1)))

    place = lambda v: np.degrees(v) + 6 * number - 183
    return [place(np.fmin.reduce(lng, 1)), lat(np.fmin.reduce(sines, 1)), place(lng.max(1)), lat(sines.max(1))]


def _edges(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, width: pd.Series, height: pd.Series, epsg: pd.Series, steps: pd.Series) -> pd.DataFrame:
    """Bounds along the edges of images whose codes are known, some hundred images at a time."""
    out = np.full((len(a), 4), np.nan)
    if len(a):
        parts = np.arange(steps.iloc[0] + 2) / (steps.iloc[0] + 1)
        u, v = np.unique([p for s in parts for p in ((s, 0.0), (s, 1.0), (0.0, s), (1.0, s))], axis=0).T
        t, codes = np.stack([a, b, c, d, e, f]).astype(float)[..., None], epsg.to_numpy()
        with np.errstate(all="ignore"):
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                for rows in np.array_split(own, len(own) // 400 + 1):
                    px, py = u * width.to_numpy()[rows, None], v * height.to_numpy()[rows, None]
                    k = t[:, rows]
                    out[rows] = np.stack(_extremes(k[0] * px + k[1] * py + k[2], k[3] * px + k[4] * py + k[5], int(code)), 1)
    return pd.DataFrame(out, columns=["west", "south", "east", "north"])


def bounds(t: Column, width: Column, height: Column, epsg: Column, steps: int = 21) -> Column:
    """struct<west, south, east, north> in WGS84 of an image with transform array a..f.

    Straight edges of a projected image are curves in degrees, so each edge is followed at ``steps`` points besides its ends. Null without
    all of the numbers or with a code that is not known.
    """
    code = F.coalesce(epsg.cast("int"), F.lit(DEGREES[0]))
    known = code.isin(*DEGREES, *WEB_MERCATOR)
    for first, last, _, _ in UTM_CODES:
        known = known | code.between(first, last)
    numbers = [t[k] for k in range(6)] + [width, height]
    there = known
    for n in numbers:
        there = there & n.isNotNull()
    edges = F.pandas_udf(_edges, "west double, south double, east double, north double")
    found = edges(*(F.coalesce(n.cast("double"), F.lit(0.0)) for n in numbers), F.when(known, code).otherwise(DEGREES[0]), F.lit(steps))
    return F.when(there, found)
