"""Additive rule tables: each class scores the sum of the rules that hold; the greatest score wins, the first of equals.

Rules are SQL conditions over feature columns: plain names are the image after, b_ the image before, d_ after minus before; ssim, lab,
hull, lines and corners compare or describe both; area, w, h and asp describe the region. They are data, so a table can be changed or stored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule tables (condition, score).
STRUCTURAL = [("d_lines > 2", 0.28), ("d_corners > 3", 0.24), ("d_edge > 8", 0.20), ("hull > 0.35", 0.18), ("lines > 4", 0.14), ("ssim < 0.65", 0.12), ("edge > 35", 0.18), ("entropy < 2.4", 0.14)]
PERMANENT = [
    ("abs(d_lines) >= 5", 0.22),
    ("abs(d_corners) >= 7", 0.22),
    ("abs(d_edge) >= 12", 0.18),
    ("hull >= 0.52 AND area >= 2500 AND (abs(d_lines) >= 4 OR abs(d_corners) >= 6)", 0.14),
    ("ssim < 0.55 AND (abs(d_lines) >= 3 OR abs(d_corners) >= 4)", 0.14),
    ("area >= 12000 AND fill >= 0.35", 0.10),
    ("entropy < 2.2 AND lines >= 8", 0.10),
]
CLASS_RULES = {
    "Water Body Change": [("blue > 0.38", 0.22), ("texture < 26", 0.18), ("edge < 28", 0.16), ("hue BETWEEN 95 AND 130", 0.18), ("lbp < 0.045", 0.14), ("contrast < 450", 0.08), ("area > 1200", 0.04)],
    "Vegetation Change": [
        ("abs(d_ndvi) > 0.08", 0.25),
        ("abs(d_exg) > 0.04", 0.20),
        ("abs(d_exg) > 0.02 AND abs(d_exg) <= 0.04", 0.10),
        ("abs(d_green) > 0.04", 0.15),
        ("lab > 15 AND (b_ndvi > 0.05 OR ndvi > 0.05)", 0.12),
        ("abs(d_sat) > 15 AND (b_green > 0.34 OR green > 0.34)", 0.12),
        ("d_lines < 3 AND d_corners < 5", 0.06),
        ("area > 500", 0.04),
    ],
    "New Construction/Building": [
        ("d_edge > 20", 0.22),
        ("d_edge > 10 AND d_edge <= 20", 0.16),
        ("d_edge > 5 AND d_edge <= 10", 0.08),
        ("d_entropy < -0.6", 0.15),
        ("d_entropy < -0.2 AND d_entropy >= -0.6", 0.10),
        ("d_lines > 8", 0.16),
        ("d_lines > 3 AND d_lines <= 8", 0.10),
        ("d_lines > 1 AND d_lines <= 3", 0.05),
        ("d_corners > 10", 0.14),
        ("d_corners > 4 AND d_corners <= 10", 0.10),
        ("d_corners > 1 AND d_corners <= 4", 0.05),
        ("ndvi < 0.08 AND b_ndvi > 0.02", 0.10),
        ("d_bright > 8", 0.06),
        ("hull > 0.50 AND (d_lines > 2 OR d_corners > 3)", 0.10),
        ("hull > 0.35 AND hull <= 0.50 AND (d_lines > 1 OR d_corners > 2)", 0.05),
        ("lines > 4 AND corners > 6", 0.08),
        ("lab > 25", 0.08),
        ("lab > 15 AND lab <= 25", 0.04),
        ("ssim < 0.4", 0.14),
        ("ssim < 0.6 AND ssim >= 0.4", 0.10),
        ("ssim < 0.75 AND ssim >= 0.6", 0.05),
        ("ndvi < 0.05 AND edge > 25", 0.08),
        ("hull - b_hull > 0.2", 0.06),
        ("asp BETWEEN 1 AND 5", 0.06),
        ("area > 600", 0.04),
    ],
    "Demolition/Clearing": [
        ("d_edge < -20", 0.22),
        ("d_edge < -10 AND d_edge >= -20", 0.16),
        ("d_edge < -5 AND d_edge >= -10", 0.08),
        ("d_lines < -8", 0.18),
        ("d_lines < -3 AND d_lines >= -8", 0.12),
        ("d_lines < -1 AND d_lines >= -3", 0.05),
        ("d_corners < -10", 0.15),
        ("d_corners < -4 AND d_corners >= -10", 0.10),
        ("d_corners < -1 AND d_corners >= -4", 0.05),
        ("d_texture > 8", 0.10),
        ("d_bright > 10", 0.10),
        ("b_lines > 4 AND lines <= 1", 0.10),
        ("b_hull - hull > 0.2", 0.08),
        ("ssim < 0.5", 0.08),
        ("ndvi > 0.03 AND b_ndvi < 0.02", 0.06),
        ("area > 500", 0.04),
    ],
    "Road/Pavement Change": [("asp > 2.5", 0.22), ("homog < 22", 0.18), ("texture < 32", 0.15), ("sat < 65", 0.12), ("entropy < 2.0", 0.15), ("bright BETWEEN 35 AND 75", 0.10), ("compact < 0.3", 0.05), ("area > 600", 0.03)],
    "Temporary Structure": [
        ("d_edge > 3 AND d_edge < 20", 0.16),
        ("d_lines > 0 AND d_lines <= 5", 0.12),
        ("d_corners > 0 AND d_corners <= 6", 0.10),
        ("hull < 0.50", 0.10),
        ("ndvi < 0.08", 0.08),
        ("ssim > 0.3 AND ssim < 0.7", 0.10),
        ("lab > 10", 0.08),
        ("area BETWEEN 200 AND 5000", 0.08),
        ("asp BETWEEN 1 AND 3.5", 0.06),
    ],
    "Bare Land/Soil Change": [("red > 0.34 AND green < 0.36", 0.20), ("hue BETWEEN 8 AND 38", 0.18), ("ndvi < 0.05", 0.18), ("texture < 35", 0.12), ("lbp < 0.04", 0.12), ("sat BETWEEN 40 AND 130", 0.10), ("bright BETWEEN 45 AND 82", 0.10)],
}
#: What water looks like, and the classes that have rules of their own for an image alone, without one before it.
WATER_CUES = ("blue > 0.38", "edge < 28", "texture < 26", "hue BETWEEN 95 AND 130", "lbp < 0.045")
SINGLE_RULES = CLASS_RULES | {
    "Vegetation Change": [("ndvi > 0.05", 0.22), ("ndvi > 0.15", 0.10), ("green > 0.36", 0.18), ("hue BETWEEN 35 AND 85", 0.15), ("sat > 40", 0.10), ("entropy > 2.5", 0.05), ("area > 500", 0.04)],
    "New Construction/Building": [
        ("entropy < 2.5", 0.18), ("homog < 28", 0.15), ("asp BETWEEN 1 AND 5", 0.10), ("compact BETWEEN 0.2 AND 0.95", 0.10), ("edge > 25", 0.14),
        ("contrast > 300", 0.10), ("sat < 100", 0.08), ("bright BETWEEN 30 AND 95", 0.08), ("area > 600", 0.05),
    ],
    "Demolition/Clearing": [("texture > 30", 0.18), ("entropy > 2.8", 0.15), ("homog > 25", 0.15), ("bright > 60", 0.10), ("ndvi < 0.05", 0.12), ("sat < 70", 0.10), ("area > 800", 0.05)],
    "Temporary Structure": [
        ("edge > 15 AND edge < 50", 0.18), ("entropy > 2.0", 0.12), ("homog > 20", 0.10), ("ndvi < 0.08", 0.12), ("area BETWEEN 200 AND 5000", 0.10),
        ("asp BETWEEN 1 AND 3.5", 0.08), ("sat < 100", 0.06),
    ],
}
#: What the columns that compare two images hold where there is one only.
SINGLE_VALUES = {"d_edge": 0.0, "d_lines": 0, "d_corners": 0, "lines": 0, "corners": 0, "hull": 0.5, "lab": 0.0, "ssim": 1.0}
VEGETATION_KINDS = {
    "Deforestation/Tree Removal": [("b_ndvi > 0.08 AND d_ndvi < -0.06", 0.30), ("b_green > 0.36 AND d_green < -0.03", 0.20), ("bright > b_bright + 10", 0.15), ("d_sat < -15", 0.15), ("entropy < b_entropy - 0.3", 0.10)],
    "New Vegetation/Growth": [("ndvi > 0.08 AND d_ndvi > 0.06", 0.30), ("green > 0.36 AND d_green > 0.03", 0.20), ("d_sat > 15", 0.15), ("bright < b_bright - 5", 0.10), ("entropy > b_entropy + 0.2", 0.10)],
    "Crop/Agricultural Change": [("b_entropy < 2.5 OR entropy < 2.5", 0.25), ("abs(d_ndvi) > 0.03 AND abs(d_ndvi) < 0.12", 0.20), ("b_sat > 35 AND sat > 35", 0.15), ("abs(d_green) < 0.04 AND abs(d_ndvi) > 0.02", 0.15), ("area > 3000", 0.10)],
    "Vegetation Health Decline": [("b_ndvi > 0.05 AND ndvi > 0.02 AND d_ndvi < -0.03", 0.25), ("b_green > 0.34 AND green > 0.30 AND d_green < -0.02", 0.20), ("d_sat > -20 AND d_sat < -3", 0.20), ("abs(d_bright) < 15", 0.10)],
    "Seasonal Variation": [("b_ndvi > 0.04 AND ndvi > 0.04 AND abs(d_ndvi) < 0.05", 0.25), ("abs(d_green) < 0.03", 0.20), ("abs(d_sat) < 12", 0.15), ("abs(d_bright) < 12", 0.15)],
}
_WAS, _IS = "(b_edge > 25 AND b_entropy < 2.8)", "(edge > 25 AND entropy < 2.8)"
BUILDING_KINDS = {
    "New Building": [(f"NOT {_WAS} AND {_IS}", 0.35), ("edge > b_edge + 15", 0.15), ("entropy < b_entropy - 0.3", 0.10), ("b_ndvi > 0.05 AND ndvi < 0.03", 0.10), ("sat < b_sat - 10", 0.10)],
    "Building Expansion": [(f"{_WAS} AND {_IS}", 0.15), (f"{_WAS} AND edge > 1.2 * b_edge", 0.20), (f"{_WAS} AND texture > b_texture + 5", 0.15), ("abs(d_entropy) < 0.5 AND edge > b_edge", 0.15)],
    "Renovation/Modification": [(f"{_WAS} AND {_IS}", 0.15), ("abs(d_edge) < 12", 0.15), ("abs(d_bright) > 8", 0.20), ("abs(d_sat) > 10", 0.10), ("abs(d_texture) < 10", 0.10)],
    "Partial Demolition": [(f"{_WAS} AND edge < 0.7 * b_edge", 0.25), (f"{_WAS} AND entropy > b_entropy + 0.3", 0.15), ("texture > b_texture + 8", 0.15), ("bright > b_bright + 10", 0.10)],
    "Full Demolition": [(f"{_WAS} AND NOT {_IS}", 0.35), ("b_edge > 30 AND edge < 20", 0.15), ("b_texture > 25 AND texture < 20", 0.15), ("bright > b_bright + 15", 0.10)],
    "Infrastructure Change": [("asp > 3", 0.25), ("entropy < 2 OR b_entropy < 2", 0.15), ("area > 2000 AND asp > 2.5", 0.15)],
}
ROAD_KINDS = {
    "New Road/Pavement": [(f"NOT {_WAS} AND {_IS}", 0.30), ("edge > b_edge + 10", 0.20), ("bright < b_bright", 0.15)],
    "Road Widening": [(f"{_WAS} AND {_IS} AND edge > 1.15 * b_edge", 0.30), ("area > 2000", 0.15)],
    "Road Resurfacing": [(f"{_WAS} AND {_IS} AND abs(d_edge) < 10", 0.20), ("abs(d_bright) > 12", 0.25), ("abs(d_texture) < 8", 0.15)],
    "Road Deterioration": [("texture > b_texture + 10", 0.25), ("edge < b_edge - 5", 0.20), ("bright > b_bright + 8", 0.15)],
}
STAGES = {
    "Foundation": [("texture < 22", 0.25), ("edge < 30", 0.20), ("homog < 20", 0.20), ("bright BETWEEN 40 AND 75", 0.15), ("sat < 60", 0.10), ("lbp < 0.03", 0.10)],
    "Structural": [("edge > 50", 0.25), ("entropy < 2.2", 0.20), ("contrast > 800", 0.20), ("texture > 30", 0.15), ("homog > 30", 0.10), ("area > 1000", 0.10)],
    "Under Construction": [("texture > 25 AND texture < 50", 0.20), ("edge > 35 AND edge < 65", 0.20), ("entropy > 2.6", 0.20), ("homog > 25", 0.15), ("lbp > 0.03 AND lbp < 0.07", 0.15), ("sat < 80", 0.10)],
    "Complete": [("texture < 28", 0.20), ("entropy < 2.3", 0.25), ("homog < 22", 0.20), ("edge > 25", 0.10), ("lbp < 0.04", 0.15), ("bright > 50", 0.10)],
}
#: Predicates of passing objects, in terms of columns; {limit} is the greatest vehicle area.
RADIOMETRIC = "NOT (area < 180 OR area > 2.5 * {limit}) AND NOT asp > 9 AND NOT ndvi > 0.22 AND NOT (lab < 8 AND ssim > 0.72) AND area <= {limit} AND asp BETWEEN 1 AND 8 AND ndvi < 0.20 AND ((lab >= 10 AND abs(d_lines) + abs(d_corners) <= 20) OR (ssim < 0.65 AND abs(d_lines) + abs(d_corners) <= 16))"
VEHICLE = """CASE WHEN area < 200 THEN true WHEN area > 3 * {limit} THEN false WHEN {radiometric} THEN true WHEN permanent >= 0.42 AND area >= 4000 THEN false
 WHEN area <= {limit} AND asp BETWEEN 1.05 AND 8 AND ndvi < 0.16 AND permanent < 0.35 THEN true
 WHEN area <= {limit} AND asp BETWEEN 1.05 AND 8 AND ndvi < 0.16 AND edge > 10 AND lines + corners < 20 AND hull < 0.72 THEN true
 WHEN area <= {limit} AND asp BETWEEN 1.05 AND 8 AND ndvi < 0.16 AND homog < 35 AND edge > 14 AND permanent < 0.40 THEN true
 WHEN area <= {limit} AND ndvi < 0.14 AND abs(d_lines) <= 12 AND abs(d_corners) <= 16 AND permanent < 0.34 AND lab > 6 AND asp BETWEEN 1 AND 7.5 THEN true
 WHEN area <= {limit} AND ndvi < 0.14 AND abs(d_edge) > 8 AND abs(d_lines) + abs(d_corners) < 18 AND permanent < 0.36 AND asp BETWEEN 1.1 AND 6.5 AND bright BETWEEN 25 AND 110 THEN true
 WHEN asp BETWEEN 1.8 AND 7 AND area BETWEEN 300 AND {limit} AND edge > 14 AND abs(d_lines) + abs(d_corners) < 14 AND ndvi < 0.12 AND permanent < 0.32 THEN true ELSE false END"""
SUPPRESSED = "({vehicle}) OR ({radiometric}) OR (area <= 2 * {limit} AND permanent < 0.26 AND asp < 9 AND ndvi < 0.20)"
PASSING = "({vehicle}) OR area < 550 OR (asp > 5 AND area < 3000) OR (edge > 70 AND area < 2800) OR (texture > 50 AND area < 1800)"


def total_sql(rules: list[tuple[str, float]], cap: bool = False) -> str:
    total = " + ".join(f"CASE WHEN {c} THEN {s}D ELSE 0D END" for c, s in rules)
    return f"least(1D, {total})" if cap else f"({total})"


def total(rules: list[tuple[str, float]], cap: bool = False) -> Column:
    """Sum of the scores of the rules that hold; a condition over a null does not hold."""
    return F.expr(total_sql(rules, cap))


def best(scores: list[tuple[str, Column]], least: float, otherwise: str, otherwise_score: float | None = None) -> Column:
    """struct<name, score> of the greatest score, the first listed of equals; ``otherwise`` below ``least``."""
    listed = F.array(*[F.struct(F.round(s, 9).alias("score"), F.lit(-k).alias("place"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scores)])
    top = F.array_max(listed)
    low = top["score"] < least
    return F.struct(F.when(low, otherwise).otherwise(top["name"]).alias("name"), F.when(low, F.lit(otherwise_score) if otherwise_score is not None else top["score"]).otherwise(F.least(top["score"], F.lit(1.0))).alias("score"))


def best_of(table: dict[str, list[tuple[str, float]]], least: float, otherwise: str, otherwise_score: float | None = None) -> Column:
    return best([(n, total(r)) for n, r in table.items()], least, otherwise, otherwise_score)


def predicate(sql: str, limit: int | str) -> Column:
    """A predicate of passing objects; ``limit`` is the greatest vehicle area, a number or the name of a column."""
    radiometric = RADIOMETRIC.format(limit=limit)
    vehicle = VEHICLE.format(limit=limit, radiometric=radiometric)
    return F.coalesce(F.expr(sql.format(limit=limit, radiometric=radiometric, vehicle=vehicle)), F.lit(False))


def classified(limit: int | str, table: dict[str, list[tuple[str, float]]] = CLASS_RULES) -> Column:
    """struct<name, score> of a region's class by the rules of ``table``.

    Structural evidence rules out water or moves it towards construction, few water cues lower water, a damped construction score goes with
    a passing object, and construction that comes close to water wins where there is structure. Needs ``structural`` and ``permanent``.
    """
    scores = {n: total(r) for n, r in table.items()}
    cues = sum((F.when(F.expr(c), 1).otherwise(0) for c in WATER_CUES), F.lit(0))
    structural, small = F.col("structural"), F.expr(f"area < {limit}")
    water = F.when(structural >= 0.25, 0.0).otherwise(scores["Water Body Change"] * F.when(cues < 3, 0.45).when(cues < 4, 0.75).otherwise(1.0))
    built = scores["New Construction/Building"] * F.when(small & predicate("{radiometric}", limit), 0.15).when(small & (F.col("permanent") < 0.34), 0.25).otherwise(1.0)
    moved = structural >= 0.30
    water = F.when(moved, water * F.greatest(F.lit(0.1), 1 - structural * 1.2)).otherwise(water)
    built = F.when(moved, F.least(F.lit(1.0), built + structural * 0.45)).otherwise(built)
    scores["Water Body Change"], scores["New Construction/Building"] = water, built
    scores["Road/Pavement Change"] = F.when(small & (F.col("asp") < 6.5), 0.0).otherwise(scores["Road/Pavement Change"])
    scores["Temporary Structure"] = F.when(small & (F.col("asp") < 5), 0.0).otherwise(scores["Temporary Structure"])
    top = best(list(scores.items()), 0.0, "Unclassified")
    preferred = (top["name"] == "Water Body Change") & (built >= top["score"] * 0.72) & (structural >= 0.22)
    name, score = F.when(preferred, "New Construction/Building").otherwise(top["name"]), F.when(preferred, built).otherwise(top["score"])
    return F.struct(F.when(score < 0.28, "Unclassified").otherwise(name).alias("name"), F.least(score, F.lit(1.0)).alias("score"))


def stories(shadow_ratio: Column, w: Column, h: Column, entropy: Column) -> Column:
    """Estimated storeys from the shadow, or else the footprint; half-even rounding, 1..50. Height is 3 m each."""
    area, long_, short = w * h, F.greatest(w, h), F.greatest(F.least(w, h), F.lit(1))
    base = F.when(shadow_ratio > 0.1, shadow_ratio / 0.35).when(area > 5000, 3.0).when(area > 2000, 2.0).otherwise(1.0)
    factor = F.when(long_ / short > 3.0, 0.5).when((long_ / short < 1.5) & (area > 2000), 1.3).otherwise(1.0)
    return F.least(F.greatest(F.bround(base * factor + F.when(entropy < 2.2, 0.5).otherwise(0.0)).cast("int"), F.lit(1)), F.lit(50))
