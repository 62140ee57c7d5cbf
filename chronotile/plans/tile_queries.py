"""Queries of the tiling, registration and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotile.operators import registration as R
from chronotile.operators import tiling as T
from chronotile.plans.bridges import GRAY_SQL, PIXELS_SQL, gray_pairs, pixels
from chronotile.plans.registry import query
from chronotile.streaming import events as E


@query("s06_window_grid", """WITH i AS (SELECT p_partkey, p_size * 40 + 100 AS height, p_partkey % 900 + 50 AS width FROM part),
g AS (SELECT p_partkey, height, width, unnest(list_distinct(list_concat(range(0, greatest(height - 512, 0) + 1, 384), [greatest(height - 512, 0)]))) AS y0 FROM i),
f AS (SELECT *, unnest(list_distinct(list_concat(range(0, greatest(width - 512, 0) + 1, 384), [greatest(width - 512, 0)]))) AS x0 FROM g)
SELECT p_partkey, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, CAST(least(512, height - y0) AS INT) AS h, CAST(least(512, width - x0) AS INT) AS w FROM f""")
def _(t):
    """S6, M20, ST1."""
    images = t("part").select("p_partkey", (F.col("p_size") * 40 + 100).cast("int").alias("height"), (F.col("p_partkey") % 900 + 50).cast("int").alias("width"))
    return T.window_grid(images).select("p_partkey", "y0", "x0", "h", "w")


@query("m14_scored_tiles", f"WITH {PIXELS_SQL} SELECT pair_id, y, x, round((abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2)) / 3.0::DOUBLE / 255, 6) AS score FROM px")
def _(t):
    """Tiles through a scorer in Arrow batches, with mirrored passes."""
    return T.unpacked(T.scored_tiles(T.packed(pixels(t("embeddings"))), T.averaged(T.difference_scorer, "full"))).select("pair_id", "y", "x", F.round("score", 6).alias("score"))


_RAMP = "CASE WHEN least({0}, 5 - ({0})) < 3 THEN least({0}, 5 - ({0})) / 2.0::DOUBLE ELSE 1.0 END"


def _windows(t, size: int, step: int):
    """Gray pixels of the overlapping windows of each pair, with the window and the size of the image."""
    g = gray_pairs(t("embeddings"))
    images = g.groupBy("pair_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    grid = images.withColumn("y0", F.explode(T.starts(F.col("height"), size, step))).withColumn("x0", F.explode(T.starts(F.col("width"), size, step)))
    tiles = T.tiles_of(g, grid.withColumns({"h": F.lit(size), "w": F.lit(size)}), size)
    return tiles.join(images, "pair_id").select("pair_id", "height", "width", "y", "x", "y0", "x0", F.col("th").alias("h"), F.col("tw").alias("w"), (F.col("g1") / 255.0).alias("score"))


@query("m15_blended_tiles", f"""WITH {GRAY_SQL}, t AS (SELECT unnest([0, 3, 6]) AS y0), u AS (SELECT unnest([0, 3, 6]) AS x0),
s AS (SELECT pair_id, y, x, g1 / 255.0::DOUBLE + y0 * 0.01 + x0 * 0.003 AS v, {_RAMP.format('y - y0')} * {_RAMP.format('x - x0')} AS w FROM gp, t, u
  WHERE y BETWEEN y0 AND y0 + 5 AND x BETWEEN x0 AND x0 + 5)
SELECT pair_id, y, x, round(sum(v * w) / greatest(sum(w), 1e-6), 6) AS score FROM s GROUP BY 1, 2, 3""")
def _(t):
    """Tiles of 6 with an overlap of 3 over images mirrored to 12 pixels, each tile with scores of its own."""
    tiles = T.overlapping_tiles(gray_pairs(t("embeddings")), 6, 3)
    scored = tiles.withColumn("score", F.col("g1") / 255.0 + F.col("y0") * 0.01 + F.col("x0") * 0.003)
    return T.blended(scored, 6, 3).select("pair_id", "y", "x", F.round("score", 6).alias("score"))


@query("m18_windowed_scores", f"""WITH {GRAY_SQL}, t AS (SELECT unnest([0, 2]) AS y0), u AS (SELECT unnest([0, 2]) AS x0),
s AS (SELECT pair_id, y0, x0, (y - y0) // 2 AS ky, (x - x0) // 2 AS kx, avg(g1 / 255.0::DOUBLE) AS v FROM gp, t, u
  WHERE y BETWEEN y0 AND y0 + 5 AND x BETWEEN x0 AND x0 + 5 GROUP BY ALL),
w AS (SELECT *, greatest((0.5 - 0.5 * cos(2 * pi() * (ky + 1) / 4)) * (0.5 - 0.5 * cos(2 * pi() * (kx + 1) / 4)), 0.001) AS w FROM s)
SELECT pair_id, CAST(y0 // 2 + ky AS INT) AS y, CAST(x0 // 2 + kx AS INT) AS x, round(sum(v * w) / sum(w), 6) AS score FROM w GROUP BY 1, 2, 3""")
def _(t):
    """Windows of 6 every 4 pixels, shrunk to half on a canvas of 4 x 4."""
    return T.on_canvas(_windows(t, 6, 4), 4, 4).select("pair_id", "y", "x", F.round("score", 6).alias("score"))


@query("m17_over_scales", f"WITH {GRAY_SQL} SELECT pair_id, y, x, greatest(g1, g2) AS score, CASE WHEN greatest(g1, g2) >= 150 THEN 1 ELSE 0 END AS \"on\" FROM gp")
def _(t):
    g = gray_pairs(t("embeddings"))
    return T.over_scales([g.withColumn("score", F.col("g1")), g.withColumn("score", F.col("g2"))], 150)


@query("p06_phase_shift")
def _(t):
    return R.shifts(gray_pairs(t("embeddings"))).select("pair_id", "dy", "dx")


@query("p07_ratio_matches", """WITH e AS (SELECT vec_id // 50 AS pair_id, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.pair_id, a.id, b.id AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e a JOIN e b ON a.pair_id = b.pair_id AND a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS s FROM d WINDOW w AS (PARTITION BY pair_id, id ORDER BY d, other)) SELECT pair_id, id, other, round(d, 6) AS d FROM r WHERE k = 1 AND d < 0.98 * s""")
def _(t):
    """Nearest descriptor with a ratio test."""
    e = t("embeddings").select(F.floor(F.col("vec_id") / 50).alias("pair_id"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    m = R.ratio_matches(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), 0.98)
    return m.select("pair_id", "id", "other", F.round("d", 6).alias("d"))


@query("p12_registration_policy", """WITH c AS (SELECT p_partkey AS pair_id, CASE WHEN p_size % 5 > 0 THEN p_size / 50.0 ELSE 0 END AS a, p_partkey % 60 / 60.0 AS b, p_partkey % 37 / 37.0 AS m, p_partkey % 41 / 41.0 AS d FROM part),
u AS (SELECT *, CASE WHEN a < 0.25 AND b > a THEN b ELSE a END AS r, CASE WHEN a < 0.25 AND b > a THEN 'second' ELSE 'first' END AS n FROM c)
SELECT pair_id, CASE WHEN r >= 0.35 AND m >= 0.55 THEN n WHEN r >= 0.35 THEN n || '_rejected' ELSE 'direct' END AS method, CASE WHEN r >= 0.35 THEN m >= 0.55 ELSE d >= 0.5 END AS ok FROM u""")
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    return R.policy(t("part").select(key.alias("pair_id"), F.when(size % 5 > 0, size / 50).alias("first_ratio"), (key % 60 / 60).alias("second_ratio"), (key % 37 / 37).alias("ncc_matched"), (key % 41 / 41).alias("ncc_direct")))


@query("st_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(t):
    """Extension: the streaming aggregate as a batch; tests hold the stream against it."""
    return E.counts_by_window(t("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
