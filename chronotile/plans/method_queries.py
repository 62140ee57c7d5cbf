"""Queries of whole detection methods and of shadows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotile.functions.lineage import cut
from chronotile.operators import masks as M
from chronotile.operators import methods as D
from chronotile.operators import regions as G
from chronotile.operators import tiling as T
from chronotile.plans.bridges import GRAY_SQL, PIXELS_SQL, gray_pairs, pixels
from chronotile.plans.registry import query


@query("m03_feature_clusters")
def _(t):
    return M.run_statistics(D.feature_mask(pixels(t("embeddings"))))


@query("m10_model_mask", f"""WITH {GRAY_SQL}, s AS (SELECT pair_id, g1 / 255.0::DOUBLE AS model, g2 / 255.0::DOUBLE AS rule FROM gp),
q AS (SELECT pair_id, quantile_cont(rule, 0.94) AS cut, quantile_cont(rule, 0.92) AS sure, max(rule) AS m FROM s GROUP BY 1),
m AS (SELECT *, model >= 0.43 AS a, rule >= cut AS b FROM s JOIN q USING (pair_id))
SELECT pair_id, count(*) AS changed FROM m WHERE (a AND b) OR (a AND model >= 0.41) OR (b AND rule >= CASE WHEN m > 1e-6 THEN sure ELSE 0.38 END) GROUP BY 1""")
def _(t):
    g = gray_pairs(t("embeddings"))
    on = D.model_mask(g.select("pair_id", "y", "x", (F.col("g1") / 255).alias("model"), (F.col("g2") / 255).alias("classical")))
    return on.groupBy("pair_id").agg(F.count(F.lit(1)).alias("changed"))


@query("m21_dispatch")
def _(t):
    """The hybrid of model and classical scores, by its name."""
    p = cut(pixels(t("embeddings")))
    scores = T.unpacked(T.scored_tiles(T.packed(p)))
    return M.run_statistics(D.detect(p, "Hybrid AI", scores, border=0, least=2))


@query("m21_fallback", f"""WITH {PIXELS_SQL}, m AS (SELECT pair_id, r1 > r2 + 60 AS o FROM px), e AS (SELECT pair_id, bool_or(o) AS found, count(*) FILTER (WHERE o) AS n FROM m GROUP BY 1)
SELECT pair_id, NOT found AS by_features, CASE WHEN found THEN n END AS changed FROM e""")
def _(t):
    """Pairs with an empty mask go to the feature method; the others keep what they have."""
    p = pixels(t("embeddings"))
    mask = p.select("pair_id", "y", "x", (F.col("r1") > F.col("r2") + 60).cast("int").alias("on"))
    found = mask.groupBy("pair_id").agg(F.max("on").alias("found"))
    out = D.with_fallback(p, mask).groupBy("pair_id").agg(F.sum("on").alias("n"), F.count(F.lit(1)).alias("all")).join(found, "pair_id")
    whole = out.filter("all = 64 and n > 0")  # the feature mask is never empty
    return whole.select("pair_id", (F.col("found") == 0).alias("by_features"), F.when(F.col("found") == 1, F.col("n")).alias("changed"))


@query("r22_shadows", f"""WITH {GRAY_SQL}, b AS (SELECT pair_id, unnest([1, 2]) AS region_id FROM (SELECT DISTINCT pair_id FROM gp)),
bx AS (SELECT pair_id, region_id, region_id AS x, region_id + 1 AS y, 4 AS w, 4 AS h FROM b),
n AS (SELECT bx.*, gp.x AS px, gp.y AS py, g1 - g2 AS d FROM gp JOIN bx USING (pair_id)
  WHERE gp.x >= bx.x - 2 AND gp.x < bx.x + 6 AND gp.y >= bx.y - 2 AND gp.y < bx.y + 6),
l AS (SELECT pair_id, region_id, greatest(25.0, 1.5 * stddev_pop(d)) AS level FROM n GROUP BY 1, 2),
m AS (SELECT n.*, d > level AND NOT (px BETWEEN x AND x + 3 AND py BETWEEN y AND y + 3) AS hit FROM n JOIN l USING (pair_id, region_id)),
e AS (SELECT a.pair_id, a.region_id, a.px, a.py, bool_and(b.hit) AS hit FROM m a JOIN m b USING (pair_id, region_id)
  WHERE abs(a.px - b.px) + abs(a.py - b.py) <= 1 GROUP BY 1, 2, 3, 4),
o AS (SELECT DISTINCT a.pair_id, a.region_id, a.px, a.py FROM e a JOIN e b USING (pair_id, region_id)
  WHERE b.hit AND abs(a.px - b.px) + abs(a.py - b.py) <= 1)
SELECT pair_id, region_id, count(*) AS shadow_px, max(px) - min(px) AS spread_x, max(py) - min(py) AS spread_y FROM o GROUP BY 1, 2""")
def _(t):
    """R22."""
    g = gray_pairs(t("embeddings"))
    boxes = g.select("pair_id").distinct().select("pair_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("region_id")).select("pair_id", "region_id", F.col("region_id").alias("x"), (F.col("region_id") + 1).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h"))
    return G.shadows(g, boxes)
