"""Queries of the pixel, signal and mask operators, on images bridged from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotile.functions.lineage import cut
from chronotile.operators import masks as M
from chronotile.operators import pixels as P
from chronotile.operators import regions as G
from chronotile.operators import signals as S
from chronotile.plans.bridges import GRAY_SQL, PIXELS_SQL, gray_pairs, pixels
from chronotile.plans.registry import query



def _rgb(k: int) -> list:
    return [F.col(f"{c}{k}") for c in "rgb"]


def _mirror(i: str, n: int) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN {2 * (n - 1)} - ({i}) ELSE {i} END"


def _clamp(i: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, {i}))"


def _stencil(name: str, src: str, cols: list[str], kernel: list[float], n: int = 8, border=_mirror) -> str:
    """CTEs ``name`` that weigh neighbours along y, then x."""
    half = len(kernel) // 2
    taps = ", ".join(f"({k - half}, {w!r}::DOUBLE)" for k, w in enumerate(kernel))
    sums = ", ".join(f"sum(k.w * b.{c}) AS {c}" for c in cols)
    one = f"{name}_y AS (SELECT a.pair_id, a.y, a.x, {sums} FROM {src} a, (VALUES {taps}) k(d, w), {src} b WHERE b.pair_id = a.pair_id AND b.x = a.x AND b.y = {border('(a.y + k.d)', n)} GROUP BY 1, 2, 3)"
    two = f"{name} AS (SELECT a.pair_id, a.y, a.x, {sums} FROM {name}_y a, (VALUES {taps}) k(d, w), {name}_y b WHERE b.pair_id = a.pair_id AND b.y = a.y AND b.x = {border('(a.x + k.d)', n)} GROUP BY 1, 2, 3)"
    return f"{one},\n{two}"


def _lab(r: str, g: str, b: str, k: str) -> str:
    lin = lambda c: f"(CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END)"
    x = f"((0.412453 * {lin(r)} + 0.357580 * {lin(g)} + 0.180423 * {lin(b)}) / 0.950456)"
    y = f"(0.212671 * {lin(r)} + 0.715160 * {lin(g)} + 0.072169 * {lin(b)})"
    z = f"((0.019334 * {lin(r)} + 0.119193 * {lin(g)} + 0.950227 * {lin(b)}) / 1.088754)"
    f = lambda t: f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE 7.787 * {t} + 16.0::DOUBLE / 116 END)"
    return f"""CAST(round((CASE WHEN {y} > 0.008856 THEN 116 * pow({y}, 1.0::DOUBLE / 3) - 16 ELSE 903.3 * {y} END) * 255 / 100) AS INT) AS l{k},
      CAST(round(500 * ({f(x)} - {f(y)}) + 128) AS INT) AS a{k}, CAST(round(200 * ({f(y)} - {f(z)}) + 128) AS INT) AS bb{k}"""


def _hue(r: str, g: str, b: str, k: str) -> str:
    v, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    hue = f"(CASE WHEN {v} = {low} THEN 0.0 WHEN {v} = {r} THEN 60.0::DOUBLE * ({g} - {b}) / ({v} - {low}) WHEN {v} = {g} THEN 120 + 60.0::DOUBLE * ({b} - {r}) / ({v} - {low}) ELSE 240 + 60.0::DOUBLE * ({r} - {g}) / ({v} - {low}) END)"
    return f"CAST(round((CASE WHEN {hue} < 0 THEN {hue} + 360 ELSE {hue} END) / 2) AS INT) % 180 AS h{k}, CAST(CASE WHEN {v} = 0 THEN 0 ELSE round(255.0::DOUBLE * ({v} - {low}) / {v}) END AS INT) AS s{k}"


_GRAY = "CAST(round(0.299::DOUBLE * {0} + 0.587::DOUBLE * {1} + 0.114::DOUBLE * {2}) AS INT)"
COLOUR = f"""{PIXELS_SQL},
col AS (SELECT *, {_GRAY.format('r1', 'g1', 'b1')} AS gray1, {_GRAY.format('r2', 'g2', 'b2')} AS gray2, {_lab('r1', 'g1', 'b1', '1')}, {_lab('r2', 'g2', 'b2', '2')}, {_hue('r1', 'g1', 'b1', '1')}, {_hue('r2', 'g2', 'b2', '2')} FROM px)"""
_EXG = "greatest(0.0, least(1.0, 2.0::DOUBLE * {1} / ({0} + {1} + {2} + 1e-6) - {0} / ({0} + {1} + {2} + 1e-6) - {2} / ({0} + {1} + {2} + 1e-6)))"
EXG1, EXG2 = _EXG.format("r1", "g1", "b1"), _EXG.format("r2", "g2", "b2")


@query("p01_rgb_clip", "WITH cells AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, pos, CAST(trunc(greatest(0, least(255, v * 1000))) AS INT) AS v FROM cells")
def _(t):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select("vec_id", "pos", P.to_byte(F.col("e").cast("double") * 1000).alias("v"))


@query("p02_unit_scale", f"WITH {PIXELS_SQL} SELECT pair_id, round(avg(r1 / 255.0), 6) AS r, round(max(g2 / 255.0), 6) AS g FROM px GROUP BY 1")
def _(t):
    return pixels(t("embeddings")).groupBy("pair_id").agg(F.round(F.avg(P.to_unit(F.col("r1"))), 6).alias("r"), F.round(F.max(P.to_unit(F.col("g2"))), 6).alias("g"))


@query("p03_preprocess", f"WITH {COLOUR},\n{_stencil('bl', 'col', ['gray1'], P.gaussian(5))} SELECT pair_id, y, x, round(gray1, 6) AS v FROM bl")
def _(t):
    return P.blur(S.coloured(pixels(t("embeddings"))), ["gray1"], P.gaussian(5)).select("pair_id", "y", "x", F.round("gray1", 6).alias("v"))


@query(
    "p03_sharpness",
    f"""WITH {COLOUR}, lap AS (SELECT a.pair_id, a.y, a.x, sum(k.w * b.gray1) AS v FROM col a, (VALUES (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)) k(dy, dx, w), col b
    WHERE b.pair_id = a.pair_id AND b.y = {_mirror('(a.y + k.dy)', 8)} AND b.x = {_mirror('(a.x + k.dx)', 8)} GROUP BY 1, 2, 3) SELECT pair_id, round(sqrt(var_pop(v)), 4) AS sharpness FROM lap GROUP BY 1""",
)
def _(t):
    return P.sharpness(S.coloured(pixels(t("embeddings"))), "gray1").select("pair_id", F.round(F.sqrt("sharpness"), 4).alias("sharpness"))


@query("p04_resize_area", f"WITH {COLOUR} SELECT pair_id, y // 2 AS y, x // 2 AS x, round(avg(gray1), 6) AS v FROM col GROUP BY ALL")
def _(t):
    return P.shrink(S.coloured(pixels(t("embeddings"))), ["gray1"], 2).select("pair_id", "y", "x", F.round("gray1", 6).alias("v"))


@query("p04_resize_nearest", f"WITH {GRAY_SQL} SELECT pair_id, CAST(a.k AS INT) AS y, CAST(b.k AS INT) AS x, g1 FROM gp, range(12) a(k), range(12) b(k) WHERE a.k * 8 // 12 = y AND b.k * 8 // 12 = x")
def _(t):
    return P.nearest(gray_pairs(t("embeddings")), 8, 8, 12, 12).select("pair_id", "y", "x", "g1")


@query("p05_colour_spaces", f"WITH {COLOUR} SELECT pair_id, y, x, gray1, l1, a1, bb1 AS lab_b1, h1, s1, greatest(r1, g1, b1) AS v1 FROM col")
def _(t):
    c = S.coloured(pixels(t("embeddings")))
    return c.select("pair_id", "y", "x", "gray1", F.col("lab1.l").alias("l1"), F.col("lab1.a").alias("a1"), F.col("lab1.b").alias("lab_b1"), F.col("hsv1.h").alias("h1"), F.col("hsv1.s").alias("s1"), F.col("hsv1.v").alias("v1"))


@query("r17_greenness", f"""WITH {COLOUR} SELECT pair_id, round((avg(g1) - avg(r1)) / (avg(g1) + avg(r1) + 1e-6), 6) AS ndvi,
  round(avg(g1) / (avg(r1) + avg(g1) + avg(b1) + 1e-6), 6) AS green_ratio, round(avg(s1), 6) AS mean_saturation FROM col GROUP BY 1""")
def _(t):
    g = G.greenness(pixels(t("embeddings")), "1")
    return g.select("pair_id", *[F.round(c, 6).alias(c) for c in ("ndvi", "green_ratio", "mean_saturation")])


@query("p09_correlation", f"WITH {GRAY_SQL} SELECT pair_id, round(coalesce(CASE WHEN isnan(corr(g1, g2)) THEN 0 ELSE corr(g1, g2) END, 0), 6) AS ncc FROM gp GROUP BY 1")
def _(t):
    return P.correlation(gray_pairs(t("embeddings")), "g1", "g2").select("pair_id", F.round("ncc", 6).alias("ncc"))


@query(
    "p13_histogram_match",
    f"""WITH {GRAY_SQL}, c1 AS (SELECT pair_id, g1 AS v, count(*) AS n FROM gp GROUP BY 1, 2), c2 AS (SELECT pair_id, g2 AS v, count(*) AS n FROM gp GROUP BY 1, 2),
    q1 AS (SELECT pair_id, v, sum(n) OVER (PARTITION BY pair_id ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY pair_id) AS q FROM c1),
    q2 AS (SELECT pair_id, v, sum(n) OVER (PARTITION BY pair_id ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY pair_id) AS q FROM c2),
    e AS (SELECT q1.pair_id, q1.v, any_value(q1.q) AS q, max(q2.q) FILTER (WHERE q2.q <= q1.q) AS ql, min(q2.q) FILTER (WHERE q2.q >= q1.q) AS qh,
          arg_max(q2.v, q2.q) FILTER (WHERE q2.q <= q1.q) AS vl, arg_min(q2.v, q2.q) FILTER (WHERE q2.q >= q1.q) AS vh FROM q1 JOIN q2 ON q1.pair_id = q2.pair_id GROUP BY 1, 2)
    SELECT gp.pair_id, y, x, round(CASE WHEN ql IS NULL THEN vh WHEN qh IS NULL THEN vl WHEN ql = qh THEN vh ELSE vl + (vh - vl) * (q - ql) / (qh - ql) END::DOUBLE, 6) AS matched FROM gp JOIN e ON e.pair_id = gp.pair_id AND e.v = gp.g1""",
)
def _(t):
    return P.match_histogram(gray_pairs(t("embeddings")), "g1", "g2").select("pair_id", "y", "x", F.round("matched", 6).alias("matched"))


@query(
    "p14_radiometric_normalise",
    f"""WITH {COLOUR}, st AS (SELECT pair_id, avg(l1) m1, stddev_pop(l1) s1, avg(l2) m2, stddev_pop(l2) s2 FROM col GROUP BY 1)
    SELECT pair_id, y, x, round(greatest(0.0, least(255.0, CASE WHEN st.s2 > 1e-6 THEN (l2 - m2) * (st.s1 / st.s2) + m1 ELSE l2 END)), 6) AS v FROM col JOIN st USING (pair_id)""",
)
def _(t):
    c = S.coloured(pixels(t("embeddings"))).select("pair_id", "y", "x", F.col("lab1.l").alias("l1"), F.col("lab2.l").alias("l2"))
    return P.normalise(c, "l1", "l2", "v").select("pair_id", "y", "x", F.round("v", 6).alias("v"))


@query("c01_excess_green", f"WITH {PIXELS_SQL} SELECT pair_id, count(*) AS n, round(avg(abs({EXG2} - {EXG1})), 6) AS change, round(quantile_cont({EXG1}, 0.95), 6) AS p95 FROM px GROUP BY 1")
def excess_green_change(t):
    """Change of excess green between the two images of each pair, with an exact quantile."""
    e1, e2 = S.excess_green(*_rgb(1)), S.excess_green(*_rgb(2))
    return pixels(t("embeddings")).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e2 - e1)), 6).alias("change"), F.round(F.percentile(e1, F.lit(0.95)), 6).alias("p95"))


def _veg(k: str) -> str:
    return f"(CASE WHEN (g{k} - r{k}) / (g{k} + r{k} + 1e-6) > 0.08 THEN 0.4 ELSE 0.0 END::DOUBLE + CASE WHEN {EXG1 if k == '1' else EXG2} > 0.05 THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN h{k} BETWEEN 35 AND 85 AND s{k} > 30 THEN 0.3 ELSE 0.0 END::DOUBLE)"


VEG = f"{COLOUR}, vr AS (SELECT pair_id, y, x, {_veg('1')} AS veg1, {_veg('2')} AS veg2 FROM col),\n{_stencil('vb', 'vr', ['veg1', 'veg2'], P.gaussian(11))}"


@query("c02_vegetation_mask", f"WITH {VEG} SELECT pair_id, y, x, round(veg1, 6) AS veg1, round(veg2, 6) AS veg2 FROM vb")
def _(t):
    return S.vegetation_masks(pixels(t("embeddings"))).select("pair_id", "y", "x", F.round("veg1", 6).alias("veg1"), F.round("veg2", 6).alias("veg2"))


@query("c03_vegetation_factor", f"WITH {VEG} SELECT pair_id, y, x, round((1 - 0.7 * least(veg1, veg2)) * (1 + 0.3 * abs(veg1 - veg2)), 6) AS f FROM vb")
def _(t):
    return S.vegetation_masks(pixels(t("embeddings"))).select("pair_id", "y", "x", F.round(S.vegetation_factor(F.col("veg1"), F.col("veg2")), 6).alias("f"))


@query("c04_shadow", f"WITH {COLOUR}, sh AS (SELECT pair_id, y, x, CASE WHEN abs(l1 - l2) > 18 AND abs(a1 - a2) + abs(bb1 - bb2) < 12 THEN 1.0 ELSE 0.0 END AS s FROM col),\n{_stencil('sb', 'sh', ['s'], P.gaussian(9))} SELECT pair_id, y, x, round(1 - 0.8 * s, 6) AS shadow FROM sb")
def _(t):
    return S.shadow_factors(pixels(t("embeddings"))).select("pair_id", "y", "x", F.round("shadow", 6).alias("shadow"))


CVA = f"""{COLOUR}, d AS (SELECT pair_id, y, x, (l2 - l1) / 100.0::DOUBLE AS dl, (a2 - a1) / 128.0::DOUBLE AS da, (bb2 - bb1) / 128.0::DOUBLE AS db FROM col),
mg AS (SELECT pair_id, y, x, sqrt(dl * dl + da * da + db * db) * greatest(0.15, least(1.0, sqrt(da * da + db * db) / (sqrt(dl * dl + da * da + db * db) + 1e-8) * 2.5)) AS m FROM d),
mq AS (SELECT pair_id, quantile_cont(m, 0.995) AS q FROM mg GROUP BY 1),
cva AS (SELECT pair_id, y, x, CASE WHEN q > 1e-8 THEN greatest(0.0, least(1.0, m / q)) ELSE m END AS cva FROM mg JOIN mq USING (pair_id))"""


@query("c05_cva", f"WITH {CVA} SELECT pair_id, y, x, round(cva, 6) AS cva FROM cva")
def _(t):
    return S.change_vectors(pixels(t("embeddings"))).select("pair_id", "y", "x", F.round("cva", 6).alias("cva"))


def _ssim(name: str, src: str, a: str, b: str, win: int, n: int) -> str:
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return f"""{name}_p AS (SELECT pair_id, y, x, {a}::DOUBLE AS x1, {b}::DOUBLE AS x2, {a}::DOUBLE * {a} AS x11, {b}::DOUBLE * {b} AS x22, {a}::DOUBLE * {b} AS x12 FROM {src}),
{_stencil(name + '_s', name + '_p', ['x1', 'x2', 'x11', 'x22', 'x12'], P.gaussian(win, win / 6), n)},
{name} AS (SELECT pair_id, y, x, greatest(0.0, least(1.0, (1 - (2 * x1 * x2 + {c1!r}::DOUBLE) * (2 * (x12 - x1 * x2) + {c2!r}::DOUBLE) / ((x1 * x1 + x2 * x2 + {c1!r}::DOUBLE) * (greatest(x11 - x1 * x1, 0.0) + greatest(x22 - x2 * x2, 0.0) + {c2!r}::DOUBLE) + 1e-12)) / 2)) AS v FROM {name}_s)"""


@query("c06_ssim", f"WITH {GRAY_SQL},\n{_ssim('ds', 'gp', 'g1', 'g2', 11, 8)} SELECT pair_id, y, x, round(v, 6) AS dssim FROM ds")
def _(t):
    return S.dissimilarity(gray_pairs(t("embeddings")), "g1", "g2", 11).select("pair_id", "y", "x", F.round("dssim", 6).alias("dssim"))


_UP = "(SELECT a.pair_id, CAST(p.k AS INT) AS y, CAST(q.k AS INT) AS x, sum(a.v * (CASE WHEN {ny} = a.y THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN {fy} = a.y THEN 0.25::DOUBLE ELSE 0 END) * (CASE WHEN {nx} = a.x THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN {fx} = a.x THEN 0.25::DOUBLE ELSE 0 END)) AS v FROM {src} a, range({n}) p(k), range({n}) q(k) GROUP BY 1, 2, 3)"


def _upsql(src: str, n: int) -> str:
    far = lambda k: f"greatest(0, least({n // 2 - 1}, {k} // 2 + CASE WHEN {k} % 2 = 0 THEN -1 ELSE 1 END))"
    return _UP.format(src=src, n=n, ny="p.k // 2", fy=far("p.k"), nx="q.k // 2", fx=far("q.k"))


STRUCT = f"""{COLOUR}, hf AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, avg(gray1) AS gray1, avg(gray2) AS gray2 FROM col GROUP BY 1, 2, 3),
{_ssim('sf', 'col', 'gray1', 'gray2', 11, 8)}, {_ssim('sh2', 'hf', 'gray1', 'gray2', 5, 4)}, su AS {_upsql('sh2', 8)},
st AS (SELECT sf.pair_id, sf.y, sf.x, 0.6 * sf.v + 0.4 * su.v AS dssim FROM sf JOIN su USING (pair_id, y, x))"""


@query("c07_structural_change", f"WITH {STRUCT} SELECT pair_id, y, x, round(dssim, 6) AS dssim FROM st")
def _(t):
    return S.structural_change(pixels(t("embeddings"))).select("pair_id", "y", "x", F.round("dssim", 6).alias("dssim"))


_EIGHT = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) k(dy, dx)"
LBP = f"lb AS (SELECT a.pair_id, a.y, a.x, sum(CASE WHEN b.gray1 >= a.gray1 THEN 1 ELSE 0 END) / 8.0 AS l1, sum(CASE WHEN b.gray2 >= a.gray2 THEN 1 ELSE 0 END) / 8.0 AS l2 FROM col a, {_EIGHT}, col b WHERE b.pair_id = a.pair_id AND b.y = {_clamp('a.y + k.dy', 8)} AND b.x = {_clamp('a.x + k.dx', 8)} GROUP BY 1, 2, 3)"


@query("c08_binary_pattern", f"WITH {COLOUR}, {LBP} SELECT pair_id, y, x, CAST(l1 AS DOUBLE) AS lbp FROM lb")
def _(t):
    g = S.coloured(pixels(t("embeddings"))).select(*P.KEY, "gray1")
    return P.around(g, "gray1", repeat_edge=True).select(*P.KEY, S.binary_pattern(F.col("around")).alias("lbp"))


@query("c09_texture_change", f"WITH {COLOUR}, {LBP} SELECT pair_id, y, x, CAST(abs(l1 - l2) AS DOUBLE) AS texture FROM lb")
def _(t):
    return S.texture_change(pixels(t("embeddings"))).select("pair_id", "y", "x", "texture")


@query("c10_edge_change")
def _(t):
    return S.edge_change(pixels(t("embeddings"))).groupBy("pair_id").agg(F.sum("edge").alias("changed"))


@query("c11_score_summary", f"WITH {CVA} SELECT pair_id, round(min(cva), 4) AS min, round(max(cva), 4) AS max, round(avg(cva), 4) AS mean, round(stddev_pop(cva), 4) AS std, round(quantile_cont(cva, 0.5), 4) AS p50, round(quantile_cont(cva, 0.9), 4) AS p90, round(quantile_cont(cva, 0.99), 4) AS p99 FROM cva GROUP BY 1")
def _(t):
    return S.score_summary(S.change_vectors(pixels(t("embeddings"))), "cva")


SNR = """(SELECT pair_id, CASE WHEN max(q95) > 1e-8 THEN avg(v) FILTER (WHERE v >= q95) ELSE 0.0 END / (stddev_pop(v) FILTER (WHERE v <= q50) + 1e-8) AS w
  FROM (SELECT pair_id, {c} AS v, quantile_cont({c}, 0.95) OVER (PARTITION BY pair_id) AS q95, quantile_cont({c}, 0.5) OVER (PARTITION BY pair_id) AS q50 FROM {src}) GROUP BY 1)"""


@query("c12_snr_weight", f"WITH {CVA}, w AS {SNR.format(c='cva', src='cva')} SELECT pair_id, round(w, 4) AS cva FROM w")
def _(t):
    return S.signal_weights(S.change_vectors(pixels(t("embeddings"))), ["cva"]).select("pair_id", F.round("cva", 4).alias("cva"))


@query("c13_classical_score")
def _(t):
    return S.score_summary(S.classical_score(pixels(t("embeddings"))), "score")


@query("c14_weighted_channels", f"WITH {CVA}, e AS (SELECT pair_id, y, x, abs({EXG2} - {EXG1}) AS exg FROM px), j AS (SELECT * FROM cva JOIN e USING (pair_id, y, x)), w1 AS {SNR.format(c='cva', src='j')}, w2 AS {SNR.format(c='exg', src='j')} SELECT pair_id, y, x, round(cva * (w1.w / (w1.w + w2.w + 1e-8)) + exg * (w2.w / (w1.w + w2.w + 1e-8)), 6) AS fused FROM j JOIN w1 USING (pair_id) JOIN w2 USING (pair_id)")
def _(t):
    p = pixels(t("embeddings"))
    both = S.change_vectors(p).join(p.select(*P.KEY, F.abs(S.excess_green(*_rgb(2)) - S.excess_green(*_rgb(1))).alias("exg")), list(P.KEY))
    return S.weighted_channels(both, S.signal_weights(both, ["cva", "exg"]), ["cva", "exg"]).select(*P.KEY, F.round("fused", 6).alias("fused"))


OTSU = """h AS (SELECT pair_id, v, count(*) AS c FROM dv GROUP BY 1, 2), hc AS (SELECT pair_id, v, sum(c) OVER w AS n, sum(c * v) OVER w AS s, sum(c) OVER (PARTITION BY pair_id) AS an, sum(c * v) OVER (PARTITION BY pair_id) AS alls FROM h WINDOW w AS (PARTITION BY pair_id ORDER BY v)),
sp AS (SELECT pair_id, v, round(CASE WHEN n < an THEN pow((s * an - alls * n)::DOUBLE, 2) / (n * (an - n))::DOUBLE ELSE 0 END, 3) AS spread FROM hc),
ot AS (SELECT pair_id, CASE WHEN max(spread) > 0 THEN arg_min(v, (-spread, v)) ELSE 0 END AS otsu FROM sp GROUP BY 1)"""


@query("m01_robust_threshold", f"""WITH {GRAY_SQL}, dv AS (SELECT pair_id, abs(g1 - g2) AS v FROM gp), {OTSU}, md AS (SELECT pair_id, median(v) AS m FROM dv GROUP BY 1), ma AS (SELECT dv.pair_id, any_value(m) AS m, median(abs(v - m)) AS mad FROM dv JOIN md USING (pair_id) GROUP BY 1)
SELECT pair_id, otsu, CAST(greatest(0, least(255, CAST(trunc(greatest(25.0, otsu, m + 3 * mad) + 2) AS INT))) AS INT) AS threshold FROM ot JOIN ma USING (pair_id)""")
def _(t):
    d = gray_pairs(t("embeddings")).select("pair_id", F.abs(F.col("g1") - F.col("g2")).alias("v"))
    return M.robust_thresholds(d, "v", 25, 0.4).join(M.otsu(d, "v"), "pair_id").select("pair_id", "otsu", "threshold")


COMP = """RECURSIVE {head}, onp AS (SELECT pair_id, y, x, y * 8 + x AS id FROM {src}),
lk(pair_id, id, low) AS (SELECT pair_id, id, id FROM onp UNION SELECT lk.pair_id, n.id, lk.low FROM lk JOIN onp a ON a.pair_id = lk.pair_id AND a.id = lk.id JOIN onp n ON n.pair_id = a.pair_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 AND n.id > lk.low),
cc AS (SELECT pair_id, id, min(low) AS label FROM lk GROUP BY 1, 2)"""


def _crossed(name: str, source: str, f: str) -> str:
    """CTE ``name``: ``f`` (min or max) of ``o`` over each pixel and its four neighbours in ``source``."""
    return f"{name} AS (SELECT a.pair_id, a.y, a.x, {f}(b.o) AS o FROM {source} a, {source} b WHERE b.pair_id = a.pair_id AND abs(b.y - a.y) + abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3)"


def cleaned_sql(head: str, source: str, least: int) -> str:
    """Cleaning of ``source`` (pair_id, y, x, o) of 8 by 8 pixels at a sensitivity of a half, without a border, and the statistics of what stays."""
    steps = [
        f"med AS (SELECT a.pair_id, a.y, a.x, CASE WHEN sum(b.o) >= 5 THEN 1 ELSE 0 END AS o FROM {source} a, range(-1, 2) i(k), range(-1, 2) j(k), {source} b WHERE b.pair_id = a.pair_id AND b.y = {_clamp('a.y + i.k', 8)} AND b.x = {_clamp('a.x + j.k', 8)} GROUP BY 1, 2, 3)",
        _crossed("op1", "med", "min"), _crossed("op2", "op1", "max"), _crossed("cl1", "op2", "max"), _crossed("cl2", "cl1", "min"),
        "reached(pair_id, y, x) AS (SELECT pair_id, y, x FROM cl2 WHERE o = 0 AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT p.pair_id, p.y, p.x FROM reached r JOIN cl2 p ON p.pair_id = r.pair_id AND abs(p.y - r.y) + abs(p.x - r.x) = 1 AND p.o = 0)",
        "solid AS (SELECT cl2.pair_id, cl2.y, cl2.x, CASE WHEN r.y IS NULL THEN 1 ELSE 0 END AS o FROM cl2 LEFT JOIN reached r USING (pair_id, y, x))",
        _crossed("br1", "solid", "min"), _crossed("br2", "br1", "max"), "kept AS (SELECT pair_id, y, x FROM br2 WHERE o = 1)",
    ]
    parts = COMP.format(head=",\n".join([head, *steps]), src="kept")
    return f"""WITH {parts},
st AS (SELECT pair_id, label, count(*) AS area, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM cc JOIN onp USING (pair_id, id) GROUP BY 1, 2),
large AS (SELECT pair_id, sum(area) AS n FROM st WHERE NOT (area < {least} OR ((2.0 * (w + h)) ** 2 / (greatest(w * h, 1) + 1e-8) > 80 AND area < {3 * least}) OR (greatest(w, h) / (least(w, h) + 1e-8) > 12 AND area < {2 * least})) GROUP BY 1)
SELECT p.pair_id, p.n AS total_pixels, CAST(coalesce(large.n, 0) AS BIGINT) AS changed_pixels, round(100.0::DOUBLE * coalesce(large.n, 0) / p.n, 2) AS change_percentage
FROM (SELECT pair_id, count(*) AS n FROM {source} GROUP BY 1) p LEFT JOIN large USING (pair_id)"""


_SOFT = f"""{COLOUR},
{_stencil('sf', 'col', ['l1', 'a1', 'bb1', 'l2', 'a2', 'bb2'], P.gaussian(5))},
de AS (SELECT pair_id, y, x, sqrt(power((l1 - l2) / 100.0::DOUBLE, 2) + power((a1 - a2) / 128.0::DOUBLE, 2) + power((bb1 - bb2) / 128.0::DOUBLE, 2)) AS d FROM sf),
dm AS (SELECT pair_id, max(d) AS m FROM de GROUP BY 1),
dv AS (SELECT pair_id, y, x, CAST(trunc(least(255, greatest(0, d / (m + 1e-8) * 255))) AS INT) AS v FROM de JOIN dm USING (pair_id)),
{OTSU}, md AS (SELECT pair_id, median(v) AS m FROM dv GROUP BY 1), ma AS (SELECT dv.pair_id, any_value(m) AS m, median(abs(v - m)) AS mad FROM dv JOIN md USING (pair_id) GROUP BY 1),
th AS (SELECT pair_id, CAST(greatest(0, least(255, CAST(trunc(greatest(30.0, otsu, m + 3 * mad)) AS INT))) AS INT) AS threshold FROM ot JOIN ma USING (pair_id)),
mask0 AS (SELECT pair_id, y, x, CASE WHEN v > threshold THEN 1 ELSE 0 END AS o FROM dv JOIN th USING (pair_id))"""


@query("m02_image_difference", cleaned_sql(_SOFT, "mask0", 2))
def _(t):
    p = pixels(t("embeddings"))
    planes = ["l1", "a1", "b1", "l2", "a2", "b2"]
    soft = P.blur(S.coloured(p).select(*P.KEY, *[F.col(f"lab{c[1]}")[c[0]].cast("double").alias(c) for c in planes]), planes, P.gaussian(5))
    d = lambda c, s: F.pow((F.col(f"{c}1") - F.col(f"{c}2")) / s, F.lit(2))
    delta = S.over_maximum(soft.select(*P.KEY, F.sqrt(d("l", 100.0) + d("a", 128.0) + d("b", 128.0)).alias("d")), ["d"]).select(*P.KEY, P.to_byte(F.col("d") * 255).alias("v"))
    delta = cut(delta)
    mask = delta.join(M.robust_thresholds(delta, "v", 30), "pair_id").select(*P.KEY, F.when(F.col("v") > F.col("threshold"), 1).otherwise(0).alias("on"))
    return M.run_statistics(M.clean(mask, border=0, least=2))


_MASK = f"{GRAY_SQL}, mk AS (SELECT pair_id, y, x FROM gp WHERE g1 >= 140)"


@query("m09_components", f"WITH {COMP.format(head=_MASK, src='mk')} SELECT pair_id, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM cc JOIN onp USING (pair_id, id) GROUP BY pair_id, label")
def _(t):
    s = M.component_stats(M.components(gray_pairs(t("embeddings")).filter("g1 >= 140")))
    return s.select("pair_id", "area", "x0", "y0", "w", "h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("m04_hysteresis", f"WITH {COMP.format(head=f'{GRAY_SQL}, mk AS (SELECT pair_id, y, x, g1 FROM gp WHERE g1 >= 140)', src='mk')} SELECT cc.pair_id, o.y, o.x FROM cc JOIN onp o USING (pair_id, id) WHERE (cc.pair_id, label) IN (SELECT (c2.pair_id, c2.label) FROM cc c2 JOIN onp p USING (pair_id, id) JOIN gp ON gp.pair_id = c2.pair_id AND gp.y = p.y AND gp.x = p.x WHERE g1 >= 165)")
def _(t):
    return M.hysteresis(gray_pairs(t("embeddings")).select(*P.KEY, F.col("g1").alias("score"), F.lit(140).alias("low"), F.lit(165).alias("high")))


@query("j09_seeded_components", f"WITH {COMP.format(head=_MASK, src='mk')} SELECT pair_id, count(DISTINCT label) AS n FROM cc WHERE EXISTS (SELECT 1 FROM cc s JOIN onp p USING (pair_id, id) JOIN gp ON gp.pair_id = s.pair_id AND gp.y = p.y AND gp.x = p.x WHERE g2 >= 165 AND s.pair_id = cc.pair_id AND s.label = cc.label) GROUP BY 1")
def _(t):
    on = gray_pairs(t("embeddings")).filter("g1 >= 140")
    labels = M.components(on)
    seeds = labels.join(on.filter("g2 >= 165"), list(P.KEY), "left_semi").select("pair_id", "label")
    return labels.join(seeds, ["pair_id", "label"], "left_semi").groupBy("pair_id").agg(F.count_distinct("label").alias("n"))


_SEEDED = COMP.split("{head}, ")[1].format(src="low0").replace("onp", "onq").replace("lk", "lq").replace("cc AS", "cq AS")
_CORE = f"""{CVA}, qc AS (SELECT pair_id, quantile_cont(cva, 0.94) AS hi, quantile_cont(cva, {0.94 - 0.06!r}) AS lo FROM cva GROUP BY 1),
low0 AS (SELECT pair_id, y, x FROM cva JOIN qc USING (pair_id) WHERE cva >= least(lo, hi)), {_SEEDED},
seed AS (SELECT DISTINCT cq.pair_id, label FROM cq JOIN onq USING (pair_id, id) JOIN cva ON cva.pair_id = cq.pair_id AND cva.y = onq.y AND cva.x = onq.x JOIN qc ON qc.pair_id = cq.pair_id WHERE cva.cva >= hi),
hyst AS (SELECT cq.pair_id, onq.y, onq.x FROM cq JOIN onq USING (pair_id, id) JOIN seed USING (pair_id, label)),
mask0 AS (SELECT cva.pair_id, cva.y, cva.x, CASE WHEN hyst.y IS NULL THEN 0 ELSE 1 END AS o FROM cva LEFT JOIN hyst USING (pair_id, y, x))"""


@query("m05_core_mask", cleaned_sql(_CORE, "mask0", 2))
def _(t):
    return M.run_statistics(M.core_mask(S.change_vectors(pixels(t("embeddings"))).withColumnRenamed("cva", "score"), border=0, least=2))


_TWO = f"{CVA}, e AS (SELECT pair_id, y, x, {EXG1} AS exg1, {EXG2} AS exg2, abs(r1 - r2) / 255.0::DOUBLE AS model FROM px), j AS (SELECT * FROM cva JOIN e USING (pair_id, y, x))"


def _two(t):
    p = pixels(t("embeddings"))
    return S.change_vectors(p).withColumnRenamed("cva", "classical").join(p.select(*P.KEY, S.excess_green(*_rgb(1)).alias("exg1"), S.excess_green(*_rgb(2)).alias("exg2"), (F.abs(F.col("r1") - F.col("r2")) / 255.0).alias("model")), list(P.KEY))


@query("m06_gated_fusion", f"""WITH {_TWO}, q AS (SELECT pair_id, quantile_cont(cva, 0.96) AS t FROM j GROUP BY 1), m AS (SELECT *, CASE WHEN model >= 0.35 AND cva >= 0.7 * t THEN greatest(model, cva) ELSE 0.65 * model + 0.35 * cva END AS s FROM j JOIN q USING (pair_id))
SELECT pair_id, y, x, round(CASE WHEN abs(exg2 - exg1) > 0.04 AND cva >= 0.8 * t THEN greatest(s, cva) ELSE s END, 6) AS score FROM m""")
def _(t):
    return M.gated_score(_two(t)).select(*P.KEY, F.round("score", 6).alias("score"))


@query("m07_smart_union", f"""WITH {_TWO}, q AS (SELECT pair_id, quantile_cont(cva, 0.92) AS q, max(cva) AS m FROM j GROUP BY 1)
SELECT pair_id, y, x FROM j JOIN q USING (pair_id) WHERE (model >= 0.3 AND cva >= 0.5) OR (model >= 0.3 AND model >= 0.36 + 0.5 * 0.10) OR (cva >= 0.5 AND cva >= CASE WHEN m > 1e-6 THEN q ELSE 0.38 END)""")
def _(t):
    on = lambda c: F.when(c, 1).otherwise(0)
    return M.smart_union(_two(t).withColumns({"model_on": on(F.col("model") >= 0.3), "rule_on": on(F.col("classical") >= 0.5)}))


def _mask(t, at=140):
    return gray_pairs(t("embeddings")).select(*P.KEY, F.when(F.col("g1") >= at, 1).otherwise(0).alias("on"))


@query("m08_median", f"WITH {GRAY_SQL} SELECT a.pair_id, a.y, a.x, CASE WHEN sum(CASE WHEN b.g1 >= 140 THEN 1 ELSE 0 END) >= 5 THEN 1 ELSE 0 END AS on FROM gp a, range(-1, 2) i(k), range(-1, 2) j(k), gp b WHERE b.pair_id = a.pair_id AND b.y = {_clamp('a.y + i.k', 8)} AND b.x = {_clamp('a.x + j.k', 8)} GROUP BY 1, 2, 3".replace(" AS on ", ' AS "on" '))
def _(t):
    return M.median3(_mask(t))


@query("m08_opening", f"WITH {GRAY_SQL}, e AS (SELECT a.pair_id, a.y, a.x, min(CASE WHEN b.g1 >= 120 THEN 1 ELSE 0 END) AS o FROM gp a, gp b WHERE b.pair_id = a.pair_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3) SELECT a.pair_id, a.y, a.x, max(b.o) AS \"on\" FROM e a, e b WHERE b.pair_id = a.pair_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3")
def _(t):
    return M.dilate(M.erode(_mask(t, 120)))


@query("m08_fill_holes", f"WITH {COMP.format(head=f'{GRAY_SQL}, mk AS (SELECT pair_id, y, x FROM gp WHERE g1 < 140)', src='mk')}, outer_ AS (SELECT DISTINCT pair_id, label FROM cc JOIN onp USING (pair_id, id) WHERE y IN (0, 7) OR x IN (0, 7)), hole AS (SELECT pair_id, y, x FROM cc JOIN onp USING (pair_id, id) WHERE (pair_id, label) NOT IN (SELECT (pair_id, label) FROM outer_)) SELECT gp.pair_id, gp.y, gp.x, CASE WHEN g1 >= 140 OR hole.y IS NOT NULL THEN 1 ELSE 0 END AS \"on\" FROM gp LEFT JOIN hole USING (pair_id, y, x)")
def _(t):
    return M.filled(_mask(t))


@query("m08_clean_mask", cleaned_sql(f"{GRAY_SQL}, mask0 AS (SELECT pair_id, y, x, CASE WHEN g1 >= 120 THEN 1 ELSE 0 END AS o FROM gp)", "mask0", 3))
def _(t):
    return M.run_statistics(M.clean(_mask(t, 120), border=0, least=3))


@query("m11_hybrid", f"WITH {GRAY_SQL} SELECT pair_id, y, x FROM gp WHERE 0.30 * g1 + 0.70 * g2 > 101")
def _(t):
    return gray_pairs(t("embeddings")).filter(M.hybrid_on(F.col("g1"), F.col("g2"), 0.4)).select(*P.KEY)


@query("m12_multiscale_union", f"WITH {GRAY_SQL}, s AS (SELECT pair_id, y // 2 AS y2, x // 2 AS x2, avg(g1) AS m FROM gp GROUP BY 1, 2, 3) SELECT gp.pair_id, gp.y, gp.x FROM gp JOIN s ON s.pair_id = gp.pair_id AND y2 = y // 2 AND x2 = x // 2 WHERE g1 >= 150 OR m >= 140")
def _(t):
    g = gray_pairs(t("embeddings"))
    half = P.shrink(g, ["g1"], 2).filter("g1 >= 140").select("pair_id", F.explode(F.array(*[F.struct((F.col("y") * 2 + a).alias("y"), (F.col("x") * 2 + b).alias("x")) for a in (0, 1) for b in (0, 1)])).alias("p")).select("pair_id", "p.y", "p.x")
    return M.united([g.filter("g1 >= 150"), half])


@query("m13_hybrid_model", f"""WITH {_TWO}, m AS (SELECT *, CASE WHEN model >= 0.3 THEN 1 ELSE 0 END AS a, CASE WHEN cva >= 0.5 THEN 1 ELSE 0 END AS b FROM j)
SELECT pair_id, y, x FROM m WHERE floor((0.7 * a + 0.3 * b) * 255 * (0.6 + 0.4 * greatest(0.0, least(1.0, 1.5 * cva))) + 1e-6) > 132""")
def _(t):
    on = lambda c: F.when(c, 1).otherwise(0)
    return _two(t).filter(M.hybrid_model_on(on(F.col("model") >= 0.3), on(F.col("classical") >= 0.5), F.col("classical"))).select(*P.KEY)


@query("r32_run_statistics", f"WITH {GRAY_SQL} SELECT pair_id, count(*) AS total_pixels, count(*) FILTER (WHERE g1 >= 140) AS changed_pixels, round(100.0 * count(*) FILTER (WHERE g1 >= 140) / count(*), 2) AS change_percentage FROM gp GROUP BY 1")
def _(t):
    return M.run_statistics(_mask(t))


@query("u03_mask_algebra", f"WITH {GRAY_SQL} SELECT pair_id, y, x, (g1 >= 140 AND g2 >= 140) AS both_on, (g1 >= 140 OR g2 >= 140) AS any_on, NOT (g1 >= 140) AS first_off FROM gp")
def _(t):
    a, b = F.col("g1") >= 140, F.col("g2") >= 140
    return gray_pairs(t("embeddings")).select(*P.KEY, (a & b).alias("both_on"), (a | b).alias("any_on"), (~a).alias("first_off"))


@query("r31_tint", f"WITH {PIXELS_SQL} SELECT pair_id, y, x, CASE WHEN abs(g1 - g2) > 60 THEN CAST(trunc(0.82 * r2 + 0.18 * 255) AS INT) ELSE r2 END AS r FROM px")
def _(t):
    return pixels(t("embeddings")).select(*P.KEY, F.when(F.abs(F.col("g1") - F.col("g2")) > 60, (0.82 * F.col("r2") + 0.18 * 255).cast("int")).otherwise(F.col("r2")).alias("r"))


@query("j10_pixel_alignment", f"WITH {GRAY_SQL} SELECT a.pair_id, a.y, a.x, a.g1 - b.g2 AS d FROM gp a JOIN gp b ON b.pair_id = a.pair_id + 1 AND b.y = a.y AND b.x = a.x")
def _(t):
    g = gray_pairs(t("embeddings"))
    return g.alias("a").join(g.select((F.col("pair_id") - 1).alias("pair_id"), "y", "x", F.col("g2").alias("other")), list(P.KEY)).select(*P.KEY, (F.col("g1") - F.col("other")).alias("d"))
