"""Queries of the scalar, region, geographic, catalog and review operators, on tables bridged from the driver's."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotile.functions import geodesy
from chronotile.functions import scalars as X
from chronotile.functions.lineage import cut
from chronotile.operators import catalog as C
from chronotile.operators import crops as R
from chronotile.operators import masks as M
from chronotile.operators import pixels as P
from chronotile.operators import regions as G
from chronotile.operators import registration
from chronotile.operators import review as V
from chronotile.operators import rules as U
from chronotile.operators import signals as S
from chronotile.plans.bridges import GRAY_SQL, REGIONS_SQL, SCENES_SQL, gray_pairs, pixels, regions, scenes
from chronotile.plans.pixel_queries import COLOUR, COMP, LBP
from chronotile.plans.registry import query
from chronotile.sources import sinks as K


def _regions(t):
    return regions(t("lineitem"), t("part"))


def _bounds(key: str = "s_suppkey"):
    """Bounds of a made-up place, from a key."""
    k = F.col(key)
    return F.struct((70 + k % 20 * 0.1).alias("west"), (20 + k % 10 * 0.1).alias("south"), (70.5 + k % 20 * 0.1).alias("east"), (20.5 + k % 10 * 0.1).alias("north"))


_B = "(70 + s_suppkey % 20 * 0.1::DOUBLE) AS west, (20 + s_suppkey % 10 * 0.1::DOUBLE) AS south, (70.5 + s_suppkey % 20 * 0.1::DOUBLE) AS east, (20.5 + s_suppkey % 10 * 0.1::DOUBLE) AS north"

# --- scalars -------------------------------------------------------------------------------------------------------

_X1 = """CASE WHEN {0} LIKE '%demolition%' OR {0} LIKE '%clearing%' OR {0} LIKE '%removed%' OR {0} LIKE '%debris%' THEN 'Demolition'
 WHEN regexp_matches({0}, 'expansion|widening|extension|renovation|addition') THEN 'Extension' WHEN regexp_matches({0}, 'vegetation|tree|forest|green|crop') THEN 'Vegetation Change'
 WHEN regexp_matches({0}, 'construction|building|structure|road|pavement|temporary|roof|concrete|foundation') THEN 'New Construction'
 WHEN regexp_matches({0}, 'water|bare|soil|land|unclassified') THEN 'Other' WHEN {0} LIKE '%new%' THEN 'New Construction' ELSE 'Other' END"""


@query("x01_change_type", f"SELECT p_partkey, {_X1.format('lower(p_name)')} AS t1, {_X1.format('lower(p_type)')} AS t2 FROM part")
def _(t):
    return t("part").select("p_partkey", X.change_type(F.col("p_name")).alias("t1"), X.change_type(F.col("p_type")).alias("t2"))


@query("x02_slug", r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(trim(text, ' '), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_\s-]', '', 'g'), '[\s_-]+', '_', 'g'), '_') AS s FROM documents)
SELECT doc_id, substr(CASE WHEN s = '' THEN 'node' WHEN lower(s) IN ('images', 'thumbs', 'cache', 'legacy') THEN lower(s) || '_1' ELSE lower(s) END, 1, 64) AS slug FROM s""")
def _(t):
    return t("documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("x03_unique_slug", "SELECT c_custkey, CASE WHEN n = 1 THEN b ELSE substr(b || '-' || n, 1, 64) END AS slug FROM (SELECT c_custkey, lower(c_mktsegment) AS b, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def _(t):
    n = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    return t("customer").select("c_custkey", X.numbered(F.lower("c_mktsegment"), n).alias("slug"))


@query("x04_report_name", "SELECT doc_id, 'report_' || doc_id || '_' || substr(replace(regexp_replace(text, '[^A-Za-z0-9 _-]', '_', 'g'), ' ', '_'), 1, 60) AS name FROM documents")
def _(t):
    return t("documents").select("doc_id", X.report_name(F.col("text"), F.col("doc_id")).alias("name"))


@query("x05_library_path", r"SELECT page_id, CASE WHEN list_contains(string_split(p, '/'), '..') THEN NULL ELSE p END AS path FROM (SELECT page_id, regexp_replace(replace(trim('/' || replace(url, '/', '\') || CASE WHEN page_id % 7 = 0 THEN '/../x' ELSE '' END), '\', '/'), '^/+', '') AS p FROM pages)")
def _(t):
    raw = F.concat(F.lit("/"), F.replace(F.col("url"), F.lit("/"), F.lit("\\")), F.when(F.col("page_id") % 7 == 0, "/../x").otherwise(""))
    return t("pages").select("page_id", X.library_path(raw).alias("path"))


@query("x06_cache_key", "SELECT page_id, substr(sha256(url), 1, 32) AS k FROM pages")
def _(t):
    return t("pages").select("page_id", X.cache_key(F.col("url")).alias("k"))


@query("x07_node_type", "SELECT p_partkey, ['zone', 'village', 'area', 'folder'][least(p_size % 6, 3) + 1] AS t FROM part")
def _(t):
    return t("part").select("p_partkey", X.node_type(F.col("p_size") % 6).alias("t"))


@query("x08_image_owner", "SELECT p_partkey, 'zone/' || p_brand AS owner FROM part")
def _(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, "/Images").when(F.col("p_partkey") % 3 == 1, "/images/thumbs").otherwise("")
    return t("part").select("p_partkey", X.image_owner(F.concat(F.lit("zone/"), "p_brand", tail)).alias("owner"))


_EXT = "['.TIF', '.tiff', '.png', '.jpeg', '.pdf', ''][p_partkey % 6 + 1]"


@query("x09_image_type", f"SELECT p_partkey, CASE WHEN lower({_EXT}) IN ('.tif', '.tiff') THEN 'GeoTIFF' WHEN {_EXT} = '.png' THEN 'PNG' WHEN {_EXT} = '.jpeg' THEN 'JPEG' ELSE 'other' END AS kind, lower({_EXT}) IN ('.tif', '.tiff', '.png', '.jpeg') AS allowed, lower({_EXT}) IN ('.tif', '.tiff') AS geo FROM part")
def _(t):
    """X9, X21, S16."""
    path = F.concat("p_brand", F.element_at(F.array(*map(F.lit, (".TIF", ".tiff", ".png", ".jpeg", ".pdf", ""))), (F.col("p_partkey") % 6 + 1).cast("int")))
    path = F.replace(path, F.lit("#"), F.lit("-"))
    return t("part").select("p_partkey", X.image_type(path).alias("kind"), X.is_image(path).alias("allowed"), X.is_geotiff(path).alias("geo"))


@query("x10_local_iso", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS iso FROM events")
def _(t):
    return t("events").select("event_id", X.local_iso(F.col("ts")).alias("iso"))


@query("x11_parsed_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return t("orders").select("o_orderkey", X.parsed_date(text).alias("d"))


@query("x12_email", r"SELECT c_custkey, regexp_full_match(e, '[^@\s]+@[^@\s]+\.[^@\s]+') AS ok FROM (SELECT c_custkey, c_mktsegment || CASE c_custkey % 4 WHEN 0 THEN '@x.org' WHEN 1 THEN '@x' WHEN 2 THEN ' @x.org' ELSE 'x.org' END AS e FROM customer)")
def _(t):
    k = F.col("c_custkey") % 4
    return t("customer").select("c_custkey", X.is_email(F.concat("c_mktsegment", F.when(k == 0, "@x.org").when(k == 1, "@x").when(k == 2, " @x.org").otherwise("x.org"))).alias("ok"))


@query("x13_year_folder", "SELECT p_partkey, (p_partkey % 400 + 1850) BETWEEN 1990 AND 2100 AS ok FROM part")
def _(t):
    return t("part").select("p_partkey", X.is_year_folder((F.col("p_partkey") % 400 + 1850).cast("string")).alias("ok"))


@query("x14_parameters", "SELECT p_partkey, greatest(0.0, least(1.0, p_size / 25.0 - 0.5)) AS sensitivity, greatest(50, least(10000, p_partkey * 9)) AS least_area, greatest(256, least(4096, p_size * 100)) AS preview FROM part")
def _(t):
    """X14, M23."""
    return t("part").select("p_partkey", X.clamped_parameters(F.col("p_size") / 25.0 - 0.5, F.col("p_partkey") * 9, F.col("p_size") * 100).alias("c")).select("p_partkey", "c.*")


@query("x15_job_progress", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN 100 WHEN 'signup' THEN 0 ELSE 15 + CAST(trunc((event_id % 101) * 0.63) AS INT) END AS p FROM events")
def _(t):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "queued").otherwise("running")
    return t("events").select("event_id", X.job_progress(status, F.col("event_id") % 101).alias("p"))


@query("x16_location_label", "SELECT c_custkey, concat_ws(' / ', nullif(c_mktsegment, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, '')) AS label FROM customer")
def _(t):
    return t("customer").select("c_custkey", X.location_label(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))).alias("label"))


@query("x17_number_formats", "SELECT p_partkey, printf('%.2f', p_size / 7.0) AS two, (p_size % 100) || '%' AS share, CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1000000) || 'M' WHEN n >= 1000 THEN printf('%.1f', n / 1000) || 'K' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END AS compact FROM (SELECT *, p_partkey * 1024.0 * p_size AS n FROM part)")
def _(t):
    return t("part").select("p_partkey", F.format_string("%.2f", F.col("p_size") / 7.0).alias("two"), F.concat((F.col("p_size") % 100).cast("string"), F.lit("%")).alias("share"), X.compact_number(F.col("p_partkey") * 1024 * F.col("p_size")).alias("compact"))


@query("x18_json_patch", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS stage FROM events")
def _(t):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("stage"), F.col("event_type")))
    return t("events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].cast("long").alias("k"), F.col("m")["stage"].alias("stage"))


@query("x19_session_address", "SELECT c_custkey, 'guest-' || substr(regexp_replace(c_name || '!' || c_mktsegment, '[^A-Za-z0-9_-]', '', 'g'), 1, 40) || '@local' AS a FROM customer")
def _(t):
    return t("customer").select("c_custkey", X.session_address(F.concat("c_name", F.lit("!"), "c_mktsegment")).alias("a"))


@query("x20_role_rank", "SELECT user_id, count(*) FILTER (WHERE r >= 3) AS allowed FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS r FROM events) GROUP BY 1")
def _(t):
    role = F.when(F.col("event_type") == "view", "viewer").when(F.col("event_type") == "click", "uploader").when(F.col("event_type") == "purchase", "analyst").when(F.col("event_type") == "signup", "admin").otherwise("none")
    return t("events").groupBy("user_id").agg(F.count_if(X.role_rank(role) >= X.ROLES.index("analyst") + 1).alias("allowed"))


@query("x22_math", "SELECT event_id, round(sqrt(value), 6) AS a, round(log2(value), 6) AS b, round(atan2(value, event_id + 1), 6) AS c, floor(value) AS d, round(pow(value, 0.85), 6) AS e FROM events")
def _(t):
    v = F.col("value")
    return t("events").select("event_id", F.round(F.sqrt(v), 6).alias("a"), F.round(X.log2(v), 6).alias("b"), F.round(F.atan2(v, F.col("event_id") + 1), 6).alias("c"), F.floor(v).alias("d"), F.round(F.pow(v, F.lit(0.85)), 6).alias("e"))


@query("x23_percent_box", f"WITH {REGIONS_SQL} SELECT run_id, region_id, round(100.0 * x / 1024, 4) AS \"left\", round(100.0 * y / 768, 4) AS top, round(100.0 * w / 1024, 4) AS width, round(100.0 * h / 768, 4) AS height FROM regions")
def _(t):
    return _regions(t).select("run_id", "region_id", X.percent_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1024), F.lit(768)).alias("b")).select("run_id", "region_id", "b.*")


# --- geography -----------------------------------------------------------------------------------------------------


@query("g01_bounds", f"SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN round(west, 6) END AS west, CASE WHEN s_suppkey % 4 < 3 THEN round(north, 6) END AS north FROM (SELECT s_suppkey, {_B} FROM supplier)")
def _(t):
    """G1, G2, G10."""
    b = _bounds()
    listed = F.concat_ws(", ", b["west"], b["south"], b["east"], b["north"])
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, X.bounds_json(b)).when(k == 1, F.concat(F.lit("["), listed, F.lit("]"))).when(k == 2, listed).otherwise("somewhere")
    out = t("supplier").select("s_suppkey", X.bounds_struct(text).alias("b"))
    return out.select("s_suppkey", F.when(X.bounds_valid(F.col("b")), F.round("b.west", 6)).alias("west"), F.when(X.bounds_valid(F.col("b")), F.round("b.north", 6)).alias("north"))


@query("g03_geo_context", f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'affine' WHEN s_suppkey % 3 = 1 THEN 'manual' ELSE 'none' END AS source FROM (SELECT s_suppkey, {_B} FROM supplier)")
def _(t):
    s = t("supplier").select("s_suppkey", _bounds().alias("b"))
    affine = s.filter("s_suppkey % 3 = 0").select("s_suppkey", F.col("b").alias("affine"))
    manual = s.filter("s_suppkey % 3 < 2").select("s_suppkey", F.col("b").alias("manual"))
    j = s.join(affine, "s_suppkey", "left").join(manual, "s_suppkey", "left")
    return j.select("s_suppkey", F.when(F.col("affine").isNotNull(), "affine").when(F.col("manual").isNotNull(), "manual").otherwise("none").alias("source"))


@query("g05_affine", "SELECT s_suppkey, round(CAST(0.001 * (s_suppkey * 2.0 + 0.5) + 70 AS DOUBLE), 9) AS lng, round(CAST(-0.002 * (s_suppkey % 50 * 2.0 + 0.5) + 28 AS DOUBLE), 9) AS lat FROM supplier")
def _(t):
    tr = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (0.001, 0, 70, 0, -0.002, 28), strict=True)])
    p = X.affine_lng_lat(F.col("s_suppkey"), F.col("s_suppkey") % 50, tr, F.lit(2.0), F.lit(2.0))
    return t("supplier").select("s_suppkey", F.round(p["lng"], 9).alias("lng"), F.round(p["lat"], 9).alias("lat"))


_PROJECTED = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 3857 WHEN o_orderkey % 11 = 0 THEN 4326 WHEN o_orderkey % 2 = 0 THEN 32701 + o_custkey % 60 ELSE 32601 + o_custkey % 60 END AS epsg,
    CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 30 WHEN o_orderkey % 11 = 0 THEN o_totalprice % 180 ELSE 200000 + o_totalprice % 600000 END AS DOUBLE) AS x,
    CAST(CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 > 0 THEN o_orderkey % 90 ELSE 1100000 + o_orderkey * 7919 % 8100000 END AS DOUBLE) AS y FROM orders)"""


def _series_sql(table: tuple, term: str) -> str:
    """The sum over k of ``term`` ({k}: twice the index) with the polynomials of ``table`` in n written out."""
    rows = ("(" + " + ".join(f"({c!r}::DOUBLE) * n ** {p + 1}" for p, c in enumerate(row) if c) + ")" for row in table)
    return " + ".join(f"{row} * {term.format(k=2 * k)}" for k, row in enumerate(rows, 1))


def _lng_lat_sql(source: str) -> str:
    """CTEs that end in ``places``: ``source`` (epsg, x, y and more) with lng and lat."""
    return f"""k0 AS (SELECT *, (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n, epsg > 32700 AND epsg < 32761 AS south, epsg > 32600 AND epsg < 32761 AS utm FROM {source}),
  k1 AS (SELECT *, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64 + n ** 6 / 256) AS long_radius FROM k0),
  k2 AS (SELECT *, CASE WHEN utm THEN (y - CASE WHEN south THEN 10000000 ELSE 0 END) / long_radius END AS xi, CASE WHEN utm THEN (x - 500000) / long_radius END AS eta FROM k1),
  k3 AS (SELECT *, xi - ({_series_sql(geodesy._TO_SPHERE, "sin({k} * xi) * cosh({k} * eta)")}) AS xi_, eta - ({_series_sql(geodesy._TO_SPHERE, "cos({k} * xi) * sinh({k} * eta)")}) AS eta_ FROM k2),
  k4 AS (SELECT *, asin(sin(xi_) / cosh(eta_)) AS chi FROM k3),
  places AS (SELECT *,
    CASE WHEN epsg = 4326 THEN x WHEN epsg = 3857 THEN degrees(x / 6378137) ELSE degrees(atan2(sinh(eta_), cos(xi_))) + 6 * (epsg % 100) - 183 END AS lng,
    CASE WHEN epsg = 4326 THEN y WHEN epsg = 3857 THEN degrees(atan(sinh(y / 6378137))) ELSE degrees(chi + {_series_sql(geodesy._TO_LATITUDE, "sin({k} * chi)")}) END AS lat FROM k4)"""


@query("g05_projected", f"WITH {_PROJECTED}, {_lng_lat_sql('o')} SELECT o_orderkey, epsg::INT AS epsg, round(lng, 7) AS lng, round(lat, 7) AS lat FROM places")
def _(t):
    """Map coordinates of UTM zones, Web Mercator and degrees to WGS84."""
    o = _projected(t)
    place = geodesy.lng_lat(F.col("x"), F.col("y"), F.col("epsg"))
    return o.select("o_orderkey", "epsg", F.round(place["lng"], 7).alias("lng"), F.round(place["lat"], 7).alias("lat"))


def _projected(t):
    key = F.col("o_orderkey")
    epsg = F.when(key % 7 == 0, 3857).when(key % 11 == 0, 4326).otherwise(F.when(key % 2 == 0, 32701).otherwise(32601) + F.col("o_custkey") % 60)
    x = F.when(key % 7 == 0, F.col("o_totalprice") * 30).when(key % 11 == 0, F.col("o_totalprice") % 180).otherwise(200000 + F.col("o_totalprice") % 600000)
    y = F.when((key % 11 == 0) & (key % 7 > 0), key % 90).otherwise(1100000 + key * 7919 % 8100000)
    return t("orders").select("o_orderkey", epsg.cast("int").alias("epsg"), x.cast("double").alias("x"), y.cast("double").alias("y"))


@query("s01_bounds", f"""WITH {_PROJECTED}, side AS (SELECT *, CASE WHEN epsg = 4326 THEN 0.0001::DOUBLE ELSE 25.0::DOUBLE END AS px, x AS x0, y AS y0 FROM o),
  rim AS (SELECT DISTINCT u, v FROM (SELECT unnest(range(23)) / 22.0::DOUBLE AS s) CROSS JOIN LATERAL (VALUES (s, 0.0::DOUBLE), (s, 1.0), (0.0, s), (1.0, s)) r(u, v)),
  edge AS (SELECT o_orderkey, epsg, x0 + px * (u * 400) AS x, y0 - px * (v * 300) AS y FROM side CROSS JOIN rim), {_lng_lat_sql('edge')}
  SELECT o_orderkey, round(min(lng), 7) AS west, round(min(lat), 7) AS south, round(max(lng), 7) AS east, round(max(lat), 7) AS north FROM places GROUP BY o_orderkey""")
def _(t):
    """Bounds in WGS84 of images of 400 by 300 pixels, along their edges."""
    px = F.when(F.col("epsg") == 4326, 0.0001).otherwise(25.0)
    zero = F.lit(0.0)
    o = _projected(t).withColumn("b", geodesy.bounds(F.array(px, zero, F.col("x"), zero, -px, F.col("y")), F.lit(400), F.lit(300), F.col("epsg")))
    return o.select("o_orderkey", *(F.round(F.col("b")[c], 7).alias(c) for c in ("west", "south", "east", "north")))


_GEO = f"WITH {REGIONS_SQL}, s AS (SELECT *, run_id % 100 AS s_suppkey FROM regions), g AS (SELECT *, {_B} FROM s)"


@query("g07_enriched_regions", f"""{_GEO} SELECT run_id, region_id, round(north - (y + h / 2.0) / 768 * (north - south), 6) AS lat, round(west + (x + w / 2.0) / 1024 * (east - west), 6) AS lng,
  round(round(w * (abs(east - west) / 1024) * (111320.0::DOUBLE * cos(radians((north + south) / 2))) * (h * (abs(north - south) / 768) * 111320.0::DOUBLE), 1), 0) AS area_sq_m FROM g""")
def _(t):
    """G6-G9."""
    r = _regions(t).withColumn("s_suppkey", F.col("run_id") % 100).withColumn("b", _bounds())
    place = X.lat_lng(F.col("x") + F.col("w") / 2.0, F.col("y") + F.col("h") / 2.0, F.lit(1024), F.lit(768), F.col("b"))
    return r.select("run_id", "region_id", place["lat"].alias("lat"), place["lng"].alias("lng"), F.round(X.box_square_metres(F.col("w"), F.col("h"), F.lit(1024), F.lit(768), F.col("b")), 0).alias("area_sq_m"))


@query("s02_world_file", "SELECT p_partkey, CAST(0.5 * p_size AS DOUBLE) AS a, CAST(100 - 0.25 * p_size AS DOUBLE) AS west, CAST(50 + 0.125 * p_size AS DOUBLE) AS north FROM part")
def _(t):
    size = F.col("p_size")
    text = F.concat_ws("\n", 0.5 * size, F.lit(0), F.lit(0), -0.25 * size, F.lit(100), F.lit(50))
    return t("part").select("p_partkey", X.world_file(text, F.lit(10), F.lit(10)).alias("f")).select("p_partkey", "f.a", F.round("f.west", 6).alias("west"), F.round("f.north", 6).alias("north"))


# --- regions -------------------------------------------------------------------------------------------------------


@query("r27_overlap", f"WITH {REGIONS_SQL}, p AS (SELECT a.run_id, a.region_id AS a, b.region_id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS o, a.w * a.h + b.w * b.h AS s FROM regions a JOIN regions b ON a.run_id = b.run_id AND a.region_id < b.region_id) SELECT run_id, a, b, round(o / (s - o), 6) AS iou FROM p WHERE o / (s - o) > 0.05")
def _(t):
    """Overlapping boxes by an equi-join on grid cells."""
    return G.overlapping_pairs(_regions(t), 0.05)


@query("r28_nms")
def _(t):
    return G.suppress_overlaps(_regions(t).withColumns({"x": F.col("x") % 40, "y": F.col("y") % 40}), 0.3).select("run_id", "region_id", "area")


_SEV = """CASE WHEN object_type LIKE '%Vegetation%' THEN CASE WHEN area / 1e7::DOUBLE * 600 + confidence * 0.6 < 0.8 THEN 'minor' WHEN area / 1e7::DOUBLE * 600 + confidence * 0.6 < 3.0 THEN 'moderate' ELSE 'major' END
 WHEN object_type IN ('New Construction/Building', 'Demolition/Clearing', 'Road/Pavement Change', 'Temporary Structure') THEN CASE WHEN area / 1e7::DOUBLE * 1200 + confidence * 0.4 < 1.2 THEN 'minor' WHEN area / 1e7::DOUBLE * 1200 + confidence * 0.4 < 4.5 THEN 'moderate' ELSE 'major' END
 ELSE CASE WHEN area / 1e7::DOUBLE * 1000 + confidence * 0.3 < 1.0 THEN 'minor' WHEN area / 1e7::DOUBLE * 1000 + confidence * 0.3 < 4.0 THEN 'moderate' ELSE 'major' END END"""


@query("r30_severity", f"WITH {REGIONS_SQL} SELECT run_id, region_id, {_SEV} AS severity FROM regions")
def _(t):
    return _regions(t).select("run_id", "region_id", X.severity(F.col("object_type"), F.col("area"), F.col("confidence"), F.lit(10000000)).alias("severity"))


@query("r10_vehicle_limit", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 35000 ELSE CAST(trunc(greatest(6000.0, least(50000.0, o_totalprice * 1000 * 0.00028))) AS INT) END AS v FROM orders")
def _(t):
    return t("orders").select("o_orderkey", X.vehicle_area_limit(F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.col("o_totalprice") * 1000)).alias("v"))


@query("r29_region_pipeline")
def _(t):
    return G.region_pipeline(_regions(t), 10000000, 1000)


@query("r29_filters", f"""WITH {REGIONS_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY area DESC, region_id) AS place FROM regions
  WHERE area >= 1000 AND area / (w * h) >= 0.15 AND NOT (w * h > 0.75 * 1000 AND area / (w * h) < 0.35) AND (confidence >= 0.24 OR area >= 3000))
SELECT run_id, region_id, CAST(place AS INT) AS place FROM k WHERE place <= 3""")
def _(t):
    """R29, SO2, L2, W1: the filters of area, fill and confidence, stable order, top regions and numbers."""
    return G.largest(G.plausible(_regions(t), 1000, 1000), 3).select("run_id", "region_id", "place")


def _features(t):
    """R1-R5 of each pair as one region."""
    f = R.described(pixels(t("embeddings")))
    return cut(f.withColumns({"area": F.lit(2500) + F.col("pair_id") * 100, "w": F.lit(60), "h": F.lit(50), "asp": F.lit(1.2) + F.col("pair_id") % 5, "fill": F.lit(0.5), "compact": F.lit(0.6)}))


_TURN = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query("r01_region_features", f"""WITH {COLOUR}, {LBP},
gr AS (SELECT a.pair_id, a.y, a.x, sum(k.wx * b.gray1) AS dx, sum(k.wy * b.gray1) AS dy
  FROM col a, (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) k(i, j, wx, wy), col b
  WHERE b.pair_id = a.pair_id AND b.y = {_TURN.format('a.y + k.i')} AND b.x = {_TURN.format('a.x + k.j')} GROUP BY 1, 2, 3),
nb AS (SELECT a.pair_id, avg((a.gray1 - l.gray1) ** 2 + (a.gray1 - u.gray1) ** 2) AS contrast FROM col a JOIN col l ON l.pair_id = a.pair_id AND l.y = a.y AND l.x = (a.x + 7) % 8 JOIN col u ON u.pair_id = a.pair_id AND u.x = a.x AND u.y = (a.y + 7) % 8 GROUP BY 1),
bins AS (SELECT pair_id, least(floor((atan2(dy, dx + 1e-8) + pi()) / (2 * pi()) * 8), 7) AS bin, count(*) / 64.0::DOUBLE AS share FROM gr GROUP BY 1, 2),
en AS (SELECT pair_id, -sum(share * log2(share)) AS entropy FROM bins GROUP BY 1),
ed AS (SELECT pair_id, avg(sqrt(dx * dx + dy * dy)) AS edge FROM gr GROUP BY 1),
lbv AS (SELECT pair_id, var_pop(CAST(l1 AS DOUBLE)) AS lbp FROM lb GROUP BY 1),
mn AS (SELECT pair_id, avg(r1) AS r, avg(g1) AS g, avg(b1) AS b, stddev_pop(gray1) AS texture, (stddev_pop(r1) + stddev_pop(g1) + stddev_pop(b1)) / 3 AS homog, avg(l1) AS bright, avg(s1) AS sat, avg(h1) AS hue,
  avg(least(1, greatest(0, 2.0 * g1 / (r1 + g1 + b1 + 1e-6) - r1 / (r1 + g1 + b1 + 1e-6) - b1 / (r1 + g1 + b1 + 1e-6)))) AS exg FROM col GROUP BY 1)
SELECT pair_id, round((g - r) / (g + r + 1e-6), 6) AS ndvi, round(exg, 6) AS exg, round(texture, 6) AS texture, round(lbp, 6) AS lbp, round(edge, 6) AS edge, round(entropy, 6) AS entropy, round(contrast, 6) AS contrast,
  round(homog, 6) AS homog, round(bright, 6) AS bright, round(g / (r + g + b + 1e-6), 6) AS green, round(b / (r + g + b + 1e-6), 6) AS blue, round(r / (r + g + b + 1e-6), 6) AS red, round(sat, 6) AS sat, round(hue, 6) AS hue
FROM mn JOIN nb USING (pair_id) JOIN en USING (pair_id) JOIN ed USING (pair_id) JOIN lbv USING (pair_id)""")
def _(t):
    """R1 of the first image of each pair."""
    return G.image_features(pixels(t("embeddings")), "1").select("pair_id", *[F.round(f, 6).alias(f) for f in G.FEATURES])


@query("r15_classified")
def _(t):
    """Classes of the change in each pair, with the predicates of passing objects."""
    f = _features(t).withColumns({"structural": U.total(U.STRUCTURAL, cap=True), "permanent": U.total(U.PERMANENT, cap=True)})
    flags = {n: U.predicate(s, 6000) for n, s in (("radiometric", "{radiometric}"), ("vehicle", "{vehicle}"), ("suppressed", U.SUPPRESSED), ("passing", U.PASSING))}
    return f.select("pair_id", F.round("structural", 6).alias("structural"), F.round("permanent", 6).alias("permanent"), U.classified(6000).alias("c"), *[v.alias(k) for k, v in flags.items()]).select("pair_id", "structural", "permanent", "c.name", F.round("c.score", 6).alias("score"), *flags)


@query("r18_subtypes")
def _(t):
    """Subtypes of vegetation, structures and roads, and the stage of construction."""
    kinds = {"vegetation": U.best_of(U.VEGETATION_KINDS, 0.25, "Vegetation Change", 0.3), "structure": U.best_of(U.BUILDING_KINDS, 0.25, "New Construction/Building", 0.3), "road": U.best_of(U.ROAD_KINDS, 0.25, "Road/Pavement Change", 0.3), "stage": U.best_of(U.STAGES, 0.25, "Unknown")}
    return _features(t).select("pair_id", *[v["name"].alias(k) for k, v in kinds.items()], *[F.round(v["score"], 6).alias(f"{k}_score") for k, v in kinds.items()])


def _rule_case(rules: list[tuple[str, float]]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {s} ELSE 0 END" for c, s in rules)


@query("r06_structural_evidence", f"SELECT p_partkey, round(CAST(least(1.0, {_rule_case(U.STRUCTURAL)}) AS DOUBLE), 6) AS score FROM (SELECT p_partkey, p_size % 7 AS d_lines, p_size % 11 AS d_corners, p_size % 23 AS d_edge, p_size / 50.0 AS hull, p_size % 9 AS lines, p_partkey % 100 / 100.0 AS ssim, p_partkey % 60 AS edge, p_partkey % 40 / 10.0 AS entropy FROM part)")
def _(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    f = t("part").select("p_partkey", (size % 7).alias("d_lines"), (size % 11).alias("d_corners"), (size % 23).alias("d_edge"), (size / 50).alias("hull"), (size % 9).alias("lines"), (key % 100 / 100).alias("ssim"), (key % 60).alias("edge"), (key % 40 / 10).alias("entropy"))
    return f.select("p_partkey", F.round(U.total(U.STRUCTURAL, cap=True), 6).alias("score"))


@query("r15_argmax", "WITH s AS (SELECT p_partkey, [p_size % 5, p_partkey % 5, (p_size + p_partkey) % 5] AS v FROM part) SELECT p_partkey, ['Water', 'Soil', 'Road'][list_position(v, list_max(v))] AS name FROM s")
def _(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    return t("part").select("p_partkey", U.best([("Water", (size % 5).cast("double")), ("Soil", (key % 5).cast("double")), ("Road", ((size + key) % 5).cast("double"))], -1, "")["name"].alias("name"))


@query("r16_ensemble_vote", """WITH v AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS part, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS name, l_discount + 0.1 AS score FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate)),
p AS (SELECT l_orderkey, count(*) FILTER (WHERE name IS NULL) AS passing, count(*) AS parts FROM v GROUP BY 1), n AS (SELECT l_orderkey, name, sum(score) AS s, count(*) AS n, min(part) AS first FROM v WHERE name IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS every, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(s, 9) DESC, first) AS k FROM n)
SELECT p.l_orderkey, CASE WHEN passing > parts // 2 THEN NULL ELSE coalesce(b.name, 'Unclassified') END AS name, round(CASE WHEN passing > parts // 2 THEN 0 ELSE coalesce(CASE WHEN n / every >= 0.6 THEN least(1.0, s / n * 1.15) ELSE s / n END, 0) END, 6) AS score FROM p LEFT JOIN b ON b.l_orderkey = p.l_orderkey AND b.k = 1""")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    name = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_linestatus") == "O", "A").otherwise("B")
    v = t("lineitem").select("l_orderkey", F.row_number().over(w).alias("part"), name.alias("name"), (F.col("l_discount") + 0.1).alias("score"))
    return G.vote(v, ["l_orderkey"]).select("l_orderkey", "name", F.round("score", 6).alias("score"))


@query("r23_stories", "SELECT p_partkey, CAST(least(50, greatest(1, CAST(round_even(CAST((CASE WHEN r > 0.1 THEN r / 0.35 WHEN a > 5000 THEN 3.0 WHEN a > 2000 THEN 2.0 ELSE 1.0 END) * (CASE WHEN asp > 3.0 THEN 0.5 WHEN asp < 1.5 AND a > 2000 THEN 1.3 ELSE 1.0 END) + CASE WHEN p_partkey % 30 / 10.0 < 2.2 THEN 0.5 ELSE 0 END AS DOUBLE), 0) AS INT))) AS INT) AS stories FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS r, p_size * (p_partkey % 90 + 10) AS a, greatest(p_size, p_partkey % 90 + 10) / greatest(1, least(p_size, p_partkey % 90 + 10))::DOUBLE AS asp FROM part)")
def _(t):
    return t("part").select("p_partkey", U.stories(F.col("p_size") / 100, F.col("p_size"), F.col("p_partkey") % 90 + 10, F.col("p_partkey") % 30 / 10).alias("stories"))


@query("r26_tight_box", """WITH b AS (SELECT DISTINCT l_suppkey AS region_id, CAST(l_suppkey % 7 AS INT) AS x, CAST(l_suppkey % 5 AS INT) AS y, CASE WHEN l_suppkey % 2 = 0 THEN 70 ELSE 30 END AS w, CASE WHEN l_suppkey % 3 = 0 THEN 60 ELSE 25 END AS h FROM lineitem),
p AS (SELECT DISTINCT l_suppkey AS region_id, CAST(l_partkey % 61 AS INT) AS x, CAST(l_orderkey % 53 AS INT) AS y FROM lineitem),
s AS (SELECT b.region_id, min(p.x) AS x0, min(p.y) AS y0, max(p.x) AS x1, max(p.y) AS y1, count(*) AS area FROM b JOIN p ON p.region_id = b.region_id AND p.x BETWEEN b.x AND b.x + w - 1 AND p.y BETWEEN b.y AND b.y + h - 1 GROUP BY 1),
j AS (SELECT b.*, s.x0, s.y0, s.x1, s.y1, coalesce(area, 0) AS area, coalesce(area > 100 AND area / (w * h) < 0.20, false) AS thin FROM b LEFT JOIN s USING (region_id))
SELECT region_id, CASE WHEN thin THEN x0 ELSE x END AS x, CASE WHEN thin THEN y0 ELSE y END AS y, CASE WHEN thin THEN x1 - x0 + 1 ELSE w END AS w, CASE WHEN thin THEN y1 - y0 + 1 ELSE h END AS h, area FROM j""")
def _(t):
    """R26, both sides of its condition: boxes of many sizes, and the order lines of a supplier as on pixels."""
    key = F.col("l_suppkey")
    lines = t("lineitem")
    boxes = lines.select(key.alias("region_id"), (key % 7).cast("int").alias("x"), (key % 5).cast("int").alias("y"), F.when(key % 2 == 0, 70).otherwise(30).alias("w"), F.when(key % 3 == 0, 60).otherwise(25).alias("h")).distinct()
    on = lines.select(key.alias("region_id"), (F.col("l_partkey") % 61).cast("int").alias("x"), (F.col("l_orderkey") % 53).cast("int").alias("y")).distinct()
    return G.tight_box(on, boxes)


@query("r14_strip_components")
def _(t):
    """On pixels of scenes without the components that show passing objects."""
    scene = cut(scenes(t("embeddings")))
    marked = scene.withColumn("on", F.col("g2") - F.col("g1") > 20)
    kept = R.strip_transients(marked.filter("on"), scene).withColumn("kept", F.lit(1))
    return marked.join(kept, list(P.KEY), "left").groupBy("pair_id").agg(F.count_if("on").alias("on_before"), F.count("kept").alias("on_after"))


def _boxes(scene):
    """Four boxes in each scene, of which two are large enough to have parts."""
    box = lambda k, *v: F.struct(F.lit(k).alias("region_id"), *(F.lit(a).alias(n) for n, a in zip("xywh", v, strict=True)))
    four = F.array(box(1, 0, 0, 32, 32), box(2, 4, 6, 24, 22), box(3, 10, 3, 12, 15), box(4, 20, 20, 40, 6))
    return scene.select("pair_id").distinct().select("pair_id", F.explode(four).alias("b")).select("pair_id", "b.*")


@query("r16_ensemble")
def _(t):
    """Classes of boxes by the votes of their parts, each part with features of its own."""
    scene = cut(scenes(t("embeddings")))
    out = R.ensemble(scene, _boxes(scene))
    return out.select("pair_id", "region_id", "name", F.round("score", 6).alias("score"))


@query("r15_single_image")
def _(t):
    """The same by the rules for an image without one before it."""
    scene = cut(scenes(t("embeddings")))
    out = R.ensemble(scene, _boxes(scene), single=True)
    return out.select("pair_id", "region_id", "name", F.round("score", 6).alias("score"))


_HULL = COMP.format(
    head=f"""{GRAY_SQL}, pic AS (SELECT pair_id * 2 AS pair_id, y, x, g1 AS v FROM gp UNION ALL SELECT pair_id * 2 + 1, y, x, g2 FROM gp),
reached(pair_id, y, x) AS (SELECT pair_id, y, x FROM pic WHERE v <= 128 AND (y IN (0, 7) OR x IN (0, 7))
  UNION SELECT p.pair_id, p.y, p.x FROM reached r JOIN pic p ON p.pair_id = r.pair_id AND abs(p.y - r.y) + abs(p.x - r.x) = 1 AND p.v <= 128),
solid AS (SELECT pair_id, y, x FROM pic ANTI JOIN reached USING (pair_id, y, x))""",
    src="solid",
)


@query("r04_hull_ratio", f"""WITH {_HULL}, lab AS (SELECT cc.pair_id, label, y, x FROM cc JOIN onp USING (pair_id, id)),
sq AS (SELECT pair_id, label, y - i.k AS sy, x - j.k AS sx, count(*) AS n FROM lab, range(2) i(k), range(2) j(k) GROUP BY 1, 2, 3, 4),
ar AS (SELECT pair_id, label, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END) AS area FROM sq GROUP BY 1, 2),
bx AS (SELECT pair_id, label, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS box FROM lab GROUP BY 1, 2),
top AS (SELECT pair_id, area / box AS hull FROM ar JOIN bx USING (pair_id, label) QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY area DESC, label) = 1)
SELECT DISTINCT pic.pair_id, round(CAST(coalesce(hull, 0) AS DOUBLE), 6) AS hull FROM pic LEFT JOIN top USING (pair_id)""")
def _(t):
    """R4 of both images of all gray pairs."""
    g = gray_pairs(t("embeddings"))
    both = g.select((F.col("pair_id") * 2).alias("pair_id"), "y", "x", F.col("g1").alias("v")).unionByName(g.select((F.col("pair_id") * 2 + 1).alias("pair_id"), "y", "x", F.col("g2").alias("v")))
    return R.hull_ratios(both).select("pair_id", F.round("hull", 6).alias("hull"))


@query("r02_shape_counts")
def _(t):
    """R2-R4 of scenes whose tiles of 8 by 8 pixels are levelled to their means, so that their borders are edges."""
    level = Window.partitionBy("pair_id", F.floor(F.col("y") / 8), F.floor(F.col("x") / 8))
    gray = scenes(t("embeddings")).select("pair_id", "y", "x", *(F.round(F.avg(c).over(level) * 4 - 400).cast("int").alias(g) for c, g in (("r1", "g1"), ("r2", "g2"))))
    s = R.shape_counts(gray)
    return s.select("pair_id", "corners", "b_corners", "lines", "b_lines", *(F.round(c, 6).alias(c) for c in ("line_length", "b_line_length", "hull", "b_hull")))


_MATCHES = """m AS (SELECT l_suppkey % 40 AS pair_id, (l_orderkey + l_linenumber * 3) % 10 < 4 AS wrong, CAST(l_partkey % 400 AS DOUBLE) AS x2, CAST((l_orderkey * 7 + l_linenumber * 13) % 300 AS DOUBLE) AS y2 FROM lineitem)"""


@query("p07_consensus", f"""WITH {_MATCHES}, p AS (SELECT pair_id, count(*) AS matches, count(*) FILTER (WHERE NOT wrong) AS inliers FROM m GROUP BY 1 HAVING count(*) >= 8)
SELECT pair_id, matches, inliers, round(inliers / matches, 6) AS ratio, round((105.0::DOUBLE + 2 + 10 + pair_id) / 1.003, 3) AS x, round((-1.5::DOUBLE + 98 + 5) / 1.003, 3) AS y FROM p""")
def _(t):
    """The map on which matches agree, found among two in five wrong ones; it takes (100, 100) to (x, y)."""
    key = F.col("l_suppkey") % 40
    m = t("lineitem").select(
        key.alias("pair_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_orderkey") + F.col("l_linenumber") * 3) % 10 < 4).cast("int").alias("wrong"),
        (F.col("l_partkey") % 400).cast("double").alias("x2"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 300).cast("double").alias("y2"),
        F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o"),
    )
    w = 1e-5 * F.col("x2") + 2e-5 * F.col("y2") + 1
    x1 = (1.05 * F.col("x2") + 0.02 * F.col("y2") + 10 + F.col("pair_id")) / w + F.col("wrong") * (1500 + F.col("p") * 7919 % 3000)
    y1 = (-0.015 * F.col("x2") + 0.98 * F.col("y2") + 5) / w + F.col("wrong") * (800 + F.col("o") * 104729 % 2500)
    found = registration.consensus(m.select("pair_id", "id", x1.alias("x1"), y1.alias("y1"), "x2", "y2"))
    x, y = registration._moved(F.col("h"), F.lit(100.0), F.lit(100.0))
    return found.select("pair_id", "matches", "inliers", F.round("ratio", 6).alias("ratio"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_QUARTERS = [(a, b) for a in (0, 1) for b in (0, 1)]


@query("p14_equalised", f"""WITH {SCENES_SQL}, n AS (SELECT pair_id, y // 4 AS ty, x // 4 AS tx, r1 AS k, count(*) AS n FROM sc GROUP BY 1, 2, 3, 4),
e AS (SELECT t.*, greatest(coalesce(n, 0) - 1, 0) AS over_, least(coalesce(n, 0), 1) AS n FROM (SELECT pair_id, ty, tx, unnest(range(256)) AS k FROM (SELECT DISTINCT pair_id, ty, tx FROM n)) t LEFT JOIN n USING (pair_id, ty, tx, k)),
o AS (SELECT *, sum(over_) OVER (PARTITION BY pair_id, ty, tx) AS rest FROM e),
b AS (SELECT *, n + rest // 256 + CASE WHEN k % greatest(256 // greatest(rest % 256, 1), 1) = 0 AND k // greatest(256 // greatest(rest % 256, 1), 1) < rest % 256 THEN 1 ELSE 0 END AS m FROM o),
lut AS (SELECT pair_id, ty, tx, k, least(255, round_even(CAST(sum(m) OVER (PARTITION BY pair_id, ty, tx ORDER BY k) * (255 / 16.0) AS DOUBLE), 0)) AS v FROM b),
w AS (SELECT pair_id, y, x, r1, CAST(floor(y / 4.0 - 0.5) AS INT) AS cy, CAST(floor(x / 4.0 - 0.5) AS INT) AS cx, y / 4.0 - 0.5 - floor(y / 4.0 - 0.5) AS u, x / 4.0 - 0.5 - floor(x / 4.0 - 0.5) AS v FROM sc)
SELECT w.pair_id, w.y, w.x, CAST(round_even(CAST((m00.v * (1 - w.v) + m01.v * w.v) * (1 - u) + (m10.v * (1 - w.v) + m11.v * w.v) * u AS DOUBLE), 0) AS INT) AS r1 FROM w
{" ".join(f"JOIN lut m{a}{b} ON m{a}{b}.pair_id = w.pair_id AND m{a}{b}.k = w.r1 AND m{a}{b}.ty = least(7, greatest(0, cy + {a})) AND m{a}{b}.tx = least(7, greatest(0, cx + {b}))" for a, b in _QUARTERS)}""")
def _(t):
    """Contrast-limited equalisation of all scenes, 8 by 8 tiles of 4 by 4 pixels."""
    return P.equalise(scenes(t("embeddings")).select("pair_id", "y", "x", "r1"), "r1")


_NEAR = "(VALUES " + ", ".join(f"({dy}, {dx}, {math.exp(-(dy * dy + dx * dx) / 5000)!r}::DOUBLE)" for dy in range(-2, 3) for dx in range(-2, 3) if math.hypot(dy, dx) <= 2) + ") e(dy, dx, s)"
_FOLD = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 31 THEN 62 - ({0}) ELSE {0} END"


@query("p03_bilateral", f"""WITH {SCENES_SQL}, n AS (SELECT a.pair_id, a.y, a.x, s * exp(-power(abs(b.r1 - a.r1) + abs(b.g1 - a.g1) + abs(b.b1 - a.b1), 2) / 5000.0::DOUBLE) AS w, b.r1, b.g1, b.b1
  FROM sc a, {_NEAR}, sc b WHERE b.pair_id = a.pair_id AND b.y = {_FOLD.format('a.y + dy')} AND b.x = {_FOLD.format('a.x + dx')})
SELECT pair_id, y, x, {", ".join(f"CAST(round_even(sum(w * {c}) / sum(w), 0) AS INT) AS {c}" for c in ("r1", "g1", "b1"))} FROM n GROUP BY 1, 2, 3""")
def _(t):
    """The bilateral filter over all scenes."""
    return P.bilateral(scenes(t("embeddings")), ["r1", "g1", "b1"])


_ROUND5 = "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, half in M.ellipse(5) for dx in range(-half, half + 1)) + ") e(dy, dx)"


@query("m08_elliptical_closing", f"""WITH {SCENES_SQL}, d AS (SELECT a.pair_id, a.y, a.x, max(CASE WHEN b.r1 >= 150 THEN 1 ELSE 0 END) AS o FROM sc a, {_ROUND5}, sc b WHERE b.pair_id = a.pair_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)
SELECT a.pair_id, a.y, a.x, min(b.o) AS "on" FROM d a, {_ROUND5}, d b WHERE b.pair_id = a.pair_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3""")
def _(t):
    """M8: closing by an elliptical element of 5 by 5."""
    on = scenes(t("embeddings")).select("pair_id", "y", "x", F.when(F.col("r1") >= 150, 1).otherwise(0).alias("on"))
    return M.morphed(M.morphed(on, 5, F.greatest), 5, F.least)


# --- catalog -------------------------------------------------------------------------------------------------------


def _nodes(t):
    """Regions of the world as roots, nations below them."""
    r = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.lit(0).alias("level"), F.col("r_name").alias("path"), F.lit(True).alias("is_active"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return r.unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"), F.lit(1).alias("level"), F.concat_ws("/", "r_name", "n_name").alias("path"), (F.col("n_nationkey") % 6 != 5).alias("is_active")))


def _images(t):
    return t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("node_id"), F.col("c_name").alias("name"), F.concat(F.lit("lib/"), "c_name").alias("path"))


NODES = """nodes AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, 0 AS level, r_name AS path, true AS is_active FROM region
 UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name, 1, r_name || '/' || n_name, n_nationkey % 6 <> 5 FROM nation JOIN region ON r_regionkey = n_regionkey),
images AS (SELECT c_custkey AS id, CAST(c_nationkey + 100 AS BIGINT) AS node_id, c_name AS name, 'lib/' || c_name AS path FROM customer)"""
CLOSURE = f"RECURSIVE {NODES}, cl(ancestor, node, distance) AS (SELECT id, id, 0 FROM nodes WHERE is_active UNION ALL SELECT cl.ancestor, n.id, distance + 1 FROM cl JOIN nodes n ON n.parent_id = cl.node AND n.is_active)"


@query("j07_tree_closure", f"WITH {CLOSURE} SELECT * FROM cl")
def _(t):
    return C.closure(_nodes(t))


@query("a03_tree_rollup", f"WITH {CLOSURE} SELECT ancestor, count(images.id) AS images FROM cl LEFT JOIN images ON images.node_id = cl.node GROUP BY 1")
def _(t):
    return C.rolled_up(_nodes(t), _images(t))


@query("f11_tree_search", f"WITH {CLOSURE} SELECT DISTINCT ancestor AS id FROM cl JOIN nodes ON nodes.id = cl.node WHERE lower(name) LIKE '%a_1%' OR contains(lower(path), '1')")
def _(t):
    return C.matching_nodes(_nodes(t), "1")


@query("j01_image_node_join", f"WITH {NODES} SELECT images.id, images.name, nodes.path AS node_path FROM images JOIN nodes ON nodes.id = images.node_id AND is_active WHERE images.name ILIKE '%9%' OR nodes.path ILIKE '%9%'")
def _(t):
    """J1, F4, F5, PR1."""
    return C.listed_images(_images(t), _nodes(t), "9").select("id", "name", "node_path")


@query("f10_null_safe_parent", f"WITH {NODES} SELECT a.id, count(b.id) AS siblings FROM nodes a LEFT JOIN nodes b ON a.parent_id IS NOT DISTINCT FROM b.parent_id AND a.id <> b.id GROUP BY 1")
def _(t):
    n = _nodes(t)
    b = n.select(F.col("id").alias("b"), F.col("parent_id").alias("p"))
    return n.join(b, F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("id") != F.col("b")), "left").groupBy("id").agg(F.count("b").alias("siblings"))


def _commands(t):
    return t("supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.when(F.col("s_suppkey") % 7 > 0, (F.col("s_suppkey") % 9).cast("long")).alias("parent_id"), F.concat(F.lit("Area "), (F.col("s_suppkey") % 4).cast("string")).alias("name"))


@query("mu01_create_node", f"""WITH {NODES}, c AS (SELECT s_suppkey + 1000000000 AS id, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 9 END AS parent_id, 'Area ' || (s_suppkey % 4) AS name FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY parent_id, lower(name) ORDER BY id) AS k FROM c)
SELECT * FROM nodes UNION ALL SELECT f.id, f.parent_id, f.name, coalesce(p.level + 1, 0), concat_ws('/', p.path, f.name), true FROM f LEFT JOIN nodes p ON p.id = f.parent_id AND p.is_active WHERE k = 1 AND (f.parent_id IS NULL OR p.id IS NOT NULL)""")
def _(t):
    return C.created(_nodes(t), _commands(t))


@query("mu02_rename_node", f"""WITH {NODES} SELECT n.id, n.parent_id, CASE WHEN n.parent_id IS NULL THEN 'Zone ' || n.id ELSE n.name END AS name, n.level, CASE WHEN n.parent_id IS NULL THEN 'Zone ' || n.id WHEN n.is_active THEN 'Zone ' || n.parent_id || '/' || n.name ELSE n.path END AS path, n.is_active FROM nodes n""")
def _(t):
    """MU2, MU4."""
    n = _nodes(t)
    return C.renamed(n, n.filter("parent_id is null").select("id", F.concat(F.lit("Zone "), F.col("id").cast("string")).alias("new_name")), True)


@query("mu03_move_node", f"""WITH {NODES}, m AS (SELECT id, CASE WHEN is_active AND level = 1 AND parent_id <> 3 THEN 3 ELSE parent_id END AS parent_id, name, level, path, is_active FROM nodes)
SELECT m.id, m.parent_id, m.name, m.level, CASE WHEN m.is_active AND m.parent_id IS NOT NULL THEN p.name || '/' || m.name ELSE m.path END AS path, m.is_active FROM m LEFT JOIN m p ON p.id = m.parent_id""")
def _(t):
    n = _nodes(t)
    legal = n.filter("level = 1 and is_active and parent_id <> 3").select("id", F.lit(3).cast("long").alias("to"))
    return C.moved(n, legal.unionByName(n.filter("level = 0").select("id", F.col("id").alias("to"))))


@query("mu05_delete_subtree", f"WITH {NODES} SELECT id, is_active AND id NOT IN (1, 2) AND coalesce(parent_id NOT IN (1, 2), true) AS is_active FROM nodes")
def _(t):
    n = _nodes(t)
    return C.deleted(n, _images(t), n.filter("id in (1, 2)").select("id"), True)[0].select("id", "is_active")


@query("mu05_images_left", f"WITH {NODES} SELECT images.id FROM images JOIN nodes ON nodes.id = node_id WHERE NOT (nodes.parent_id IN (1, 2) AND is_active)")
def _(t):
    """MU5, MU11."""
    n = _nodes(t)
    return C.deleted(n, _images(t), n.filter("id in (1, 2)").select("id"), True)[1].select("id")


@query("s10_folder_sync", """WITH c AS (SELECT 'f' || p_partkey AS path, p_size AS size, p_partkey % 9 AS node_id FROM part WHERE p_partkey % 5 > 0), l AS (SELECT 'f' || p_partkey AS path, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size, p_partkey % 9 AS node_id FROM part WHERE p_partkey % 6 > 0)
SELECT coalesce(l.path, c.path) AS path, coalesce(l.size, c.size) AS size, coalesce(l.node_id, c.node_id) AS node_id, CASE WHEN l.path IS NULL THEN 'orphan' WHEN c.path IS NULL THEN 'insert' WHEN l.size <> c.size THEN 'update' ELSE 'same' END AS action FROM l FULL JOIN c ON l.path = c.path""")
def _(t):
    """S9, S10, S12, ST4."""
    p = t("part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_size").alias("size"), (F.col("p_partkey") % 9).alias("node_id"), "p_partkey")
    listing = p.filter("p_partkey % 6 > 0").withColumn("size", F.col("size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0))
    return C.synced(p.filter("p_partkey % 5 > 0").drop("p_partkey"), listing.drop("p_partkey"))


@query("s11_year_folders", "SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 2100 GROUP BY 1")
def _(t):
    """Files in year folders, the first root winning, counted by year."""
    year = F.year("o_orderdate")
    files = t("orders").select((F.col("o_orderkey") % 3).alias("root"), F.concat_ws("/", year.cast("string"), F.col("o_custkey").cast("string")).alias("path"))
    one = C.first_root(files).select(F.regexp_extract("path", "^([0-9]+)/", 1).alias("y"))
    return one.filter(X.is_year_folder(F.col("y"))).groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("s13_regions_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 > 0")
def _(t):
    """JSON lists unpacked; a malformed one is empty."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("[{oops")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    e = t("events").select("event_id", F.coalesce(F.from_json(text, "array<struct<k:bigint>>"), F.array().cast("array<struct<k:bigint>>")).alias("r"))
    return e.select("event_id", F.explode("r").alias("r")).select("event_id", F.col("r.k").alias("k")).filter("k is not null")


@query("s14_seed_roots", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(t):
    return _nodes(t).filter("parent_id is null").select(F.col("id").cast("int").alias("id"), "name")


@query("mu12_upload_names", "SELECT c_custkey, c_nationkey || '.tif' AS name, CASE WHEN k = 1 THEN c_nationkey || '.tif' ELSE c_nationkey || '_' || (k - 1) || '.tif' END AS stored_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer)")
def _(t):
    u = t("customer").select(F.col("c_custkey").alias("upload_id"), F.col("c_mktsegment").alias("node_id"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".tif")).alias("name"))
    return C.uploaded_names(u).select(F.col("upload_id").alias("c_custkey"), "name", "stored_name")


@query("mu13_folder_chain", "SELECT DISTINCT 'root' AS path, '' AS parent, 'root' AS name, 0 AS depth FROM part UNION SELECT 'root/' || p_brand, 'root', p_brand, 1 FROM part UNION SELECT 'root/' || p_brand || '/' || p_size, 'root/' || p_brand, CAST(p_size AS VARCHAR), 2 FROM part")
def _(t):
    return C.chains(t("part").select(F.concat_ws("/", F.lit("root"), "p_brand", F.col("p_size").cast("string")).alias("path")))


# --- runs, jobs, reviews -------------------------------------------------------------------------------------------


def _jobs(t):
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "queued").otherwise("failed")
    return t("events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("run_id"), F.col("ts").alias("created_at"))


def _runs(t):
    return t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total"))


def _reviews(t):
    return _regions(t).filter("review_status <> 'pending'").select("run_id", "region_id", F.col("review_status").alias("status"))


JOBS = "jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' ELSE 'failed' END AS status, CASE WHEN event_id % 3 = 0 THEN event_id END AS run_id, ts AS created_at FROM events)"


@query("f01_owner_history", "SELECT o_orderkey AS run_id, o_totalprice AS total, o_orderdate AS created_at FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(t):
    """F1, SO1, L1, F9."""
    return _runs(t).filter("user_id = 7").orderBy(F.col("created_at").desc(), "run_id").limit(100).select("run_id", "total", "created_at")


@query("f02_optional_filters", "SELECT p_partkey FROM part WHERE p_size = 5 AND (p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%')")
def _(t):
    """equality filters that are set, and a search in three columns."""
    out = t("part")
    for column, value in (("p_size", 5), ("p_brand", ""), ("p_type", None)):
        out = out.filter(F.col(column) == value) if value else out
    return out.filter(F.col("p_name").ilike("%a%") | F.col("p_brand").ilike("%a%") | F.col("p_type").ilike("%a%")).select("p_partkey")


@query("f06_status_filter", f"WITH {REGIONS_SQL} SELECT run_id, region_id FROM regions WHERE coalesce(nullif(CASE WHEN area % 4 = 0 THEN '' ELSE review_status END, ''), 'pending') = 'pending'")
def _(t):
    r = _regions(t).withColumn("review_status", F.when(F.col("area") % 4 == 0, "").otherwise(F.col("review_status")))
    return r.filter(V.status_of("review_status") == "pending").select("run_id", "region_id")


@query("f08_cutoff", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 365 DAY")
def _(t):
    return _runs(t).filter(F.col("created_at") < F.expr("timestamp_ntz'1998-06-01' - interval 365 days")).select("run_id")


@query("f12_unseen", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'completed' AND job_id NOT IN (SELECT event_id FROM events WHERE value > 200)")
def _(t):
    seen = t("events").filter("value > 200").select(F.col("event_id").alias("job_id"))
    return _jobs(t).filter("status = 'completed'").join(seen, "job_id", "left_anti").select("job_id")


@query("pr02_unchanged", "SELECT o_orderkey AS run_id, round(o_totalprice - o_totalprice * 0.25, 4) AS unchanged FROM orders")
def _(t):
    return _runs(t).select("run_id", F.round(F.col("total") - F.col("total") * 0.25, 4).alias("unchanged"))


@query("j02_lookup_join", "SELECT c_custkey, coalesce(n_name, '') AS zone FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def _(t):
    n = t("nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t("customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("zone"))


@query("j03_training_export", f"WITH {REGIONS_SQL} SELECT run_id, region_id, o_custkey AS user_id, area FROM regions JOIN orders ON o_orderkey = run_id WHERE review_status = 'false_positive'")
def _(t):
    """J3, K2."""
    return K.false_positives(_reviews(t), _runs(t), _regions(t)).select("run_id", "region_id", "user_id", "area")


@query("j04_review_left", f"WITH {REGIONS_SQL} SELECT run_id, region_id, CASE WHEN area % 2 = 0 AND review_status <> 'pending' THEN review_status ELSE 'pending' END AS review_status FROM regions")
def _(t):
    r = _regions(t)
    return V.merged(r.withColumn("review_status", F.lit("")), r.filter("area % 2 = 0 and review_status <> 'pending'").select("run_id", "region_id", F.col("review_status").alias("status"))).select("run_id", "region_id", "review_status")


@query("j05_job_run", f"WITH {JOBS} SELECT job_id, o_totalprice AS total FROM jobs LEFT JOIN orders ON o_orderkey = run_id")
def _(t):
    return _jobs(t).join(_runs(t).select("run_id", "total"), "run_id", "left").select("job_id", "total")


@query("j06_union_anti", f"WITH {JOBS} SELECT 'job' AS kind, job_id, run_id, created_at FROM jobs UNION ALL SELECT 'run', NULL, o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT run_id FROM jobs WHERE run_id IS NOT NULL)")
def _(t):
    """J6, U1, SO3."""
    return V.activity(_jobs(t), _runs(t))


@query("a01_filtered_counts", f"WITH {JOBS} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(run_id) AS with_run FROM jobs")
def _(t):
    return _jobs(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.count("run_id").alias("with_run"))


@query("a02_review_summary", f"WITH {REGIONS_SQL} SELECT s AS review_status, count(run_id) AS n FROM (VALUES ('pending'), ('confirmed'), ('false_positive'), ('submitted')) v(s) LEFT JOIN regions ON review_status = s AND review_status <> 'submitted' GROUP BY 1")
def _(t):
    return V.summary(_regions(t).filter("review_status <> 'submitted'"))


@query("a05_with_coordinates", f"{_GEO} SELECT run_id, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS n FROM g GROUP BY 1")
def _(t):
    r = _regions(t).withColumn("s_suppkey", F.col("run_id") % 100)
    place = X.lat_lng(F.col("x"), F.col("y"), F.lit(1024), F.lit(768), F.when(F.col("s_suppkey") % 2 == 0, _bounds()))
    return r.groupBy("run_id").agg(F.count_if(place.isNotNull()).alias("n"))


_A7 = """SELECT {k} AS k, tp, fp, fn, tn, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp + fn) END, 4) AS iou, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 4) AS dice,
 round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 4) AS recall,
 round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 4) AS accuracy, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 4) AS fpr, round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn::DOUBLE / (fn + tp) END, 4) AS fnr FROM c"""


@query("a07_metrics", f"WITH c AS (SELECT doc_id % 7 AS k, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn FROM labels GROUP BY 1) {_A7.format(k='k')}")
def _(t):
    """A6, A7."""
    c = V.confusion(t("labels").withColumn("k", F.col("doc_id") % 7), ["k"], F.col("toxic") == 1, F.col("quality") == 1)
    return V.measures(c).drop("f1")


@query("a08_array_aggregates", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 4) AS var, min(value) AS low, max(value) AS high, median(value) AS mid, round(quantile_cont(value, 0.95), 6) AS q95, round(corr(value, user_id), 6) AS r FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"), F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("mid"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("q95"), F.round(F.corr("value", "user_id"), 6).alias("r"))


@query("a09_weighted_mean", "SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / greatest(sum(l_quantity), 1e-6), 4) AS v FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.greatest(F.sum("l_quantity"), F.lit(1e-6)), 4).alias("v"))


@query("l03_first_queued", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1")
def _(t):
    return _jobs(t).filter("status = 'queued'").orderBy("created_at", "job_id").limit(1).select("job_id")


@query("l04_page", f"WITH {REGIONS_SQL} SELECT run_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY region_id) AS k FROM regions) WHERE k BETWEEN 3 AND 4")
def _(t):
    k = F.row_number().over(Window.partitionBy("run_id").orderBy("region_id"))
    return _regions(t).withColumn("k", k).filter("k between 3 and 4").select("run_id", "region_id")


@query("l05_last_seen", "SELECT user_id, list_slice(list(event_id ORDER BY event_id), -5, -1) AS ids FROM events GROUP BY 1")
def _(t):
    ids = F.sort_array(F.collect_list("event_id"))
    return t("events").groupBy("user_id").agg(ids.alias("ids")).select("user_id", F.when(F.size("ids") > 5, F.slice("ids", -5, 5)).otherwise(F.col("ids")).alias("ids"))


@query("u02_mask_or", "SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS \"on\" FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("on"))


@query("w02_cumulative", "SELECT event_type, v, sum(n) OVER (PARTITION BY event_type ORDER BY v) AS upto FROM (SELECT event_type, CAST(floor(value / 50) AS INT) AS v, count(*) AS n FROM events GROUP BY 1, 2)")
def _(t):
    counts = t("events").groupBy("event_type", F.floor(F.col("value") / 50).cast("int").alias("v")).count()
    return counts.select("event_type", "v", F.sum("count").over(Window.partitionBy("event_type").orderBy("v")).alias("upto"))


@query("mu06_review_log", """WITH l AS (SELECT user_id AS run_id, event_id % 4 AS region_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'false_positive' WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN CASE WHEN value > 470 THEN 'submitted' ELSE 'confirmed' END ELSE 'odd' END AS status FROM events),
k AS (SELECT *, coalesce(max(CASE WHEN status = 'submitted' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, region_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l WHERE status <> 'odd') SELECT run_id, region_id, arg_max(status, seq) AS status, count(*) AS changes FROM k WHERE done = 0 GROUP BY 1, 2""")
def _(t):
    """MU6, ST5."""
    e = F.col("event_type")
    status = F.when(e == "view", "confirmed").when(e == "click", "false_positive").when(e == "signup", "pending").when(e == "purchase", F.when(F.col("value") > 470, "submitted").otherwise("confirmed")).otherwise("odd")
    return V.latest(t("events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 4).alias("region_id"), F.col("event_id").alias("seq"), status.alias("status")))


@query("mu07_submit", f"WITH {REGIONS_SQL} SELECT run_id, region_id, CASE WHEN review_status = 'confirmed' AND area % 3 = 0 THEN 'submitted' ELSE review_status END AS status FROM regions WHERE review_status <> 'pending'")
def _(t):
    """MU7, F7."""
    return V.submitted(_reviews(t), _regions(t).filter("area % 3 = 0"))


_OLD = "o_orderdate < TIMESTAMP '1994-01-01'"


@query("mu08_purge_runs", f"SELECT o_orderkey AS run_id FROM orders WHERE NOT ({_OLD})")
def _(t):
    """MU8, MU9."""
    return C.purged(_runs(t), _reviews(t), _jobs(t), F.expr("created_at < timestamp_ntz'1994-01-01'"))[0].select("run_id")


@query("mu08_purge_jobs", f"WITH {JOBS} SELECT job_id, CASE WHEN run_id NOT IN (SELECT o_orderkey FROM orders WHERE {_OLD}) THEN run_id END AS run_id FROM jobs")
def _(t):
    return C.purged(_runs(t), _reviews(t), _jobs(t), F.expr("created_at < timestamp_ntz'1994-01-01'"))[2].select("job_id", "run_id")


@query("mu10_repair_jobs", f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' THEN 'failed' WHEN job_id = (SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1) THEN 'running' ELSE status END AS status FROM jobs")
def _(t):
    """MU10, MU14, ST2."""
    return C.repaired(_jobs(t), False).select("job_id", "status")


@query("k01_region_csv", f"WITH {REGIONS_SQL} SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(region_id AS VARCHAR) AS region_id, printf('%.4f', confidence) AS confidence, '' AS lat, review_status FROM regions")
def _(t):
    return K.region_rows(_regions(t)).select("run_id", "region_id", "confidence", "lat", "review_status")


@query("k03_payloads", f"WITH {REGIONS_SQL} SELECT run_id, count(*) AS n FROM regions GROUP BY 1")
def _(t):
    """K3, K5."""
    return K.payloads(_regions(t)).filter(F.length("payload") > 20).select("run_id", "n")


@query("k04_file_export", f"""WITH {REGIONS_SQL}, c AS (SELECT run_id, count(*) FILTER (WHERE review_status = 'confirmed') AS n FROM regions GROUP BY 1)
SELECT run_id, n > 0 AS ok, 'file' AS mode, CASE WHEN n > 0 THEN n || ' confirmed region(s) ready for CSV download.' ELSE 'No confirmed regions to export.' END AS message,
  n AS submitted_count, CASE WHEN n > 0 THEN '/api/dda/reports/' || run_id || '/export.csv?confirmed=1' END AS download_path FROM c""")
def _(t):
    r = _regions(t)
    return K.hand_over(r.select("run_id").distinct(), r.filter("review_status = 'confirmed'"), None)


@query("r33_serialised", f"""WITH {REGIONS_SQL} SELECT run_id, region_id AS id, area, CAST(round_even(x + (w - 1) / 2.0, 0) AS INT) AS cx, CAST(round_even(y + (h - 1) / 2.0, 0) AS INT) AS cy,
  object_type, round(confidence, 6) AS confidence, 'minor' AS severity, NULL::INT AS stories FROM regions""")
def _(t):
    """The stored text, read back."""
    shape = "array<struct<id:int,area:long,center:struct<x:int,y:int>,objectType:string,confidence:double,severity:string,estimatedStories:int>>"
    r = K.serialised(_regions(t)).select("run_id", F.explode(F.from_json("regions_json", shape)).alias("r"))
    named = [F.col("r.center.x").alias("cx"), F.col("r.center.y").alias("cy"), F.col("r.objectType").alias("object_type")]
    return r.select("run_id", "r.id", "r.area", *named, F.round("r.confidence", 6).alias("confidence"), "r.severity", F.col("r.estimatedStories").alias("stories"))


@query("k11_run_rows", f"""WITH {REGIONS_SQL}, n AS (SELECT run_id, count(*) AS n FROM regions GROUP BY 1)
SELECT o_orderkey AS run_id, o_orderpriority AS title, 1000 AS total_pixels, o_custkey % 1000 AS changed_pixels, round((o_custkey % 1000) / 10.0, 2) AS change_percentage, CAST(coalesce(n, 0) AS INT) AS regions_count
FROM orders LEFT JOIN n ON n.run_id = o_orderkey""")
def _(t):
    o = t("orders").withColumnRenamed("o_orderkey", "run_id")
    changed = F.col("o_custkey") % 1000
    stats = o.select("run_id", F.lit(1000).alias("total_pixels"), changed.alias("changed_pixels"), F.round(changed / 10, 2).alias("change_percentage"))
    rows = K.run_rows(o.select("run_id", F.col("o_orderpriority").alias("title")), stats, _regions(t))
    return rows.drop("regions_json")


@query("k09_cache_state", "SELECT p_partkey, p_size > 25 AS valid, CASE WHEN p_partkey * 3000000 > 2147483648 THEN 512 WHEN p_partkey * 3000000 > 524288000 THEN 1024 ELSE 4096 END AS max_side FROM part")
def _(t):
    return K.cache_state(t("part").select("p_partkey", F.col("p_size").alias("cached_at"), F.lit(26).alias("modified_at"), (F.col("p_partkey") * 3000000).alias("size"))).select("p_partkey", "valid", "max_side")


@query("k12_audit", "SELECT n_nationkey + 100 AS id FROM nation WHERE n_nationkey % 6 <> 5 AND n_regionkey IN (1, 2) UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey IN (1, 2)")
def _(t):
    n = _nodes(t)
    return K.audit_rows(n, C.deleted(n, _images(t), n.filter("id in (1, 2)").select("id"), True)[0], "id", "delete").select("id")
