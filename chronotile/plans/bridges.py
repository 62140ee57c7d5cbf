"""Domain tables made from the driver's tables, so that every operator has input of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDE = 8


def _bytes(embeddings: DataFrame) -> DataFrame:
    cells = embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    level = F.floor((F.col("v").cast("double") + 0.55) * 230).cast("int")
    return cells.select("vec_id", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"), F.least(F.lit(255), F.greatest(F.lit(0), level)).alias("v"))


def pixels(embeddings: DataFrame) -> DataFrame:
    """pair_id, y, x, r1, g1, b1, r2, g2, b2: two 8 x 8 colour images for each six consecutive vectors; incomplete sixes are left out."""
    cells = _bytes(embeddings).withColumn("pair_id", F.floor(F.col("vec_id") / 6)).withColumn("slot", F.col("vec_id") % 6)
    names = ("r1", "g1", "b1", "r2", "g2", "b2")
    wide = cells.groupBy("pair_id", "y", "x").agg(*[F.max(F.when(F.col("slot") == k, F.col("v"))).alias(n) for k, n in enumerate(names)])
    return wide.na.drop(subset=list(names))


def scenes(embeddings: DataFrame, side: int = 4) -> DataFrame:
    """``pixels`` laid out in scenes of ``side`` by ``side`` image pairs, 8 * side pixels long and wide; scenes that are not full are left out."""
    pair, n = F.col("pair_id"), side * side
    laid = pixels(embeddings).select(
        F.floor(pair / n).alias("pair_id"), (F.floor(pair % n / side) * SIDE + F.col("y")).cast("int").alias("y"), (pair % side * SIDE + F.col("x")).cast("int").alias("x"),
        "r1", "g1", "b1", "r2", "g2", "b2",
    )
    counted = laid.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("pair_id")))  # a scene is small; the pixels are made once
    return counted.filter(F.col("_n") == n * SIDE * SIDE).drop("_n")


def gray_pairs(embeddings: DataFrame) -> DataFrame:
    """pair_id, y, x, g1, g2: two 8 x 8 gray images for each even vector and the next."""
    cells = _bytes(embeddings).withColumn("pair_id", F.floor(F.col("vec_id") / 2)).withColumn("slot", F.col("vec_id") % 2)
    return cells.groupBy("pair_id", "y", "x").agg(F.max(F.when(F.col("slot") == 0, F.col("v"))).alias("g1"), F.max(F.when(F.col("slot") == 1, F.col("v"))).alias("g2")).na.drop(subset=["g1", "g2"])


#: Region classes in scoring order.
CLASSES = ("Water Body Change", "Vegetation Change", "New Construction/Building", "Demolition/Clearing", "Road/Pavement Change", "Temporary Structure", "Bare Land/Soil Change", "Unclassified")


def regions(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """run_id, region_id, area, x, y, w, h, object_type, confidence, review_status: change regions from order lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    status = F.when(F.col("l_returnflag") == "R", "false_positive").when(F.col("l_returnflag") == "N", "pending").when(F.col("l_linestatus") == "O", "submitted").otherwise("confirmed")
    base = lineitem.select(
        F.col("l_orderkey").alias("run_id"),
        F.row_number().over(order).alias("region_id"),
        F.col("l_extendedprice").cast("bigint").alias("area"),
        (F.col("l_partkey") % 400).cast("int").alias("x"),
        (F.col("l_suppkey") % 400).cast("int").alias("y"),
        (F.col("l_quantity") + 10).cast("int").alias("w"),
        F.col("l_partkey").alias("p_partkey"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("l_partkey") % 8 + 1).cast("int")).alias("object_type"),
        F.round(F.col("l_discount") * 10 + 0.0, 4).alias("confidence"),
        status.alias("review_status"),
    )
    return base.join(part.select("p_partkey", F.col("p_size").alias("h")), "p_partkey").drop("p_partkey")


#: The same tables in DuckDB, as CTEs.
PIXELS_SQL = """
cells AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id < 6 * ((SELECT count(*) FROM embeddings) // 6)),
lv AS (SELECT vec_id // 6 AS pair_id, vec_id % 6 AS slot, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(least(255, greatest(0, floor((v + 0.55) * 230))) AS INT) AS v FROM cells),
px AS (SELECT pair_id, y, x, max(CASE WHEN slot = 0 THEN v END) AS r1, max(CASE WHEN slot = 1 THEN v END) AS g1, max(CASE WHEN slot = 2 THEN v END) AS b1,
       max(CASE WHEN slot = 3 THEN v END) AS r2, max(CASE WHEN slot = 4 THEN v END) AS g2, max(CASE WHEN slot = 5 THEN v END) AS b2 FROM lv GROUP BY 1, 2, 3)
"""
SCENES_SQL = f"""{PIXELS_SQL}, laid AS (SELECT pair_id // 16 AS pair_id, CAST(pair_id % 16 // 4 * 8 + y AS INT) AS y, CAST(pair_id % 4 * 8 + x AS INT) AS x, r1, g1, b1, r2, g2, b2 FROM px),
sc AS (SELECT * FROM laid WHERE pair_id IN (SELECT pair_id FROM laid GROUP BY 1 HAVING count(*) = 1024))
"""
GRAY_SQL = """
cells AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
lv AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS slot, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(least(255, greatest(0, floor((v + 0.55) * 230))) AS INT) AS v FROM cells),
gp AS (SELECT pair_id, y, x, max(CASE WHEN slot = 0 THEN v END) AS g1, max(CASE WHEN slot = 1 THEN v END) AS g2 FROM lv GROUP BY 1, 2, 3 HAVING count(DISTINCT slot) = 2)
"""
REGIONS_SQL = """
regions AS (
  SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate) AS INT) AS region_id,
    CAST(trunc(l_extendedprice) AS BIGINT) AS area, CAST(l_partkey % 400 AS INT) AS x, CAST(l_suppkey % 400 AS INT) AS y, CAST(trunc(l_quantity + 10) AS INT) AS w, p_size AS h,
    ['Water Body Change', 'Vegetation Change', 'New Construction/Building', 'Demolition/Clearing', 'Road/Pavement Change', 'Temporary Structure', 'Bare Land/Soil Change', 'Unclassified'][l_partkey % 8 + 1] AS object_type,
    round(l_discount * 10 + 0.0, 4) AS confidence,
    CASE WHEN l_returnflag = 'R' THEN 'false_positive' WHEN l_returnflag = 'N' THEN 'pending' WHEN l_linestatus = 'O' THEN 'submitted' ELSE 'confirmed' END AS review_status
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""
