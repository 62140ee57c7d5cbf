"""Connected components of an edge table by alternating large-star and small-star steps (DataFrame operations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions.lineage import cut

#: Links that one partition of a table between the steps may hold; small tables would else be spread over very many small files.
LINKS_PER_PARTITION = 50_000


def _kept(edges: DataFrame, links: int) -> DataFrame:
    """The edges, materialised in partitions for about so many links."""
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(edges.coalesce(max(1, min(most, -(-links // LINKS_PER_PARTITION)))))


def _with_least(edges: DataFrame, links: int) -> DataFrame:
    """(u, v) rows with m, the least of u and all its v. Adaptive execution splits the join where a u has very many edges."""
    least = _kept(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), links)
    return edges.join(least.hint("merge"), "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component), component being the least node that links lead to; a row for each linked node.

    Nodes are numbers or structs, any type with an order. Links may repeat, run either way, or join a node to itself. Rounds grow with the logarithm of the longest chain.
    """
    now = _kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), edges.count())
    state = _state(now)
    while state[0]:
        links = 2 * state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _kept(_with_least(both, links).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), links)
        small = _with_least(large, links)
        now = _kept(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct(), links)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
