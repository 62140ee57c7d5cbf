"""The image catalog: a tree of nodes with images, as snapshots. Every change is a function from a snapshot and commands to a new snapshot.

nodes(id, parent_id, name, level, path, is_active); images(id, node_id, name, path, ...). Paths join names with "/".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions.lineage import cut


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of all active nodes, themselves included, at any depth. One join for each level of the tree.

    Parents that form a cycle are no tree and raise a ValueError.
    """
    active = nodes.filter("is_active")
    edges = active.select(F.col("id").alias("child"), "parent_id")
    step = active.select(F.col("id").alias("ancestor"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    out, level = step, 0
    while True:
        level += 1
        below = step.join(edges, F.col("node") == F.col("parent_id"))
        step = cut(below.select("ancestor", F.col("child").alias("node"), F.lit(level).alias("distance")))
        rows, cycles = step.agg(F.count(F.lit(1)), F.count_if(F.col("ancestor") == F.col("node"))).first()
        if cycles:
            raise ValueError("the parents of some nodes form a cycle")
        if not rows:
            return out
        out = out.unionByName(step)


def rolled_up(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """A3: images in each node's whole subtree."""
    per_node = images.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    tree = closure(nodes)
    return tree.join(per_node, tree["node"] == per_node["node_id"], "left").groupBy("ancestor").agg(F.sum(F.coalesce("n", F.lit(0))).alias("images"))


def matching_nodes(nodes: DataFrame, q: str) -> DataFrame:
    """nodes that match by name or path, or have a descendant that does."""
    hit = nodes.filter(F.col("is_active") & (F.lower("name").contains(q.lower()) | F.lower("path").contains(q.lower()))).select(F.col("id").alias("node"))
    return closure(nodes).join(hit, "node", "left_semi").select(F.col("ancestor").alias("id")).distinct()


def listed_images(images: DataFrame, nodes: DataFrame, q: str | None = None) -> DataFrame:
    """Images with their active node, filtered by name or path (wildcards in q are not escaped)."""
    n = nodes.filter("is_active").select(F.col("id").alias("node_id"), F.col("path").alias("node_path"))
    both = images.join(n, "node_id")
    return both if not q else both.filter(F.col("name").ilike(f"%{q}%") | F.col("node_path").ilike(f"%{q}%"))


def created(nodes: DataFrame, commands: DataFrame) -> DataFrame:
    """MU1: nodes with those of ``commands`` (id, parent_id, name) added: not empty, and not the name of a sibling in any case; of equal new
    names under one parent the smallest id is taken. A null parent is a root."""
    w = Window.partitionBy("parent_id", F.lower("name")).orderBy("id")
    new = commands.withColumn("name", F.trim("name")).filter(F.length("name") > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    taken = nodes.filter("is_active").select(F.col("parent_id").alias("p"), F.lower("name").alias("low"))
    new = new.join(taken, F.col("parent_id").eqNullSafe(F.col("p")) & (F.lower("name") == F.col("low")), "left_anti")
    parents = nodes.filter("is_active").select(F.col("id").alias("p"), F.col("level").alias("pl"), F.col("path").alias("pp"))
    placed = new.join(parents, F.col("parent_id") == F.col("p"), "left").filter(F.col("parent_id").isNull() | F.col("p").isNotNull())
    rows = placed.select("id", "parent_id", "name", (F.coalesce(F.col("pl") + 1, F.lit(0))).alias("level"), F.concat_ws("/", "pp", "name").alias("path"), F.lit(True).alias("is_active"))
    return nodes.unionByName(rows)


def with_paths(nodes: DataFrame) -> DataFrame:
    """MU4: paths of active nodes rebuilt from names and parents; levels are left alone."""
    names = nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("part"))
    paths = closure(nodes).join(names, "ancestor").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "part"))).alias("p")).select(F.col("node").alias("id"), F.array_join("p.part", "/").alias("new_path"))
    return nodes.join(paths, "id", "left").withColumn("path", F.coalesce("new_path", "path")).select(nodes.columns)


def renamed(nodes: DataFrame, commands: DataFrame, refresh: bool) -> DataFrame:
    """MU2: new names for the ids of ``commands`` (id, new_name); the node's own path follows, descendants' only with ``refresh``."""
    j = nodes.join(commands, "id", "left")
    own = F.when(F.col("new_name").isNull(), F.col("path")).otherwise(F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.col("new_name")))
    out = j.withColumn("path", own).withColumn("name", F.coalesce("new_name", "name")).select(nodes.columns)
    return with_paths(out) if refresh else out


def moved(nodes: DataFrame, commands: DataFrame) -> DataFrame:
    """MU3: new parents for ``commands`` (id, to): not under itself or a descendant, nor beside a node of the same name unless at the root."""
    tree = closure(nodes).select(F.col("ancestor").alias("id"), F.col("node").alias("to"))
    legal = commands.join(tree, ["id", "to"], "left_anti").join(nodes.select("id", F.lower("name").alias("low")), "id")
    taken = nodes.filter("is_active").select(F.col("parent_id").alias("to"), F.lower("name").alias("low"))
    legal = legal.join(taken, ["to", "low"], "left_anti").select("id", "to", F.lit(True).alias("_moves"))
    out = nodes.join(legal, "id", "left").withColumn("parent_id", F.when(F.col("_moves"), F.col("to")).otherwise(F.col("parent_id"))).select(nodes.columns)
    return with_paths(out)


def deleted(nodes: DataFrame, images: DataFrame, ids: DataFrame, with_files: bool) -> tuple[DataFrame, DataFrame]:
    """MU5: the subtrees of ``ids`` (id) switched off and their images dropped; without ``with_files`` only nodes that have neither child nor image."""
    tree = closure(nodes)
    if not with_files:
        used = nodes.filter("is_active and parent_id is not null").select(F.col("parent_id").alias("id")).unionByName(images.select(F.col("node_id").alias("id"))).distinct()
        ids = ids.join(used, "id", "left_anti")
    gone = tree.join(ids.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("id")).distinct()
    marked = nodes.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(nodes.columns)
    return marked, images.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(images.columns)


def synced(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """S9, S10, S12, ST4: (path, size, node_id, action) of a folder listing against the catalog: insert, update, same, or orphan."""
    c = catalog.select("path", F.col("size").alias("c_size"), F.col("node_id").alias("c_node"), F.lit(True).alias("c"))
    action = F.when(F.col("size").isNull(), "orphan").when(F.col("c").isNull(), "insert").when((F.col("size") != F.col("c_size")) | (F.col("node_id") != F.col("c_node")), "update").otherwise("same")
    return listing.join(c, "path", "full").select("path", F.coalesce("size", "c_size").alias("size"), F.coalesce("node_id", "c_node").alias("node_id"), action.alias("action"))


def chains(paths: DataFrame) -> DataFrame:
    """MU13: every folder on the way to each path, once: path, parent, name, depth."""
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    p = paths.select(F.explode(prefix).alias("path")).distinct()
    return p.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"))


def first_root(files: DataFrame) -> DataFrame:
    """One row per relative path, from the first root that has it."""
    w = Window.partitionBy("path").orderBy("root")
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def purged(runs: DataFrame, reviews: DataFrame, jobs: DataFrame, old: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MU8, MU9: runs for which ``old`` holds dropped with their reviews; jobs forget them."""
    gone = runs.filter(old).select("run_id")
    kept_jobs = jobs.join(gone.withColumn("_gone", F.lit(True)), "run_id", "left").withColumn("run_id", F.when(F.col("_gone").isNull(), F.col("run_id"))).select(jobs.columns)
    return runs.join(gone, "run_id", "left_anti"), reviews.join(gone, "run_id", "left_anti"), kept_jobs


def repaired(jobs: DataFrame, busy: bool) -> DataFrame:
    """MU10, L3: unless one runs here, all running jobs failed and the oldest queued one started."""
    if busy:
        return jobs
    first = jobs.filter("status = 'queued'").orderBy("created_at", "job_id").limit(1).select("job_id", F.lit(True).alias("_next"))
    out = jobs.join(F.broadcast(first), "job_id", "left")
    return out.withColumn("status", F.when(F.col("status") == "running", "failed").when(F.col("_next"), "running").otherwise(F.col("status"))).select(jobs.columns)


def uploaded_names(uploads: DataFrame) -> DataFrame:
    """MU12: file names made unique in their node: name, name_1, name_2 ... in order of upload."""
    w = Window.partitionBy("node_id", F.lower("name")).orderBy("upload_id")
    n = F.row_number().over(w)
    numbered = F.concat(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("_"), (n - 1).cast("string"), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2))
    return uploads.withColumn("stored_name", F.when(n == 1, F.col("name")).otherwise(numbered))
