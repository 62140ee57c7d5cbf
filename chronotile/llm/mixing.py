"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Every document of a source may be copied ``target / source_size`` times: a whole part that is certain and a fraction
that is a probability. Pivotal rounding takes two fractional documents and moves mass (probability times words)
from one to the other, at random in one of two directions and so that both expectations stay, until one of them is
integral; the words that the pair contributes do not change. A block of documents is folded this way into decisions and one
residual document; residuals of 128 blocks form a block of the next level, up to one residual for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import WORD, join_ids, let, saved

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
BLOCK = 128
#: Most sources whose targets a checked broadcast may hold; beyond it their join shuffles.
BROADCAST_SOURCES = 100_000
_NEAR = 1e-9
_FIELDS = ("order", "doc_id", "size", "base", "p", "u", "source_size", "target", "row")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets for (key, source, size) rows, one row per source: key, source, n_docs, source_size, target.

    Sources in code-point order, null last, weigh 5, 2, 1, repeating. They share BUDGET times all words by weight; a
    target stops at CAP times its source and the excess goes to the others by weight, which is the level ``l`` at which
    sum(least(cap, l * weight)) equals the budget. One row per source meets in one window, never the documents.
    """
    by_source = sizes.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn("rn", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rn") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    by_ratio = everything.orderBy("ratio", "rn")
    levels = (
        weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * BUDGET)
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn", "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).select("key", "source", "n_docs", "source_size", "target")


def _met(acc: Column, x: Column) -> Column:
    """The carried document meets ``x``: one becomes integral and is decided, the other is carried on."""
    c = acc["c"]
    up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])

    def moved(m: Column) -> Column:
        d = F.when(x["u"] * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])
        return let(F.struct((c["p"] + d / c["size"]).alias("c"), (x["p"] - d / x["size"]).alias("x")), settled)

    def settled(p: Column) -> Column:
        c_done, x_done = _whole(p["c"]), _whole(p["x"])
        decided = lambda item, done, share: F.when(done, F.array(_with_p(item, F.round(share)))).otherwise(_none(item))
        out = F.concat(acc["out"], decided(c, c_done, p["c"]), decided(x, x_done, p["x"]))
        return F.struct((~(c_done & x_done)).alias("live"), F.when(c_done, _with_p(x, p["x"])).otherwise(_with_p(c, p["c"])).alias("c"), out.alias("out"))

    return let(F.struct(up.alias("up"), down.alias("down")), moved)


def _whole(p: Column) -> Column:
    return F.abs(p - F.round(p)) < _NEAR


def _with_p(item: Column, p: Column) -> Column:
    return F.struct(*[(p if f == "p" else item[f]).alias(f) for f in _FIELDS])


def _none(item: Column) -> Column:
    return F.filter(F.array(_with_p(item, item["p"])), lambda _: F.lit(False))


def _folded(items: DataFrame) -> DataFrame:
    """(key, block, item) rows to one row per block: the residual ``c``, if there is one (``live``), and the decided ``out``."""
    blocks = items.groupBy("key", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    first = F.col("items")[0]
    start = F.struct(F.lit(True).alias("live"), _with_p(first, first["p"]).alias("c"), _none(first).alias("out"))
    taken_up = lambda acc, x: F.struct(F.lit(True).alias("live"), _with_p(x, x["p"]).alias("c"), acc["out"].alias("out"))
    folded = F.aggregate(F.slice("items", 2, F.size("items")), start, lambda acc, x: F.when(acc["live"], _met(acc, x)).otherwise(taken_up(acc, x)))
    return blocks.select("key", "block", folded.alias("f")).select("key", "block", "f.live", "f.c", "f.out")


def _even(items: DataFrame, blocks: int) -> tuple[DataFrame, int]:
    """Items with blocks of a bounded size, and the number of blocks.

    Hashes of different ids make even blocks. Rows that share id and size, such as those without an id, share a hash, and a block that
    they swell is split by the rows' number in the input.
    """
    large = items.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * BLOCK)
    large = saved(large.select("key", "block", F.ceil(F.col("n") / BLOCK).alias("parts")))
    most = large.agg(F.max("parts")).first()[0]
    if most is None:
        return items.drop("number"), blocks
    part = F.coalesce(1 + F.pmod("number", "parts"), F.lit(0))
    split = items.join(large.hint("merge"), ["key", "block"], "left")
    return split.withColumn("block", F.col("block") + blocks * part).drop("number", "parts"), blocks * (1 + most)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    copies is 0, 1 or 2 and taken is copies times size. A source's taken words differ from its target by at most half of
    one of its documents, the last residual, which is rounded to the nearer side; every other step keeps all expectations. Random
    numbers are hashes of seed, level and doc_id, so reruns agree. A null text has no words, a null source is a source of its own, an empty
    document takes nothing, rows with a repeated or null doc_id are rounded as documents of their own. A very long text is a document
    like others; extra columns are ignored; an empty table gives an empty result.
    """
    return _mixed(docs.select("doc_id", "text", "source", F.lit(0).cast("long").alias("row")), seed).drop("row")


def _mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``mix`` of rows (doc_id, text, source, row) with ``row`` as it is."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sizes = saved(docs.select("doc_id", "row", "source", size.alias("size")).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    total = sizes.count()
    joined = join_ids(sizes.drop("source"), saved(source_targets(sizes).drop("n_docs")), "key", "left", BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(_whole(rate), F.round(rate)).otherwise(F.floor(rate))
    noise = lambda level: F.xxhash64(F.lit(seed), F.lit(level), "item.doc_id", "item.size").bitwiseAND(2**53 - 1) / float(2**53)
    blocks = max(1, -(-total // BLOCK))
    prepared = joined.withColumn("base", whole.cast("long")).withColumn("p", F.when(_whole(rate) | (F.col("size") == 0), F.lit(0.0)).otherwise(rate - whole))
    block = F.pmod(F.xxhash64(F.lit(seed), "key", "doc_id", "size"), F.lit(blocks)).alias("block")
    item = F.struct((-F.col("size")).alias("order"), "doc_id", "size", "base", "p", F.lit(0.0).alias("u"), "source_size", "target", "row")
    items = saved(prepared.select("key", block, F.monotonically_increasing_id().alias("number"), item.alias("item")))
    items, blocks = _even(items, blocks)
    decided = [items.filter("item.p = 0").select("key", "item")]
    open_ = items.filter("item.p > 0").select("key", "block", "item")
    level = 0
    while True:
        folded = saved(_folded(open_.withColumn("item", F.struct(*[(noise(level) if f == "u" else F.col(f"item.{f}")).alias(f) for f in _FIELDS]))))
        decided.append(folded.select("key", F.explode("out").alias("item")))
        left = folded.filter("live")
        if blocks == 1:
            break
        blocks, level = -(-blocks // BLOCK), level + 1
        open_ = left.select("key", F.floor(F.col("block") / BLOCK).alias("block"), F.col("c").alias("item"))
    decided.append(left.select("key", _with_p(F.col("c"), F.round("c.p")).alias("item")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = out.select("item.*", F.when(F.length("key") > 0, F.substring("key", 2, 2**31 - 1)).alias("source"))
    copies = F.col("base") + F.col("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def mixed_docs(docs: DataFrame) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as ``mix`` takes it; rows are told apart by a number of their own, so doc_id may repeat or be null."""
    rows = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    copies = _mixed(rows.select("doc.doc_id", "doc.text", "doc.source", "row")).select("row", "copies").filter("copies > 0")
    return rows.join(copies, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
