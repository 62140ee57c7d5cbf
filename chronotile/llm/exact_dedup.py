"""Exact duplicate removal by content-defined chunk recipes (DataFrame operations only).

A text is cut where its own content says so, so equal texts are cut alike. Each document becomes the ordered list of
its chunks' 64-bit fingerprints. Every chunk's bytes are moved once, into a dictionary that shows which fingerprints
stand for exactly one chunk: those are verified identifiers. Two documents are equal when their identifier lists are.
If two different chunks share a fingerprint, all identifiers of the run are lengthened by a 256-bit digest of the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import ascii_lower, attach, join_ids, saved

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: In other scripts than Latin a chunk ends after one of these characters: every 16th code point of the scripts with small alphabets, and
#: beyond them the first 16 of each row of 256.
_SMALL = "".join(rf"\x{{{code:x}}}" for code in range(0x400, 0x2000, 16))
_OTHERS = _SMALL + "".join(rf"\x{{{row:x}00}}-\x{{{row:x}0f}}" for row in range(0x20, 0x100) if not 0xD8 <= row < 0xE0)
#: A chunk ends after a vowel, a blank and one of these letters, or after one of _OTHERS, at the first such place from MIN_CHUNK on.
CHUNKS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:(?<=[aeiou] [a-h])|(?<=[[^\x00-\x{{3ff}}]&&[{_OTHERS}]]))|.{{1,{MAX_CHUNK}}}"
_LOWEST = "-9223372036854775809"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(CHUNKS), F.lit(0))


def exact_groups(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of a group stays.
    Of rows repeated with the same doc_id and text exactly one stays; a null doc_id ranks below every other, and a group
    of null doc_ids only has a null keep_id. Other columns are ignored; an empty table gives an empty result.
    """
    return _grouped(docs, fingerprint)


def _grouped(docs: DataFrame, fingerprint=F.xxhash64, *carried: str) -> DataFrame:
    """``exact_groups`` with the columns ``carried`` of each row as they are."""
    base = docs.select("doc_id", "text", *carried)
    dictionary = base.select(F.explode(_chunks(F.col("text"))).alias("chunk")).select(fingerprint(F.col("chunk")).alias("mark"), "chunk").distinct()
    shared = dictionary.groupBy("mark").count().filter("count > 1").limit(1).count()

    def identifier(chunk: Column) -> Column:
        return F.concat_ws(":", F.hex(fingerprint(chunk)), F.sha2(chunk, 256)) if shared else F.hex(fingerprint(chunk))

    recipes = base.select(
        "doc_id",
        *carried,
        F.transform(_chunks(F.col("text")), identifier).alias("recipe"),
        F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
    )
    code = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(_LOWEST).cast("decimal(20,0)")) * F.lit("1" + "0" * 18).cast("decimal(19,0)")
    recipes = saved(recipes.withColumn("_code", (code.cast("decimal(38,0)") + F.col("_row") % F.lit(10**18)).cast("decimal(38,0)")).drop("_row"))
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.max("_code").alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return attach(recipes, saved(groups.filter("group_size > 1")), "recipe").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("_code") == F.col("_best"), F.lit(True)).alias("kept"),
        "text_sha256",
        *carried,
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; rows are told apart by a number of their own, so doc_id may repeat or be null."""
    rows = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("at")))
    dropped = saved(_grouped(rows.select("doc.doc_id", "doc.text", "at"), F.xxhash64, "at").filter(~F.col("kept")).select("at"))
    return join_ids(rows, dropped, "at", "left_anti").select("doc.*")


#: DuckDB: the contract of op9.
SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
