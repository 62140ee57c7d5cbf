"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

A log often holds the same conversation several times, each snapshot with more turns. A rolling hash of every turn prefix is kept
for each conversation; one whose whole hash is a shorter prefix hash of another is dropped by an anti-join, as are
repeats of the same turns under another id. Only what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import saved

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), mark: the rolling 128-bit hash of the first n turns, as text. No turn text is kept."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role_", "text_")
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.withColumn("n", F.row_number().over(order)).withColumns({f"h{k}": F.xxhash64(F.lit(k), "n", "role_", "text_") for k in (1, 2)})
    one, two = (F.hex(F.expr(f"bit_xor(h{k})").over(rolling)) for k in (1, 2))
    return hashed.select("conv_id", "n", F.concat(one, F.lit("-"), two).alias("mark"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of each conversation that is neither a proper turn prefix of another nor a repeat of one.

    Turns follow their number (null last), then role and text. Rows repeated whole count once; null roles and texts are empty;
    rows with a null conv_id belong to no conversation. Of equal conversations the smallest conv_id stays.
    """
    marks = saved(prefix_hashes(_clean(turns)))
    whole = marks.groupBy("conv_id").agg(F.max_by("mark", "n").alias("mark"), F.max("n").alias("n_turns"))
    first = whole.groupBy("mark", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    longest = marks.join(whole.select("conv_id", "n_turns"), "conv_id").filter("n < n_turns").select("mark").distinct()
    return first.join(longest, "mark", "left_anti").select("conv_id", "n_turns")


def _clean(turns: DataFrame) -> DataFrame:
    named = [F.coalesce(c, F.lit("")).alias(f"{c}_") for c in ("role", "text")]
    return turns.filter("conv_id is not null").select("conv_id", "turn", *named).distinct()


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_chars and the rendered text of each maximal conversation, opening and closing every turn.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Ties, nulls and repeats are as ``maximal_conversations`` has them;
    very long turns are rendered whole; one conversation, however long, is one row of the result and is put together in one task.
    An empty table gives an empty result.
    """
    kept = saved(maximal_conversations(turns))
    parts = _clean(turns).join(kept, "conv_id").withColumn("part", F.concat(F.lit(OPEN), "role_", F.lit("\n"), "text_", F.lit(CLOSE)))
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", "role_", "text_", "part")
    listed = parts.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(turn)).alias("parts"))
    rendered = listed.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join("parts.part", "").alias("rendered"))
    return rendered.withColumn("n_chars", F.length("rendered").cast("long"))


#: DuckDB: op5 by comparing lists of turns.
SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) ORDER BY turn NULLS LAST, role, text) AS parts
  FROM t GROUP BY conv_id
),
p AS (SELECT conv_id, n_turns, k, array_to_string(parts[1:k], '') AS prefix FROM c, unnest(range(1, n_turns + 1)) AS u(k)),
f AS (SELECT min(conv_id) AS conv_id, n_turns, prefix AS rendered FROM p WHERE k = n_turns GROUP BY n_turns, prefix)
SELECT conv_id, n_turns, length(rendered) AS n_chars, sha256(rendered) AS rendered_sha256
FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = f.n_turns AND p.k < p.n_turns AND p.prefix = f.rendered)
"""
