"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.functions.lineage import cut

#: Most ids that a checked broadcast may hold (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Most rows of an Arrow batch of whole texts. Batches of Spark's default size hold ten times as much in the JVM and twice over in Python.
BATCH_ROWS = 1000
#: White space as the word contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, for Python functions on whole texts: from now on the session hands over at most BATCH_ROWS rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the cluster's shared checkpoint folder."""
    return cut(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def attach(left: DataFrame, right: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """Join of ``left`` with one ``right`` row per key, for keys that may hold a large share of ``left``.

    A sort-merge join, so nothing is broadcast at any size. Adaptive execution splits the partitions of ``left`` that a heavy key
    makes large and gives each part the one ``right`` row. It can do so when ``right`` is materialised. Null keys match nothing.
    """
    return left.join(right.hint("merge"), list(keys), how)


def join_ids(left: DataFrame, ids: DataFrame, key: str, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Join with a materialised table of one row per key: broadcast when it has at most ``most`` rows, which is checked, else shuffled."""
    few = ids.limit(most + 1).count() <= most
    return left.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same, and faster, when every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def in_fold(doc_id: Column) -> Column:
    """Whether labels of the document may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))
