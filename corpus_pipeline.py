"""The corpus pipeline: documents to encoded training text, each stage written as Parquet and read again by the next.

Stages decide row by row, so rows with repeated or null doc_ids are documents of their own; null texts count as empty; very long texts are
taken whole; an empty table gives an empty result; columns beyond those of ``documents`` come through to the last stage, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronotile.functions.lineage import shared_folder
from chronotile.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from chronotile.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; one of those that repeat it."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity, the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.mixed_docs(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each row, digested, and the digest of the text decoded from them."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL cannot train the toxicity field or draw the mix; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The first four run at this call; their tables go to the shared checkpoint folder, where only the last
    of them stays, which the result reads."""
    folder = shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/pipeline-{uuid.uuid4().hex}-{k}")
            docs = spark.read.parquet(path)
            if before is not None:
                _drop(spark, before)
            before = path
    return docs
