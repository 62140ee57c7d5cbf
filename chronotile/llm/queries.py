"""The queries of this subpackage, for the driver's contract; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chronotile.llm import block_search, bpe, chat, exact_dedup, html_text, jaccard_join, language_id, mixing, pii, source_divergence, speculative_bpe, spelling_variants, toxicity
from chronotile.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_chars", F.sha2("rendered", 256).alias("rendered_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents"))


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative_bpe.encode_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_nearest_neighbours, op2_language_id, op3_ngram_jaccard_join, op4_byte_bpe, op5_chat_formatting,
        op6_html_extraction, op7_mixing, op8_pii, op9_exact_dedup, op10_toxicity,
        op11_source_divergence, op12_spelling_variants, op13_speculative_bpe,
    )
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest_neighbours": block_search.SQL,
        "op3_ngram_jaccard_join": jaccard_join.SQL,
        "op5_chat_formatting": chat.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op11_source_divergence": source_divergence.SQL,
        "op12_spelling_variants": spelling_variants.SQL,
    }
