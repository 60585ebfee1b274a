"""The opN queries: each applies one operator to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphworks.llm import chat, decontaminate, jaccard, licenses, lm, mixing, repeats, tokens, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.flag(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.queue(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"), "n_license_lines")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_lm_score, op3_decontaminate, op4_exact_topk, op5_mix_sources, op6_ngram_jaccard, op7_chat_format, op8_license_scan, op9_token_output, op10_toxicity)
}

SQL: dict[str, str] = {
    "op1_suffix_dedup": repeats.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_exact_topk": topk.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_ngram_jaccard": jaccard.SQL,
    "op7_chat_format": chat.SQL,
    "op8_license_scan": licenses.SQL,
}
