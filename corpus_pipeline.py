"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

Toxic documents go; one document of each group of near copies stays; documents with
benchmark passages go; sources are mixed to their target weights (a document can be taken
up to three times); the rest becomes token files, whose index is the result.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns as
its operator says.  In short: a null text is an empty one, which is neither toxic nor a copy nor contaminated, and has
no words to mix, so that the mix leaves it out; a document without an id is never a near copy; of rows
with one id each is judged by its own text, but near copies are judged by the id; all stages but the last keep all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphworks.llm import decontaminate, jaccard, mixing, tokens, toxicity
from glyphworks.llm._shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_index(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: SQL cannot express the network or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
