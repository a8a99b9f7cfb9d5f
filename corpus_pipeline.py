"""A corpus pipeline over documents: each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontaminate, language, mixing, near_dup, sharding
from claimweave.llm.common import materialise, table

SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: without letters, or unlike any of the languages. Mixtures stay.

    Null and empty texts go; repeated rows fare alike; a table without labels or rows gives none."""
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each class of near copies. Repeated rows are one; texts without words are one class."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of any benchmark item occurs. Null and empty texts have none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources weigh as the square root of their bytes, in a globally shuffled order.

    Rows that repeat a doc_id are drawn alike; sources without bytes (null and empty texts only) go; a null source is a source."""
    return mixing.drawn(docs, mixing.source_rates(docs)).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document, with near equal bytes, tokens and rows in the shards. Copies of a text stay together; a null
    text has 8 bytes; an empty table gives an empty result."""
    return sharding.shard(docs, SHARDS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("sharded", sharded)]

#: Language models, similarity classes and bin packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
