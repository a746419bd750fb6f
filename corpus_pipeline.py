"""A corpus pipeline over ``documents``: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it again as the next stage's docs; what only a finished stage read is deleted. All stages but the last return the columns of documents.

1. toxicity: drops documents whose probability of being toxic reaches one half (model fitted on labelled documents).
2. near_dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id stays.
3. decontamination: drops documents that hold a benchmark item.
4. mixing: sources are mixed to their target weights; a document is repeated as often as its source's epochs say.
5. sharding: a reproducible shuffle into 8 shards; adds size, text_crc32, law, shard, slot and grown_shard.

An empty table passes through all stages as an empty table; null texts are harmless, unique and clean, and have no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, neardup, sharding, toxicity
from tessera.llm.common import forget, settle, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep_harmless=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def feistel_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", feistel_sharding),
]

#: The toxicity model and the near-duplicate groups have no SQL form; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = written()
        kept = settle(stage(spark, docs, sf_dir), before)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
