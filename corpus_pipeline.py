"""A training-corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontamination, language_id, mixing, ngram_jaccard, sharding
from brindle.llm.shared import removed, rewritten
from brindle.session import ship
from brindle.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject; they are fitted on documents with a language."""
    ship(spark)
    model = language_id.fit(docs, F.lit(True))
    return language_id.known(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates."""
    ship(spark)
    return ngram_jaccard.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and ``shard``."""
    return sharding.with_shard(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: Language models, set similarity and fitted rates are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = rewritten(stage(spark, docs, sf_dir), name)
        if before:  # no later stage reads it
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
