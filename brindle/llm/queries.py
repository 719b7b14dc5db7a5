"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontamination
from brindle.llm import embedding_dedup as embeddings
from brindle.llm import language_id as languages
from brindle.llm import lm_score as lm
from brindle.llm import mixing
from brindle.llm import ngram_jaccard as jaccard
from brindle.llm import oracles, sharding
from brindle.llm import substring_dedup as substrings
from brindle.llm import suffix_dedup as suffixes
from brindle.llm import toxicity as toxic
from brindle.tables import table


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identify(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Sums are rounded: engines add in different orders."""
    scored = lm.lm_score(table(spark, folder, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, folder, "documents"))


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "labels"), repeat=True)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_slots(table(spark, folder, "documents"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each repeated span; documents without one have no row."""
    found = suffixes.suffix_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", F.col("span.first").alias("first_word"), F.col("span.words").alias("n_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": oracles.JACCARD_JOIN, "op4_lm_score": oracles.LM_SCORE, "op6_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op7_embedding_dedup": oracles.NEAR_DUPLICATES, "op9_sharding": oracles.SHARDING, "op10_suffix_dedup": oracles.REPEATED_SPANS,
    }
