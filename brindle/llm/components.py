"""Connected components by alternating large-star and small-star rounds.

Links never leave the executors; each round is an aggregation of minima and a join with them, and takes a number of rounds
that grows with the logarithm of the longest chain.  Minima are checkpointed before they are joined: then both
sides of the join are plain exchanges, and a node with a large share of all links is split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import checkpoint


def _least(links: DataFrame) -> DataFrame:
    return checkpoint(links.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links must run from the larger to the smaller id."""
    found = links.join(_least(links), "u")
    return found.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component`` for every id in ``links(a, b)``: the least id that can be reached. Links with a null are ignored."""
    now = checkpoint(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = checkpoint(_small_star(checkpoint(_large_star(now))))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
