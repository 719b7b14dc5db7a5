"""Catalog search: exact, prefix, word order, staged and fuzzy lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.session import cut

LEAST, MOST, USUAL = 1, 50, 10
USUAL_DISTANCE = 4


def bounded(limit: int | None) -> int:
    return min(MOST, max(LEAST, USUAL if limit is None else limit))


def latest(catalog: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one that was written last."""
    columns = [c for c in catalog.columns if c != key]
    return catalog.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(key, "row.*")


def prefix(catalog: DataFrame, key: str, query: str, limit: int | None = None) -> DataFrame:
    """Rows whose folded key starts with the query, in key order. ``key`` holds folded names, so the scan gets the filter."""
    return catalog.where(F.col(key).startswith(query.strip().lower())).orderBy(key).limit(bounded(limit))


def staged(catalog: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Search over ``kind, kind_rank, name_ru, name_en``: prefix of the first name, then words in order in either name,
    and only if both find nothing a substring of either. Best stage first, then kind and name; one row for each kind and name."""
    q = query.strip().lower()
    ru, en = T.fold("name_ru"), T.fold("name_en")
    words = q.split()
    at_front = ru.startswith(q)
    in_order = (T.words_in_order("name_ru", q) | T.words_in_order("name_en", q)) if len(words) > 1 else F.lit(False)
    stage = F.when(at_front, F.lit(1)).when(in_order, F.lit(2)).when(ru.contains(q) | en.contains(q), F.lit(3))
    found = catalog.withColumns({"name_key": ru, "stage": stage}).where(F.col("stage").isNotNull() & F.lit(bool(q)))
    early = F.when(F.col("stage") < 3, F.col("kind_rank"))
    one = found.groupBy("kind", "name_key").agg(F.coalesce(F.min(early), F.min("kind_rank")).alias("kind_rank"), F.min("stage").alias("stage"), F.min_by("name_ru", F.struct("stage", "name_ru")).alias("name_ru"))
    # One pass: if an earlier stage has found anything, that is in front, and the last stage's rows leave what is returned.
    first = one.orderBy("stage", "kind_rank", "name_key", "kind").limit(bounded(limit))
    least = F.min("stage").over(Window.partitionBy(F.lit(1)))  # of at most MOST rows
    return first.withColumn("_least", least).where((F.col("stage") < 3) | (F.col("_least") == 3)).drop("_least").orderBy("stage", "kind_rank", "name_key", "kind")


def numbered(df: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """Adds the place of each row in an order, from 0: rows are dealt into ranges once, and each range begins where the ones before it end."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each partition.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def paged(df: DataFrame, order: list[str], size: int = 400) -> DataFrame:
    """Adds ``page``: all pages of a scan in order at once; the last one is the short one."""
    return numbered(df, order, "page").withColumn("page", F.floor(F.col("page") / size))


def nearest(queries: DataFrame, candidates: DataFrame, query: str, name: str, order: str, within: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The candidate at the least edit distance from each query; of equals, the first in ``order``.

    Candidates are a catalog of names: they are few, and Spark decides whether to broadcast them.  With ``within`` only lengths
    that can be near meet: the join is an equality on the length, so it scales with both sides.
    """
    by = by or []
    if within is None:
        # What is near is found by lengths; whoever has no near candidate, and only they, is compared with all.
        near = nearest(queries, candidates, query, name, order, USUAL_DISTANCE, by)
        rest = queries.join(near.select(*by, query), [*by, query], "left_anti")
        b = candidates.select(*by, F.col(order).alias("_order"), F.col(name).alias("nearest"))
        far = (rest.join(b, by) if by else rest.crossJoin(b)).withColumn("distance", F.levenshtein(F.lower(query), F.lower("nearest")))
        far = far.groupBy(*by, query).agg(F.min(F.struct("distance", "_order", "nearest")).alias("best")).select(*by, query, "best.nearest", "best.distance")
        return near.unionByName(far)
    a = queries.withColumn("_len", F.length(query))
    b = candidates.withColumn("_len", F.length(name))
    a = a.withColumn("_len", F.explode(F.sequence(F.greatest(F.col("_len") - within, F.lit(0)), F.col("_len") + within)))
    pairs = a.join(b, ["_len", *by])
    d = F.levenshtein(F.lower(query), F.lower(name), within)
    scored = pairs.withColumn("distance", d).where("distance >= 0")
    return scored.groupBy(*by, query).agg(F.min(F.struct("distance", F.col(order).alias("_order"), F.col(name).alias("nearest"))).alias("best")).select(*by, query, "best.nearest", "best.distance")


def similar(candidates: DataFrame, name: str, query: Column, order: str, k: int = 5, above: float = 0.0) -> DataFrame:
    """The k names most like the query, of which each spelling counts once; of equals the first."""
    score = T.similarity(F.lower(F.col(name)), F.lower(query))
    return (
        candidates.withColumn("score", score).where(F.col("score") > above).groupBy(F.lower(name).alias("name_key")).agg(F.max("score").alias("score"), F.min(order).alias("first_seen"))
        .orderBy(F.desc("score"), "first_seen").limit(k)
    )


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
