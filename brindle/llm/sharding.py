"""Contiguous shards of equal bytes, from global prefix sums.

Rows are range-partitioned by ``doc_id`` (ties by checksum and size, then by their place in the input, so that rows which are equal in all of these are no
single range), so the order of partitions and the order within them make one global order.  Each partition's bytes are added up; prefix sums of those totals (one row for each partition) start the running
sum of each partition.  A row goes to the shard in whose equal share of all bytes its first byte lies, so shards are
contiguous in ``doc_id`` and differ by less than one document from equal sizes.

Only DataFrame operations are used.  What is shuffled is 32 bytes a row: texts never move.  The ranged rows are checkpointed,
as both passes must see the same partitions even if an executor is lost between them.

Defined results: a null text counts one byte and has checksum 0; rows with null ``doc_id`` come first; equal rows are interchangeable;
an empty table gives no rows; further columns are ignored by ``shard_slots`` and kept by ``with_shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import checkpoint, unused

ORDER = ("doc_id", "text_crc32", "size", "place")


def sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))


def positions(rows: DataFrame) -> DataFrame:
    """Adds ``before`` (bytes), ``at`` (rows before it) and ``total`` (bytes) in the global order to rows of ``sizes``."""
    ranged = checkpoint(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition: bounded by the number of partitions, not by rows.
    starts = parts.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"upto": F.sum("size").over(within), "nth": F.row_number().over(within)}).join(F.broadcast(starts), "part")
    return placed.select(*ORDER, (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("before"), (F.col("rows_before") + F.col("nth") - 1).alias("at"), "total")


def shard_slots(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` with near equal bytes in each shard."""
    share = F.least(F.expr(f"before * {shards} div total"), F.lit(shards - 1)).cast("int")
    placed = positions(sizes(docs)).withColumn("shard", share)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All columns of ``docs`` and ``shard`` (replacing a column of that name), without moving texts.

    The first row of each shard is at most ``shards`` keys, and a row's shard follows from comparing its key with them.  Of rows that are equal in id,
    checksum and size it is open which goes where.
    """
    share = F.least(F.expr(f"before * {shards} div total"), F.lit(shards - 1)).cast("int")
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("text_crc32"), F.col("size"), F.col("place"))
    cuts = positions(sizes(docs)).groupBy(share.alias("shard")).agg(F.min(key).alias("least")).collect()
    text = F.coalesce(F.col("text"), F.lit(""))
    place = unused(docs, "place")
    own = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.crc32(text.cast("binary")), (F.octet_length(text) + 1).cast("long"), F.col(place))
    shard = F.lit(0)
    for cut in sorted(cuts, key=lambda r: r["shard"]):
        bound = F.struct(*(F.lit(x).cast("long") for x in cut["least"]))
        shard = F.when(own >= bound, F.lit(cut["shard"])).otherwise(shard)
    return docs.withColumn(place, F.monotonically_increasing_id()).withColumn("shard", shard.cast("int")).drop(place)
