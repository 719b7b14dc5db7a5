"""Incremental validation: new modules of a folder are checked as they come (an extension; a rebuild of the whole index remains the exact way)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Modules (Parquet files of ``schema``) that appear in ``folder`` go through ``check``; findings are written once for each batch, under its number."""

    def batch(df: DataFrame, number: int) -> None:
        check(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
