"""Session defaults."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; sizes of partitions are left to adaptive execution.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "brindle", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application: they need not have it on their path."""
    context = spark.sparkContext
    if not getattr(context, "_brindle_shipped", False):
        package = Path(__file__).resolve().parent
        if package.is_dir():
            context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='brindle-')}/brindle", "zip", package.parent, package.name))
        context._brindle_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors see: ``spark.checkpoint.dir``; only where all runs on one machine and it is unset, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it in the shared folder: what follows reads it as often as it likes.

    A checkpoint carries on the size that Spark guesses from the files read, which knows nothing of how well they are packed nor of rows that Python makes: a large table would be broadcast.
    So the size is left unknown, and adaptive execution broadcasts what it has measured.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
