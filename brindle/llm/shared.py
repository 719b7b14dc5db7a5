"""Tables that outlive a step: checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests), in a temporary folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager)


def folder(session: SparkSession) -> str:
    """The shared folder, where checkpoints go."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        shared = setting(session)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="brindle-checkpoints-"))
    return context.getCheckpointDir()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rewritten(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again; and its path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(session: SparkSession, path: str) -> None:
    """Deletes a table that ``rewritten`` made and that nothing reads any more."""
    jvm, context = session.sparkContext._jvm, session.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def setting(session: SparkSession) -> str | None:
    return session.conf.get("spark.checkpoint.dir", None)


def least_hashed(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the least hash of ``key``, the same whatever the partitions.

    Only rows with a hash small enough to be among them are sorted: a count of all rows says how small (four times as many as wanted pass).
    """
    total = rows.count()
    place = F.xxhash64(F.lit(seed), key).cast("double") / float(1 << 64) + 0.5
    near = rows.where(place <= min(1.0, (4 * n + 400) / max(1, total)))
    return near.orderBy(F.xxhash64(F.lit(seed), key), *rows.columns).limit(n)


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (bounded, with distinct ``doc_id``) with the ``text`` of each in ``docs``: of documents that share an id, the first text in order."""
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")
