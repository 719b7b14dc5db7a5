"""A foreign index in SQLite as a batch source: ``spark.read.format("brindle_sqlite").option("path", …).option("query", …)``.

The file is read from a file: URI, read-only, which all executors must see.  With the options ``key`` (an integer column of the query) and ``parts`` each task reads one range of
keys; otherwise one task reads all.  Blobs that are compressed with zstandard can be decoded by ``decoded``.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.functions import text as X


class _Range(InputPartition):
    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.query, self.key, self.parts = options["path"], options["query"], options.get("key"), int(options.get("parts", 1))

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if not self.key or self.parts < 2:
            return [_Range()]
        with self._connect() as con:
            low, high = con.execute(f"select min({self.key}), max({self.key}) from ({self.query})").fetchone()
        if low is None:
            return [_Range()]
        step = -(-(high - low + 1) // self.parts)
        # The first range also has the rows without a key.
        return [_Range(None if i == 0 else low + i * step, low + (i + 1) * step) for i in range(self.parts)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._connect() as con:
            if partition.high is None:
                yield from con.execute(self.query)
            elif partition.low is None:
                yield from con.execute(f"select * from ({self.query}) where {self.key} < ? or {self.key} is null", (partition.high,))
            else:
                yield from con.execute(f"select * from ({self.query}) where {self.key} >= ? and {self.key} < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brindle_sqlite"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, query: str, columns: str, key: str | None = None, parts: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    more = {"key": key, "parts": str(parts)} if key else {}
    return spark.read.format("brindle_sqlite").options(path=path, query=query, columns=columns, **more).load()


def global_exports(spark: SparkSession, path: str, parts: int = 4) -> DataFrame:
    """``method_lower``: exports of the common modules whose descriptions mark them as global. What the index would be asked for each description is one join."""
    files = read(spark, path, "select id, path from files", "file_id long, path string", "id", parts)
    blobs = read(spark, path, "select file_id, content_blob from file_contents where oversize = 0", "file_id long, blob binary", "file_id", parts)
    functions = read(spark, path, "select file_id, name, args from functions", "file_id long, name string, args string", "file_id", parts)
    described = decoded(files.where(F.col("path").like("%/CommonModules/%.xml")).join(blobs, "file_id"), "blob")
    modules = described.where(F.col("text").contains("<Global>true</Global>")).select(X.module_of_xml(F.col("path")).alias("path")).where("path is not null")
    exported = functions.where(F.col("args").contains(") Экспорт")).select("file_id", F.lower("name").alias("method_lower"))
    return files.join(modules, "path", "left_semi").join(exported, "file_id").select("method_lower").distinct()


def decoded(df: DataFrame, blob: str, text: str = "text") -> DataFrame:
    """Adds the text of zstandard blobs; null where a blob is broken."""
    import zstandard

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = zstandard.ZstdDecompressor()

        def one(raw):
            try:
                return None if raw is None else d.decompressobj().decompress(bytes(raw)).decode("utf-8", "replace")
            except zstandard.ZstdError:
                return None

        for frame in frames:
            yield frame.assign(**{text: frame[blob].map(one)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {text} string")
