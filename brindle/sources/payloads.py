"""Answers of a remote index, as Column expressions over JSON texts.

An answer that was cut in any way is not trusted: its rows are null, which is "unknown", not "none".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_data(payload: Column) -> Column:
    """JSON of a payload that is either JSON or a stream of events: the first data line that isn't empty."""
    line = F.nullif(F.regexp_extract(payload, r"(?m)^data:[ \t]*(\S[^\n]*)$", 1), F.lit(""))
    return F.when(F.ltrim(payload).startswith("{"), payload).otherwise(line)


def body(payload: Column) -> Column:
    """The text content of an answer, without its ``result`` wrapper."""
    text = F.get_json_object(event_data(payload), "$.result.content[0].text")
    return F.coalesce(F.get_json_object(text, "$.result"), text)


def trusted(payload: Column) -> Column:
    text = F.get_json_object(event_data(payload), "$.result.content[0].text")
    inner = body(payload)
    cut = F.get_json_object(text, "$.response_truncated").isNotNull() | F.get_json_object(inner, "$.rows_truncated").isNotNull() | F.get_json_object(inner, "$.rows_elided_already_delivered").isNotNull()
    return F.coalesce(inner.isNotNull() & ~cut & (F.coalesce(F.get_json_object(inner, "$.truncated"), F.lit("false")) != "true"), F.lit(False))


def rows(payload: Column) -> Column:
    """array<array<string>>, null if the answer isn't trusted."""
    return F.when(trusted(payload), F.from_json(F.get_json_object(body(payload), "$.rows"), "array<array<string>>"))


def object_names(payload: Column) -> Column:
    """Names behind the first dot of the first column."""
    return F.transform(rows(payload), lambda r: F.regexp_replace(r[0], r"^[^.]*\.", ""))


FIELDS = "struct<attributes: array<struct<name: string, indexing: string>>, dimensions: array<struct<name: string, indexing: string>>, resources: array<struct<name: string, indexing: string>>, properties: struct<RegisterType: string>>"


def object_schema(json: Column) -> Column:
    return F.from_json(json, FIELDS)


def repository_answer(payload: Column, name: Column | str) -> Column:
    """``known``, ``unknown`` (with names to choose from in its message) or ``unrecognized``, which must not block."""
    inner = body(payload)
    return F.when(F.get_json_object(inner, "$.repo") == name, "known").when(F.get_json_object(inner, "$.message").contains("Неизвестный repo"), "unknown").otherwise("unrecognized")


def exported(summary: DataFrame, name: str = "name", args: str = "args") -> DataFrame:
    """Names of functions whose signature ends in the export mark; a parameter of that name doesn't count."""
    return summary.where(F.col(args).contains(") Экспорт")).select(F.lower(name).alias("name_lower")).distinct()


def global_variables(lines: Column) -> Column:
    """Names that a line of an application module exports."""
    return F.regexp_extract_all(F.regexp_extract(lines, r"(?iU)^\s*(?:Перем|Var)\s+(.*?)\s*(?:;|$)", 1), F.lit(r"(?iU)([^\W\d]\w*)\s+(?:Экспорт|Export)\b"), F.lit(1))


def paged(spark: SparkSession, pages: DataFrame, page_size: int = 400) -> DataFrame:
    """``names`` and whether the scan is complete: all pages trusted, all but the last full. ``pages(page, payload)``."""
    got = pages.select("page", object_names(F.col("payload")).alias("names"))
    summary = got.agg(F.bool_and(F.col("names").isNotNull()).alias("all_trusted"), F.count_if(F.size("names") < page_size).alias("short"), F.max_by(F.size("names"), "page").alias("last"))
    complete = summary.select((F.col("all_trusted") & (F.col("short") == 1) & (F.col("last") < page_size)).alias("complete"))
    return got.select(F.explode("names").alias("name")).distinct().crossJoin(F.broadcast(complete))
