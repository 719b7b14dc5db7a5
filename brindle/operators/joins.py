"""Joins: known and unknown names, three-valued lookups, intervals, as-of with tolerance, piecewise offsets, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST = 200_000


def small(names: DataFrame | None, most: int = MOST) -> DataFrame | None:
    """A table of names, to be broadcast if it has ``most`` rows at most; a larger one is joined as Spark sees fit."""
    if names is None:
        return None
    return F.broadcast(names) if names.limit(most + 1).count() <= most else names


def known(facts: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    return facts.join(catalog.select(*on), on, "left_semi")


def unknown(facts: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    return facts.join(catalog.select(*on), on, "left_anti")


def tri_state(facts: DataFrame, catalog: DataFrame, on: list[str], answers: Column, name: str = "exists") -> DataFrame:
    """Adds true, false, or null where the source can't answer (``answers`` is false or null): null is not false."""
    found = catalog.select(*on).distinct().withColumn("_found", F.lit(True))
    told = F.when(F.coalesce(answers, F.lit(False)), F.coalesce("_found", F.lit(False)))
    return facts.join(found, on, "left").withColumn(name, told).drop("_found")


def within_interval(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points in [start, end) of intervals with the same key. The key keeps this a hash or sort-merge join."""
    p, i = points.alias("p"), intervals.alias("i")
    keys = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in on]
    inside = (F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"p.{at}") < F.col(f"i.{end}"))
    rest = [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    joined = p.join(i, [*keys, inside], how)
    return joined.select("p.*", *(rest if how in ("inner", "left") else []))


def as_of(facts: DataFrame, events: DataFrame, on: list[str], at: str, event_at: str, tolerance, take: list[str], key: list[str]) -> DataFrame:
    """The last event at or before each fact, no further back than ``tolerance``; facts without one have nulls. ``key`` identifies a fact.

    Facts meet the events of their key only, and the best is kept by a map-side aggregation.
    """
    e = events.select(*on, F.col(event_at).alias("_event_at"), *take)
    near = (F.col("_event_at") <= F.col(at)) & (F.col(at) - F.col("_event_at") <= tolerance)
    best = facts.select(*dict.fromkeys([*key, *on, at])).join(e, on).where(near).groupBy(*key).agg(F.max_by(F.struct("_event_at", *take), F.struct("_event_at", *take)).alias("best"))
    return facts.join(best, key, "left").select(*facts.columns, F.col("best._event_at").alias(f"matched_{event_at}"), *(F.col(f"best.{c}").alias(c) for c in take))


def piecewise(offsets: DataFrame, spans: DataFrame, on: list[str], offset: str, key: list[str]) -> DataFrame:
    """``mapped``: where an offset of a text lies in its module, by spans (text_offset, module_at, len); in a gap, the end of the span before."""
    s = spans.select(*on, "text_offset", "module_at", F.col("len").alias("_len"))
    narrow = offsets.select(*dict.fromkeys([*key, *on, offset]))
    hit = narrow.join(s, on).where(F.col("text_offset") <= F.col(offset)).groupBy(*key).agg(F.max_by(F.struct("text_offset", "module_at", "_len"), "text_offset").alias("s"))
    mapped = F.col("s.module_at") + F.least(F.col(offset) - F.col("s.text_offset"), F.col("s._len"))
    return offsets.join(hit, key, "left").select(*offsets.columns, mapped.alias("mapped"))


def first_with_prefix(needles: DataFrame, catalog: DataFrame, needle: str, key: str) -> DataFrame:
    """The least key that starts with each needle. Needles are a fixed list; keys are cut to each needle length, so keys meet by equality."""
    lengths = [r[0] for r in needles.select(F.length(needle)).distinct().collect()]
    heads = catalog.select(F.col(key).alias("_key"), F.explode(F.array(*(F.lit(n) for n in sorted(lengths)))).alias("_n")).where(F.length("_key") >= F.col("_n"))
    heads = heads.select("_key", F.substring("_key", F.lit(1), F.col("_n")).alias(needle))
    return needles.join(heads.groupBy(needle).agg(F.min("_key").alias("first_key")), needle, "left")
