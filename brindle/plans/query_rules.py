"""Rules on query texts, as joins over parsed rows and a catalog of objects and their fields.

``objects(collection, name_lower, register_type)`` and ``object_fields(collection, name_lower, field_lower, kind, indexing)`` are what the source knows.
A source that can't answer is passed as None: rules that need it stay silent, which differs from an empty catalog.
Findings are ``text_id, offset, kind, confidence, detail``, offsets in bytes of the query text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import joins as J
from brindle.plans import query_text
from brindle.session import cut

# Fields that are indexed everywhere, and fields that only movements have.
INDEXED = "ссылка ref код code наименование description владелец owner родитель parent дата date номер number период period регистратор recorder номерстроки linenumber счетдт счеткт".split()
MOVEMENT = "регистратор recorder период period номерстроки linenumber активность active виддвижения recordtype".split()


def _template(name: Column) -> Column:
    return name.contains("%") | name.contains("#")


def _found(rows: DataFrame, offset: str, kind: str, confidence: str, detail: str, key: str) -> DataFrame:
    return rows.select(key, F.col(offset).alias("offset"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.col(detail).alias("detail"))


def temp_table_without_index(queries: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    made = queries.where("into is not null and size(indexed) = 0").where(~_template(F.col("into"))).withColumn("name_lower", F.lower("into"))
    joined = sources.where("join_kind is not null and table_kind = 'temp'").select(key, F.lower("name").alias("name_lower"))
    return _found(made.join(joined, [key, "name_lower"], "left_semi"), "into_offset", "temp_table_without_index", "high", "into", key)


def or_in_join_condition(sources: DataFrame, key: str) -> DataFrame:
    return _found(sources.where("join_kind is not null and on_top_or"), "join_offset", "or_in_join_condition", "high", "name", key)


def join_with_subquery(sources: DataFrame, key: str) -> DataFrame:
    return _found(sources.where("join_kind is not null and table_kind = 'subquery'"), "join_offset", "join_with_subquery", "low", "alias", key)


def _meta(sources: DataFrame) -> DataFrame:
    return sources.where("table_kind = 'meta'").withColumns({"collection": query_text.collection_of(F.col("meta_kind")), "name_lower": F.lower("name"), "sub_upper": F.upper("sub_table")})


def physical_register_table(sources: DataFrame, fields: DataFrame, objects: DataFrame, object_fields: DataFrame, key: str) -> DataFrame:
    """Balance registers that are read physically although nothing but dimensions and resources is needed."""
    meta = _meta(sources).where(query_text.is_register(F.col("meta_kind")) & F.col("sub_table").isNull() & ~_template(F.col("name")) & F.col("alias").isNotNull())
    balance = meta.join(objects.where("register_type = 'Balance'").select("collection", "name_lower"), ["collection", "name_lower"])
    used = fields.where("part in ('select', 'where', 'on')").select(
        key, "query", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("field_lower"),
        F.when(F.size(F.split("path", r"\.")) > 1, F.lower(F.element_at(F.split("path", r"\."), 1))).alias("qualifier"),
    )
    used = balance.select(key, "query", "source", "collection", "name_lower", F.lower("alias").alias("alias_lower")).join(used, [key, "query"])
    used = used.where("qualifier is null or qualifier = alias_lower")
    attributes = object_fields.where("kind = 'attribute'").select("collection", "name_lower", "field_lower", F.lit(True).alias("attribute"))
    needs = used.join(attributes, ["collection", "name_lower", "field_lower"], "left").where(F.col("field_lower").isin(MOVEMENT) | F.col("attribute")).select(key, "source")
    return _found(balance.join(needs, [key, "source"], "left_anti"), "offset", "physical_register_table", "low", "name", key)


def virtual_table_without_filter(sources: DataFrame, fields: DataFrame, objects: DataFrame | None, object_fields: DataFrame | None, key: str) -> DataFrame:
    """Virtual tables whose filter slot is empty, or has fields of which none is a dimension. A slot of parameters only may filter by anything."""
    slots = F.create_map(*(x for name, slot in query_text.VIRTUAL_SLOT.items() if slot for x in (F.lit(name), F.lit(slot))))
    meta = _meta(sources).where(query_text.is_register(F.col("meta_kind")) & F.col("sub_table").isNotNull()).withColumn("filter_slot", slots[F.col("sub_upper")]).where("filter_slot is not null")
    empty = F.coalesce(F.try_element_at("empty_slots", F.col("filter_slot") + 1), F.lit(True))
    found = _found(meta.where(empty), "offset", "virtual_table_without_filter", "low", "name", key)
    if objects is None or object_fields is None:
        return found
    used = fields.where("part = 'param'").select(key, "source", F.col("slot").alias("filter_slot"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("field_lower"))
    full = meta.where(~empty & ~_template(F.col("name"))).join(objects.select("collection", "name_lower").distinct(), ["collection", "name_lower"])
    with_fields = full.join(used, [key, "source", "filter_slot"], "left_semi")
    dimensions = object_fields.where("kind = 'dimension'").select("collection", "name_lower", "field_lower")
    by_dimension = full.select(key, "source", "filter_slot", "collection", "name_lower").join(used, [key, "source", "filter_slot"]).join(dimensions, ["collection", "name_lower", "field_lower"], "left_semi")
    return found.unionByName(_found(with_fields.join(by_dimension.select(key, "source"), [key, "source"], "left_anti"), "offset", "virtual_table_without_filter", "low", "name", key))


def join_on_unindexed_field(sources: DataFrame, fields: DataFrame, objects: DataFrame, object_fields: DataFrame, key: str) -> DataFrame:
    """Joined objects of whose own fields in the condition some are known and none is indexed."""
    meta = _meta(sources).where(F.col("has_on") & F.col("join_kind").isNotNull() & ~query_text.is_register(F.col("meta_kind")) & F.col("alias").isNotNull() & ~_template(F.col("name")))
    meta = meta.join(objects.select("collection", "name_lower").distinct(), ["collection", "name_lower"])
    path = F.split("path", r"\.")
    used = fields.where("part = 'on'").where(F.size(path) == 2).select(key, "source", F.lower(path[0]).alias("alias_lower"), F.lower(path[1]).alias("field_lower"), F.col("offset").alias("at"), F.col("path"))
    own = meta.withColumn("alias_lower", F.lower("alias")).select(key, "source", "alias_lower", "collection", "name_lower").join(used, [key, "source", "alias_lower"])
    kinds = object_fields.groupBy("collection", "name_lower", "field_lower").agg(F.bool_or(F.col("indexing").isNotNull()).alias("indexed"))
    own = own.join(kinds, ["collection", "name_lower", "field_lower"], "left")
    told = own.groupBy(key, "source").agg(
        F.bool_or(F.col("field_lower").isin(INDEXED) | F.coalesce("indexed", F.lit(False))).alias("any_indexed"),
        F.min(F.when(F.col("indexed").isNotNull() & ~F.col("field_lower").isin(INDEXED), F.struct("at", "path"))).alias("first"),
    )
    bad = told.where("not any_indexed and first is not null").select(key, F.col("first.at").alias("offset"), F.col("first.path").alias("path"))
    return _found(bad, "offset", "join_on_unindexed_field", "low", "path", key)


def check(parsed: DataFrame, objects: DataFrame | None = None, object_fields: DataFrame | None = None, key: str = "text_id") -> DataFrame:
    """All findings on parsed texts, which are kept first: no rule parses them again."""
    parsed, objects, object_fields = cut(parsed), J.small(objects), J.small(object_fields)
    queries, sources, fields = (query_text.relation(parsed, x, key) for x in ("queries", "sources", "fields"))
    found = temp_table_without_index(queries, sources, key).unionByName(or_in_join_condition(sources, key)).unionByName(join_with_subquery(sources, key))
    found = found.unionByName(virtual_table_without_filter(sources, fields, objects, object_fields, key))
    if objects is not None and object_fields is not None:
        found = found.unionByName(physical_register_table(sources, fields, objects, object_fields, key)).unionByName(join_on_unindexed_field(sources, fields, objects, object_fields, key))
    return found
