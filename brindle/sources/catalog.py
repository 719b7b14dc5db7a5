"""Catalog tables from the contents and pages of a help container.

A top page is the global context, a catalog of enumerations, or a catalog of types.  Below a catalog the first page that is no catalog page is a type
(or enumeration); pages further down are its members, by their paths.  A type replaces an enumeration of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import tree
from brindle.session import cut
from brindle.sources import help_container, help_pages

# Page of the global context, titles of enumeration catalogs, paths of catalog pages.
GLOBAL, ENUMERATIONS, CATALOG_PAGE = "Global context.html", ("Системные наборы значений", "Системные перечисления"), r"/catalog\d+\.html"


def root_kind(html_path, ru, en):
    return F.when(html_path.contains(GLOBAL), "global").when(ru.isin(*ENUMERATIONS) | en.isin(*ENUMERATIONS), "enum").otherwise("type")


def owners(toc: DataFrame) -> DataFrame:
    """``id, html_path, root, owner``: kind of the top page, and the type page that a page belongs to (null at and above it)."""
    real = tree.rooted(toc).where("html_path <> ''")
    placed = tree.trail(real, "id", "parent_id")
    pages = real.select(F.col("id").alias("_id"), "html_path", root_kind(F.col("html_path"), F.col("ru"), F.col("en")).alias("_kind"), F.col("html_path").rlike(CATALOG_PAGE).alias("_catalog"))
    steps = placed.select("node", F.posexplode("trail").alias("depth", "_id")).join(pages.drop("html_path"), "_id")
    told = steps.groupBy("node").agg(
        F.min_by("_kind", "depth").alias("root"), F.min(F.when((F.col("depth") > 0) & ~F.col("_catalog"), F.struct("depth", "_id"))).alias("first"), F.max("depth").alias("depth"),
    )
    joined = told.join(pages.select(F.col("_id").alias("node"), "html_path"), "node")
    return joined.select(F.col("node").alias("id"), "html_path", "root", F.when(F.col("root") == "global", F.lit(None)).otherwise(F.col("first._id")).alias("owner"))


def load(toc: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """``types``, ``members``, ``methods`` and ``properties`` from contents (``help_container.TOC``) and ``pages(html_path, html)``; entries without a page are skipped."""
    path = lambda c: F.regexp_replace(c, "^/+", "")
    parsed = help_pages.parse(pages.select(path("html_path").alias("html_path"), "html"))
    placed = owners(toc).withColumn("html_path", path("html_path")).join(parsed, "html_path").withColumn("role", help_pages.role())
    named = placed.where(~F.col("name_ru").startswith("<") & (F.col("name_ru") != ""))
    first = Window.partitionBy("type_lower").orderBy(F.desc("root"), F.desc("id"))  # 'type' before 'enum', the last written of equals
    types = named.where("id = owner").withColumn("type_lower", F.lower("name_ru")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    types = types.select("id", "type_lower", F.col("name_ru").alias("type_name"), "name_en", "description", (F.col("root") == "enum").alias("is_enum"))
    kind = F.when(F.col("root") == "enum", "enum_value").when(F.col("role") == "object", "enum_value").otherwise(F.col("role"))
    under = named.where("id <> owner").select("owner", kind.alias("kind"), F.lower("name_ru").alias("ru"), F.lower("name_en").alias("en"), F.col("name_ru").alias("member_name"), "name_en", "description", "signatures", "return_type", "value_type", "readonly")
    under = under.join(types.select(F.col("id").alias("owner"), "type_lower"), "owner")
    value = F.when(F.col("kind") == "method", F.col("return_type")).otherwise(F.col("value_type"))
    members = under.select("type_lower", F.explode(F.filter(F.array("ru", "en"), lambda x: x != "")).alias("member_lower"), "member_name", "name_en", "kind", "description", "signatures", value.alias("value_type"), "readonly").dropDuplicates(["type_lower", "member_lower", "kind"])
    tables = help_pages.catalog_tables(named.where("root = 'global'").select(parsed.columns))
    return {"types": types.drop("id"), "members": members, "methods": tables["methods"], "properties": tables["properties"].withColumn("scope", F.lit("global"))}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalog of a help container: its contents and, of its archive, the pages that they name."""
    files = cut(help_container.containers(spark, path))
    toc = cut(help_container.contents_of(files))
    return load(toc.drop("path"), help_container.pages_of(files, toc).drop("path"))
