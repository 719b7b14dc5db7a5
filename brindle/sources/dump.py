"""Index of a configuration dump: modules, methods, objects, fields and global variables as tables."""

from __future__ import annotations

import time
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLPullParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import facts
from brindle.session import cut
from brindle.sources import payloads

# Folders of a dump that hold objects; file names of modules.
COLLECTIONS = (
    "CommonModules Documents Catalogs InformationRegisters AccumulationRegisters AccountingRegisters CalculationRegisters Reports DataProcessors ChartsOfAccounts "
    "ChartsOfCharacteristicTypes ChartsOfCalculationTypes BusinessProcesses Tasks ExchangePlans Constants DocumentJournals Enums CommonForms WebServices HTTPServices "
    "SettingsStorages FilterCriteria ScheduledJobs Sequences ExternalDataSources"
).split()
#: Collections whose descriptions are read: those with fields, and common modules for one mark.
DESCRIBED = (
    "CommonModules Catalogs Documents DocumentJournals ChartsOfCharacteristicTypes ChartsOfAccounts ChartsOfCalculationTypes InformationRegisters AccumulationRegisters "
    "AccountingRegisters CalculationRegisters BusinessProcesses Tasks ExchangePlans"
).split()
# Names of kinds in a foreign index; three of them are plural there as well.
META_TYPES = {
    "CommonModules": "CommonModule", "Catalogs": "Catalog", "Documents": "Document", "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister",
    "AccountingRegisters": "AccountingRegister", "CalculationRegisters": "CalculationRegister", "Enums": "Enum", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes",
    "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCalculationTypes": "ChartOfCalculationTypes", "BusinessProcesses": "BusinessProcess", "Tasks": "Task", "ExchangePlans": "ExchangePlan",
    "Constants": "Constant", "DataProcessors": "DataProcessor", "Reports": "Report", "DocumentJournals": "DocumentJournal", "FilterCriteria": "FilterCriterion", "Sequences": "Sequence",
}
MODULES = {"module.bsl": "Module", "managermodule.bsl": "ManagerModule", "objectmodule.bsl": "ObjectModule", "recordsetmodule.bsl": "RecordSetModule", "valuemanagermodule.bsl": "ValueManagerModule", "recalculationmodule.bsl": "RecalculationModule", "commandmodule.bsl": "CommandModule"}
EXTENSION = "перед после вместо изменениеиконтроль before after around changeandvalidate".split()


def classify(path: Column) -> dict[str, Column]:
    """scope, collection, object_name, module_type and owner_path of a path relative to the dump."""
    seg = F.split(path, "/")
    low = F.transform(seg, lambda x: F.lower(x))
    first = low[0]
    scope = F.when(first.isin("base", "extensions", "external"), first).otherwise(F.lit("other"))
    names = F.create_map(*(x for c in COLLECTIONS for x in (F.lit(c.lower()), F.lit(c))))
    at = F.array_min(F.filter(F.transform(low, lambda x, i: F.when(x.isin([c.lower() for c in COLLECTIONS]), i)), lambda x: x.isNotNull()))
    kinds = F.create_map(*(x for k, v in MODULES.items() for x in (F.lit(k), F.lit(v))))
    form = path.contains("/Forms/") | path.contains("/Form/")
    external = (F.size(seg) == 5) & (first == "external") & (low[2] == "form") & (low[4] == "form.obj.bsl")
    return {
        "scope": scope, "collection": names[F.get(low, at)], "object_name": F.get(seg, at + 1),
        "module_type": F.when(form, F.lit("Form")).otherwise(F.coalesce(kinds[F.element_at(low, -1)], F.lit("Other"))),
        "owner_path": F.when(external, F.concat_ws("/", seg[0], seg[1], F.lit("ExternalDataProcessor.obj.bsl"))),
    }


def object_fields(xml: str) -> tuple[str | None, list[tuple[str, str, str | None]]]:
    """(register type, [(name, kind, indexing)]) of an object description. Of a broken one, what comes before the break."""
    reader = XMLPullParser(("start", "end"))
    depth, tabular, field, register, out = 0, None, None, None, []
    try:
        for piece in (xml[i : i + 65536] for i in range(0, len(xml), 65536)):
            reader.feed(piece)
            for event, node in reader.read_events():
                tag = node.tag.rpartition("}")[2]
                if event == "start":
                    depth += 1
                    if tag == "TabularSection" and tabular is None:
                        tabular = depth
                    elif tag in ("Attribute", "Dimension", "Resource") and tabular is None:
                        field = [depth, tag.lower(), None, None]
                    continue
                text = (node.text or "").strip()
                if field and depth == field[0] + 2 and text:
                    if tag == "Name":
                        field[2] = text
                    elif tag == "Indexing" and text != "DontIndex":
                        field[3] = text
                elif tag == "RegisterType" and field is None and text:
                    register = text
                if field and depth == field[0]:
                    if field[2]:
                        out.append((field[2], field[1], field[3]))
                    field = None
                if tabular == depth:
                    tabular = None
                depth -= 1
    except ParseError:
        pass
    return register, out


def read_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path`` (relative to the dump) and ``source`` of the files whose names match; folders of version control are left out, and files without a byte, which Spark doesn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_extract("path", r"^(?:[a-z0-9]+:)?/*(.*)$", 1)
    base = F.lit(root.split(":", 1)[-1].strip("/") + "/")
    path = F.when(relative.startswith(base), F.substring(relative, F.length(base) + 1, F.lit(1 << 20))).otherwise(relative)
    text = F.decode(F.col("content"), "UTF-8")
    return files.select(path.alias("path"), F.when(text.startswith("﻿"), F.substring(text, 2, 1 << 30)).otherwise(text).alias("source")).where(~F.col("path").rlike(r"(^|/)\.(git|code-index)/"))


def build(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the index of a dump on disk. Of descriptions the paths are listed first; content is read of the folders that need it only."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(root).select("path")
    parent = F.element_at(F.split("path", "/"), -2)
    listed = every.where(parent.isin(COLLECTIONS) & ~parent.isin(DESCRIBED)).select("path", F.lit(None).cast("string").alias("source"))
    # A folder for each described collection of each part of the dump.
    folders = [r[0] for r in every.where(parent.isin(DESCRIBED)).select(F.regexp_replace("path", "/[^/]+$", "")).distinct().collect()]
    xml = listed
    if folders:
        read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(folders)
        xml = listed.unionByName(read.select("path", F.decode(F.col("content"), "UTF-8").alias("source")))
    return index(read_files(spark, root, "*.[bB][sS][lL]"), xml)


def index(code: DataFrame, xml: DataFrame) -> dict[str, DataFrame]:
    """The tables of the index from ``code(path, source)`` and ``xml(path, source)``; modules are parsed once."""
    module_id = F.xxhash64("path").alias("module_id")
    xml = xml.withColumns({"parts": F.split("path", "/")}).where("size(parts) >= 2")
    xml = xml.withColumns({"collection": F.element_at("parts", -2), "name": F.regexp_replace(F.element_at("parts", -1), r"(?i)\.xml$", "")}).where(F.col("collection").isin(COLLECTIONS))
    is_global = xml.where("collection = 'CommonModules'").where(F.col("source").contains("<Global>true</Global>")).select(F.col("collection"), F.col("name").alias("object_name"), F.lit(True).alias("is_global")).distinct()
    found = cut(facts.extract(code.select(module_id, "source")))
    extension = found.where("kind = 'directive'").where(F.lower("name").isin(EXTENSION)).select("module_id", F.lit(True).alias("is_extension")).distinct()
    modules = code.select(module_id, "path", *(c.alias(k) for k, c in classify(F.col("path")).items())).join(is_global, ["collection", "object_name"], "left").join(extension, "module_id", "left")
    modules = modules.withColumns({"is_global": F.coalesce("is_global", F.lit(False)), "is_extension": F.coalesce("is_extension", F.lit(False))})
    parts = F.split("extra", ",")
    methods = found.where("kind = 'proc'").select(
        "module_id", "name", F.lower("name").alias("name_lower"), parts[1].isin("функция", "function").alias("is_function"), F.col("flag").alias("is_export"),
        F.nullif(parts[0], F.lit("")).alias("directive"), F.col("line").alias("line_start"), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), ", ").alias("params"),
    )
    described = cut(_describe(xml.select("collection", "name", F.when(F.col("collection").isin(DESCRIBED), F.col("source")).alias("source"))))
    objects = described.select("collection", "name", F.lower("name").alias("name_lower"), "register_type")
    fields = described.select("collection", F.lower("name").alias("name_lower"), F.explode("fields").alias("f")).select("collection", "name_lower", F.col("f.name").alias("field"), F.lower("f.name").alias("field_lower"), F.col("f.kind").alias("kind"), F.col("f.indexing").alias("indexing"))
    application = F.lower(F.element_at(F.split("path", "/"), -1)).isin("managedapplicationmodule.bsl", "ordinaryapplicationmodule.bsl", "externalconnectionmodule.bsl")
    variables = found.where("kind = 'assign' and flag and extra = 'export'").join(code.where(application).select(module_id), "module_id", "left_semi").select(F.col("name"), F.lower("name").alias("name_lower")).distinct()
    return {"modules": modules, "methods": methods, "objects": objects, "object_fields": fields, "global_vars": variables}


def grep_variables(spark: SparkSession, root: str) -> DataFrame:
    """``name_lower``: variables that application modules of a dump export, found line by line without parsing them."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*ApplicationModule.bsl").text(root)
    return lines.where(F.col("value").rlike(r"(?iU)^\s*(?:Перем|Var)\s")).select(F.explode(payloads.global_variables(F.col("value"))).alias("name")).select(F.lower("name").alias("name_lower")).distinct()


def methods_of(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Methods of one module, by its path."""
    return tables["methods"].join(tables["modules"].where(F.col("path") == path).select("module_id"), "module_id", "left_semi")


def owner_exports(tables: dict[str, DataFrame]) -> DataFrame:
    """``module_id, method_lower``: exports of the module that owns each form module: by the owner's path of the index, else by one derived from the form's."""
    derived = F.regexp_replace("path", r"(?i)/Form/[^/]+/Form\.obj\.bsl$", "/ExternalDataProcessor.obj.bsl")
    forms = tables["modules"].select("module_id", F.coalesce("owner_path", F.when(derived != F.col("path"), derived)).alias("owner")).where("owner is not null")
    owners = tables["modules"].select(F.col("path").alias("owner"), F.col("module_id").alias("_owner"))
    exported = tables["methods"].where("is_export").select(F.col("module_id").alias("_owner"), F.col("name_lower").alias("method_lower"))
    return forms.join(owners, "owner").join(exported, "_owner").select("module_id", "method_lower").distinct()


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how much the index holds."""
    modules = tables["modules"].agg(F.count("*").alias("modules"), F.count_if("is_global").alias("global_modules"), F.count_if("is_extension").alias("extension_modules"))
    methods = tables["methods"].agg(F.count("*").alias("methods"), F.count_if("is_export").alias("exports"), F.countDistinct("name_lower").alias("names"))
    objects = tables["objects"].agg(F.count("*").alias("objects"), F.countDistinct("collection").alias("collections"))
    return modules.crossJoin(methods).crossJoin(objects)  # one row each


def _describe(xml: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [object_fields(x or "") for x in frame["source"]]
            yield pd.DataFrame({"collection": frame["collection"], "name": frame["name"], "register_type": [r for r, _ in got], "fields": [[{"name": n, "kind": k, "indexing": i} for n, k, i in f] for _, f in got]})

    return xml.mapInPandas(run, "collection string, name string, register_type string, fields array<struct<name: string, kind: string, indexing: string>>")


def publish(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """Writes a version of all tables with a row about the build, then flips the pointer that ``load`` follows: a build that fails changes nothing."""
    spark = next(iter(tables.values())).sparkSession
    target = f"{folder}/version={version}"
    for name, df in tables.items():
        keys = [c for c in ("name_lower",) if c in df.columns]
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("errorifexists").parquet(f"{target}/{name}")
    built = spark.range(1).select(F.lit(version).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("built_at"), F.unix_timestamp().alias("built_unix"))
    built.coalesce(1).write.mode("overwrite").parquet(f"{target}/meta")
    built.select("version", "built_at").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return target


SCHEMA_VERSION = 3


def load(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the version that was published last, or of a given one."""
    if version is None:
        version = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "built_at")).first()[0]
    return {name: spark.read.parquet(f"{folder}/version={version}/{name}") for name in ("modules", "methods", "objects", "object_fields", "global_vars", "meta")}


def health(spark: SparkSession, folder: str, started: float) -> dict:
    """State of the service: seconds since it started, and the build it answers from; without one it says so."""
    out = {"uptime_seconds": int(time.time() - started), "unix_seconds": int(time.time())}
    try:
        tables = load(spark, folder)
        meta = tables["meta"].first()
        return out | {"status": "ok", "version": meta.version, "schema_version": meta.schema_version, "index": stats(tables).first().asDict()}
    except AnalysisException as e:
        return out | {"status": "no index", "detail": str(e).splitlines()[0]}
