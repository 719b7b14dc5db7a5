"""Validation of a whole corpus: findings, totals of a run, tallies by kind, and a baseline file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import facts
from brindle.operators import joins as J
from brindle.plans import module_rules, query_rules, query_text
from brindle.session import cut


def validate(modules: DataFrame, catalog: module_rules.Catalog, source: module_rules.Source | None = None, objects: DataFrame | None = None, object_fields: DataFrame | None = None, **options) -> DataFrame:
    """Findings of modules (module_id, source): those of the code and those of the query texts in it, with positions in the module."""
    found = cut(facts.extract(modules))
    code = module_rules.check(found, catalog, source, **options).select("module_id", "line", "col", "kind", "confidence", "name")
    texts = found.where("kind = 'query'").select(F.concat_ws("/", F.col("module_id").cast("string"), F.col("emit_ord").cast("string")).alias("text_id"), F.col("name").alias("text"), "module_id", "line", "col", "extra")
    bad = query_rules.check(query_text.parse(texts), objects, object_fields).join(texts.drop("text"), "text_id")
    pieces = texts.select("text_id", F.explode(F.split("extra", ",")).alias("piece")).withColumn("piece", F.split("piece", ":"))
    spans = pieces.select("text_id", F.col("piece")[0].cast("long").alias("text_offset"), F.col("piece")[1].cast("long").alias("module_at"), F.col("piece")[2].cast("long").alias("len"))
    placed = J.piecewise(bad.select("text_id", "module_id", "offset", "kind", "confidence", F.coalesce("detail", F.lit("")).alias("name")).distinct(), spans, ["text_id"], "offset", key=["text_id", "offset", "kind", "name"])
    text = modules.select("module_id", "source").hint("merge")  # texts are larger than Spark guesses from packed files
    lines = placed.join(text, "module_id").withColumn("before", F.decode(F.substring(F.encode("source", "UTF-8"), F.lit(1), F.col("mapped").cast("int")), "UTF-8"))
    line, col = F.size(F.split("before", "\n")), F.length(F.substring_index("before", "\n", -1)) + 1
    queries = lines.select("module_id", line.alias("line"), col.alias("col"), "kind", "confidence", "name")
    return code.unionByName(queries.where("confidence = 'high'") if options.get("profile") == "strict" else queries)


def totals(modules: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: modules scanned, with findings, findings in all."""
    per = findings.groupBy("module_id").agg(F.count("*").alias("n"))
    joined = modules.select("module_id").join(per, "module_id", "left")
    return joined.agg(F.count("*").alias("modules_total"), F.count("n").alias("modules_with_errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors_total"))


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("module_id").alias("modules"), F.min_by("name", F.struct("module_id", "line", "col")).alias("first")).orderBy(F.desc("n"), "kind")


def most_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    """The modules with most findings."""
    return findings.groupBy("module_id").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds")).orderBy(F.desc("n"), "module_id").limit(k)


def baseline(findings: DataFrame, path: str) -> None:
    """Counts by kind of each module as JSON lines, to compare runs."""
    counts = findings.groupBy("module_id", "kind").count().groupBy("module_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "count")))).alias("counts"))
    counts.write.mode("overwrite").json(path)


def append_run(findings: DataFrame, run_id: int, path: str) -> None:
    """Findings of a run, in batches as Spark's tasks write them; a run that is written again replaces itself."""
    findings.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def progress(modules: DataFrame, findings: DataFrame, run_id: int, status: str, path: str) -> None:
    """Appends the state of a run: totals so far, and whether it is running, done or failed."""
    totals(modules, findings).select(F.lit(run_id).alias("run_id"), "*", F.lit(status).alias("status"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(path)
