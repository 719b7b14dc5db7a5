"""Types of variables: annotations, constructors, enumeration values, and chains of members.

Within a procedure the last assignment counts and later ones may build on it, so a module is read in order; modules are independent of each other.
The catalog of a platform is a fixed table of a few thousand types: it is sent to the executors while each of its tables has at most ``MOST`` rows; a larger
one is first cut to the names that the modules mention, by a join, and if that is still too much, groups of modules meet their part of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.facts import without_deleted
from brindle.session import cut

MOST = 500_000
NEAR = 200  # bytes from an annotation to its assignment
ANY = ("Произвольный", "Неопределено")
_PROC = re.compile(r"(?imu)^[ \t]*(?:Процедура|Функция)\s+\w+.*?^[ \t]*Конец(?:Процедуры|Функции)\b", re.S)
_ASSIGN = re.compile(r"(?mu)^[ \t]*(?P<name>[^\W\d]\w*)[ \t]*=[ \t]*(?P<value>[^;\n]+)")
_NOTE = re.compile(r"(?mu)//[ \t]*@type:?[ \t]+(?P<type>[^\W\d][\w.]*)[^\n]*")
_NEW = re.compile(r"(?iu)^(?:Новый|New)\s+([^\W\d]\w*)")
_VALUE = re.compile(r"(?u)^([^\W\d]\w*)\.([^\W\d]\w*)$")
_LINK = re.compile(r"(?u)\s*([^\W\d]\w*)\s*(\((?:[^()]|\([^()]*\))*\))?\s*")


def chain(text: str) -> list[tuple[str, bool]] | None:
    """Names of ``a.b(…).c`` with whether each is a call; null for anything else."""
    out, at = [], 0
    while True:
        m = _LINK.match(text, at)
        if not m:
            return None
        out.append((m[1].lower(), m[2] is not None))
        at = m.end()
        if at == len(text):
            return out
        if text[at] != ".":
            return None
        at += 1


def primary(types: set[str], raw: str) -> str | None:
    """The first known type of a list."""
    for part in re.split(r"[,;|]", raw or ""):
        name = re.sub(r"^\W+|\W+$", "", part)
        if name and name.lower() not in [x.lower() for x in ANY] and name.lower() in types:
            return name.lower()
    return None


def scopes(source: str, types: set[str], enums: set[str], methods: dict[str, str], members: dict[tuple[str, str], str], level: int = 3) -> list[tuple[int, int, str, str]]:
    """(start, end, variable, type) in bytes; a module without procedures is one scope."""
    text = without_deleted(source)
    at = lambda i: len(source[:i].encode())
    parts = [m.span() for m in _PROC.finditer(text)] or [(0, len(text))]
    out = []
    for begin, end in parts:
        notes = [(at(begin + m.end()), m["type"].lower()) for m in _NOTE.finditer(text[begin:end])]
        known: dict[str, str] = {}
        for m in _ASSIGN.finditer(text[begin:end]):
            here, value = at(begin + m.start("name")), m["value"].strip()
            near = [(p, t) for p, t in notes if 0 <= here - p <= NEAR]
            found = max(near)[1] if near else None
            if not found and (n := _NEW.match(value)) and n[1].lower() in types:
                found = n[1].lower()
            if not found and (n := _VALUE.match(value)) and n[1].lower() in enums:
                found = n[1].lower()
            if not found and level >= 3 and (links := chain(value)) and (len(links) > 1 or links[0][1]):
                found = resolve(links, known, types, methods, members)
            if found:
                known[m["name"].lower()] = found
        out += [(at(begin), at(end), name, kind) for name, kind in known.items()]
    return out


def resolve(links: list[tuple[str, bool]], known: dict[str, str], types: set[str], methods: dict[str, str], members: dict[tuple[str, str], str]) -> str | None:
    name, call = links[0]
    now = known.get(name) or (primary(types, methods.get(name, "")) if call else name if name in types else None)
    for member, _ in links[1:]:
        if now is None:
            return None
        now = primary(types, members.get((now, member), ""))
    return now


COLUMNS = ["module_id", "start", "end", "name_lower", "type_lower"]


def _by_groups(modules: DataFrame, types: DataFrame, methods: DataFrame, members: DataFrame, level: int, groups: int = 256) -> DataFrame:
    """The same with a catalog that is too large to send: groups of modules meet the entries that their words ask for, however many others there are."""
    kind = modules.schema["module_id"].dataType.simpleString()
    rows = modules.select("module_id", "source", F.pmod(F.xxhash64("module_id"), F.lit(groups)).alias("grp"))
    words = cut(rows.select("grp", F.explode(F.array_distinct(F.split(F.lower("source"), r"(?U)\W+"))).alias("word")).distinct())
    none = F.lit(None).cast("string")
    every = types.select(F.lit("type").alias("what"), F.col("type_lower").alias("word"), none.alias("of"), F.col("is_enum").cast("string").alias("value"))
    every = every.unionByName(methods.select(F.lit("method").alias("what"), F.col("method_lower").alias("word"), none.alias("of"), F.col("return_type").alias("value")))
    asked = every.unionByName(members.select(F.lit("member").alias("what"), F.col("member_lower").alias("word"), F.col("type_lower").alias("of"), F.col("value_type").alias("value"))).join(words, "word")
    # Types that members give are asked for by name in no module: those count as known types too.
    given = asked.where("what <> 'type'").select("grp", F.lit("type").alias("what"), F.explode(F.split(F.lower(F.regexp_replace("value", "`", "")), r"[,;|]\s*")).alias("word"))
    more = given.join(types.select(F.col("type_lower").alias("word"), F.col("is_enum").cast("string").alias("value")), "word").withColumn("of", none)
    asked = asked.unionByName(more.select(asked.columns)).distinct()

    def run(key, texts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        by = {what: part for what, part in entries.groupby("what")}
        t, m, n = (by.get(w, entries.iloc[:0]) for w in ("type", "method", "member"))
        told = set(t["word"]), set(t["word"][t["value"] == "true"]), dict(zip(m["word"], m["value"], strict=True)), {(a, b): v for a, b, v in zip(n["of"], n["word"], n["value"], strict=True)}
        rows = [(k, *row) for k, text in zip(texts["module_id"], texts["source"], strict=True) for row in scopes(text or "", *told, level=level)]
        return pd.DataFrame(rows, columns=COLUMNS)

    return rows.groupBy("grp").cogroup(asked.groupBy("grp")).applyInPandas(run, f"module_id {kind}, start long, end long, name_lower string, type_lower string")


def infer(modules: DataFrame, types: DataFrame, methods: DataFrame, members: DataFrame, level: int = 3) -> DataFrame:
    """``module_id, start, end, name_lower, type_lower``. types(type_lower, is_enum), methods(method_lower, return_type), members(type_lower, member_lower, value_type)."""
    every, words = (types, methods, members), None
    if any(x.limit(MOST + 1).count() > MOST for x in (methods, members)):
        # Types aren't cut: members give types that no module mentions.
        words = cut(modules.select(F.explode(F.array_distinct(F.split(F.lower("source"), r"(?U)\W+"))).alias("word")).distinct())
        methods = methods.join(words.withColumnRenamed("word", "method_lower"), "method_lower", "left_semi")
        members = members.join(words.withColumnRenamed("word", "member_lower"), "member_lower", "left_semi")
    if any(x.limit(MOST + 1).count() > MOST for x in (types, methods, members)):
        return _by_groups(modules, *every, level)
    spark = modules.sparkSession
    listed = types.select("type_lower", "is_enum").collect()
    told = spark.sparkContext.broadcast((
        {r.type_lower for r in listed}, {r.type_lower for r in listed if r.is_enum}, {r.method_lower: r.return_type for r in methods.select("method_lower", "return_type").collect()},
        {(r.type_lower, r.member_lower): r.value_type for r in members.select("type_lower", "member_lower", "value_type").collect()},
    ))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k, text in zip(frame["module_id"], frame["source"], strict=True) for row in scopes(text or "", *told.value, level=level)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    kind = modules.schema["module_id"].dataType.simpleString()
    return modules.select("module_id", "source").mapInPandas(run, f"module_id {kind}, start long, end long, name_lower string, type_lower string")
