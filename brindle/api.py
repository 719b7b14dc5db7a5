"""The tools of the catalog: search, cards, members, checks of single names and of whole modules, rebuild of the index; lists and cards are Markdown."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregates as A
from brindle.operators import lookup as L
from brindle.plans import module_rules
from brindle.sources import dump

TOOLS = "search info get_member get_members get_constructors get_enum_values validate_enum validate_method_call validate_module reserved_names rebuild_symbol_index".split()
# Names under which the text of a module may be given.
SOURCES = "source code module text module_text content".split()


def signature(name: str, parameters: list) -> str:
    """``Name(A, [B])``: optional parameters are in brackets."""
    return f"{name}({', '.join(p['name'] if p['required'] else '[' + p['name'] + ']' for p in parameters)})"


def card(row: Row) -> str:
    """What is known of an entry: names, kind, description, overloads with their parameters, types, whether it can be written."""
    r = row.asDict(recursive=True)
    name = r.get("name_ru") or r.get("method_name") or r.get("member_name") or r.get("type_name")
    out = [f"# {name}" + (f" ({r['name_en']})" if r.get("name_en") else "")]
    if r.get("kind"):
        out.append(f"*{r['kind']}*")
    if r.get("description"):
        out.append(r["description"])
    for s in r.get("signatures") or []:
        lines = [f"- `{p['name']}`" + ("" if p["required"] else " (optional)") for p in s["parameters"]]
        out.append("\n".join([f"`{signature(name, s['parameters'])}`", *lines]))
    for label, key in (("Returns", "return_type"), ("Type", "value_type")):
        if r.get(key):
            out.append(f"{label}: {r[key]}")
    if r.get("readonly"):
        out.append("Read only")
    return "\n\n".join(out)


class Tools:
    """Tools over ``entries(kind, kind_rank, name_ru, name_en, description)``, ``members`` and ``methods`` of a catalog; ``allowed`` limits them.

    Modules are validated against ``catalog`` and one of ``sources`` (by name of repository).  ``roots`` names the dump and the folder of the index of each repository.
    """

    def __init__(
        self, entries: DataFrame, members: DataFrame, methods: DataFrame, properties: DataFrame, allowed: list[str] | None = None, catalog: module_rules.Catalog | None = None,
        sources: dict[str, module_rules.Source] | None = None, roots: dict[str, tuple[str, str]] | None = None,
    ):
        odd = sorted(set(allowed or []) - set(TOOLS))
        if odd:
            raise ValueError(f"unknown tools: {', '.join(odd)}")
        self.entries, self.members, self.methods, self.properties = entries, members, methods, properties
        self.allowed = set(allowed or TOOLS)
        self.catalog, self.sources, self.roots = catalog, dict(sources or {}), dict(roots or {})
        self.building: set[str] = set()

    def __getattribute__(self, name):
        if name in TOOLS and name not in object.__getattribute__(self, "allowed"):
            raise PermissionError(f"{name} is not among the allowed tools")
        return object.__getattribute__(self, name)

    def search(self, query: str, limit: int | None = None) -> str:
        found = L.staged(self.entries, query, limit).collect()
        return "\n".join([f"# {query}", *(f"- **{r.name_ru}** ({r.kind})" for r in found)]) if found else f"Nothing found for {query!r}"

    def info(self, name: str, kind: str | None = None) -> str:
        """Card of a type, else a method, else a property; a type's members are listed, a method has its overloads."""
        key = name.strip().lower()
        hit = self.entries.where(F.lower("name_ru") == key)
        hit = (hit.where(F.col("kind") == kind) if kind else hit).orderBy("kind_rank").limit(1).collect()
        if not hit:
            return f"{name} is not known"
        out = [card(hit[0])]
        if hit[0].kind == "type":
            listed = self._of(name).where("kind in ('method', 'property')").orderBy("kind", "member_lower").select("member_name", "kind").distinct().orderBy("kind", "member_name").collect()
            out += ["\n".join(f"- {r.member_name} ({r.kind})" for r in listed)] if listed else []
        elif hit[0].kind == "method":
            out += [card(r).partition("\n\n")[2] for r in self.methods.where(F.col("method_lower") == key).limit(1).collect()]
        return "\n\n".join(x for x in out if x)

    def _of(self, type_name: str, kind: str | None = None) -> DataFrame:
        rows = self.members.where(F.col("type_lower") == type_name.strip().lower())
        return rows.where(F.col("kind") == kind) if kind else rows

    def get_members(self, type_name: str) -> str:
        rows = self._of(type_name).where("kind in ('method', 'property')").orderBy("kind", "member_lower").collect()
        return "\n".join([f"# {type_name}", *(f"- {r.member_name} ({r.kind})" for r in rows)]) if rows else f"{type_name} has no members"

    def get_member(self, type_name: str, member: str) -> str:
        """Card of a member, asked for by its Russian name."""
        rows = self._of(type_name).where(F.lower("member_name") == member.strip().lower()).orderBy("kind").limit(1).collect()
        return card(rows[0]).replace("# ", f"# {type_name}.", 1) if rows else f"{type_name} has no member {member}"

    def get_constructors(self, type_name: str) -> str:
        rows = self._of(type_name, "constructor").orderBy("member_lower").collect()
        return "\n".join([f"# {type_name}", *(f"- {r.member_name}" for r in rows)]) if rows else f"{type_name} has no constructors"

    def get_enum_values(self, type_name: str) -> str:
        rows = self._of(type_name, "enum_value").orderBy("member_lower").collect()
        return "\n".join([f"# {type_name}", *(f"- {r.member_name}" for r in rows)]) if rows else f"{type_name} is not an enumeration"

    def validate_enum(self, type_name: str, value: str) -> dict:
        values = self._of(type_name, "enum_value").withColumn("ord", F.col("member_lower"))
        if values.where(F.col("member_lower") == value.strip().lower()).limit(1).count():
            return {"valid": True, "similar": []}
        return {"valid": False, "similar": [r.name_key for r in L.similar(values, "member_name", F.lit(value), "ord").collect()]}

    def validate_method_call(self, name: str, n_args: int) -> dict:
        """Whether a global method takes so many arguments, and how many it takes; a method without signatures is valid, unchecked."""
        hit = self.methods.where(F.col("method_lower") == name.strip().lower())
        told = hit.select(
            "method_name", (F.size("signatures") == 0).alias("free"), A.accepts(F.col("signatures"), F.lit(n_args), F.col("method_name")).alias("fits"), A.expected(F.col("signatures"), F.col("method_name")).alias("expected"), "signatures"
        )
        rows = told.limit(1).collect()
        if not rows:
            return {"known": False, "valid": False, "expected": None, "signatures": []}
        r = rows[0]
        shown = [signature(r.method_name, [p.asDict() for p in s.parameters]) for s in r.signatures]
        return {"known": True, "valid": bool(r.free or r.fits), "expected": r.expected or None, "signatures": shown}

    def validate_module(self, level: int = 1, profile: str = "full", module_path: str | None = None, form_attributes: list[str] | None = None, repo: str | None = None, **text: str) -> dict:
        """Findings of one module; its text comes under any of the names in ``SOURCES``. ``profile="strict"``: high confidence only."""
        odd = sorted(set(text) - set(SOURCES))
        if odd or len(text) != 1:
            raise ValueError(f"unknown settings: {', '.join(odd)}" if odd else f"the text of a module is expected once, as one of {', '.join(SOURCES)}")
        if profile not in ("full", "strict"):
            raise ValueError(f"unknown profile: {profile}")
        if self.catalog is None:
            raise ValueError("no catalog to validate with")
        if repo is not None and repo not in self.sources:
            raise ValueError(f"unknown repository {repo}: there are {', '.join(sorted(self.sources)) or 'none'}")
        source = self.sources[repo] if repo is not None else next(iter(self.sources.values())) if len(self.sources) == 1 else None
        spark = self.entries.sparkSession
        module = spark.createDataFrame([(0, next(iter(text.values())), module_path)], "module_id long, source string, path string")
        names = None if form_attributes is None else spark.createDataFrame([(0, [x.lower() for x in form_attributes])], "module_id long, names array<string>")
        rows = module_rules.validate(module, self.catalog, source, level, profile, names).collect()
        found = [{k: r[k] for k in ("line", "col", "kind", "confidence", "name", "suggestion")} for r in rows]
        return {"valid": not found, "errors": found, "count": len(found), "level": 1 if profile == "strict" else max(1, min(3, level)), "profile": profile}

    def reserved_names(self) -> dict:
        """Names of the context by scope and by whether they can be written, in byte order, with their numbers."""
        rows = self.properties.groupBy("scope", "readonly").agg(F.sort_array(F.collect_list("property_lower")).alias("names"), F.count("*").alias("n")).collect()
        return {f"{r.scope}_{'readonly' if r.readonly else 'writable'}": {"names": r.names, "count": r.n} for r in rows}

    def rebuild_symbol_index(self, repo: str, build: Callable[[SparkSession, str], dict[str, DataFrame]] = dump.build) -> dict:
        """Builds the index of a repository anew and answers from it; until it is published, and if that fails, from the one before. One build at a time for each."""
        if repo not in self.roots:
            raise ValueError(f"unknown repository {repo}: there are {', '.join(sorted(self.roots)) or 'none'}")
        if repo in self.building:
            return {"repo": repo, "status": "already building"}
        root, folder = self.roots[repo]
        spark, began = self.entries.sparkSession, time.time()
        self.building.add(repo)
        try:
            version = str(time.time_ns())
            dump.publish(build(spark, root), folder, version)
            tables = dump.load(spark, folder, version)
            self.sources[repo] = module_rules.preloaded(tables, dump.owner_exports(tables))
            return {"repo": repo, "status": "ok", "version": version, "seconds": round(time.time() - began, 1), "index": dump.stats(tables).first().asDict()}
        finally:
            self.building.discard(repo)

    def as_json(self, tool: str, **options) -> str:
        """The result of a tool that gives a dict, as JSON."""
        return json.dumps(getattr(self, tool)(**options), ensure_ascii=False, sort_keys=True)
