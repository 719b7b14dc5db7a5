"""Rules on the facts of modules, as joins with a catalog.

``Catalog`` holds what is known of the platform; ``Source`` what is known of a configuration, with a flag for each question it can answer: where it can't,
the answer is null and the rule is silent.  ``prepared`` adds to each fact what is known of its module (is it a form, a common module, an extension, which
attributes does its form have) and keeps the result, so modules are parsed once however many rules there are.  Findings are ``module_id, line, col,
kind, confidence, name, suggestion, emit_ord``.  Catalogs are tables of names: those that are small are broadcast, so facts stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import aggregates as A
from brindle.operators import inference
from brindle.operators import joins as J
from brindle.operators import lookup as L
from brindle.operators.facts import extract
from brindle.session import cut

# Directives, managers of collections, types whose members the catalog can't know.
DIRECTIVES = (
    "НаКлиенте НаСервере НаСервереБезКонтекста НаКлиентеНаСервере НаКлиентеНаСервереБезКонтекста AtClient AtServer AtServerNoContext AtClientAtServer "
    "AtClientAtServerNoContext Перед После Вместо ИзменениеИКонтроль Before After Around ChangeAndValidate"
).split()
MANAGERS = {
    "Справочники": ("Catalogs", "СправочникМенеджер"), "Документы": ("Documents", "ДокументМенеджер"), "РегистрыСведений": ("InformationRegisters", "РегистрСведенийМенеджер"),
    "РегистрыНакопления": ("AccumulationRegisters", "РегистрНакопленияМенеджер"), "РегистрыБухгалтерии": ("AccountingRegisters", "РегистрБухгалтерииМенеджер"),
    "РегистрыРасчета": ("CalculationRegisters", "РегистрРасчетаМенеджер"), "Перечисления": ("Enums", "ПеречислениеМенеджер"),
    "ПланыВидовХарактеристик": ("ChartsOfCharacteristicTypes", "ПланВидовХарактеристикМенеджер"), "ПланыСчетов": ("ChartsOfAccounts", "ПланСчетовМенеджер"),
    "ПланыВидовРасчета": ("ChartsOfCalculationTypes", "ПланВидовРасчетаМенеджер"), "БизнесПроцессы": ("BusinessProcesses", "БизнесПроцессМенеджер"), "Задачи": ("Tasks", "ЗадачаМенеджер"),
    "ПланыОбмена": ("ExchangePlans", "ПланОбменаМенеджер"), "Константы": ("Constants", "КонстантаМенеджер"), "Обработки": ("DataProcessors", "ОбработкаМенеджер"), "Отчеты": ("Reports", "ОтчетМенеджер"),
    "ЖурналыДокументов": ("DocumentJournals", "ЖурналДокументовМенеджер"), "КритерииОтбора": ("FilterCriteria", "КритерийОтбораМенеджер"), "Последовательности": ("Sequences", "ПоследовательностьМенеджер"),
}
EXTENSION = "перед после вместо изменениеиконтроль before after around changeandvalidate".split()
NO_CONTEXT = "насерверебезконтекста наклиентенасерверебезконтекста atservernocontext atclientatservernocontext".split()
#: Names of a module's own object, which are no common modules.
CONTEXT_HEADS = "объект этотобъект этаформа форма".split()
DYNAMIC = "выборкаизрезультатазапроса выборкаданных строкатаблицызначений строкадеревазначений структура фиксированнаяструктура форма управляемаяформа элементыформы объектxdto значениеxdto".split()


@dataclass
class Catalog:
    types: DataFrame  # type_lower, type_name, is_enum
    members: DataFrame  # type_lower, member_lower, member_name, kind: method, property, enum_value, constructor; value_type
    methods: DataFrame  # method_lower, method_name, return_type, signatures array<struct<parameters array<struct<name, required>>>>
    properties: DataFrame  # property_lower, readonly, type_name, scope: global, form


@dataclass
class Source:
    objects: DataFrame | None  # collection, name_lower (and name, for suggestions); None: can't tell
    unknown: DataFrame | None = None  # collection: those it can't tell of; in any other, an object that isn't listed doesn't exist
    exports: DataFrame | None = None  # method_lower of global exports
    variables: DataFrame | None = None  # name_lower of exported global variables; None: can't tell
    owner_exports: DataFrame | None = None  # module_id, method_lower: what the owner of a form module exports; None: nothing
    methods: DataFrame | None = None  # method_lower of all methods anywhere in the configuration
    healthy: bool = True  # a source that fails refuses the whole validation
    suggests: bool = True  # whether it can list the names of a collection


def preloaded(tables: dict[str, DataFrame], owner_exports: DataFrame | None = None) -> Source:
    """A source over the tables of an index (``dump.build``): it has a table of objects, so a collection that isn't there has no objects: the answer is no, not unknown."""
    methods = tables["methods"].select(F.col("name_lower").alias("method_lower"))
    exported = tables["methods"].where("is_export").join(tables["modules"].where("is_global").select("module_id"), "module_id", "left_semi").select(F.col("name_lower").alias("method_lower"))
    return Source(tables["objects"], None, exported.distinct(), tables["global_vars"].select("name_lower"), owner_exports, methods.distinct())


def prepared(facts: DataFrame, modules: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """Facts with ``path``, ``is_form``, ``is_common``, ``is_extension``, ``has_directives`` and ``attributes`` of their module.

    ``modules(module_id, path)``: a module without a path is a fragment.  ``attributes(module_id, names)``: lower-case attributes of forms, where they are known.
    """
    directive = F.col("kind") == "directive"
    about = facts.groupBy("module_id").agg(F.bool_or(directive).alias("has_directives"), F.bool_or(directive & F.lower("name").isin(EXTENSION)).alias("is_extension"))
    if modules is not None:
        about = about.join(modules.groupBy("module_id").agg(F.min("path").alias("path")), "module_id", "left")
    else:
        about = about.withColumn("path", F.lit(None).cast("string"))
    if attributes is not None:
        about = about.join(attributes.select("module_id", F.col("names").alias("attributes")), "module_id", "left")
    else:
        about = about.withColumn("attributes", F.lit(None).cast("array<string>"))
    about = about.withColumns({"is_form": X.form_module(F.col("path")), "is_common": X.common_module(F.col("path"))})
    return cut(facts.join(about, "module_id"))


def _found(rows: DataFrame, kind: str, confidence: str | Column, name: str = "name", suggestion: str | None = None) -> DataFrame:
    told = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select("module_id", "line", "col", F.lit(kind).alias("kind"), told.alias("confidence"), F.col(name).alias("name"), (F.col(suggestion) if suggestion else F.lit(None).cast("string")).alias("suggestion"), "emit_ord")


def _at_member(rows: DataFrame) -> DataFrame:
    """Member accesses at the position of the member."""
    place = F.split("extra", ":")
    return rows.withColumns({"line": place[0].cast("int"), "col": place[1].cast("int")})


def unknown_directive(facts: DataFrame) -> DataFrame:
    known = facts.sparkSession.createDataFrame([(i, d) for i, d in enumerate(DIRECTIVES)], "ord int, directive string")
    odd = facts.where("kind = 'directive'").where(~F.lower("name").isin([d.lower() for d in DIRECTIVES]))
    near = L.nearest(odd.select("name").distinct(), known, "name", "directive", "ord", within=3)
    told = odd.join(near, "name").withColumn("told", X.confidence(F.col("name"), F.col("nearest"))).where("told is not null")
    return _found(told, "unknown_directive", F.col("told"), suggestion="nearest")


def unknown_new_type(facts: DataFrame, c: Catalog) -> DataFrame:
    news = facts.where("kind = 'new'").withColumn("type_lower", F.lower("name"))
    return _found(J.unknown(news, c.types, ["type_lower"]), "unknown_new_type", "low")


def _dots(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'dot'").withColumns({"type_lower": F.lower("name"), "member_lower": F.lower("member")})


def typed_dots(facts: DataFrame, c: Catalog, typed: DataFrame | None = None) -> DataFrame:
    """Member accesses whose head is a type, or a variable that ``typed(module_id, start, end, name_lower, type_lower)`` gives one where it stands."""
    dots = _dots(facts)
    known = J.known(dots, c.types, ["type_lower"])
    if typed is None:
        return known
    rest = J.unknown(dots, c.types, ["type_lower"]).drop("type_lower").withColumn("name_lower", F.lower("name"))
    via = J.within_interval(rest, typed, ["module_id", "name_lower"], "byte", "start", "end")
    return known.unionByName(J.known(via.select(known.columns), c.types, ["type_lower"]))


def unknown_enum_value(dots: DataFrame, c: Catalog) -> DataFrame:
    on_enums = J.known(dots, c.types.where("is_enum"), ["type_lower"])
    bad = J.unknown(on_enums, c.members.where("kind = 'enum_value'"), ["type_lower", "member_lower"])
    return _found(_at_member(_suggested(bad, c.members.where("kind = 'enum_value'"))), "unknown_enum_value", "high", "member", "nearest")


def _suggested(bad: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``nearest``: the member of the type that is most like the one asked for, if it is more than half alike."""
    near = bad.select("type_lower", "member").distinct().join(members.select("type_lower", "member_name").distinct(), "type_lower")
    near = near.withColumn("score", X.similarity(F.lower("member"), F.lower("member_name"))).where("score > 0.5").groupBy("type_lower", "member").agg(F.min_by("member_name", F.struct(-F.col("score"), "member_name")).alias("nearest"))
    return bad.join(near, ["type_lower", "member"], "left")


def unknown_type_member(dots: DataFrame, c: Catalog) -> DataFrame:
    on_types = J.known(dots.where(~F.col("type_lower").isin(DYNAMIC)), c.types.where("not is_enum"), ["type_lower"])
    bad = J.unknown(on_types, c.members.where("kind in ('method', 'property')"), ["type_lower", "member_lower"])
    return _found(_at_member(_suggested(bad, c.members.where("kind in ('method', 'property')"))), "unknown_type_member", "low", "member", "nearest")


def _foreign_calls(facts: DataFrame) -> DataFrame:
    """Calls of what the module doesn't declare itself."""
    own = facts.where("kind = 'proc'").select("module_id", F.lower("name").alias("method_lower"))
    return facts.where("kind = 'call'").withColumn("method_lower", F.lower("name")).join(own, ["module_id", "method_lower"], "left_anti")


def wrong_argument_count(facts: DataFrame, c: Catalog) -> DataFrame:
    known = _foreign_calls(facts).join(c.methods.where(F.size("signatures") > 0), "method_lower")
    return _found(known.where(~A.accepts(F.col("signatures"), F.col("n_args"), F.col("name"))), "wrong_argument_count", "high")


def unknown_calls(facts: DataFrame, c: Catalog, source: Source | None, strict: bool = True) -> DataFrame:
    """Calls of what neither the platform, nor any of its types, nor the module declares: a likely typo of a platform method, else undeclared (not in extensions)."""
    left = J.unknown(J.unknown(_foreign_calls(facts), c.methods, ["method_lower"]), c.members.where("kind = 'method'").select(F.col("member_lower").alias("method_lower")), ["method_lower"])
    near = L.nearest(left.select("name").distinct(), c.methods.select("method_lower", "method_name"), "name", "method_name", "method_lower", within=3)
    told = left.join(near, "name", "left").withColumn("told", X.confidence(F.col("name"), F.col("nearest")))
    out = _found(told.where("told is not null"), "unknown_global_method", F.col("told"), suggestion="nearest")
    if not strict:
        return out
    rest = told.where("told is null and not is_extension")
    if source is not None and source.exports is not None:
        rest = J.unknown(rest, source.exports, ["method_lower"])
    if source is not None and source.owner_exports is not None:
        rest = rest.join(source.owner_exports, ["module_id", "method_lower"], "left_anti")
    rest = rest.withColumn("elsewhere", F.lit(False)) if source is None or source.methods is None else J.tri_state(rest, source.methods, ["method_lower"], F.lit(True), "elsewhere")
    return out.unionByName(_found(rest, "undeclared_method", F.when(F.col("elsewhere"), "low").otherwise("high")))


def _parameters(facts: DataFrame, name: str) -> DataFrame:
    """Parameters of all procedures, with the number of the procedure's row."""
    parts = F.split("extra", ",")
    return facts.where("kind = 'proc'").select("module_id", F.col("emit_ord").alias("scope"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).alias(name))


def bound(facts: DataFrame) -> DataFrame:
    """Names that a module binds anywhere: assignments, declarations, loop variables and parameters."""
    names = facts.where("kind in ('assign', 'loop')").select("module_id", F.lower("name").alias("name_lower"))
    return names.unionByName(_parameters(facts, "name_lower").drop("scope")).distinct()


def shadowed_context_name(facts: DataFrame, c: Catalog) -> DataFrame:
    """Assignments and declarations that take a read-only name of the context.

    Properties of forms count in managed forms only, outside procedures without context; those of the global context everywhere but in forms whose attributes
    aren't known, unless the procedure is without context.  Parameters of the procedure and variables declared in it or for the module may be assigned to.
    """
    procs = facts.where("kind = 'proc'").select("module_id", F.col("emit_ord").alias("scope"), F.lower(F.element_at(F.split("extra", ","), 1)).isin(NO_CONTEXT).alias("no_context"))
    written = facts.where("kind = 'assign'").withColumn("property_lower", F.lower("name"))
    declared = written.where("flag").select("module_id", "property_lower", "scope")
    local = declared.where("scope is not null").unionByName(_parameters(facts, "property_lower"))
    set_to = written.where("not flag").join(declared.where("scope is null").select("module_id", "property_lower"), ["module_id", "property_lower"], "left_anti").join(local, ["module_id", "property_lower", "scope"], "left_anti")
    rows = set_to.select(written.columns).unionByName(written.where("flag")).where(~F.coalesce(F.array_contains("attributes", F.col("property_lower")), F.lit(False)))
    rows = rows.join(procs, ["module_id", "scope"], "left").withColumn("no_context", F.coalesce("no_context", F.lit(False)))
    rows = J.tri_state(rows, c.properties.where("readonly and scope = 'form'").select("property_lower"), ["property_lower"], F.lit(True), "of_form")
    rows = J.tri_state(rows, c.properties.where("readonly and scope = 'global'").select("property_lower"), ["property_lower"], F.lit(True), "of_all")
    hit = rows.where("of_form and is_form and has_directives and not no_context or of_all and (not is_form or attributes is not null or no_context)")
    return _found(hit, "shadowed_context_name", "high")


def _managers(spark) -> DataFrame:
    return spark.createDataFrame([(k.lower(), c, p.lower()) for k, (c, p) in MANAGERS.items()], "type_lower string, collection string, prefix string")


def object_exists(rows: DataFrame, source: Source) -> DataFrame:
    """Adds ``exists`` for ``collection, name_lower``: null only where the source can't tell of the collection."""
    if source.objects is None:
        return rows.withColumn("exists", F.lit(None).cast("boolean"))
    rows = J.tri_state(rows, source.unknown, ["collection"], F.lit(True), "unasked") if source.unknown is not None else rows.withColumn("unasked", F.lit(False))
    return J.tri_state(rows, source.objects, ["collection", "name_lower"], ~F.col("unasked")).drop("unasked")


def _visible(rows: DataFrame, facts: DataFrame, head: str) -> DataFrame:
    """Rows of modules whose form attributes are known if they are forms, where neither the module nor its form binds the head."""
    rows = rows.where("not is_form or attributes is not null").where(~F.coalesce(F.array_contains("attributes", F.col(head)), F.lit(False)))
    return rows.join(bound(facts).withColumnRenamed("name_lower", head), ["module_id", head], "left_anti")


def _alike(rows: DataFrame, source: Source, name: str) -> DataFrame:
    """Adds ``nearest``: the object of the collection that a name is a likely typo of; null if the source can't list names."""
    if not source.suggests or source.objects is None:
        return rows.withColumn("nearest", F.lit(None).cast("string"))
    names = source.objects.select("collection", F.col("name" if "name" in source.objects.columns else "name_lower").alias("candidate")).distinct()
    near = L.nearest(rows.select("collection", name).distinct(), names, name, "candidate", "candidate", within=3, by=["collection"])
    near = near.where(X.confidence(F.col(name), F.col("nearest")).isNotNull()).select("collection", name, "nearest")
    return rows.join(near, ["collection", name], "left")


def unknown_metadata_object(facts: DataFrame, c: Catalog, source: Source) -> DataFrame:
    """Members of collection managers that are neither theirs nor objects of the configuration."""
    dots = _visible(_dots(facts), facts, "type_lower").join(_managers(facts.sparkSession), "type_lower")
    typed = c.properties.where("scope = 'global'").select(F.col("property_lower").alias("type_lower"), F.lower(F.expr("trim(both '`' from type_name)")).alias("manager_type"))
    own = typed.join(c.members.select(F.col("type_lower").alias("manager_type"), "member_lower"), "manager_type").select("type_lower", "member_lower")
    told = object_exists(J.unknown(dots, own, ["type_lower", "member_lower"]).withColumn("name_lower", F.col("member_lower")), source)
    return _found(_at_member(_alike(told.where(F.col("exists") == F.lit(False)), source, "member")), "unknown_metadata_object", "high", "member", "nearest")


def unknown_common_module(facts: DataFrame, c: Catalog, source: Source) -> DataFrame:
    """Calls through a name that nothing binds, that the platform doesn't know, and that is no common module; only where no object is around that could have such an attribute."""
    if source.variables is None:
        return _found(facts.limit(0), "unknown_common_module", "high")
    dots = _dots(facts).withColumn("name_lower", F.col("type_lower")).where("flag and (path is null or is_common or is_form)")
    free = _visible(dots, facts, "name_lower").where(~F.col("name_lower").isin(CONTEXT_HEADS))
    forms = c.properties.where("scope = 'form'").select(F.col("property_lower").alias("name_lower"))
    for known in (c.types.select(F.col("type_lower").alias("name_lower")), c.properties.where("scope = 'global'").select(F.col("property_lower").alias("name_lower")), source.variables.select("name_lower")):
        free = J.unknown(free, known, ["name_lower"])
    free = J.tri_state(free, forms, ["name_lower"], F.lit(True), "of_form").where("not (of_form and is_form and has_directives)")
    free = free.where(~F.col("name_lower").isin([k.lower() for k in MANAGERS])).withColumn("collection", F.lit("CommonModules"))
    told = object_exists(free, source)
    return _found(_alike(told.where(F.col("exists") == F.lit(False)), source, "name"), "unknown_common_module", "high", "name", "nearest")


def unknown_manager_method(facts: DataFrame, c: Catalog, source: Source) -> DataFrame:
    """Methods of managers of existing objects that look like a typo of a platform method of that manager, and that no module declares."""
    calls = facts.where("kind = 'manager_call'").withColumns({"type_lower": F.lower("name"), "member_lower": F.lower("member"), "name_lower": F.lower("owner")})
    calls = _visible(calls, facts, "type_lower").join(_managers(facts.sparkSession), "type_lower")
    there = object_exists(calls, source).where("exists")
    if source.methods is not None:
        there = J.unknown(there, source.methods.select(F.col("method_lower").alias("member_lower")), ["member_lower"])
    needles = _managers(facts.sparkSession).select("prefix", F.concat("prefix", F.lit(".")).alias("needle"))
    first = J.first_with_prefix(needles.select("needle"), c.types.select("type_lower"), "needle", "type_lower").join(needles, "needle").where("first_key is not null").select("prefix", F.col("first_key").alias("manager_type"))
    typed = there.join(first, "prefix")
    members = c.members.select(F.col("type_lower").alias("manager_type"), "member_lower", "member_name", "kind")
    odd = typed.join(members.select("manager_type", "member_lower"), ["manager_type", "member_lower"], "left_anti")
    near = L.nearest(odd.select("manager_type", "member").distinct(), members.where("kind = 'method'").select("manager_type", "member_name"), "member", "member_name", "member_name", within=3, by=["manager_type"])
    told = odd.join(near, ["manager_type", "member"]).withColumn("told", X.confidence(F.col("member"), F.col("nearest"))).where("told is not null")
    return _found(told, "unknown_manager_method", F.col("told"), "member", "nearest")


def check(
    facts: DataFrame, c: Catalog, source: Source | None = None, level: int = 1, strict: bool = True, profile: str = "full", modules: DataFrame | None = None, attributes: DataFrame | None = None,
    typed: DataFrame | None = None,
) -> DataFrame:
    """All findings, in the order of a module: line, column, then rule.

    ``modules(module_id, path)`` and ``attributes`` are as in ``prepared``.  From level 2 on ``typed`` (``inference.infer``) gives variables their types: at level 2 by annotations, constructors
    and values of enumerations, at level 3 by chains of members too.  The ``strict`` profile keeps findings of high confidence at level 1.
    """
    if source is not None and not source.healthy:
        raise RuntimeError("the source of symbols does not answer: nothing is validated")
    level = 1 if profile == "strict" else max(1, min(3, level))
    facts = prepared(facts, modules, attributes)
    c = Catalog(*(J.small(x) for x in (c.types, c.members, c.methods, c.properties)))
    if source is not None:
        source = replace(source, **{k: J.small(getattr(source, k)) for k in ("objects", "unknown", "exports", "variables", "methods")})
    dots = typed_dots(facts, c, typed if level > 1 else None)
    parts = [unknown_directive(facts), unknown_enum_value(dots, c), unknown_type_member(dots, c), unknown_new_type(facts, c), wrong_argument_count(facts, c), unknown_calls(facts, c, source, strict), shadowed_context_name(facts, c)]
    if source is not None:
        parts += [unknown_common_module(facts, c, source), unknown_metadata_object(facts, c, source), unknown_manager_method(facts, c, source)]
    out = parts[0].withColumn("rule_ord", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("rule_ord", F.lit(n)))
    if source is not None and not source.healthy:
        raise RuntimeError("the source of symbols stopped answering: nothing is validated")
    return (out.where("confidence = 'high'") if profile == "strict" else out).orderBy("module_id", "line", "col", "rule_ord", "emit_ord")


def validate(modules: DataFrame, c: Catalog, source: Source | None = None, level: int = 1, profile: str = "full", attributes: DataFrame | None = None) -> DataFrame:
    """Findings of ``modules(module_id, source, path)``; at levels 2 and 3 with types inferred from the catalog."""
    facts, typed = extract(modules), None
    level = 1 if profile == "strict" else max(1, min(3, level))
    if level > 1:
        typed = inference.infer(modules, c.types, c.methods, c.members, level)
    return check(facts, c, source, level, True, profile, modules if "path" in modules.columns else None, attributes, typed)
