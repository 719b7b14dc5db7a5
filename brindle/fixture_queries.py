"""Registered queries over query texts, module texts, pages, containers and paths.

Texts are put together from rows of the driver's tables and templates.  In a template ``{n}`` is a number of the row, ``{s}`` a text of it, and ``¦`` the place where a
finding stands; Spark sees the text without the mark and finds the place itself, the SQL computes it from the mark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import api, corpus
from brindle.operators import aggregates as A
from brindle.operators import facts, inference
from brindle.plans import module_rules, query_rules, query_text
from brindle.functions import text as X
from brindle.session import cut, shared_folder, ship
from brindle.sources import catalog as help_catalog
from brindle.sources import dump, help_container, help_pages, html, payloads, remote, sqlite_index
from brindle.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def values(rows: list[tuple], columns: str, name: str = "c") -> str:
    """Rows as a SQL table."""
    one = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") as {name}({columns})"


def filled(spark: SparkSession, rows: DataFrame, templates: list[str]) -> DataFrame:
    """``rows(id, s)`` with ``case_no`` and ``text``: the template of each row by its id, without the mark."""
    cases = spark.createDataFrame(list(enumerate(templates)), "case_no int, template string")
    text = F.replace(F.replace("template", F.lit("{n}"), F.col("id").cast("string")), F.lit("{s}"), F.col("s"))
    return rows.withColumn("case_no", (F.col("id") % len(templates)).cast("int")).join(F.broadcast(cases), "case_no").select("id", "case_no", F.replace(text, F.lit("¦"), F.lit("")).alias("text"))


def filled_sql(rows: str, cases: str, columns: str, n: int) -> str:
    """The same with the mark, and what is expected of each case. ``rows``: SQL for id, s."""
    return f"""rows as ({rows}), cases as (select * from {cases}),
marked as (select id, replace(replace(template, '{{n}}', id::varchar), '{{s}}', s) as marked, {columns} from rows join cases on case_no = id % {n}),
placed as (select *, split_part(marked, '¦', 1) as before from marked)"""


# Query texts: orders of a library. Template, kind of finding (None: none), confidence, detail.
LOAN = "РегистрНакопления.Запасы"
TEXTS: list[tuple[str, str | None, str | None, str | None]] = [
    ("ВЫБРАТЬ К.Ссылка ИЗ Справочник.Книги КАК К // {s}", None, None, None),
    ("SELECT B.Ref FROM Catalog.Books{n} AS B", None, None, None),
    ("// {s}\nВЫБРАТЬ К.Ссылка ПОМЕСТИТЬ ¦ВТ{n} ИЗ Справочник.Книги КАК К; ВЫБРАТЬ 1 ИЗ Справочник.Книги КАК К ЛЕВОЕ СОЕДИНЕНИЕ ВТ{n} КАК В ПО К.Ссылка = В.Ссылка", "temp_table_without_index", "high", "ВТ{n}"),
    ("ВЫБРАТЬ К.Ссылка ПОМЕСТИТЬ ВТ{n} ИЗ Справочник.Книги КАК К ИНДЕКСИРОВАТЬ ПО Ссылка; ВЫБРАТЬ 1 ИЗ Справочник.Книги КАК К ЛЕВОЕ СОЕДИНЕНИЕ ВТ{n} КАК В ПО К.Ссылка = В.Ссылка", None, None, None),
    ("ВЫБРАТЬ К.А, К.Б ПОМЕСТИТЬ ВТ ИЗ Справочник.Книги КАК К ИНДЕКСИРОВАТЬ ПО НАБОРАМ ((А, Б), (Б)); ВЫБРАТЬ 1 ИЗ Справочник.Книги КАК К ВНУТРЕННЕЕ СОЕДИНЕНИЕ ВТ КАК В ПО К.А = В.А", None, None, None),
    ("ВЫБРАТЬ К.Ссылка ПОМЕСТИТЬ ВТ ИЗ Справочник.Книги КАК К; ВЫБРАТЬ 1 ИЗ ВТ КАК В", None, None, None),
    ("SELECT {n} FROM Catalog.Shelves AS A ¦LEFT JOIN Catalog.Rooms AS B ON A.Ref = B.Ref OR A.Code = B.Code", "or_in_join_condition", "high", "Rooms"),
    ("SELECT {n} FROM Catalog.Shelves AS A LEFT OUTER JOIN Catalog.Rooms AS B ON A.Ref = B.Ref AND (A.X = 1 OR A.X = {n})", None, None, None),
    ("SELECT 1 FROM Catalog.Shelves AS A WHERE A.X = 1 OR A.X = {n}", None, None, None),
    ("ВЫБРАТЬ {n} ИЗ Справочник.Книги КАК К ¦ПРАВОЕ СОЕДИНЕНИЕ (ВЫБРАТЬ Ц.Ссылка ИЗ Справочник.Цены КАК Ц) КАК Ц{n} ПО К.Ссылка = Ц{n}.Ссылка", "join_with_subquery", "low", "Ц{n}"),
    ("ВЫБРАТЬ 1 ИЗ Справочник.Книги КАК К ГДЕ К.Ссылка В (ВЫБРАТЬ Ц.Ссылка ИЗ Справочник.Цены КАК Ц) УПОРЯДОЧИТЬ ПО К.Код ИТОГИ СУММА(К.Цена) ПО ОБЩИЕ", None, None, None),
    (f"ВЫБРАТЬ З.Книга КАК Поле{{n}} ИЗ ¦{LOAN} КАК З", "physical_register_table", "low", "Запасы"),
    (f"ВЫБРАТЬ З.Регистратор ИЗ {LOAN} КАК З", None, None, None),
    (f"ВЫБРАТЬ З.Поправка ИЗ {LOAN} КАК З", None, None, None),
    (f"ВЫБРАТЬ Книга ИЗ {LOAN}", None, None, None),
    ("ВЫБРАТЬ В.Книга ИЗ РегистрНакопления.Выдачи КАК В", None, None, None),
    (f"ВЫБРАТЬ О.Полка ИЗ Справочник.Книги КАК К{{n}}, ¦{LOAN}.Остатки() КАК О", "virtual_table_without_filter", "low", "Запасы"),
    (f"ВЫБРАТЬ О.Полка ИЗ {LOAN}.Остатки(&Дата, Полка = &Полка) КАК О", None, None, None),
    (f"ВЫБРАТЬ О.Полка ИЗ {LOAN}.Остатки(&Дата, &Отбор) КАК О", None, None, None),
    (f"ВЫБРАТЬ О.Полка ИЗ ¦{LOAN}.Остатки(, Число > {{n}}) КАК О", "virtual_table_without_filter", "low", "Запасы"),
    (f"ВЫБРАТЬ О.Полка ИЗ ¦{LOAN}.Обороты(, , Месяц) КАК О", "virtual_table_without_filter", "low", "Запасы"),
    (f"ВЫБРАТЬ О.Полка ИЗ {LOAN}.ОстаткиИОбороты(, , , , Полка = &П) КАК О", None, None, None),
    ("ВЫБРАТЬ 1 ИЗ Документ.Заказ КАК Д ПОЛНОЕ СОЕДИНЕНИЕ Справочник.Книги КАК К ПО Д.Текст{n} = ¦К.Заметка", "join_on_unindexed_field", "low", "К.Заметка"),
    ("ВЫБРАТЬ 1 ИЗ Документ.Заказ КАК Д ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Книги КАК К ПО Д.Издание = К.Издание", None, None, None),
    ("ВЫБРАТЬ 1 ИЗ Документ.Заказ КАК Д ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Книги КАК К ПО Д.К = К.Ссылка", None, None, None),
    ("ВЫБРАТЬ 1 ИЗ Документ.Заказ КАК Д ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Книги КАК К ПО Д.К = К.Неизвестно{n}", None, None, None),
    ("ВЫБРАТЬ Т.Номер ИЗ Документ.%1 КАК Т", None, None, None),
    ("ВЫБРАТЬ Т.А ИЗ &Имя{n} КАК Т", None, None, None),
    ("ВЫБРАТЬ РАЗРЕШЕННЫЕ РАЗЛИЧНЫЕ ПЕРВЫЕ {n} А.А ИЗ Справочник.А КАК А ОБЪЕДИНИТЬ ВСЕ ВЫБРАТЬ Б.Б ИЗ Справочник.Б КАК Б; УНИЧТОЖИТЬ ВТ", None, None, None),
    ("¦ЭТО НЕ ЗАПРОС {s}", "not understood", None, None),
    ("ВЫБРАТЬ 1 ИЗ(%1) КАК Т", "not understood", None, None),
]
OBJECTS = [("AccumulationRegisters", "запасы", "Balance"), ("AccumulationRegisters", "выдачи", "Turnovers"), ("Catalogs", "книги", None)]
FIELDS = [
    ("AccumulationRegisters", "запасы", "поправка", "attribute", None), ("AccumulationRegisters", "запасы", "книга", "dimension", None), ("AccumulationRegisters", "запасы", "полка", "dimension", None),
    ("AccumulationRegisters", "запасы", "число", "resource", None), ("AccumulationRegisters", "выдачи", "книга", "dimension", None), ("Catalogs", "книги", "издание", "attribute", "Index"), ("Catalogs", "книги", "заметка", "attribute", None),
]


def parsed_texts(spark: SparkSession, rows: DataFrame | None = None) -> DataFrame:
    """Parsed query texts of ``rows(id, s)``, or one of each kind."""
    ship(spark)
    rows = spark.range(len(TEXTS)).withColumn("s", F.lit("x")) if rows is None else rows
    return cut(query_text.parse(filled(spark, rows, [t for t, *_ in TEXTS]).select(F.col("id").alias("text_id"), "text")))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("s"))


CUSTOMERS = "select c_custkey as id, c_name as s from customer"


def known_objects(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(OBJECTS, "collection string, name_lower string, register_type string"), spark.createDataFrame(FIELDS, "collection string, name_lower string, field_lower string, kind string, indexing string")


@query(f"""with {filled_sql(CUSTOMERS, values([(i, *t) for i, t in enumerate(TEXTS)], "case_no, template, kind, confidence, detail"), "kind, confidence, replace(detail, '{n}', id::varchar) as detail", len(TEXTS))}
select id as text_id, case when kind <> 'not understood' then strlen(before)::int end as "offset", kind, confidence, detail from placed where kind is not null""")
def query_rule_findings(spark, folder):
    """Findings of all rules on a query text for each customer, and the texts that aren't understood."""
    parsed = parsed_texts(spark, customers(spark, folder))
    found = query_rules.check(parsed, *known_objects(spark)).select("text_id", "offset", "kind", "confidence", "detail")
    none = F.lit(None).cast("string")
    return found.unionByName(parsed.where("not understood").select("text_id", F.lit(None).cast("int").alias("offset"), F.lit("not understood").alias("kind"), none.alias("confidence"), none.alias("detail")))


# For each source of each text: number of its query, kind of table, name, third segment, kind of join, alias, empty slots.
SOURCES = [
    (0, 0, "meta", "Книги", None, None, "К", ""), (1, 0, "meta", "Books{n}", None, None, "B", ""), (2, 0, "meta", "Книги", None, None, "К", ""), (2, 1, "meta", "Книги", None, None, "К", ""), (2, 1, "temp", "ВТ{n}", None, "left", "В", ""),
    (6, 0, "meta", "Shelves", None, None, "A", ""), (6, 0, "meta", "Rooms", None, "left", "B", ""), (9, 0, "meta", "Книги", None, None, "К", ""), (9, 0, "subquery", None, None, "right", "Ц{n}", ""), (9, 1, "meta", "Цены", None, None, "Ц", ""),
    (14, 0, "meta", "Запасы", None, None, None, ""), (16, 0, "meta", "Книги", None, None, "К{n}", ""), (16, 0, "meta", "Запасы", "Остатки", None, "О", ""), (17, 0, "meta", "Запасы", "Остатки", None, "О", "false,false"),
    (20, 0, "meta", "Запасы", "Обороты", None, "О", "true,true,false"), (21, 0, "meta", "Запасы", "ОстаткиИОбороты", None, "О", "true,true,true,true,false"), (22, 0, "meta", "Заказ", None, None, "Д", ""), (22, 0, "meta", "Книги", None, "full", "К", ""),
    (26, 0, "meta", "%1", None, None, "Т", ""), (27, 0, "parameter", "&Имя{n}", None, None, "Т", ""), (28, 0, "meta", "А", None, None, "А", ""), (28, 1, "meta", "Б", None, None, "Б", ""),
]
_SHOWN = sorted({r[0] for r in SOURCES})


@query(f"""select c_custkey as text_id, "query", table_kind, replace(name, '{{n}}', c_custkey::varchar) as name, sub_table, join_kind, replace(alias, '{{n}}', c_custkey::varchar) as alias, slots
from customer join {values(SOURCES, 'case_no, "query", table_kind, name, sub_table, join_kind, alias, slots')} on case_no = c_custkey % {len(TEXTS)}""")
def query_text_sources(spark, folder):
    """Every source of the texts: what it is, what it is joined by, and which slots of its call are empty."""
    s = query_text.relation(parsed_texts(spark, customers(spark, folder)), "sources").where((F.col("text_id") % len(TEXTS)).isin(_SHOWN))
    slots = F.array_join(F.transform("empty_slots", lambda x: x.cast("string")), ",")
    return s.select("text_id", "query", "table_kind", "name", "sub_table", "join_kind", "alias", slots.alias("slots"))


# Fields that texts mention: case, part, path.
MENTIONED = [
    (0, "select", "К.Ссылка"), (6, "on", "A.Ref"), (6, "on", "B.Ref"), (6, "on", "A.Code"), (6, "on", "B.Code"), (7, "on", "A.Ref"), (7, "on", "B.Ref"), (7, "on", "A.X"), (7, "on", "A.X"), (8, "where", "A.X"), (8, "where", "A.X"),
    (10, "where", "К.Ссылка"), (10, "where", "Ц.Ссылка"), (10, "where", "Справочник.Цены"), (10, "where", "Ц"), (11, "select", "З.Книга"), (11, "select", "Поле{n}"), (17, "select", "О.Полка"), (17, "param", "Полка"), (28, "select", "А.А"), (28, "select", "Б.Б"),
]
_FIELDS_OF = sorted({r[0] for r in MENTIONED})


@query(f"""select c_custkey as text_id, part, replace(path, '{{n}}', c_custkey::varchar) as path, count(*) as n from customer join {values(MENTIONED, "case_no, part, path")} on case_no = c_custkey % {len(TEXTS)} group by all""")
def query_text_fields(spark, folder):
    """Fields that clauses mention; GROUP BY, ORDER BY, TOTALS and what they hold are passed over."""
    f = query_text.relation(parsed_texts(spark, customers(spark, folder)), "fields").where((F.col("text_id") % len(TEXTS)).isin(_FIELDS_OF))
    return f.groupBy("text_id", "part", "path").agg(F.count("*").alias("n"))


# Modules: template (from its second line on), kind, confidence, name, suggestion, path, attributes of the form.
FORM, COMMON = "base/Catalogs/Книги/Forms/Ф/Ext/Form/Module.bsl", "base/CommonModules/М/Ext/Module.bsl"
PROC = "&НаСервере\nПроцедура П{n}(А)\n\t%s\nКонецПроцедуры"
MODULES: list[tuple[str, str | None, str | None, str | None, str | None, str | None, str | None]] = [
    (PROC % "К{n} = 1; ¦Сообщит(К{n});", "unknown_global_method", "high", "Сообщит", "Сообщить", None, None),
    (PROC % "Б = ¦СтрНайти(А);", "wrong_argument_count", "high", "СтрНайти", None, None, None),
    (PROC % "Б = Макс(1, 2, {n}); В = СтрНайти(А, Б, 1); Сообщить(А);", None, None, None, None, None, None),
    (PROC % "Б = Новый ¦Тип{n};", "unknown_new_type", "low", "Тип{n}", None, None, None),
    (PROC % "Б{n} = Цвет.¦Красны;", "unknown_enum_value", "high", "Красны", "Красный", None, None),
    (PROC % "Запрос.¦Выполнит();", "unknown_type_member", "low", "Выполнит", "Выполнить", None, None),
    (PROC % "¦НеОбъявлена{n}();", "undeclared_method", "high", "НеОбъявлена{n}", None, None, None),
    ('&Вместо("Ф")\nПроцедура П{n}()\n\tНеОбъявлена{n}();\nКонецПроцедуры', None, None, None, None, None, None),
    (PROC % "¦Загрузить();", "undeclared_method", "low", "Загрузить", None, None, None),
    (PROC % "Глобальная(); П{n}(1);", None, None, None, None, None, None),
    ("¦&НаСервре\nПроцедура П{n}()\nКонецПроцедуры", "unknown_directive", "high", "НаСервре", "НаСервере", None, None),
    (PROC % "Б = Справочники.¦Нету{n};", "unknown_metadata_object", "high", "Нету{n}", None, None, None),
    (PROC % "Б = Справочники.¦Книг;", "unknown_metadata_object", "high", "Книг", "Книги", None, None),
    (PROC % "Б = Справочники.Книги; В = Справочники.ТипВсеСсылки();", None, None, None, None, None, None),
    (PROC % "Б = Документы.¦Заказ{n};", "unknown_metadata_object", "high", "Заказ{n}", None, None, None),
    (PROC % "Б = Отчеты.Отчет{n};", None, None, None, None, None, None),
    (PROC % "¦НетМодуля{n}.Ф();", "unknown_common_module", "high", "НетМодуля{n}", None, COMMON, None),
    (PROC % "НетМодуля{n}.Ф();", None, None, None, None, "base/Catalogs/Книги/Ext/ObjectModule.bsl", None),
    (PROC % "НетМодуля{n}.Ф();", None, None, None, None, FORM, None),
    (PROC % "НетМодуля{n}.Ф(); ¦Другой{n}.Ф();", "unknown_common_module", "high", "Другой{n}", None, FORM, "нетмодуля{n}"),
    (PROC % "Объект.Записать(); ПараметрыПриложения.Вставить({n}); Общий.Ф(); НетМодуля{n}.Свойство = 1;", None, None, None, None, COMMON, None),
    (PROC % "Справочники.Книги.¦НайтиПоКодуу({n});", "unknown_manager_method", "high", "НайтиПоКодуу", "НайтиПоКоду", None, None),
    (PROC % "Справочники.Книги.ПустаяСсылка(); Справочники.Книги.Загрузить();", None, None, None, None, None, None),
    (PROC % "¦Документы = {n};", "shadowed_context_name", "high", "Документы", None, None, None),
    ("Перем ¦Документы;\nПроцедура П{n}()\n\tДокументы = 1;\nКонецПроцедуры", "shadowed_context_name", "high", "Документы", None, None, None),
    ("Процедура П{n}(Документы)\n\tДокументы = 1; РабочаяДата = 2;\nКонецПроцедуры", None, None, None, None, None, None),
    (PROC % "¦Параметры = {n};", "shadowed_context_name", "high", "Параметры", None, FORM, None),
    (PROC % "Параметры = {n};", None, None, None, None, FORM, "параметры"),
    (PROC % "Параметры = {n};", None, None, None, None, COMMON, None),
    ("&НаКлиентеНаСервереБезКонтекста\nПроцедура П{n}()\n\tПараметры = 1;\nКонецПроцедуры", None, None, None, None, FORM, None),
    (PROC % "З{n} = Новый Запрос; З{n}.¦Выполнит();", "unknown_type_member", "low", "Выполнит", "Выполнить", None, None),
    ("Процедура А()\n\tЗ = Новый Запрос;\nКонецПроцедуры\nПроцедура П{n}(З)\n\tЗ.Выполнит();\nКонецПроцедуры", None, None, None, None, None, None),
    (PROC % "З = Новый Запрос;\n\tР{n} = З.Выполнить();\n\tР{n}.¦Выбрат();", "unknown_type_member", "low", "Выбрат", "Выбрать", None, None),
    (PROC % "// @type Цвет\n\tЦ{n} = Сообщить(А);\n\tЦ{n}.¦Синий = 1;", "unknown_enum_value", "high", "Синий", None, None, None),
    (PROC % "#Удаление\n\tНеОбъявлена{n}();\n#КонецУдаления\n\tБ = 1;", None, None, None, None, None, None),
]


def catalog(spark: SparkSession) -> module_rules.Catalog:
    """A platform of a few names."""
    manager = "справочникменеджер.<имя справочника>"
    types = [("цвет", "Цвет", True), ("запрос", "Запрос", False), ("результатзапроса", "РезультатЗапроса", False), (manager, "СправочникМенеджер.<Имя справочника>", False), ("справочникименеджер", "СправочникиМенеджер", False)]
    members = [
        ("цвет", "красный", "Красный", "enum_value", None), ("цвет", "red", "Красный", "enum_value", None), ("запрос", "выполнить", "Выполнить", "method", "`РезультатЗапроса`"), ("справочникименеджер", "типвсессылки", "ТипВсеСсылки", "method", None),
        ("результатзапроса", "выбрать", "Выбрать", "method", "ВыборкаИзРезультатаЗапроса"), (manager, "найтипокоду", "НайтиПоКоду", "method", None), (manager, "пустаяссылка", "ПустаяСсылка", "method", None),
    ]
    methods = [("сообщить", "Сообщить", "", [([("Текст", True)],)]), ("макс", "Макс", "Число", [([("Значение", True)],)]), ("стрнайти", "СтрНайти", "Число", [([("А", True), ("Б", True), ("В", False)],)])]
    properties = [("справочники", True, "`СправочникиМенеджер`", "global"), ("документы", True, "`ДокументыМенеджер`", "global"), ("рабочаядата", False, "Дата", "global"), ("параметры", True, "Структура", "form")]
    return module_rules.Catalog(
        spark.createDataFrame(types, "type_lower string, type_name string, is_enum boolean"), spark.createDataFrame(members, "type_lower string, member_lower string, member_name string, kind string, value_type string"),
        spark.createDataFrame(methods, "method_lower string, method_name string, return_type string, signatures array<struct<parameters: array<struct<name: string, required: boolean>>>>"),
        spark.createDataFrame(properties, "property_lower string, readonly boolean, type_name string, scope string"),
    )


def configuration(spark: SparkSession) -> module_rules.Source:
    """Knows catalogs, documents (there are none) and common modules; can't tell of reports."""
    objects = spark.createDataFrame([("Catalogs", "книги", "Книги"), ("CommonModules", "общий", "Общий")], "collection string, name_lower string, name string")
    one = lambda x, c: spark.createDataFrame([(x,)], f"{c} string")
    return module_rules.Source(objects, one("Reports", "collection"), one("глобальная", "method_lower"), one("параметрыприложения", "name_lower"), None, one("загрузить", "method_lower"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by number, with their words as a comment."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("s"))


DOCUMENTS = "select doc_id as id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') as s from documents"


def modules_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A module for each document, with its path; attributes of its form."""
    ship(spark)
    texts = filled(spark, documents(spark, folder), ["// {s}\n" + m[0] for m in MODULES])
    more = spark.createDataFrame([(i, m[5], m[6]) for i, m in enumerate(MODULES)], "case_no int, path string, attribute string")
    rows = texts.join(F.broadcast(more), "case_no").select(F.col("id").alias("module_id"), F.col("text").alias("source"), "path", F.replace("attribute", F.lit("{n}"), F.col("id").cast("string")).alias("attribute"))
    return rows.select("module_id", "source", "path"), rows.where("attribute is not null").select("module_id", F.array("attribute").alias("names"))


_MODULES_SQL = filled_sql(
    DOCUMENTS, values([(i, "// {s}\n" + m[0], *m[1:5]) for i, m in enumerate(MODULES)], "case_no, template, kind, confidence, name, suggestion"), "kind, confidence, replace(name, '{n}', id::varchar) as name, suggestion", len(MODULES)
)


@query(f"""with {_MODULES_SQL} select id as module_id, (length(before) - length(replace(before, chr(10), '')) + 1)::int as line, (length(before) - length(regexp_replace(before, '[^\\n]*$', '')) + 1)::int as col,
kind, confidence, name, suggestion from placed where kind is not null""")
def module_rule_findings(spark, folder):
    """Findings of all rules on modules at level 3: names of the platform and of the configuration, scopes, types of variables, forms and extensions."""
    modules, attributes = modules_of(spark, folder)
    return module_rules.validate(modules, catalog(spark), configuration(spark), level=3, attributes=attributes).drop("emit_ord", "rule_ord")


@query(f"""with {_MODULES_SQL}, found as (select * from placed where kind is not null and confidence = 'high' and not (kind = 'unknown_enum_value' and name = 'Синий'))
select kind, count(*) as n, count(distinct id) as modules, arg_min(name, id) as first from found group by kind""")
def strict_profile_by_kind(spark, folder):
    """Tallies of a run with the strict profile: high confidence, without inferred types."""
    modules, attributes = modules_of(spark, folder)
    return corpus.by_kind(module_rules.validate(modules, catalog(spark), configuration(spark), level=3, profile="strict", attributes=attributes))


@query(f"""with {_MODULES_SQL} select count(*) as modules_total, count(kind) as modules_with_errors, count(kind) as errors_total from placed""")
def run_of_corpus(spark, folder):
    modules, attributes = modules_of(spark, folder)
    return corpus.totals(modules, module_rules.validate(modules, catalog(spark), configuration(spark), level=3, attributes=attributes))


def module_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the comment of a small module that calls a method and sets a variable: positions must follow the text."""
    source = F.concat(F.lit("Процедура П"), F.col("doc_id").cast("string"), F.lit("(А, Знач Б = 1) Экспорт\n// "), F.regexp_replace("text", r"\s+", " "), F.lit("\nХ = Новый Массив; Сообщить(А, , Б);\nКонецПроцедуры"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("module_id"), source.alias("source"))


@query("""select doc_id as module_id, 'П' || doc_id as proc, 3::bigint as n_args, 'Массив' as new_type,
strlen('Процедура П' || doc_id || '(А, Знач Б = 1) Экспорт' || chr(10) || '// ' || regexp_replace(text, '\\s+', ' ', 'g') || chr(10) || 'Х = Новый Массив; ')::bigint as call_byte, 19::bigint as call_col, 3::bigint as call_line, 4::bigint as n_facts from documents""")
def module_facts(spark, folder):
    found = facts.extract(module_of_documents(spark, folder))
    return found.groupBy("module_id").agg(
        F.max(F.when(F.col("kind") == "proc", F.col("name"))).alias("proc"), F.max(F.when(F.col("kind") == "call", F.col("n_args"))).cast("long").alias("n_args"),
        F.max(F.when(F.col("kind") == "new", F.col("name"))).alias("new_type"), F.max(F.when(F.col("kind") == "call", F.col("byte"))).alias("call_byte"),
        F.max(F.when(F.col("kind") == "call", F.col("col"))).cast("long").alias("call_col"), F.max(F.when(F.col("kind") == "call", F.col("line"))).cast("long").alias("call_line"), F.count("*").alias("n_facts"),
    )


@query("""select c_custkey as module_id, 'ВЫБРАТЬ "' || c_custkey || '"' || chr(10) || 'ИЗ ' || c_mktsegment || ' ГДЕ ' || c_name as name, 4 as line, 6 as col,
strlen('#Удаление' || chr(10) || '"' || c_name || chr(10) || '#КонецУдаления' || chr(10) || chr(9) || 'Т = ')::bigint as byte from customer""")
def module_query_texts(spark, folder):
    """Query texts in string literals: doubled quotes, continued lines with comments between, literals joined by +, behind a deleted block that breaks a literal."""
    ship(spark)
    c = table(spark, folder, "customer")
    source = F.format_string(
        '#Удаление\n"%s\n#КонецУдаления\n\tТ = "ВЫБРАТЬ ""%s""\n\t// примечание\n\t|ИЗ %s" + " ГДЕ %s"; Х = "не запрос"; // "ВЫБРАТЬ', "c_name", F.col("c_custkey").cast("string"), "c_mktsegment", "c_name"
    )
    found = facts.extract(c.select(F.col("c_custkey").alias("module_id"), source.alias("source")))
    return found.where("kind = 'query'").select("module_id", "name", "line", "col", "byte")


_SCOPES = "Процедура А{n}()\n// {s}\nЗ = Новый Запрос;\nР = З.Выполнить();\nКонецПроцедуры"


@query(f"""with m as (select id, replace(replace('{_SCOPES}', '{{n}}', id::varchar), '{{s}}', s) || chr(10) as a, 'Функция Б()' || chr(10) || 'Ц = Цвет.Красный;' || chr(10) || 'КонецФункции' as b from ({CUSTOMERS}))
select id as module_id, 0::bigint as "start", strlen(a) - 1 as "end", unnest(['з', 'р']) as name_lower, unnest(['запрос', 'результатзапроса']) as type_lower from m
union all select id, strlen(a), strlen(a) + strlen(b), 'ц', 'цвет' from m""")
def type_scopes(spark, folder):
    """Types of variables in each procedure: constructors, values of enumerations, chains of members."""
    ship(spark)
    text = F.replace(F.replace(F.lit(_SCOPES), F.lit("{n}"), F.col("id").cast("string")), F.lit("{s}"), F.col("s"))
    modules = customers(spark, folder).select(F.col("id").alias("module_id"), F.concat(text, F.lit("\nФункция Б()\nЦ = Цвет.Красный;\nКонецФункции")).alias("source"))
    c = catalog(spark)
    return inference.infer(modules, c.types, c.methods, c.members)


_BYTES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', '\"', 'g'), '&copy;', '©', 'g'), '&middot;', '·', 'g')"
#: Pages without comments, and with every < of a script set apart.
_PLAIN = r"""p as (select page_id, regexp_replace(array_to_string(list_transform(string_split(coalesce(html, ''), '</script>'), lambda x: case when contains(x, '<script>')
 then split_part(x, '<script>', 1) || replace(split_part(x, '<script>', 2), '<', chr(1)) else x end), ''), '<!--.*?-->', '', 'gs') as h from pages)"""


def _decoded(x: str) -> str:
    return f"replace(replace({_BYTES.format(x=x)}, '&amp;', '&'), chr(1), '<')"


@query(rf"""with {_PLAIN} select page_id, trim(regexp_replace({_decoded("regexp_replace(h, '<[^>]*>', '', 'gs')")}, '\s+', ' ', 'g')) as text from p""")
def html_text(spark, folder):
    return html.parse_pages(table(spark, folder, "pages"), "page_id").select("page_id", "text")


@query(rf"""with {_PLAIN}, links as (select page_id, regexp_replace(h, '<a href="([^"]*)">(.*?)</a>', '[\2](\1)', 'gs') as h from p),
marks as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<h1>', chr(10) || '# ', 'g'), '</h1>|</?p>|<br>', chr(10), 'g'), '<li>', chr(10) || '* ', 'g'), '</?(b|strong)>', '**', 'g'), '</?(i|em)>', '*', 'g') as h from links)
select page_id, trim({_decoded("regexp_replace(h, '<[^>]*>', '', 'gs')")}, ' ' || chr(9) || chr(10) || chr(13)) as markdown from marks""")
def html_markdown(spark, folder):
    return html.parse_pages(table(spark, folder, "pages"), "page_id").select("page_id", "markdown")


@query("""with c as (select page_id, unnest([0, 1, 2]) as ord, unnest(['', '', 'Про ' || page_id]) as title, unnest(['x', 'a &amp; <b>' || page_id || '</b>', replace(url, '&', '&amp;')]) as body from pages) select page_id, ord, title, length(body)::int as n_chars from c""")
def html_chapters(spark, folder):
    """Chapters of a help page for each page of the table: one begins at a rule, one at a heading."""
    p = table(spark, folder, "pages").withColumn("html", F.format_string('<html><head><title>t</title></head><body>x<hr>a &amp; <b>%d</b><p class="V8SH_chapter">Про  <i>%d</i></p>%s</body></html>', "page_id", "page_id", F.replace("url", F.lit("&"), F.lit("&amp;"))))
    return html.parse_pages(p, "page_id").select("page_id", F.explode("chapters").alias("c")).select("page_id", "c.ord", "c.title", F.length("c.body").alias("n_chars"))


@query("""select p_partkey, p_name as name_ru, p_brand_en as name_en, 'Тип' || p_size as return_type, 'Ищет ' || p_name || '.' as description, p_size > 25 as readonly, ['Строка', 'Число1-Число' || p_size] as parameters, [true, false] as required, p_type as note
from (select *, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') as p_brand_en from part)""")
def help_page_entries(spark, folder):
    """A method page of the help for each part."""
    ship(spark)
    page = F.format_string(
        '<html><body><p class="V8SH_heading">%s (%s)</p><p class="V8SH_chapter">Синтаксис:</p>Ф(А)<p class="V8SH_chapter">Параметры:</p><div class="V8SH_rubric"><p>&lt;Строка&gt; (обязательный)</p></div><div class="V8SH_rubric">&lt;Число1-Число%d&gt; (необязательный)</div>'
        '<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: Тип%d. Место.<p class="V8SH_chapter">Описание:</p>Ищет %s.<p class="V8SH_chapter">Использование:</p>%s<p class="V8SH_chapter">Примечание:</p>%s</body></html>',
        "p_name", F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), "p_size", "p_size", "p_name", F.when(F.col("p_size") > 25, "Только чтение.").otherwise("Чтение и запись."), "p_type",
    )
    parsed = help_pages.parse(table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("html_path"), page.alias("html")))
    ps = F.flatten(F.transform("signatures", lambda s: s["parameters"]))
    return parsed.select(
        F.col("html_path").cast("long").alias("p_partkey"), "name_ru", "name_en", "return_type", "description", "readonly", F.transform(ps, lambda x: x["name"]).alias("parameters"), F.transform(ps, lambda x: x["required"]).alias("required"), "note",
    )


def packed(spark: SparkSession, folder: str) -> DataFrame:
    """A help container for each region, with its nations as entries and pages."""
    ship(spark)
    r, n = table(spark, folder, "region"), table(spark, folder, "nation")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for frame in frames:
            out = []
            for key, name, nations in zip(frame["r_regionkey"], frame["r_name"], frame["nations"], strict=True):
                entry = lambda i, parent, kids, title, page: "{%d,%d,%d%s,{0,0,{0,0,{\"ru\",\"%s\"},{\"en\",\"%s\"}},\"%s\"}}" % (i, parent, len(kids), "".join(f",{k}" for k in kids), title, title.title(), page)  # noqa: E731, UP031
                toc = [entry(1, 0, [x["n_nationkey"] + 2 for x in nations], name, "")] + [entry(x["n_nationkey"] + 2, 1, [], x["n_name"], f"/n/{x['n_nationkey']}.html") for x in nations]
                archive = io.BytesIO()
                with zipfile.ZipFile(archive, "w") as z:
                    for x in nations:
                        z.writestr(f"n/{x['n_nationkey']}.html", f"<p>{x['n_name']}")
                    z.writestr("n/other.html", "x")
                content = help_container.pack({"PackBlock": help_container.deflate_block("﻿{%d,%s}" % (len(toc), ",".join(toc))), "FileStorage": archive.getvalue(), "Book": b"x"})  # noqa: UP031
                out.append((f"{key}.hbk", content))
            yield pd.DataFrame([*out, ("broken.hbk", b"no container")], columns=["path", "content"])

    return rows.repartition(1).mapInPandas(run, "path string, content binary")


@query("""select r_regionkey || '.hbk' as path, 1 as id, 0 as parent_id, 0 as ord, r_name as ru, '' as html_path from region
union all select n_regionkey || '.hbk', n_nationkey + 2, 1, row_number() over (partition by n_regionkey order by n_nationkey)::int, n_name, '/n/' || n_nationkey || '.html' from nation""")
def help_contents(spark, folder):
    """Contents of help containers: binary records, a packed block, its nested entries; what is no container gives nothing."""
    return help_container.contents_of(packed(spark, folder)).drop("en")


@query("""select n_regionkey || '.hbk' as path, '/n/' || n_nationkey || '.html' as html_path, '<p>' || n_name as html from nation""")
def help_archive_pages(spark, folder):
    """Pages that the contents name, out of the archives of the containers."""
    files = cut(packed(spark, folder))
    return help_container.pages_of(files, help_container.contents_of(files))


_DUMP = """p as (select c_custkey as id, c_custkey % 6 as k, 'Имя' || c_custkey as name, c_name from customer),
f as (select *, case k when 0 then 'base/CommonModules/' || name || '/Ext/Module.bsl' when 1 then 'extensions/Е/Catalogs/' || name || '/Forms/Ф/Ext/Form/Module.bsl' when 2 then 'external/' || name || '/Form/Ф/Form.obj.bsl'
 when 3 then 'base/Documents/' || name || '/Ext/ObjectModule.bsl' when 4 then 'external/' || name || '/ExternalDataProcessor.obj.bsl' else 'other/' || name || '.bsl' end as path from p)"""


def index_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """An index over a dump with a module and a description for each customer."""
    ship(spark)
    c = table(spark, folder, "customer").select((F.col("c_custkey") % 6).alias("k"), F.concat(F.lit("Имя"), F.col("c_custkey").cast("string")).alias("name"), "c_name", "c_custkey")
    at = lambda *x: F.concat(*(F.col("name") if y == "@" else F.lit(y) for y in x))
    path = F.when(F.col("k") == 0, at("base/CommonModules/", "@", "/Ext/Module.bsl")).when(F.col("k") == 1, at("extensions/Е/Catalogs/", "@", "/Forms/Ф/Ext/Form/Module.bsl")).when(F.col("k") == 2, at("external/", "@", "/Form/Ф/Form.obj.bsl"))
    path = path.when(F.col("k") == 3, at("base/Documents/", "@", "/Ext/ObjectModule.bsl")).when(F.col("k") == 4, at("external/", "@", "/ExternalDataProcessor.obj.bsl")).otherwise(at("other/", "@", ".bsl"))
    source = F.concat(F.when(F.col("k") == 1, F.lit('&После("Ф")\n')).otherwise(F.lit("")), F.lit("// "), F.col("c_name"), F.lit("\nФункция Взять"), F.col("c_custkey").cast("string"), F.lit("(А, Знач Б = 1) Экспорт\nКонецФункции\nПроцедура Внутри()\nКонецПроцедуры"))
    xml = F.concat(
        F.lit("<M><AccumulationRegister><Properties><RegisterType>Balance</RegisterType><Global>"), (F.col("c_custkey") % 4 == 0).cast("string"), F.lit("</Global></Properties><ChildObjects><Dimension><Properties><Name>Изм"), F.col("c_custkey").cast("string"),
        F.lit("</Name><Indexing>Index</Indexing></Properties></Dimension><TabularSection><ChildObjects><Attribute><Properties><Name>Внутри</Name></Properties></Attribute></ChildObjects></TabularSection><Resource><Properties><Name>Рес</Name><Indexing>DontIndex</Indexing></Properties></Resource>"),
    )
    xml_path = F.when(F.col("k") == 0, at("base/CommonModules/", "@", ".xml")).when(F.col("k") == 3, at("base/AccumulationRegisters/", "@", ".XML")).when(F.col("k") == 5, at("base/Enums/", "@", ".xml"))
    return dump.index(c.select(path.alias("path"), source.alias("source")), c.select(xml_path.alias("path"), xml.alias("source")).where("path is not null"))


@query(f"""with {_DUMP} select path, case when k in (0, 3) then 'base' when k = 1 then 'extensions' when k in (2, 4) then 'external' else 'other' end as scope, case k when 0 then 'CommonModules' when 1 then 'Catalogs' when 3 then 'Documents' end as collection,
case when k in (0, 1, 3) then name end as object_name, case k when 0 then 'Module' when 1 then 'Form' when 2 then 'Form' when 3 then 'ObjectModule' else 'Other' end as module_type, k = 0 and id % 4 = 0 as is_global, k = 1 as is_extension,
case when k = 2 then 'external/' || name || '/ExternalDataProcessor.obj.bsl' end as owner_path from f""")
def dump_modules(spark, folder):
    """Modules of an index: what their paths say, marks of their descriptions, and whether they extend others."""
    return index_of(spark, folder)["modules"].drop("module_id")


@query(f"""with {_DUMP} select path, 'Взять' || id as name, true as is_function, true as is_export, (case when k = 1 then 3 else 2 end)::int as line_start, 'а, б' as params from f union all select path, 'Внутри', false, false, (case when k = 1 then 5 else 4 end)::int, '' from f""")
def dump_methods(spark, folder):
    t = index_of(spark, folder)
    return t["methods"].join(t["modules"].select("module_id", "path"), "module_id").select("path", "name", "is_function", "is_export", "line_start", "params")


@query(f"""with {_DUMP} select case k when 0 then 'CommonModules' when 3 then 'AccumulationRegisters' else 'Enums' end as collection, name, case when k <> 5 then 'Balance' end as register_type, case when k <> 5 then 'Изм' || id end as dimension, case when k <> 5 then 'Index' end as indexing,
case when k <> 5 then 'Рес' end as resource from f where k in (0, 3, 5)""")
def dump_objects(spark, folder):
    """Objects and fields of truncated descriptions: nested attributes don't count, and content of enumerations isn't read."""
    t = index_of(spark, folder)
    by = t["object_fields"].groupBy("collection", "name_lower").agg(F.max(F.when(F.col("kind") == "dimension", F.col("field"))).alias("dimension"), F.max("indexing").alias("indexing"), F.max(F.when(F.col("kind") == "resource", F.col("field"))).alias("resource"))
    return t["objects"].join(by, ["collection", "name_lower"], "left").drop("name_lower")


@query(f"""with {_DUMP} select count(*) as modules, count(*) filter (where k = 0 and id % 4 = 0) as global_modules, count(*) filter (where k = 1) as extension_modules, 2 * count(*) as methods, count(*) as exports, count(*) + 1 as names, count(*) filter (where k in (0, 3, 5)) as objects, 3::bigint as collections from f""")
def index_stats(spark, folder):
    return dump.stats(index_of(spark, folder))


@query(f"""with {_DUMP} select a.path, 'взять' || b.id as method_lower from f a join f b on a.k = 2 and b.k = 4 and b.name = a.name union all select null, null where false""")
def owner_export_names(spark, folder):
    """Exports that the owners of form modules give them (no form of this dump has its owner in it)."""
    t = index_of(spark, folder)
    return dump.owner_exports(t).join(t["modules"].select("module_id", "path"), "module_id").select("path", "method_lower")


@query(f"""with {_DUMP} select a.path, m as name from f a, (values ('взять'), ('внутри')) as v(m) where a.id = 3""")
def methods_of_module(spark, folder):
    """Methods of one module, by its path."""
    found = dump.methods_of(index_of(spark, folder), "base/Documents/Имя3/Ext/ObjectModule.bsl")
    return found.select(F.lit("base/Documents/Имя3/Ext/ObjectModule.bsl").alias("path"), F.regexp_replace("name_lower", r"\d+$", "").alias("name"))


@query("""with s as (select l_orderkey, l_linenumber, 1 + l_orderkey % 3 as n_args from lineitem)
select l_orderkey, l_linenumber, n_args between 2 and 3 or n_args = 1 and l_linenumber % 2 = 0 as fits, n_args >= 1 as fits_any, case when l_linenumber % 2 = 0 then '2..3 / 1' else '2..3' end as expected from s""")
def arity_overloads(spark, folder):
    """Whether some overload takes so many arguments; an overload with a range parameter takes as many as it says, a method of any number has no upper bound."""
    one = lambda *p: F.struct(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("required")) for n, r in p)).alias("parameters"))
    first, second = one(("А", True), ("Б1-Б2", True)), one(("А", True))
    two = F.struct(F.array(F.struct(F.lit("А").alias("name"), F.lit(True).alias("required")), F.struct(F.lit("Б1-Б2").alias("name"), F.lit(True).alias("required"))).alias("parameters"))
    rows = table(spark, folder, "lineitem").withColumns({"n": (1 + F.col("l_orderkey") % 3).cast("int"), "s": F.when(F.col("l_linenumber") % 2 == 0, F.array(first, second)).otherwise(F.array(two))})
    return rows.select("l_orderkey", "l_linenumber", A.accepts(F.col("s"), F.col("n")).alias("fits"), A.accepts(F.array(second), F.col("n"), F.lit("Макс")).alias("fits_any"), A.expected(F.col("s"), F.lit("Ф")).alias("expected"))


@query("""with t as (select c_custkey, c_custkey % 5 as k, 'РегистрСведений.' || c_mktsegment as full_name, c_name from customer)
select c_custkey, case when k in (0, 1) then [regexp_replace(full_name, '^[^.]*\\.', ''), c_name] end as names, k in (0, 1) as trusted from t""")
def payload_rows(spark, folder):
    """Answers of a remote index, plain and as a stream of events; those that were cut in any way are unknown, not empty."""
    c = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("k"), F.concat(F.lit("РегистрСведений."), F.col("c_mktsegment")).alias("full_name"), "c_name")
    rows = F.array(F.array("full_name"), F.array("c_name"))
    inner = F.to_json(F.struct(rows.alias("rows"), F.when(F.col("k") == 2, F.lit(True)).alias("truncated"), F.when(F.col("k") == 3, F.lit(7)).alias("rows_truncated")))
    text = F.to_json(F.struct(inner.alias("result"), F.when(F.col("k") == 4, F.lit(1)).alias("response_truncated")))
    whole = F.to_json(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("content")).alias("result")))
    payload = F.when(F.col("k") == 1, F.concat(F.lit("event: message\ndata:\ndata: "), whole, F.lit("\n\n"))).otherwise(whole)
    return c.select("c_custkey", payloads.object_names(payload).alias("names"), payloads.trusted(payload).alias("trusted"))


@query("""select s_suppkey, case s_suppkey % 3 when 0 then 'known' when 1 then 'unknown' else 'unrecognized' end as answer from supplier""")
def source_probe(spark, folder):
    """What a source answers when it is asked for a repository at connect."""
    k = F.col("s_suppkey") % 3
    inner = F.when(k == 0, F.to_json(F.struct(F.col("s_name").alias("repo")))).when(k == 1, F.to_json(F.struct(F.concat(F.lit("Неизвестный repo: "), F.col("s_name"), F.lit(". Есть: a, b")).alias("message")))).otherwise(F.lit("{}"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.to_json(F.struct(inner.alias("result"))).alias("text"))).alias("content")).alias("result")))
    return table(spark, folder, "supplier").select("s_suppkey", payloads.repository_answer(payload, F.col("s_name")).alias("answer"))


@query("""select p_partkey, p_size % 2 = 0 as is_export, case when p_size % 2 = 0 then lower(p_name) end as name_lower from part""")
def export_marks(spark, folder):
    """Names whose signature ends in the export mark; a parameter of that name doesn't count."""
    summary = table(spark, folder, "part").select("p_partkey", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, "(А) Экспорт").otherwise("(Экспорт, Б)").alias("args"))
    found = payloads.exported(summary).withColumn("p_partkey", F.element_at(F.split("name_lower", "#"), -1).cast("long"))
    told = summary.select("p_partkey").join(found, "p_partkey", "left")
    return told.select("p_partkey", F.col("name_lower").isNotNull().alias("is_export"), F.regexp_replace("name_lower", "#[0-9]+$", "").alias("name_lower"))


@query("""select s_suppkey, ['А' || s_suppkey, 'В'] as names from supplier where s_suppkey % 2 = 0 union all select s_suppkey, [] from supplier where s_suppkey % 2 = 1""")
def declared_variables(spark, folder):
    """Variables that lines of an application module export; a comment declares none."""
    line = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Перем А").otherwise("// Перем А"), F.col("s_suppkey").cast("string"), F.lit(" Экспорт, Б, В Экспорт; // x"))
    return table(spark, folder, "supplier").select("s_suppkey", payloads.global_variables(line).alias("names"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then [lower(c_mktsegment)] else [] end as dimensions, 'Balance' as register_type from customer""")
def object_schemas(spark, folder):
    """Fields of objects out of a JSON description."""
    dimension = F.when(F.col("c_custkey") % 4 == 0, F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit("Index").alias("indexing")))).otherwise(F.array().cast("array<struct<name: string, indexing: string>>"))
    json = F.to_json(F.struct(dimension.alias("dimensions"), F.struct(F.lit("Balance").alias("RegisterType")).alias("properties")))
    schema = payloads.object_schema(json)
    return table(spark, folder, "customer").select("c_custkey", F.transform(schema["dimensions"], lambda x: F.lower(x["name"])).alias("dimensions"), schema["properties"]["RegisterType"].alias("register_type"))


@query("""select n_name as asked, lower(n_name) as name_lower, n_nationkey % 2 = 0 as found from nation""")
def remote_search(spark, folder):
    """Fuzzy answers of a remote search are filtered exactly: the name itself, exported, of a global common module."""
    n = table(spark, folder, "nation").select("n_name", "n_nationkey")
    hits = n.select(F.col("n_name").alias("asked"), F.explode(F.array(
        F.struct(F.upper("n_name").alias("name"), F.concat(F.lit("base/CommonModules/М"), F.col("n_nationkey").cast("string"), F.lit("/Ext/Module.bsl")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "(А) Экспорт").otherwise("(А)").alias("args")),
        F.struct(F.concat("n_name", F.lit("2")).alias("name"), F.lit("base/CommonModules/М0/Ext/Module.bsl").alias("path"), F.lit("() Экспорт").alias("args")),
        F.struct(F.col("n_name").alias("name"), F.lit("base/Documents/Д/Ext/ObjectModule.bsl").alias("path"), F.lit("() Экспорт").alias("args")),
    )).alias("h")).select("asked", "h.*")
    marks = n.select(F.concat(F.lit("base/CommonModules/М"), F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("path"), F.lit("<Global>true</Global>").alias("source"))
    found = remote.global_exports(hits, marks)
    return n.select(F.col("n_name").alias("asked")).join(found.withColumn("found", F.lit(True)), "asked", "left").select("asked", F.lower("asked").alias("name_lower"), F.coalesce("found", F.lit(False)).alias("found"))


@query("""select 'ф' || n_nationkey as method_lower from nation where n_nationkey % 2 = 0 and n_nationkey % 3 > 0""")
def foreign_global_exports(spark, folder):
    """A foreign SQLite index with compressed texts: exports of the modules whose description marks them as global, in one join."""
    import sqlite3
    import uuid

    import zstandard

    ship(spark)
    path = f"{shared_folder(spark).removeprefix('file:')}/foreign-{uuid.uuid4().hex}.db"
    rows = table(spark, folder, "nation").select("n_nationkey").collect()  # a table of 25 rows
    with sqlite3.connect(path) as con:
        con.execute("create table files(id integer, path text)")
        con.execute("create table file_contents(file_id integer, content_blob blob, oversize integer)")
        con.execute("create table functions(file_id integer, name text, args text)")
        for (k,) in rows:
            con.executemany("insert into files values (?, ?)", [(2 * k, f"base/CommonModules/М{k}.xml"), (2 * k + 1, f"base/CommonModules/М{k}/Ext/Module.bsl")])
            con.execute("insert into file_contents values (?, ?, ?)", (2 * k, zstandard.compress(f"<x><Global>{'true' if k % 2 == 0 else 'false'}</Global></x>".encode()), 0))
            con.executemany("insert into functions values (?, ?, ?)", [(2 * k + 1, f"Ф{k}", "(А) Экспорт" if k % 3 else "(Экспорт)"), (2 * k + 1, "Внутри", "()")])
    con.close()
    return sqlite_index.global_exports(spark, path)


_PATHS = ["base/Catalogs/К{n}/Forms/Ф/Ext/Form/Module.bsl", "BASE\\COMMONFORMS\\Ф{n}\\Ext\\Form\\Module.bsl", "external/О{n}/Form/Ф/Form.obj.bsl", "base/CommonModules/М{n}/Ext/Module.bsl", "base/CommonModules/М{n}.xml", "base/Catalogs/К{n}/Ext/ManagerModule.bsl"]


@query(f"""with p as (select c_custkey as id, replace(path, '{{n}}', c_custkey::varchar) as path, case_no from customer join {values(list(enumerate(_PATHS)), "case_no, path")} on case_no = c_custkey % {len(_PATHS)})
select id, path, case_no <= 2 as is_form, case_no = 3 as is_common, case when case_no = 4 then 'base/CommonModules/М' || id || '/Ext/Module.bsl' end as module_path, case when case_no = 3 then 'base/CommonModules/М' || id || '.xml' end as xml_path,
case case_no when 0 then 'Form' when 1 then 'Other' when 2 then 'Form' when 3 then 'Module' when 4 then 'Other' else 'ManagerModule' end as module_type from p""")
def path_kinds(spark, folder):
    """What paths of modules say: forms, common modules, pairs of module and description."""
    cases = spark.createDataFrame(list(enumerate(_PATHS)), "case_no int, path string")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % len(_PATHS)).cast("int").alias("case_no")).join(F.broadcast(cases), "case_no")
    c = c.withColumn("path", F.replace("path", F.lit("{n}"), F.col("id").cast("string")))
    p = F.col("path")
    kind = F.when(F.col("case_no") == 1, F.lit("Other")).otherwise(dump.classify(p)["module_type"])
    return c.select("id", "path", X.form_module(p).alias("is_form"), X.common_module(p).alias("is_common"), X.module_of_xml(p).alias("module_path"), X.xml_of_module(p).alias("xml_path"), kind.alias("module_type"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_name || ' (' || p_type || ')' else p_name end as ru, case when p_partkey % 3 = 0 then p_type else '' end as en, case when p_partkey % 2 = 0 then p_size end as upper, p_name || ' ' || p_type as one_space from part""")
def name_parts(spark, folder):
    """Two names of a title (letters of the second are Latin), the upper end of a range parameter, single spaces."""
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.format_string("%s (%s)", "p_name", "p_type")).when(k == 1, F.format_string("%s (%s) (Ж)", "p_name", "p_type")).otherwise(F.col("p_name"))
    both = X.two_names(title)
    parameter = F.when(F.col("p_partkey") % 2 == 0, F.format_string("Значение1-Значение%d", "p_size")).otherwise("Значение")
    ru = F.regexp_replace(both["ru"], r" \(Ж\)$", "")
    return table(spark, folder, "part").select("p_partkey", ru.alias("ru"), both["en"].alias("en"), X.range_upper(parameter).alias("upper"), X.one_space(F.format_string("  %s \n\t %s ", "p_name", "p_type")).alias("one_space"))


@query("""select 'type' as what, lower(r_name) as owner, r_name as name, null as detail from region union all select 'method', lower(r_name), n_name, 'Тип' || n_nationkey from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0
union all select 'property', lower(r_name), n_name, 'Вид' || n_nationkey from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 1""")
def catalog_of_help(spark, folder):
    """Types of the regions with their nations as members, out of contents and pages."""
    ship(spark)
    r, n = table(spark, folder, "region"), table(spark, folder, "nation")
    part = F.when(F.col("n_nationkey") % 2 == 0, "methods").otherwise("properties")
    toc = spark.createDataFrame([(1, 0, 0, "Прочее", "", "/objects/catalog1.html")], "id long, parent_id long, ord long, ru string, en string, html_path string")
    toc = toc.unionByName(r.select((F.col("r_regionkey") + 10).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("ru"), F.lit("").alias("en"), F.format_string("/objects/r%d.html", "r_regionkey").alias("html_path")))
    toc = toc.unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 10).cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("ru"), F.lit("").alias("en"), F.format_string("/objects/r%d/%s/n%d.html", "n_regionkey", part, "n_nationkey").alias("html_path")))
    head = '<html><body><p class="V8SH_heading">%s</p>'
    method = F.format_string(head + '<p class="V8SH_chapter">Синтаксис:</p>Ф()<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: Тип%d. Д.</body></html>', "n_name", "n_nationkey")
    other = F.format_string(head + '<p class="V8SH_chapter">Описание:</p>Тип: Вид%d. Д.</body></html>', "n_name", "n_nationkey")
    pages = r.select(F.format_string("objects/r%d.html", "r_regionkey").alias("html_path"), F.format_string(head + "</body></html>", "r_name").alias("html"))
    pages = pages.unionByName(n.select(F.format_string("objects/r%d/%s/n%d.html", "n_regionkey", part, "n_nationkey").alias("html_path"), F.when(F.col("n_nationkey") % 2 == 0, method).otherwise(other).alias("html")))
    t = help_catalog.load(toc, pages)
    types = t["types"].select(F.lit("type").alias("what"), F.col("type_lower").alias("owner"), F.col("type_name").alias("name"), F.lit(None).cast("string").alias("detail"))
    return types.unionByName(t["members"].select(F.col("kind").alias("what"), F.col("type_lower").alias("owner"), F.col("member_name").alias("name"), F.col("value_type").alias("detail")))


@query("""select c_nationkey, count(*) as n, count(distinct c_mktsegment) as kinds from customer group by c_nationkey order by n desc, c_nationkey limit 10""")
def most_findings(spark, folder):
    """The ten with most rows, as a run lists modules."""
    found = corpus.most_findings(table(spark, folder, "customer").select(F.col("c_nationkey").alias("module_id"), F.col("c_mktsegment").alias("kind")))
    return found.withColumnRenamed("module_id", "c_nationkey")


@query("""select count(distinct c_mktsegment) as enumerations, count(distinct c_nationkey) - count(distinct case when c_nationkey < 5 then c_nationkey end) as others from customer""")
def catalog_counts(spark, folder):
    """Types of a catalog that have values, and those that have none."""
    c = table(spark, folder, "customer")
    types = c.select(F.lower("c_mktsegment").alias("type_lower"), F.lit(True).alias("is_enum")).union(c.where("c_nationkey >= 5").select(F.col("c_nationkey").cast("string"), F.lit(False))).distinct()
    return A.type_counts(types)


@query("""select n_name, '# ' || n_name || ' (' || r_name || ')' || chr(10) || chr(10) || '*method*' || chr(10) || chr(10) || '`' || n_name || '(А, [Б' || n_nationkey || '])`' || chr(10) || '- `А`' || chr(10) || '- `Б' || n_nationkey || '` (optional)' || chr(10) || chr(10) || 'Returns: Тип' || n_regionkey as card
from nation join region on n_regionkey = r_regionkey""")
def method_cards(spark, folder):
    """Cards of methods as Markdown."""
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct(F.array(F.struct(F.lit("А").alias("name"), F.lit(True).alias("required")), F.struct(F.format_string("Б%d", "n_nationkey").alias("name"), F.lit(False).alias("required"))).alias("parameters"))
    rows = n.select(F.col("n_name").alias("name_ru"), F.col("r_name").alias("name_en"), F.lit("method").alias("kind"), F.array(one).alias("signatures"), F.format_string("Тип%d", "n_regionkey").alias("return_type")).collect()  # 25 rows
    return spark.createDataFrame([(r.name_ru, api.card(r)) for r in rows], "n_name string, card string")


_JOINED = 'Т = "ВЫБРАТЬ ""{n}""\n\t|ИЗ Справочник.А КАК А\n\t// {s}\n\t|" + "¦ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Б КАК Б\n\t|ПО А.Х = Б.Х ИЛИ А.У = Б.У"; Сообщить(1);'


@query(f"""with m as (select id, split_part(replace(replace('{_JOINED}', '{{n}}', id::varchar), '{{s}}', s), '¦', 1) as before from ({CUSTOMERS}))
select id as module_id, (length(before) - length(replace(before, chr(10), '')) + 1)::int as line, (length(before) - length(regexp_replace(before, '[^\n]*$', '')) + 1)::int as col, 'or_in_join_condition' as kind, 'Б' as name from m""")
def query_findings_in_modules(spark, folder):
    """Findings of query texts at their places in modules: over several lines, with comments between, doubled quotes and joined literals."""
    ship(spark)
    text = F.replace(F.replace(F.lit(_JOINED.replace("¦", "")), F.lit("{n}"), F.col("id").cast("string")), F.lit("{s}"), F.col("s"))
    modules = customers(spark, folder).select(F.col("id").alias("module_id"), text.alias("source"))
    return corpus.validate(modules, catalog(spark)).select("module_id", "line", "col", "kind", "name")
