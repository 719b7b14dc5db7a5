import re

import pytest
from pyspark.sql import functions as F

from brindle import corpus
from brindle.functions import text as X
from brindle.operators import facts
from brindle.plans import module_rules as R
from brindle.session import cut
from tests_catalog import catalog


def rows(source, kind=None):
    return [r for r in facts.Module(source).rows if kind is None or r[0] == kind]


def test_calls_and_arguments():
    got = [(r[1], r[8]) for r in rows('А(); Б(1); В(1, , 3); Г(Д(1, 2), "а, б"); Е(,); М.Метод(1); Новый Тип(1);', "call")]
    assert got == [("А", 0), ("Б", 1), ("В", 3), ("Г", 2), ("Д", 2), ("Е", 2)]


def test_heads_members_managers():
    source = "Х = Справочники.Товары.НайтиПоКоду(1); М.Метод(); Т.Свойство = 1;"
    assert [(r[1], r[2], r[9]) for r in rows(source, "dot")] == [("Справочники", "Товары", False), ("М", "Метод", True), ("Т", "Свойство", False)]
    assert [(r[1], r[3], r[2], r[8]) for r in rows(source, "manager_call")] == [("Справочники", "Товары", "НайтиПоКоду", 1)]
    assert [(r[1], r[9]) for r in rows(source, "assign")] == [("Х", False)]


def test_conditions_are_no_assignments():
    assert [r[1] for r in rows("Если А = Б Тогда В = 1; ИначеЕсли Г = 2 Тогда Д = 3; КонецЕсли; Пока Е = 1 Цикл Ж = 2; КонецЦикла;", "assign")] == ["В", "Д", "Ж"]


def test_procedures_and_positions():
    source = "&НаСервереБезКонтекста\nПроцедура Проба(А, Знач Б = -1) Экспорт\n\tПерем В, Г;\n\tДля Каждого С Из А Цикл К = 1; КонецЦикла;\nКонецПроцедуры\n"
    (p,) = rows(source, "proc")
    assert p[1] == "Проба" and p[9] is True and p[10] == "НаСервереБезКонтекста,процедура,а,б" and source.encode()[p[4] : p[7]].decode().endswith("КонецПроцедуры")
    assert [(r[1], r[9]) for r in rows(source, "assign")] == [("В", True), ("Г", True), ("К", False)] and [r[1] for r in rows(source, "loop")] == ["С"]
    assert [(r[1], r[5], r[6]) for r in rows(source, "loop")] == [("С", 4, 14)]


def test_query_texts_and_spans():
    source = 'Т = "ВЫБРАТЬ\n\t|  ""а""\n\t// примечание\n\t|ИЗ Б" + " ГДЕ В"; Х = "не запрос";'
    (q,) = rows(source, "query")
    assert q[1] == 'ВЫБРАТЬ\n  "а"\nИЗ Б ГДЕ В'
    spans = [tuple(map(int, x.split(":"))) for x in q[10].split(",")]
    assert all(q[1].encode()[o : o + n] == source.encode()[m : m + n] for o, m, n in spans) and sum(n for _, _, n in spans) == len(q[1].encode())
    offset, _, length = spans[-1]
    assert q[1].encode()[offset : offset + length].decode() == " ГДЕ В"


def test_forms_that_other_parsers_stumble_over():
    """Letters like ё, no-break spaces, a blank behind ? and #, raising without an argument, negative defaults."""
    assert [(r[1], r[6]) for r in rows("\u00a0Ёлка(1);\nЗелёный = Учёт.Чёрный(2);", "call")] == [("Ёлка", 2)] and [r[2] for r in rows("Зелёный = Учёт.Чёрный(2);", "dot")] == ["Чёрный"]
    assert rows("Х = ? (А, Б, В);", "call") == [] and [r[1] for r in rows("Попытка\n А();\nИсключение\n ВызватьИсключение;\nКонецПопытки; Б();", "call")] == ["А", "Б"]
    assert [r[1] for r in rows("# Если Сервер() Тогда\nА();\n# КонецЕсли\n#Область Имя()\nБ();", "call")] == ["А", "Б"]
    (p,) = rows("Функция Ф(А = -1, Знач Б = - 2.5, В = Неопределено) Экспорт\nКонецФункции", "proc")
    assert p[10].split(",")[2:] == ["а", "б", "в"] and p[9] is True


def test_deleted_and_binary():
    assert [r[1] for r in rows("#Удаление\nА();\n#КонецУдаления\nБ();", "call")] == ["Б"]
    assert rows("А();\0") == [] and rows("") == [] and rows('"не закрыто') == []


def source(spark, collections=("Catalogs", "CommonModules"), variables=("параметрыприложения",)):
    """Knows nothing of collections that aren't listed; None: of none."""
    objects = spark.createDataFrame([("Catalogs", "номенклатура", "Номенклатура"), ("CommonModules", "общегоназначения", "ОбщегоНазначения")], "collection string, name_lower string, name string")
    rest = [(c,) for c, _ in R.MANAGERS.values() if c not in (collections or ())]
    names = spark.createDataFrame([(v,) for v in variables], "name_lower string") if variables is not None else None
    exports, methods = (spark.createDataFrame([(x,)], "method_lower string") for x in ("глобальная", "загрузить"))
    return R.Source(objects if collections else None, spark.createDataFrame(rest, "collection string"), exports, names, methods=methods)


def findings(spark, cases, s=None, **options):
    """Findings of each case: a text, or (text, path, attributes of its form or None)."""
    cases = [c if isinstance(c, tuple) else (c, None, None) for c in ([cases] if isinstance(cases, str) else cases)]
    modules = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "module_id long, source string, path string")
    known = spark.createDataFrame([(i, a) for i, (_, _, a) in enumerate(cases) if a is not None], "module_id long, names array<string>")
    out = [[] for _ in cases]
    for r in R.validate(modules, catalog(spark), s, attributes=known, **options).collect():
        out[r.module_id].append((r.kind, r.confidence, r.name, r.suggestion))
    return out


def test_platform_rules(spark):
    text = "&НаКлиэнте\nПроцедура П()\n Сообщит(1);\n СтрНайти(1);\n А = Новый Запросс;\n Б = Цвет.Красны;\n В = Цвет.Red;\n Запрос.Выполнит();\n П();\nКонецПроцедуры"
    assert findings(spark, text)[0] == [
        ("unknown_directive", "high", "НаКлиэнте", "НаКлиенте"), ("unknown_global_method", "high", "Сообщит", "Сообщить"), ("wrong_argument_count", "high", "СтрНайти", None), ("unknown_new_type", "low", "Запросс", None),
        ("unknown_enum_value", "high", "Красны", "Красный"), ("unknown_type_member", "low", "Выполнит", "Выполнить"),
    ]
    assert all(c == "high" for _, c, _, _ in findings(spark, text, profile="strict")[0])


FORM, COMMON, OBJECT = "Catalogs/Т/Forms/Ф/Ext/Form/Module.bsl", "CommonModules/М/Ext/Module.bsl", "Catalogs\\Т\\Ext\\ObjectModule.bsl"


def kinds(spark, cases, s=None, **options):
    return [[k for k, *_ in found] for found in findings(spark, cases, s, **options)]


def test_configuration_rules(spark):
    text = "А = Справочники.Нету; Б = Справочники.Номенклатура; В = Справочники.ТипВсеСсылки(); ОбщегоНазначения.Ф(); НетМодуля.Ф(); ПараметрыПриложения.Вставить(1); НетМодуля2.Свойство = 1; Справочники.Номенклатура.НайтиПоКодуу(1); Справочники.Номенклатура.Загрузить(); Справочники.Номенклатура.ПустаяСсылка(); НеОбъявлена(); Глобальная(); Загрузить(); Справочники.Номенклатур.Х();"
    assert findings(spark, text, source(spark))[0] == [
        ("unknown_metadata_object", "high", "Нету", None), ("unknown_common_module", "high", "НетМодуля", None), ("unknown_manager_method", "high", "НайтиПоКодуу", "НайтиПоКоду"), ("undeclared_method", "high", "НеОбъявлена", None),
        ("undeclared_method", "low", "Загрузить", None), ("unknown_metadata_object", "high", "Номенклатур", "Номенклатура"),
    ]


def test_unknown_answers_are_silent(spark):
    """A collection that a source can tell of has no objects if none is listed; one that it can't tell of may have any."""
    text, bound = "А = Справочники.Нету; НетМодуля.Ф();", "Процедура П(НетМодуля) Экспорт\n НетМодуля.Ф(); Справочники = 1; А = Справочники.Нету;\nКонецПроцедуры"
    assert kinds(spark, text, source(spark, collections=None)) == [[]]
    assert kinds(spark, text, source(spark, variables=None)) == [["unknown_metadata_object"]]
    assert kinds(spark, [bound, "А = Документы.Нету;"], source(spark)) == [["shadowed_context_name"], []]
    s = source(spark, collections=("Documents", "Catalogs"))
    s.suggests = False
    assert findings(spark, ["А = Документы.Нету;", "А = Справочники.Номенклатур;"], s) == [[("unknown_metadata_object", "high", "Нету", None)], [("unknown_metadata_object", "high", "Номенклатур", None)]]


def test_paths_and_forms(spark):
    text, inside = "НетМодуля.Ф(); Объект.Записать(); ЭтаФорма.Закрыть();", "&НаКлиенте\nПроцедура П()\n Параметры.Вставить(1);\nКонецПроцедуры"
    cases = [(text, None, None), (text, COMMON, None), (text, FORM, []), (text, FORM, None), (text, OBJECT, None), (text, FORM, ["нетмодуля"]), (inside, FORM, [])]
    assert kinds(spark, cases, source(spark)) == [["unknown_common_module"]] * 3 + [[]] * 4


def test_extensions_declare_elsewhere(spark):
    cases = ["НеОбъявлена();", '&Вместо("Ф")\nПроцедура П()\n НеОбъявлена(); ПродолжитьВызов(1, 2, 3);\nКонецПроцедуры', "Макс(1, 2, 3); Мин(); СтрНайти(1, 2, 3, 4);"]
    assert kinds(spark, cases) == [["undeclared_method"], [], ["wrong_argument_count", "wrong_argument_count"]]


def test_owner_exports_and_health(spark):
    s = source(spark)
    s.owner_exports = spark.createDataFrame([(0, "необъявлена")], "module_id long, method_lower string")
    assert findings(spark, "НеОбъявлена(); Другая();", s) == [[("undeclared_method", "high", "Другая", None)]]
    s.healthy = False
    with pytest.raises(RuntimeError):
        findings(spark, "А();", s)


def test_shadowed_context_names(spark):
    inside = "&{}\nПроцедура П({})\n {}Параметры = 1;\nКонецПроцедуры"
    form, one = inside.format("НаСервере", "", ""), "Процедура А()\n Перем Справочники; Справочники = 1;\nКонецПроцедуры\nПроцедура Б()\n Справочники = 2;\nКонецПроцедуры"
    cases = [
        ((form, FORM, None), 1), ((form, None, None), 0), ((form, COMMON, None), 0), ((form, FORM, ["параметры"]), 0), ((inside.format("НаСервереБезКонтекста", "", ""), FORM, None), 0),
        ((inside.format("НаСервере", "Параметры", ""), FORM, None), 0), (("Процедура П()\n Параметры = 1;\nКонецПроцедуры", FORM, None), 0),  # no directive: no managed form
        # A declaration is itself an attempt; what it declares may be assigned to in its procedure, or everywhere if it stands outside.
        ((inside.format("НаСервере", "", "Перем Параметры; "), FORM, None), 1), ((one, None, None), 2), (("Перем Справочники;\n" + one, None, None), 2),
        (("Справочники = 1; РабочаяДата = 2;", None, None), 1), (("Справочники = 1;", FORM, None), 0), (("Справочники = 1;", FORM, []), 1), ((inside.format("НаСервереБезКонтекста", "", "Справочники = 1; "), FORM, None), 1),
    ]
    assert kinds(spark, [c for c, _ in cases]) == [["shadowed_context_name"] * n for _, n in cases]


def test_types_of_variables_hold_in_their_procedure(spark):
    text = "Процедура А()\n З = Новый Запрос;\n З.Выполнит();\nКонецПроцедуры\nПроцедура Б(З)\n З.Выполнит();\nКонецПроцедуры"
    chain = "З = Новый Запрос;\nР = З.Выполнить();\nР.Выбрат();\n// @type Цвет\nЦ = Ф;\nЦ.Синий = 1;"
    assert findings(spark, [text, chain], level=2) == [[("unknown_type_member", "low", "Выполнит", "Выполнить")], [("unknown_enum_value", "high", "Синий", None)]]
    assert kinds(spark, [text, chain]) == kinds(spark, [text, chain], level=2, profile="strict") == [[], []]
    assert kinds(spark, chain, level=3) == [["unknown_type_member", "unknown_enum_value"]]


def test_positions_are_those_of_members(spark):
    modules = spark.createDataFrame([(1, "Перем А;\n А = Цвет.\n  Синий; НеОбъявлена();")], "module_id long, source string")
    assert [(r.line, r.col, r.name) for r in R.validate(modules, catalog(spark)).collect()] == [(3, 3, "Синий"), (3, 10, "НеОбъявлена")]


def test_modules_are_parsed_once(spark):
    modules = spark.createDataFrame([(1, "А();")], "module_id long, source string")
    plan = R.check(facts.extract(modules), catalog(spark), source(spark))._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan  # they are read from the table that was cut off


def test_paths_of_descriptions(spark):
    d = spark.createDataFrame([("a/CommonModules/М.xml",), ("a/CommonModules/М/Ext/Module.bsl",)], "p string").select(X.module_of_xml(F.col("p")).alias("m"), X.xml_of_module(F.col("p")).alias("x"))
    assert [tuple(r) for r in d.collect()] == [("a/CommonModules/М/Ext/Module.bsl", None), (None, "a/CommonModules/М.xml")]


def broadcast_tables(df):
    """Lines of a plan under a broadcast that read modules, or facts and texts that were kept; catalogs may be broadcast."""
    lines, out, inside = df._jdf.queryExecution().executedPlan().toString().splitlines(), [], None
    for line in lines:
        depth = len(re.match(r"[\s:+-]*", line)[0])
        inside = None if inside is not None and depth <= inside else inside
        inside = depth if inside is None and "BroadcastExchange" in line else inside
        if inside is not None and re.search(r"(FileScan|Scan ExistingRDD).*(module_id|text_id)", line):
            out.append(line)
    return out


def test_large_tables_are_not_broadcast_by_a_guess(spark, tmp_path):
    # Files of one text many times are small, and so is Spark's guess of what is made of them.
    source = "Т = \"ВЫБРАТЬ 1 ИЗ Справочник.А КАК А ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Б КАК Б ПО А.Х = Б.Х ИЛИ А.У = Б.У\"; Сообщить(1);"
    spark.range(20000).select(F.col("id").alias("module_id"), F.lit(source).alias("source")).write.parquet(f"{tmp_path}/modules")
    modules = spark.read.parquet(f"{tmp_path}/modules")
    found = cut(facts.extract(modules))
    assert broadcast_tables(found.groupBy("module_id").agg(F.count("*").alias("n")).join(found, "module_id")) == []
    got = corpus.validate(modules, catalog(spark))
    assert broadcast_tables(got) == []
    assert got.groupBy("kind").count().collect() == [("or_in_join_condition", 20000)]
