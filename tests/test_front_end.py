import pytest
from pyspark.sql import functions as F

from brindle import fixture_queries as Q
from brindle.plans import query_rules, query_text


def read(text):
    return query_text.Reader(text)


@pytest.mark.parametrize(("text", "n"), [("ВЫБРАТЬ 1; ВЫБРАТЬ 2; УНИЧТОЖИТЬ ВТ", 3), (";;SELECT 1;;", 1), ("ВЫБРАТЬ 1 ОБЪЕДИНИТЬ ВЫБРАТЬ 2", 2)])
def test_packages(text, n):
    assert len(read(text).queries) == n


@pytest.mark.parametrize("text", ["", ";", "ГДЕ А", "ВЫБРАТЬ 1 ИЗ (ВЫБРАТЬ 2", "ВЫБРАТЬ 1 ИЗ Т(1)", "SELECT 1 FROM A LEFT B", "ВЫБРАТЬ 1 ПОМЕСТИТЬ #Т", "ВЫБРАТЬ 1 ИЗ " + "(ВЫБРАТЬ 1 ИЗ " * 40])
def test_not_understood(text):
    with pytest.raises(query_text.NotUnderstood):
        read(text)


def test_tokens():
    assert [(k, b) for k, _, b in query_text.tokens('ВЫБРАТЬ "а""б" // к\n &П 1.5 сгруппировать ПО')] == [("SELECT", 0), ("text", 15), ("param", 31), ("number", 35), ("GROUP BY", 39)]


def test_names_beside_dots():
    r = read("ВЫБРАТЬ В.Ссылка, Т.И ИЗ Справочник.А КАК В ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Б Т ПО В.Х = Т.Х И НЕ Т.Y")
    assert [f["path"] for f in r.fields] == ["В.Ссылка", "Т.И", "В.Х", "Т.Х", "Т.Y"]
    assert [s["alias"] for s in r.sources] == ["В", "Т"] and r.sources[1]["join_kind"] == "left"


def test_virtual_table_slots():
    slots = lambda t: read(f"ВЫБРАТЬ 1 ИЗ РегистрНакопления.Р.Остатки{t}").sources[0]["empty_slots"]
    assert slots("()") == [] and slots("(,)") == [True, True] and slots("(&Д, А = Б(1, 2))") == [False, False] and slots("") == []


def test_unknown_source_is_silent(spark):
    parsed = Q.parsed_texts(spark)
    kinds = {r.kind for r in query_rules.check(parsed).select("kind").distinct().collect()}
    assert "physical_register_table" not in kinds and "join_on_unindexed_field" not in kinds and "or_in_join_condition" in kinds


def test_or_finding_position(spark):
    text = "ВЫБРАТЬ 1\nИЗ Справочник.А КАК А\nЛЕВОЕ СОЕДИНЕНИЕ Справочник.Б КАК Б ПО А.Х = Б.Х ИЛИ А.У = Б.У"
    parsed = query_text.parse(spark.createDataFrame([("t", text)], "text_id string, text string"))
    (row,) = query_rules.check(parsed).where(F.col("kind") == "or_in_join_condition").collect()
    assert text.encode()[: row.offset].decode().count("\n") == 2
