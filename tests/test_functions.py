from pyspark.sql import functions as F

from brindle.functions import text as X


def test_confidence(spark):
    cases = [
        ("СтрНайит", "СтрНайти", "high"), ("Сообщитт", "Сообщить", "high"), ("Формат", "Формат", None), ("Формат2", "Формат", None), ("ФорматЧисла", "Формат", None), ("тФормат", "Формат", None),
        ("ФФормат", "Формат", "high"), ("ТЗСтрока", "Строка", None), ("Строкаа", "Строка", "high"), ("Мак", "Макс", "high"), ("Ма", "Макс", None), ("абвгде", "абвxyz", "low"), ("абвгд", "xyzгд", None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select("a", "b", X.confidence(F.col("a"), F.col("b")).alias("c"))
    assert {(r.a, r.b): r.c for r in df.collect()} == {(a, b): c for a, b, c in cases}


def test_names(spark):
    df = spark.createDataFrame([("Массив (Array)",), ("Без имени",), ("А (Б) (C D)",), ("Тип (Тип)",)], "t string").select("t", X.two_names(F.col("t")).alias("n"))
    assert {r.t: (r.n.ru, r.n.en) for r in df.collect()} == {"Массив (Array)": ("Массив", "Array"), "Без имени": ("Без имени", ""), "А (Б) (C D)": ("А (Б)", "C D"), "Тип (Тип)": ("Тип (Тип)", "")}


def test_range_upper_and_similarity(spark):
    df = spark.createDataFrame([("Значение1-Значение10", "Значение"), ("", "")], "a string, b string")
    rows = df.select(X.range_upper(F.col("a")).alias("n"), X.similarity(F.col("a"), F.col("b")).alias("s"), X.one_space(F.lit("a  \n b")).alias("o")).collect()
    assert [r.n for r in rows] == [10, None] and rows[1].s == 1.0 and rows[0].o == "a b"
