"""A small platform catalog."""

from brindle.plans import module_rules as R


def catalog(spark):
    types = spark.createDataFrame([("результатзапроса", "РезультатЗапроса", False), ("цвет", "Цвет", True), ("структура", "Структура", False), ("запрос", "Запрос", False), ("справочникменеджер.<имя справочника>", "СправочникМенеджер.<Имя справочника>", False), ("справочникименеджер", "СправочникиМенеджер", False)], "type_lower string, type_name string, is_enum boolean")
    members = spark.createDataFrame(
        [("цвет", "красный", "Красный", "enum_value", None), ("цвет", "red", "Red", "enum_value", None), ("запрос", "выполнить", "Выполнить", "method", "`РезультатЗапроса`"), ("справочникименеджер", "типвсессылки", "ТипВсеСсылки", "method", None), ("результатзапроса", "выбрать", "Выбрать", "method", "ВыборкаИзРезультатаЗапроса")]
        + [("справочникменеджер.<имя справочника>", x.lower(), x, "method", None) for x in ("НайтиПоКоду", "НайтиПоРеквизиту", "ПустаяСсылка")],
        "type_lower string, member_lower string, member_name string, kind string, value_type string",
    )
    one = [([("Текст", True)],)]
    methods = spark.createDataFrame([("сообщить", "Сообщить", one), ("макс", "Макс", [([("Значение", True)],)]), ("мин", "Мин", [([("Значение", True)],)]), ("продолжитьвызов", "ПродолжитьВызов", one), ("стрнайти", "СтрНайти", [([("А", True), ("Б", True), ("В", False)],)]), ("сстранное", "ССтранное", [])], "method_lower string, method_name string, signatures array<struct<parameters: array<struct<name: string, required: boolean>>>>").selectExpr("*", "'' as return_type")
    properties = spark.createDataFrame([("справочники", True, "`СправочникиМенеджер`", "global"), ("рабочаядата", False, "Дата", "global"), ("документы", True, "`ДокументыМенеджер`", "global"), ("параметры", True, "Структура", "form")], "property_lower string, readonly boolean, type_name string, scope string")
    return R.Catalog(types, members, methods, properties)
