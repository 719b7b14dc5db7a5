from brindle import api
from brindle.sources import catalog, help_container


def page(name, *chapters):
    return f'<html><body><p class="V8SH_heading">{name}</p>' + "".join(f'<p class="V8SH_chapter">{t}</p>{b}' for t, b in chapters) + "</body></html>"


def test_catalog_from_help(spark):
    toc = [
        (1, 0, 0, "Глобальный контекст", "", "/objects/Global context.html"), (2, 1, 1, "Сообщить", "", "/objects/Global context/methods/m1.html"), (3, 1, 2, "Справочники", "", "/objects/Global context/properties/p1.html"),
        (4, 0, 3, "Системные перечисления", "", "/objects/catalog1.html"), (5, 4, 4, "Подкаталог", "", "/objects/catalog2.html"), (6, 5, 5, "Цвет", "", "/objects/color.html"), (7, 6, 6, "Красный", "", "/objects/color/properties/red.html"),
        (8, 0, 7, "Прочее", "", "/objects/catalog3.html"), (9, 8, 8, "Запрос", "", "/objects/query.html"), (10, 9, 9, "Выполнить", "", "/objects/query/methods/run.html"), (11, 9, 10, "Текст", "", "/objects/query/properties/text.html"),
        (12, 9, 11, "<Имя>", "", "/objects/query/properties/any.html"), (13, 8, 12, "Нет страницы", "", "/objects/none.html"), (14, 8, 13, "Цвет", "", "/objects/color2.html"),
    ]
    signature = [("Синтаксис:", "Ф(А)"), ("Параметры:", '<div class="V8SH_rubric">&lt;А&gt; (обязательный)</div>')]
    pages = {
        "objects/Global context/methods/m1.html": page("Сообщить (Message)", *signature), "objects/Global context/properties/p1.html": page("Справочники (Catalogs)", ("Описание:", "Тип: СправочникиМенеджер. Д."), ("Использование:", "Только чтение.")),
        "objects/color.html": page("Цвет (Color)"), "objects/color/properties/red.html": page("Красный (Red)"), "objects/query.html": page("Запрос (Query)"), "objects/color2.html": page("Оттенок (Shade)"),
        "objects/query/methods/run.html": page("Выполнить (Execute)", *signature, ("Возвращаемое значение:", "Тип: Результат. Д.")), "objects/query/properties/text.html": page("Текст (Text)", ("Описание:", "Тип: Строка. Д.")), "objects/query/properties/any.html": page("<Имя>"),
    }
    t = catalog.load(spark.createDataFrame(toc, "id long, parent_id long, ord long, ru string, en string, html_path string"), spark.createDataFrame(list(pages.items()), "html_path string, html string"))
    assert {(r.type_lower, r.is_enum) for r in t["types"].collect()} == {("цвет", True), ("запрос", False), ("оттенок", False)}
    assert {(r.type_lower, r.member_lower, r.kind, r.value_type) for r in t["members"].collect()} == {
        ("цвет", "красный", "enum_value", ""), ("цвет", "red", "enum_value", ""), ("запрос", "выполнить", "method", "Результат"), ("запрос", "execute", "method", "Результат"), ("запрос", "текст", "property", "Строка"), ("запрос", "text", "property", "Строка"),
    }
    assert [(r.method_lower, r.signatures[0].parameters[0].required) for r in t["methods"].collect()] == [("сообщить", True)]
    assert [(r.property_lower, r.type_name, r.readonly) for r in t["properties"].collect()] == [("справочники", "СправочникиМенеджер", True)]


def test_catalog_from_a_container(spark, tmp_path):
    import io
    import zipfile

    entry = lambda i, parent, kids, title, path: "{%d,%d,%d%s,{0,0,{0,0,{\"ru\",\"%s\"}},\"%s\"}}" % (i, parent, len(kids), "".join(f",{k}" for k in kids), title, path)  # noqa: E731, UP031
    toc = [entry(1, 0, [2], "Прочее", "/objects/catalog1.html"), entry(2, 1, [3, 4], "Поток", "/objects/s.html"), entry(3, 2, [], "Читать", "/objects/s/methods/r.html"), entry(4, 2, [], "Нет страницы", "/objects/s/methods/none.html")]
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("objects/s.html", page("Поток (Stream)"))
        z.writestr("objects/s/methods/r.html", page("Читать (Read)", ("Синтаксис:", "Читать()"), ("Параметры:", '<div class="V8SH_rubric">&lt;Размер&gt; (необязательный)</div>'), ("Возвращаемое значение:", "Тип: Число. Д.")))
        z.writestr("objects/unused.html", page("Лишняя"))
    data = help_container.pack({"PackBlock": help_container.deflate_block("{%d,%s}" % (len(toc), ",".join(toc))), "FileStorage": archive.getvalue()})  # noqa: UP031
    (tmp_path / "help.hbk").write_bytes(data)
    t = catalog.read(spark, str(tmp_path))
    assert [(r.type_lower, r.name_en) for r in t["types"].collect()] == [("поток", "Stream")]
    assert {(r.member_lower, r.kind, r.value_type) for r in t["members"].collect()} == {("читать", "method", "Число"), ("read", "method", "Число")}
    entries = t["types"].selectExpr("'type' as kind", "1 as kind_rank", "type_name as name_ru", "name_en", "description")
    tools = api.Tools(entries, t["members"], t["methods"], t["properties"])
    assert tools.get_member("Поток", "читать") == "# Поток.Читать (Read)\n\n*method*\n\n`Читать([Размер])`\n- `Размер` (optional)\n\nType: Число" and "no member" in tools.get_member("Поток", "read")
    assert tools.info("поток") == "# Поток (Stream)\n\n*type*\n\n- Читать (method)" and tools.get_constructors("Поток").endswith("has no constructors")
