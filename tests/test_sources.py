import io
import json
import sqlite3
import struct
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle import api, config, corpus, fixture_queries
from brindle.operators import inference
from brindle.plans import module_rules
from brindle.sources import dump, help_container, help_pages, html, payloads, remote, sqlite_index
from brindle.streaming import watch
from tests_catalog import catalog

TOC = '﻿{4,{1,0,2,2,3,{0,0,{0,0,{"ru","Корень ""А"""},{"en","Root"}},"/a.html"}},{2,1,0,{0,0,{0,0,{"ru","Лист"}},"/b.html"}},{3,1,0,{0,0,{0,0},"/c.html"}},{0,0,0,{0,0,{0,0},""}}}'


def size(n: int) -> bytes:
    return b"%08x\r" % n


def container(**bodies: bytes) -> bytes:
    head = bytes(18) + size(12 * len(bodies)) + size(12 * len(bodies)) + bytes(11)
    at = len(head) + 12 * len(bodies)
    records, tail = b"", b""
    for name, body in bodies.items():
        raw = name.encode("utf-16-le")
        h = bytes(2) + size(len(raw) + 24) + bytes(40) + raw
        b = bytes(2) + size(len(body)) + bytes(20) + body
        records += struct.pack("<iii", at, at + len(h), 2**31 - 1)
        tail += h + b
        at += len(h) + len(b)
    return head + records + tail


def packed(text: str) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return b"PK\x03\x04" + bytes(22) + struct.pack("<HH", 1, 0) + b"x" + c.compress(text.encode()) + c.flush()


def test_container_and_contents(spark, tmp_path):
    data = container(PackBlock=packed(TOC), Другое=b"abc")
    assert help_container.entities(data)["Другое"] == b"abc"
    (tmp_path / "a.hbk").write_bytes(data)
    (tmp_path / "b.hbk").write_bytes(b"no container")
    rows = {(r.id, r.parent_id, r.ord, r.ru, r.en, r.html_path) for r in help_container.read_contents(spark, str(tmp_path)).collect()}
    assert rows == {(1, 0, 0, 'Корень "А"', "Root", "/a.html"), (2, 1, 1, "Лист", "", "/b.html"), (3, 1, 2, "", "", "/c.html")}
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.html", "<p>")
    assert list(help_container.pages(z.getvalue(), ["/a.html", "/none.html"])) == [("/a.html", "<p>")]
    with pytest.raises(help_container.BadContainer):
        help_container.entities(data[:40])


PAGE = (
    '<html><body><p class="V8SH_heading">Найти (Find)</p><p class="V8SH_chapter">Вариант синтаксиса: По строке</p><p class="V8SH_chapter">Параметры:</p>'
    '<div class="V8SH_rubric"><p>&lt;Строка&gt; (обязательный)</p></div><div class="V8SH_rubric">&lt;Число1-Число3&gt; (необязательный)</div>'
    '<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: <a href="v8help://x">Число</a>. Место.<p class="V8SH_chapter">Описание:</p><b>Ищет</b> строку.<hr>'
    '<p class="V8SH_chapter">Пример:</p>А = 1;<br>Б = 2;<p class="V8SH_chapter">См. также:</p><a href="v8help://y">Тип , метод</a></body></html>'
)


def test_pages(spark):
    row = help_pages.parse(spark.createDataFrame([("/methods/a.html", PAGE), ("/x.html", None)], "html_path string, html string")).where("html_path like '/m%'").first()
    assert (row.name_ru, row.name_en, row.return_type, row.description, row.example) == ("Найти", "Find", "`Число`", "**Ищет** строку.", "А = 1;\nБ = 2;")
    assert [(s.name, [(p.name, p.required) for p in s.parameters]) for s in row.signatures] == [("По строке", [("Строка", True), ("Число1-Число3", False)])]
    assert [(r.name, r.href) for r in row.related] == [("Тип, метод", "v8help://y")]
    assert html.text_of("<p>a&amp;b\n <i>c</i></p>") == "a&b c" and html.markdown("<ul><li>a<ul><li>b</ul></ul><h2>t</h2>") == "* a\n  * b\n## t"
    assert [t for t, _ in html.chapters("<body>a<hr>b<p class='V8SH_chapter'>T <i>x</i></p>c</body>")] == ["", "", "T x"]


# A title that was cut off inside a reference, references that only begin like one, ampersands of scripts and links, and a page with the sign that stands for ampersands.
REFERENCES = [
    ("<title>a&amp;&lt;b&amp</title><p>c", "a&<b&ampc", "a&<b&amp\nc"), ("x &ampy; &notit; &lt &gt;&copy", "x &ampy; &notit; &lt >&copy", "x &ampy; &notit; &lt >&copy"), ("&amp;lt; &amp;amp", "&lt; &amp", "&lt; &amp"),
    ('<a href="/?a=1&amp;copy=2&lt">t&#33;&#33&#x21;</a>', "t!&#33!", "[t!&#33!](/?a=1&copy=2&lt)"), ("<script>a&&b&amp;&amp</script>&", "a&&b&amp;&amp&", "a&&b&amp;&amp&"), ("\ue000&\ue001&amp", "\ue000&\ue001&amp", "\ue000&\ue001&amp"),
]


def test_references_end_with_a_semicolon():
    for page, text, markdown in REFERENCES:
        assert (html.text_of(page), html.markdown(page)) == (text, markdown)
    ((_, body),) = html.chapters("<body><b title='&lt'>a&amp</b></body>")
    assert html.text_of(body) == "a&amp"


@pytest.mark.parametrize("name", ["html_text", "html_markdown"])
def test_pages_with_cut_off_references(spark, tmp_path, name):
    pages = [(1, "u", "<title>Q&amp;A and&amp</title><p>x&lt;y</p>"), (2, "u", '<h1>a &copy; &copy</h1><a href="/a&amp;b&amp">c&lt</a>'), (3, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, fixture_queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(fixture_queries.SQL[name]).fetchall())


# Spaces that HTML doesn't collapse, inside and at the ends, spaces that it does, and pages of nothing else; numbers that a double can't hold, beside a page without one.
PAGES = {
    "spaces": [(1, "u", "<p>a\xa0\xa0b\u2003c\x0bd\x1c\u2028e\x85 f</p>\u3000"), (2, "u", "\xa0 \n\xa0"), (3, "u", "\u2028<b> x </b>\u2028"), (4, "u", "\ta\r\n\f b\n"), (5, "u", "\u202f\n\x1fa \u200b\u2007")],
    "numbers": [(None, "u", "<p>x"), (2**53 + 1, "u", "<p>y"), (-(2**63), "u", None), (1, "u", ""), (1, "u", "z")],
}


@pytest.mark.parametrize("odd", PAGES)
def test_text_of_odd_pages(spark, tmp_path, odd):
    spark.createDataFrame(PAGES[odd], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = map(tuple, fixture_queries.QUERIES["html_text"](spark, str(tmp_path)).collect())
    assert sorted(got, key=repr) == sorted(con.execute(fixture_queries.SQL["html_text"]).fetchall(), key=repr)


def answer(inner, **outer):
    return json.dumps({"result": {"content": [{"text": json.dumps({"result": inner} | outer)}]}})


def test_payloads(spark):
    rows = [["Справочник.А"], ["Б"]]
    cases = {
        "plain": answer({"rows": rows}), "stream": "event: message\ndata:\ndata: " + answer({"rows": rows}) + "\n\n", "cut": answer({"rows": rows, "rows_truncated": 1}), "cut2": answer({"rows": rows, "truncated": True}),
        "cut3": answer({"rows": rows}, response_truncated=True), "cut4": answer({"rows": rows, "rows_elided_already_delivered": 3}), "junk": "oops",
    }
    df = spark.createDataFrame(list(cases.items()), "k string, payload string").select("k", payloads.object_names(F.col("payload")).alias("names"))
    assert {r.k: r.names for r in df.collect()} == {k: ["А", "Б"] if k in ("plain", "stream") else None for k in cases}
    stats = spark.createDataFrame([(answer({"repo": "a"}),), (answer({"message": "Неизвестный repo: b"}),), ("{}",)], "p string").select(payloads.repository_answer(F.col("p"), "a").alias("s"))
    assert [r.s for r in stats.collect()] == ["known", "unknown", "unrecognized"]
    lines = spark.createDataFrame([("Перем А Экспорт, Б, В Экспорт; // x",), ("// Перем Г Экспорт;",)], "l string").select(payloads.global_variables(F.col("l")).alias("v"))
    assert [r.v for r in lines.collect()] == [["А", "В"], []]
    pages = spark.createDataFrame([(0, answer({"rows": rows})), (1, answer({"rows": [["В"]]}))], "page int, payload string")
    assert {(r.name, r.complete) for r in payloads.paged(spark, pages, 2).collect()} == {("А", True), ("Б", True), ("В", True)}


def test_sqlite(spark, tmp_path):
    import zstandard

    path = tmp_path / "i.db"
    with sqlite3.connect(path) as con:
        con.execute("create table f(id integer, b blob)")
        con.executemany("insert into f values (?, ?)", [(1, zstandard.compress("текст".encode())), (2, b"broken"), (3, None)])
    df = sqlite_index.decoded(sqlite_index.read(spark, str(path), "select id, b from f", "id long, b binary"), "b")
    assert {r.id: r.text for r in df.collect()} == {1: "текст", 2: None, 3: None}


XML = "<M><AccumulationRegister><Properties><RegisterType>Balance</RegisterType></Properties><ChildObjects><Resource><Properties><Name>Р</Name></Properties></Resource><Dimension><Properties><Name>Склад</Name><Indexing>Index</Indexing></Properties></Dimension><Attribute><Properties><Name>А</Name><Indexing>DontIndex</Indexing></Properties></Attribute><TabularSection><ChildObjects><Attribute><Properties><Name>Нет</Name></Properties></Attribute></ChildObjects></TabularSection></ChildObjects></AccumulationRegister></M>"


def test_dump(spark, tmp_path):
    root = tmp_path / "dump"
    files = {
        "base/CommonModules/Общий/Ext/Module.bsl": "Функция Ф(А) Экспорт\nКонецФункции\nПроцедура П()\nКонецПроцедуры", "base/CommonModules/Общий.xml": "<x><Global>true</Global></x>", "base/Catalogs/Товары/Forms/Ф/Ext/Form/Module.bsl": "&Перед(\"А\")\nПроцедура Б()\nКонецПроцедуры",
        "external/О/Form/Ф/Form.obj.bsl": "// x", "base/AccumulationRegisters/Остатки.xml": XML, "base/Catalogs/Сломан.xml": "<a><Attribute><Properties><Name>Я</Name></Properties></Attribute><b", "Ext/ManagedApplicationModule.bsl": "Перем Г Экспорт; Перем Д;", ".git/x.bsl": "Процедура Х()\nКонецПроцедуры",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    t = dump.build(spark, str(root))
    m = {r.path: (r.scope, r.collection, r.object_name, r.module_type, r.is_global, r.is_extension, r.owner_path) for r in t["modules"].collect()}
    assert m["base/CommonModules/Общий/Ext/Module.bsl"] == ("base", "CommonModules", "Общий", "Module", True, False, None)
    assert m["base/Catalogs/Товары/Forms/Ф/Ext/Form/Module.bsl"] == ("base", "Catalogs", "Товары", "Form", False, True, None)
    assert m["external/О/Form/Ф/Form.obj.bsl"][-1] == "external/О/ExternalDataProcessor.obj.bsl" and len(m) == 4
    assert {(r.name, r.is_function, r.is_export) for r in t["methods"].collect()} == {("Ф", True, True), ("П", False, False), ("Б", False, False)}
    assert {(r.name_lower, r.field, r.kind, r.indexing) for r in t["object_fields"].collect()} == {("остатки", "Р", "resource", None), ("остатки", "Склад", "dimension", "Index"), ("остатки", "А", "attribute", None), ("сломан", "Я", "attribute", None)}
    assert {(r.name, r.register_type) for r in t["objects"].where("collection != 'CommonModules'").collect()} == {("Остатки", "Balance"), ("Сломан", None)}
    assert [r.name for r in t["global_vars"].collect()] == ["Г"] and [r.name_lower for r in dump.grep_variables(spark, str(root)).collect()] == ["г"]
    folder = str(tmp_path / "out")
    assert dump.health(spark, folder, 0.0)["status"] == "no index"
    dump.publish(t, folder, "1")
    with pytest.raises(ZeroDivisionError):  # a build that fails changes nothing
        dump.publish(t | {"global_vars": 1 // 0}, folder, "2")
    assert dump.load(spark, folder)["meta"].first().version == "1" and dump.load(spark, folder)["objects"].count() == t["objects"].count()
    told = dump.health(spark, folder, 0.0)
    assert told["status"] == "ok" and told["schema_version"] == dump.SCHEMA_VERSION and told["index"]["modules"] == 4 and told["uptime_seconds"] > 10**9
    s = module_rules.preloaded(dump.load(spark, folder))
    assert {r.method_lower for r in s.exports.collect()} == {"ф"} and {r.method_lower for r in s.methods.collect()} == {"ф", "п", "б"}
    c = catalog(spark)
    entries = spark.createDataFrame([("type", 1, "Цвет", "Color", "Цвета")], "kind string, kind_rank int, name_ru string, name_en string, description string")
    tools = api.Tools(entries, c.members, c.methods, c.properties, catalog=c, sources={"a": s}, roots={"a": (str(root), folder)})
    got = tools.validate_module(code="А = Справочники.Товары1; Ф(); Б();", repo="a", level=7)
    assert [(e["kind"], e["confidence"], e["name"]) for e in got["errors"]] == [("unknown_metadata_object", "high", "Товары1"), ("undeclared_method", "low", "Б")] and got["level"] == 3 and not got["valid"]
    assert tools.validate_module(source="Сообщить(1);")["valid"] and json.loads(tools.as_json("validate_enum", type_name="Цвет", value="red"))["valid"]
    for bad in ({}, {"code": "", "text": ""}, {"nope": ""}, {"code": "", "repo": "b"}, {"code": "", "profile": "x"}):
        with pytest.raises(ValueError):
            tools.validate_module(**bad)
    (root / "base/CommonModules/Общий/Ext/Module.bsl").write_text("Функция Ф2() Экспорт\nКонецФункции", encoding="utf-8")
    built = tools.rebuild_symbol_index("a")
    assert built["status"] == "ok" and dump.load(spark, folder)["meta"].first().version == built["version"] and {r.method_lower for r in tools.sources["a"].exports.collect()} == {"ф2"}
    with pytest.raises(ZeroDivisionError):
        tools.rebuild_symbol_index("a", lambda spark, root: 1 // 0)
    assert {r.method_lower for r in tools.sources["a"].exports.collect()} == {"ф2"} and not tools.building
    tools.building.add("a")
    assert tools.rebuild_symbol_index("a")["status"] == "already building"


def test_remote_source(spark):
    answers = {"get_stats": answer({"repo": "a"}), "sql": [answer({"rows": [[f"Справочник.О{i:03}"] for i in range(400)]}), answer({"rows": [["Справочник.Я"]]})]}
    asked = []

    def post(tool, options):
        asked.append(options.get("query", tool))
        return answers[tool] if tool != "sql" else answers["sql"]["OFFSET 400" in options["query"]] if "Catalog'" in options["query"] else answer({"rows": [], "truncated": True})

    r = remote.Remote(post, "a")
    objects, unknown = r.object_table(spark, {"Catalogs": "Catalog", "Documents": "Document"})
    assert objects.count() == 401 and [x.collection for x in unknown.collect()] == ["Documents"] and objects.where("name_lower = 'я'").count() == 1
    n = len(asked)
    assert r.objects("Catalog") and len(asked) == n and r.healthy  # answers are kept
    with pytest.raises(ValueError):
        remote.Remote(lambda *a: answer({"message": "Неизвестный repo: b. Есть: a"}), "b")
    assert remote.Remote(lambda *a: "odd", "b").healthy

    def broken(*a):
        raise OSError

    assert not remote.Remote(broken, "a").healthy


def test_sqlite_by_key_ranges(spark, tmp_path):
    path = tmp_path / "k.db"
    with sqlite3.connect(path) as con:
        con.execute("create table f(id integer, x text)")
        con.executemany("insert into f values (?, ?)", [(i, str(i)) for i in range(3, 40, 3)] + [(None, "none")])
    df = sqlite_index.read(spark, str(path), "select id, x from f", "id long, x string", "id", 5)
    assert df.rdd.getNumPartitions() == 5 and {r.x for r in df.collect()} == {str(i) for i in range(3, 40, 3)} | {"none"} and df.count() == 14


def test_inference_with_a_large_catalog(spark, monkeypatch):
    c = catalog(spark)
    modules = spark.createDataFrame([(i, f"З{i} = Новый Запрос;\nР = З{i}.Выполнить();\nЦ = Цвет.Red;\nЧ = Макс(1);") for i in range(5)], "module_id long, source string")
    methods, types = c.methods.selectExpr("method_lower", "if(method_lower = 'макс', 'Цвет', '') as return_type"), c.types
    want = {tuple(r) for r in inference.infer(modules, types, methods, c.members).collect()}
    monkeypatch.setattr(inference, "MOST", 1)
    assert {tuple(r) for r in inference.infer(modules, types, methods, c.members).collect()} == want and len(want) == 20


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('default_validation_level = 9\n[[symbol_sources]]\nkind = "lite"\nrepo = "a"\npath = "x"\n')
    assert config.load(str(p)).default_validation_level == 3 and list(config.load(str(p)).sources()) == ["a"] and config.load(None).sources() == {}
    for bad in ("nope = 1", '[symbol_source]\nkind = "lite"', '[symbol_source]\nkind = "lite"\npath = "x"\n[[symbol_sources]]\nkind = "lite"\nrepo = "a"\npath = "x"', '[[symbol_sources]]\nkind = "lite"\npath = "x"'):
        p.write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(p))


def test_inference(spark):
    source = "Процедура П()\n З = Новый Запрос;\n Р = З.Выполнить();\n Ц = Цвет.Красный;\n Н = Нечто.А;\n // @type Структура\n Х = Что();\nКонецПроцедуры\n"
    types = spark.createDataFrame([("запрос", False), ("результат", False), ("цвет", True), ("структура", False)], "type_lower string, is_enum boolean")
    methods = spark.createDataFrame([("что", "Произвольный, `Запрос`")], "method_lower string, return_type string")
    members = spark.createDataFrame([("запрос", "выполнить", "`Результат`, Неопределено")], "type_lower string, member_lower string, value_type string")
    get = lambda level: {r.name_lower: r.type_lower for r in inference.infer(spark.createDataFrame([(1, source)], "module_id long, source string"), types, methods, members, level).collect()}
    assert get(3) == {"з": "запрос", "р": "результат", "ц": "цвет", "х": "структура"} and get(2) == {"з": "запрос", "ц": "цвет", "х": "структура"}
    assert inference.chain("А.Б(1, (2)).В") == [("а", False), ("б", True), ("в", False)] and inference.chain("А + Б") is None


def test_corpus_and_tools(spark, tmp_path):
    source = 'Сообщит(1);\nТ = "ВЫБРАТЬ 1 ИЗ Справочник.А КАК А\n|ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Б КАК Б\n|ПО А.Х = Б.Х ИЛИ А.У = Б.У";\n'
    modules = spark.createDataFrame([(1, source), (2, "А = 1;"), (3, None)], "module_id long, source string")
    c = catalog(spark)
    found = corpus.validate(modules, c)
    assert {(r.module_id, r.line, r.col, r.kind) for r in found.collect()} == {(1, 1, 1, "unknown_global_method"), (1, 3, 2, "or_in_join_condition")}
    assert tuple(corpus.totals(modules, found).first()) == (3, 1, 2) and [r.n for r in corpus.by_kind(found).collect()] == [1, 1]
    corpus.baseline(found, str(tmp_path / "b"))
    corpus.append_run(found, 1, str(tmp_path / "r"))
    corpus.append_run(found, 1, str(tmp_path / "r"))  # a run that is written again replaces itself
    corpus.progress(modules, found, 1, "done", str(tmp_path / "p"))
    (state,) = spark.read.parquet(str(tmp_path / "p")).collect()
    assert (state.run_id, state.modules_total, state.modules_with_errors, state.errors_total, state.status) == (1, 3, 1, 2, "done")
    assert [(r.module_id, r.n, r.kinds) for r in corpus.most_findings(found).collect()] == [(1, 2, 2)]
    assert spark.read.json(str(tmp_path / "b")).count() == 1 and spark.read.parquet(str(tmp_path / "r")).where("run_id = 1").count() == 2
    entries = spark.createDataFrame([("type", 1, "Цвет", "Color", "Цвета"), ("method", 2, "Сообщить", "Message", "")], "kind string, kind_rank int, name_ru string, name_en string, description string")
    t = api.Tools(entries, c.members, c.methods, c.properties, ["search", "info", "validate_enum", "validate_method_call", "reserved_names", "get_enum_values"])
    assert "**Цвет** (type)" in t.search("цв") and t.info("цвет").startswith("# Цвет (Color)") and t.validate_enum("Цвет", "Красны")["similar"][0] == "красный"
    assert t.validate_method_call("Сообщить", 1) == {"known": True, "valid": True, "expected": "1", "signatures": ["Сообщить(Текст)"]} and t.validate_method_call("Макс", 4)["expected"] == "1+" and not t.validate_method_call("Сообщить", 3)["valid"] and t.reserved_names()["form_readonly"]["count"] == 1
    with pytest.raises(PermissionError):
        t.get_members("Цвет")
    with pytest.raises(ValueError):
        api.Tools(entries, c.members, c.methods, c.properties, ["nope"])
    modules.write.parquet(str(tmp_path / "in"))
    watch.watch(spark, str(tmp_path / "in"), "module_id long, source string", lambda df: corpus.validate(df, c), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
