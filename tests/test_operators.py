import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregates as A
from brindle.operators import joins as J
from brindle.operators import lookup as L
from brindle.operators import tree


def test_staged_search_stages(spark):
    rows = [("type", 1, "Массив", "Array"), ("method", 2, "Массив2", ""), ("method", 2, "Найти значение", "FindValue"), ("type", 1, "МАССИВ", "Array"), ("property", 3, "Значение", "Value")]
    c = spark.createDataFrame(rows, "kind string, kind_rank int, name_ru string, name_en string")
    get = lambda q: [(r.kind, r.name_key, r.stage) for r in L.staged(c, q).collect()]
    assert get("масс") == [("type", "массив", 1), ("method", "массив2", 1)]
    assert get("найти знач") == [("method", "найти значение", 1)]
    assert get("ти чени") == [("method", "найти значение", 2)]
    assert get("alue") == [("method", "найти значение", 3), ("property", "значение", 3)]
    assert get("  ") == [] and L.bounded(None) == 10 and L.bounded(0) == 1 and L.bounded(99) == 50


def test_tri_state(spark):
    facts = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), ("C", "x")], "collection string, name_lower string")
    objects = spark.createDataFrame([("A", "x"), ("A", "x")], "collection string, name_lower string")
    told = J.tri_state(facts, objects, ["collection", "name_lower"], F.when(F.col("collection") != "C", F.col("collection") == "A"))
    assert {(r.collection, r.name_lower): r.exists for r in told.collect()} == {("A", "x"): True, ("A", "y"): False, ("B", "x"): None, ("C", "x"): None}


def test_as_of_keeps_repeated_facts(spark):
    facts = spark.createDataFrame([(1, "u", 100), (2, "u", 350), (3, "v", 5), (4, "u", 100)], "k long, m string, at long")
    events = spark.createDataFrame([("u", 60, "a"), ("u", 90, "b"), ("u", 101, "c")], "m string, at long, t string")
    got = J.as_of(facts, events, ["m"], "at", "at", F.lit(200), ["t"], key=["k"])
    assert {(r.k, r.t, r.matched_at) for r in got.collect()} == {(1, "b", 90), (2, None, None), (3, None, None), (4, "b", 90)}


def test_piecewise_gap(spark):
    spans = spark.createDataFrame([(1, 0, 100, 5), (1, 8, 200, 4)], "q long, text_offset long, module_at long, len long")
    offsets = spark.createDataFrame([(i, 1, o) for i, o in enumerate([0, 3, 5, 7, 8, 11, 40])], "k long, q long, off long")
    got = {r.off: r.mapped for r in J.piecewise(offsets, spans, ["q"], "off", key=["k"]).collect()}
    assert got == {0: 100, 3: 103, 5: 105, 7: 105, 8: 200, 11: 203, 40: 204}


def test_interval_is_half_open(spark):
    p = spark.createDataFrame([("m", 5), ("m", 10), ("n", 5)], "m string, at long")
    i = spark.createDataFrame([("m", 5, 10, "s")], "m string, lo long, hi long, s string")
    assert [(r.m, r.at, r.s) for r in J.within_interval(p, i, ["m"], "at", "lo", "hi").collect()] == [("m", 5, "s")]


def test_nearest_takes_the_first_of_equals(spark):
    q = spark.createDataFrame([("abc",)], "q string")
    c = spark.createDataFrame([(2, "abd"), (1, "abe"), (3, "xyz")], "ord int, name string")
    for within in (None, 2):
        assert [tuple(r) for r in L.nearest(q, c, "q", "name", "ord", within=within).collect()] == [("abc", "abe", 1)]


def test_merge_and_arity(spark):
    rows = spark.createDataFrame([(1, "attribute", "Код", None), (2, "attribute", "КОД", "Index"), (3, "resource", "код", None)], "ord int, kind string, name string, indexing string").withColumn("name_lower", F.lower("name"))
    got = {(r.kind, r.name_lower): (r.name, r.indexing, r.first_seen) for r in A.merge_copies(rows, ["kind", "name_lower"], "ord", ["name"], ["indexing"]).collect()}
    assert got == {("attribute", "код"): ("Код", "Index", 1), ("resource", "код"): ("код", None, 3)}
    s = spark.sql("select array(named_struct('parameters', array(named_struct('name', 'Шаблон', 'required', true), named_struct('name', 'Значение1-Значение10', 'required', false)))) as s")
    got = s.select(*(A.accepts(F.col("s"), F.lit(n)).alias(str(n)) for n in (0, 1, 11, 12))).first()
    assert list(got) == [False, True, True, False]


def test_tree_reparents_orphans(spark):
    n = spark.createDataFrame([(1, 0, 0, "a"), (2, 1, 1, "b"), (3, 99, 2, "c"), (0, 0, 3, "root")], "id long, parent_id long, ord long, name string")
    got = {r.node: (r.depth, r.names) for r in tree.paths(tree.rooted(n), "id", "parent_id", "ord", "name").collect()}
    assert got == {1: (1, "a"), 2: (2, "a/b"), 3: (1, "c")}


def test_deep_trees_are_whole_and_circles_an_error(spark):
    chain = spark.createDataFrame([(i, i - 1, 0, str(i)) for i in range(1, 8)], "id long, parent_id long, ord long, name string")
    assert tree.paths(chain, "id", "parent_id", "ord", "name").count() == 7 == tree.trail(chain, "id", "parent_id").count()
    for few in (tree.paths, tree.trail):
        with pytest.raises(ValueError):
            few(chain, "id", "parent_id", *(["ord", "name"] if few is tree.paths else []), max_depth=4)
    part = tree.paths(chain, "id", "parent_id", "ord", "name", through=F.col("id") < 3)
    assert {r.node for r in part.collect()} == {1, 2, 3}


def test_pages_and_places(spark):
    rows = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "k int, x string").repartition(5)
    assert {r.k: r.nth for r in L.numbered(rows, ["k"]).collect()} == {k: k for k in range(50)}
    assert {r.k: r.page for r in L.paged(rows, ["k"], 20).collect()} == {k: k // 20 for k in range(50)}


def test_nearest_without_a_bound(spark):
    q = spark.createDataFrame([("abcd",), ("zzzzzzzzzzzzzzzz",)], "q string")
    c = spark.createDataFrame([(1, "abce"), (2, "abcdefghijk")], "ord int, name string")
    assert {(r.q, r.nearest, r.distance) for r in L.nearest(q, c, "q", "name", "ord").collect()} == {("abcd", "abce", 1), ("zzzzzzzzzzzzzzzz", "abce", 16)}
