"""Registered queries of the catalog engine on the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import aggregates as A
from brindle.operators import joins as J
from brindle.operators import lookup as L
from brindle.operators import tree
from brindle.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def part_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a catalog with two names and a kind."""
    p = table(spark, folder, "part")
    kind = F.element_at(F.split("p_type", " "), 1)
    return p.select(kind.alias("kind"), F.when(kind < "M", 1).otherwise(2).alias("kind_rank"), F.col("p_name").alias("name_ru"), F.col("p_brand").alias("name_en"))


PART_CATALOG = """part_catalog as (select split_part(p_type, ' ', 1) as kind, case when split_part(p_type, ' ', 1) < 'M' then 1 else 2 end as kind_rank,
  p_name as name_ru, p_brand as name_en from part)"""


@query("select p_partkey, p_brand, p_name from part where lower(trim(p_brand)) = 'brand#12'")
def exact_ci_lookup(spark, folder):
    return table(spark, folder, "part").where(X.same_name("p_brand", " bRaNd#12 ")).select("p_partkey", "p_brand", "p_name")


@query("select p_partkey, p_name, p_brand from part where lower(p_name) = 'brand#11' or (p_brand <> '' and lower(p_brand) = 'brand#11')")
def bilingual_or_lookup(spark, folder):
    return table(spark, folder, "part").where(X.either_name("p_name", "p_brand", "BRAND#11")).select("p_partkey", "p_name", "p_brand")


@query("select c_custkey, lower(c_name) as name_lower from customer where starts_with(lower(c_name), 'customer#00000001') order by name_lower, c_custkey limit 50")
def prefix_search(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.lower("c_name").alias("name_lower"))
    return c.where(F.col("name_lower").startswith("customer#00000001")).orderBy("name_lower", "c_custkey").limit(L.bounded(500))


@query("select distinct p_name from part where regexp_matches(lower(p_name), '(?s)e.*d')")
def word_order_search(spark, folder):
    return table(spark, folder, "part").where(X.words_in_order("p_name", "e d")).select("p_name").distinct()


def _staged_sql(q: str, limit: int) -> str:
    words = q.split()
    ordered = f"(regexp_matches(lower(trim(name_ru)), '(?s){'.*'.join(words)}') or regexp_matches(lower(trim(name_en)), '(?s){'.*'.join(words)}'))" if len(words) > 1 else "false"
    return f"""with {PART_CATALOG},
staged as (select *, lower(trim(name_ru)) as name_key, case when starts_with(lower(trim(name_ru)), '{q}') then 1 when {ordered} then 2
  when contains(lower(trim(name_ru)), '{q}') or contains(lower(trim(name_en)), '{q}') then 3 end as stage from part_catalog),
kept as (select * from staged where stage is not null and (stage < 3 or (select min(stage) from staged) = 3))
select kind, name_key, min(kind_rank) as kind_rank, min(stage) as stage, arg_min(name_ru, (stage, name_ru)) as name_ru from kept
group by kind, name_key order by stage, kind_rank, name_key, kind limit {limit}"""


@query(_staged_sql("a", 50))
def staged_search(spark, folder):
    """Prefix stage."""
    return L.staged(part_catalog(spark, folder), "A", 50)


@query(_staged_sql("o e", 50))
def staged_search_words(spark, folder):
    """Words-in-order stage."""
    return L.staged(part_catalog(spark, folder), " O E ", 50)


@query(_staged_sql("#23", 50))
def staged_search_substring(spark, folder):
    """Substring stage, which runs as the others find nothing."""
    return L.staged(part_catalog(spark, folder), "#23", 50)


QUERY_WORDS = ["almond antiqe", "blu steel", "chocolate", "Brand#1", "forest grean", "unknown thing"]
_WORDS_SQL = "(values " + ", ".join(f"('{w}')" for w in QUERY_WORDS) + ") as w(word)"


@query(f"""with names as (select distinct p_name as name from part),
d as (select word, name, levenshtein(lower(word), lower(name)) as distance from {_WORDS_SQL}, names)
select word, arg_min(name, (distance, name)) as nearest, min(distance) as distance from d group by word""")
def fuzzy_top1(spark, folder):
    names = table(spark, folder, "part").select(F.col("p_name").alias("name")).distinct()
    words = spark.createDataFrame([(w,) for w in QUERY_WORDS], "word string")
    return L.nearest(words, names, "word", "name", "name")


@query(f"""with names as (select distinct p_name as name from part),
d as (select word, name, levenshtein(lower(word), lower(name)) as distance from {_WORDS_SQL}, names where abs(length(word) - length(name)) <= 4)
select word, arg_min(name, (distance, name)) as nearest, min(distance) as distance from d where distance <= 4 group by word""")
def fuzzy_top1_within(spark, folder):
    names = table(spark, folder, "part").select(F.col("p_name").alias("name")).distinct()
    words = spark.createDataFrame([(w,) for w in QUERY_WORDS], "word string")
    return L.nearest(words, names, "word", "name", "name", within=4)


@query("""with s as (select lower(p_name) as name_key, case when length(p_name) = 0 then 1.0 else 1.0 - levenshtein(lower(p_name), 'almond steel') / greatest(length(p_name), 12)::double end as score, p_partkey from part)
select name_key, round(max(score), 9) as score, min(p_partkey) as first_seen from s group by name_key order by max(score) desc, first_seen limit 5""")
def similar_top5(spark, folder):
    found = L.similar(table(spark, folder, "part"), "p_name", F.lit("Almond Steel"), "p_partkey")
    return found.withColumn("score", F.round("score", 9))


@query("""with names as (select distinct c_mktsegment as a from customer), pairs as (select x.a || t.tail as name, y.a as candidate from names x, names y, (values (''), ('X'), ('1'), ('12'), ('XY')) as t(tail)),
m as (select *, lower(name) as a, lower(candidate) as b, levenshtein(lower(name), lower(candidate)) as d from pairs)
select name, candidate, case when d = 0 then null when length(a) > length(b) and starts_with(a, b) and (length(a) - length(b) >= 2 or regexp_matches(substr(a, length(b) + 1), '^[0-9]+$')) then null
 when length(a) > length(b) and suffix(a, b) and length(a) - length(b) >= 2 then null
 when (length(name) >= 5 and d <= 2) or (length(name) < 5 and d <= 1) then 'high' when length(name) >= 6 and d <= 3 then 'low' end as confidence from m""")
def fuzzy_confidence(spark, folder):
    names = table(spark, folder, "customer").select("c_mktsegment").distinct()
    tails = spark.createDataFrame([("",), ("X",), ("1",), ("12",), ("XY",)], "tail string")
    # A handful of segments: the product is bounded by their number.
    pairs = names.crossJoin(tails).select(F.concat("c_mktsegment", "tail").alias("name")).crossJoin(names.select(F.col("c_mktsegment").alias("candidate")))
    return pairs.withColumn("confidence", X.confidence(F.col("name"), F.col("candidate")))


@query("select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def semi_known(spark, folder):
    c = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.known(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where c_custkey = o_custkey and o_orderpriority like '1%' and o_orderstatus = 'F')")
def anti_unknown(spark, folder):
    o = table(spark, folder, "orders").where("o_orderpriority like '1%' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.unknown(table(spark, folder, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("""select c_custkey, c_mktsegment, case when c_nationkey % 3 = 0 then null else exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%') end as "exists" from customer""")
def tri_state_lookup(spark, folder):
    c = table(spark, folder, "customer")
    urgent = table(spark, folder, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return J.tri_state(c, urgent, ["c_custkey"], F.col("c_nationkey") % 3 != 0).select("c_custkey", "c_mktsegment", "exists")


@query("""with w as (select user_id, min(ts) as starts, min(ts) + interval 6 hour as ends from events group by user_id)
select e.event_id, e.user_id, w.starts from events e join w on e.user_id = w.user_id and e.ts >= w.starts and e.ts < w.ends""")
def interval_join(spark, folder):
    e = table(spark, folder, "events")
    w = e.groupBy("user_id").agg(F.min("ts").alias("starts")).withColumn("ends", F.expr("starts + interval 6 hours"))
    return J.within_interval(e.select("event_id", "user_id", "ts"), w, ["user_id"], "ts", "starts", "ends").select("event_id", "user_id", "starts")


@query("""with v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by user_id, ts),
p as (select event_id as purchase_id, user_id, ts from events where event_type = 'purchase'),
j as (select p.purchase_id, p.user_id, v.event_id, v.ts as vts, p.ts as pts from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts)
select purchase_id, user_id, case when pts - vts <= interval 1 hour then event_id end as event_id, case when pts - vts <= interval 1 hour then vts end as matched_ts from j""")
def asof_tolerance(spark, folder):
    e = table(spark, folder, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    return J.as_of(bought, views, ["user_id"], "ts", "ts", F.expr("interval 1 hour"), ["event_id"], key=["purchase_id"]).select("purchase_id", "user_id", "event_id", "matched_ts")


@query("""with l as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as len, sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as upto from lineitem),
s as (select l_orderkey, l_linenumber, (upto - len) * 2 as text_offset, (upto - len) * 3 + 7 as module_at, len from l),
o as (select o_orderkey, o_orderkey % 100 as off from orders)
select o.o_orderkey, o.off, s.module_at + least(o.off - s.text_offset, s.len) as mapped from o asof left join s on o.o_orderkey = s.l_orderkey and o.off >= s.text_offset""")
def piecewise_offset(spark, folder):
    from pyspark.sql import Window

    upto = F.sum("len").over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "len").rowsBetween(Window.unboundedPreceding, 0))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("len"))
    spans = lines.withColumn("before", upto - F.col("len")).select("o_orderkey", (F.col("before") * 2).alias("text_offset"), (F.col("before") * 3 + 7).alias("module_at"), "len")
    offsets = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("off"))
    return J.piecewise(offsets, spans, ["o_orderkey"], "off", key=["o_orderkey"])


@query("""with needles as (select * from (values ('a'), ('b'), ('blue'), ('brand#1'), ('zz')) as n(needle)), k as (select distinct lower(p_name) as key from part union select distinct lower(p_brand) from part)
select needle, min(key) as first_key from needles left join k on starts_with(key, needle) group by needle""")
def prefix_theta_join(spark, folder):
    p = table(spark, folder, "part")
    keys = p.select(F.lower("p_name").alias("key")).union(p.select(F.lower("p_brand"))).distinct()
    needles = spark.createDataFrame([("a",), ("b",), ("blue",), ("brand#1",), ("zz",)], "needle string")
    return J.first_with_prefix(needles, keys, "needle", "key")


@query("""select l_orderkey, l_suppkey, arg_min(l_partkey, ord) as l_partkey, arg_min(l_partkey, ord) filter (where l_returnflag = 'R') as returned, min(ord) as first_seen
from (select *, l_linenumber * 10000000 + l_partkey as ord from lineitem) group by l_orderkey, l_suppkey""")
def merge_copies(spark, folder):
    rows = table(spark, folder, "lineitem").withColumns({"returned": F.when(F.col("l_returnflag") == "R", F.col("l_partkey")), "ord": F.col("l_linenumber") * 10000000 + F.col("l_partkey")})
    return A.merge_copies(rows, ["l_orderkey", "l_suppkey"], "ord", ["l_partkey"], ["returned"])


@query("""select o_orderkey, count(*) as n_lines, count(*) filter (where l_returnflag <> 'N') as least, bool_or(l_quantity >= 10) as fits
from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def arity_exists(spark, folder):
    # Lines are overloads of one parameter range each; the operator asks whether one takes 10 to 12 arguments.
    one = F.struct(F.array(F.struct(F.concat(F.lit("А1-А"), F.col("l_quantity").cast("int").cast("string")).alias("name"), F.lit(False).alias("required"))).alias("parameters"))
    o = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey")
    o = o.agg(F.collect_list(one).alias("signatures"), F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") != "N").alias("least"))
    return o.select("o_orderkey", "n_lines", "least", A.accepts(F.col("signatures"), F.lit(10)).alias("fits"))


@query("""select nullif(regexp_extract(p_name, '^(\\w+) ', 1), '') as head, count(*) as n, count(distinct p_brand) as n_distinct, min(p_name) as sample from part group by 1 order by n desc, head nulls last limit 25""")
def regex_group_topn(spark, folder):
    return A.tally(table(spark, folder, "part"), X.group_or_null(F.col("p_name"), r"^(\w+) "), "head", "p_brand", 25, sample="p_name")


@query("select count(distinct nullif(regexp_extract(p_name, '^(\\w+) ', 1), '')) as n_heads from part")
def regex_count_distinct(spark, folder):
    return table(spark, folder, "part").agg(F.countDistinct(X.group_or_null(F.col("p_name"), r"^(\w+) ")).alias("n_heads"))


@query("""select o_orderpriority, count(*) filter (where o_orderdate < timestamp '1995-01-01') as before, count(*) filter (where o_orderdate >= timestamp '1995-01-01') as after,
count(*) filter (where o_orderdate >= timestamp '1995-01-01') - count(*) filter (where o_orderdate < timestamp '1995-01-01') as change from orders group by o_orderpriority""")
def run_compare(spark, folder):
    cut = F.lit("1995-01-01").cast("timestamp")
    return A.compare_runs(table(spark, folder, "orders"), ["o_orderpriority"], F.col("o_orderdate") < cut, F.col("o_orderdate") >= cut)


@query("""select o_orderpriority, count(*) as scanned, count(*) filter (where o_custkey % 5 > 0) as with_errors, sum(o_custkey % 5)::bigint as errors_total, count(*) filter (where o_orderstatus = 'F') as failed,
count(distinct o_custkey) as modules from orders group by o_orderpriority""")
def run_totals(spark, folder):
    return A.run_totals(table(spark, folder, "orders"), ["o_orderpriority"], "o_custkey", F.col("o_orderstatus") == "F", F.col("o_custkey") % 5)


@query("""select event_type, p_name, n, sample_event from (select e.event_type, e.props as p_name, count(*) as n, min(event_id) as sample_event from events e where props like '%1%' group by 1, 2) order by n desc, event_type, p_name limit 30""")
def residual_sample(spark, folder):
    e = table(spark, folder, "events").where(F.col("props").like("%1%"))
    return e.groupBy("event_type", F.col("props").alias("p_name")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample_event")).orderBy(F.desc("n"), "event_type", "p_name").limit(30)


@query("select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k, cast(coalesce(json_extract(props, '$.result.k'), json_extract(props, '$.k')) as bigint) as unwrapped from events")
def json_schema_decode(spark, folder):
    e = table(spark, folder, "events").withColumn("p", F.from_json("props", "k long"))
    unwrapped = F.coalesce(F.get_json_object("props", "$.result.k"), F.get_json_object("props", "$.k")).cast("long")
    return e.select("event_id", "event_type", F.col("p.k").alias("k"), unwrapped.alias("unwrapped"))


@query("select c_name as name from customer union select s_name from supplier union select p_name from part")
def union_distinct_names(spark, folder):
    names = [table(spark, folder, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return names[0].union(names[1]).union(names[2]).distinct()


@query("select s_suppkey, s_name, (row_number() over (order by s_name, s_suppkey) - 1) // 40 as page from supplier")
def paged_scan_complete(spark, folder):
    """Pages of 40 in name order, numbered in one pass; together they are the whole table."""
    return L.paged(table(spark, folder, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], 40)


@query("""with recursive nodes as (select r_regionkey + 1 as id, 0 as parent, r_regionkey as ord, r_name as name from region union all select n_nationkey + 101, n_regionkey + 1, n_nationkey, n_name from nation
union all select c_custkey + 1000, c_nationkey + 101, c_custkey, c_name from customer),
t as (select id, 1 as depth, name as names, cast(ord as varchar) as path from nodes where parent = 0 union all select n.id, t.depth + 1, t.names || '/' || n.name, t.path || '.' || n.ord from nodes n join t on n.parent = t.id)
select id::bigint as node, depth, names, path from t""")
def recursive_tree(spark, folder):
    r, n, c = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    nodes = (
        r.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("name"))
        .union(n.select((F.col("n_nationkey") + 101).cast("long"), (F.col("n_regionkey") + 1).cast("long"), F.col("n_nationkey").cast("long"), "n_name"))
        .union(c.select(F.col("c_custkey") + 1000, (F.col("c_nationkey") + 101).cast("long"), "c_custkey", "c_name"))
    )
    return tree.paths(tree.rooted(nodes), "id", "parent_id", "ord", "name").select("node", "depth", "names", F.concat_ws(".", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("select l_orderkey, l_linenumber, l_shipdate, row_number() over (order by l_shipdate, l_orderkey, l_linenumber) as emit_ord from lineitem order by 3, 1, 2 limit 200")
def stable_ordered_findings(spark, folder):
    """The first 200 in a total order, with their ordinal: the ordinal is given to 200 rows, not to the table."""
    from pyspark.sql import Window

    first = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").orderBy("l_shipdate", "l_orderkey", "l_linenumber").limit(200)
    return first.withColumn("emit_ord", F.row_number().over(Window.orderBy("l_shipdate", "l_orderkey", "l_linenumber")).cast("long"))


@query("select c_custkey, count(o_orderkey) as n_orders, max(o_orderdate) as latest from customer left join orders on c_custkey = o_custkey group by c_custkey")
def left_outer_found(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_orderdate").alias("latest"))


@query("select r_name, n_nationkey % 2 = 0 as readonly, string_agg(n_name, ',' order by n_name) as names, count(*) as n from region join nation on r_regionkey = n_regionkey group by 1, 2")
def reserved_groups(spark, folder):
    r, n = table(spark, folder, "region"), table(spark, folder, "nation")
    joined = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).withColumn("readonly", F.col("n_nationkey") % 2 == 0)
    return joined.groupBy("r_name", "readonly").agg(F.concat_ws(",", F.sort_array(F.collect_list("n_name"))).alias("names"), F.count("*").alias("n"))


@query("select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, length(unnest(string_split(text, chr(10)))) as n_chars from documents")
def line_split(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"))


@query("""select event_id, user_id from events e where not exists (select 1 from customer where c_custkey = user_id and c_nationkey < 12) and not exists (select 1 from supplier where s_suppkey = user_id)""")
def chained_anti(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id")
    c = table(spark, folder, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return J.unknown(J.unknown(e, c, ["user_id"]), s, ["user_id"]).select("event_id", "user_id")


@query("""select c_nationkey, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments, count(distinct c_mktsegment) as n from customer group by c_nationkey""")
def set_building(spark, folder):
    return table(spark, folder, "customer").groupBy("c_nationkey").agg(F.concat_ws(",", F.sort_array(F.collect_set("c_mktsegment"))).alias("segments"), F.countDistinct("c_mktsegment").alias("n"))


@query("select distinct c_mktsegment as name from customer except select 'BUILDING'")
def set_difference(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_mktsegment").alias("name")).distinct().exceptAll(spark.createDataFrame([("BUILDING",)], "name string"))


@query("""with f as (select l_orderkey, bool_or(l_returnflag = 'R') as any_flag, arg_min(l_partkey, l_linenumber * 10000000 + l_partkey) filter (where l_returnflag <> 'R') as first_other from lineitem group by l_orderkey)
select l_orderkey, any_flag, first_other from f where not any_flag and first_other is not null""")
def boolean_reduction(spark, folder):
    other = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") * 10000000 + F.col("l_partkey"))
    f = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_flag"), F.min_by("l_partkey", other).alias("first_other"))
    return f.where("not any_flag and first_other is not null")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from brindle import fixture_queries

    return QUERIES | fixture_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from brindle import fixture_queries

    return SQL | fixture_queries.SQL
