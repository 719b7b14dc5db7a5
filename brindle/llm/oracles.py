"""SQL for the training-data queries that SQL can express, over whole tables. DuckDB's dialect."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

#: Rows as documents of their own, with their words.
_DOCS = f"d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents)"

SUBSTRING_DEDUP = rf"""with {_DOCS},
starts as (select rid, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
win as (select starts.rid, i, array_to_string(w[i:i + 34], ' ') as x from starts join d using (rid)),
twice as (select x from win group by x having count(*) > 1),
gone as (select distinct rid, unnest(range(i, i + 35)) as i from win join twice using (x)),
every as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select e.rid, string_agg(e.word, ' ' order by e.i) as x, count(*) as n from every e left join gone g on e.rid = g.rid and e.i = g.i where g.rid is null group by e.rid)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.x, '')) as kept_sha256 from d left join kept using (rid)"""

JACCARD_JOIN = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d),
e as (select doc_id, unnest(g) as x from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
edges as (select a, b from links union select b, a from links),
reach as (select a as id, a as root from edges union select e.b, r.root from reach r join edges e on e.a = r.id),
least as (select id, min(root) as root from reach group by id)
select s.doc_id, len(g)::bigint as n_shingles, coalesce(root, s.doc_id) as component_id from s left join least on id = s.doc_id"""

NEAR_DUPLICATES = """with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
fit as (select * from v where label is not null and x is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0 and list_sum(list_transform(x, lambda y: y * y)) > 0),
links as (select a.vec_id as a, b.vec_id as b from fit a join fit b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id < b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.93),
edges as (select a, b from links union select b, a from links),
reach as (select a as id, a as root from edges union select e.b, r.root from reach r join edges e on e.a = r.id),
least as (select id, min(root) as root from reach group by id), n as (select a as id, count(*) as n from edges group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept from v left join least on least.id = vec_id left join n on n.id = vec_id"""

LM_SCORE = f"""with {_DOCS},
t as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
p as (select rid, i, word as w3, lag(word) over q as w2, lag(word, 2) over q as w1 from t window q as (partition by rid order by i)),
total as (select count(*) as n from t),
g as (select rid, w3 as a, null as b, null as c from p union all select rid, w2, w3, null from p where w2 is not null union all select rid, w1, w2, w3 from p where w1 is not null),
own as (select rid, a, b, c, count(*) as n from g group by all), every as (select a, b, c, sum(n) as n from own group by all),
o as (select rid, own.a, own.b, own.c, every.n - own.n as n from own join every on own.a = every.a and own.b is not distinct from every.b and own.c is not distinct from every.c),
o1 as (select rid, a, n from o where b is null), o2 as (select rid, a, b, n from o where b is not null and c is null), o3 as (select rid, a, b, c, n from o where c is not null),
x as (select p.rid, u.n as uni, coalesce(bi.n, 0) as bi, coalesce(tri.n, 0) as tri, cu.n as c1, cb.n as c2, w1, w2, total.n - len(d.w) as others
 from p join d using (rid) cross join total join o1 u on u.rid = p.rid and u.a = w3 left join o2 bi on bi.rid = p.rid and bi.a = w2 and bi.b = w3 left join o3 tri on tri.rid = p.rid and tri.a = w1 and tri.b = w2 and tri.c = w3
 left join o1 cu on cu.rid = p.rid and cu.a = w2 left join o2 cb on cb.rid = p.rid and cb.a = w1 and cb.b = w2),
s as (select rid, uni, ln(case when tri > 0 then tri / c2::double else (case when w1 is null then 1.0 else 0.4 end) * (case when bi > 0 then bi / c1::double
 else (case when w2 is null then 1.0 else 0.4 end) * (case when uni > 0 then uni / others::double else 0.4 / (others + 1) end) end) end) as s from x),
r as (select rid, sum(s) as s, count(*) filter (where uni <= 0) as unseen from s group by rid)
select d.doc_id, len(w)::bigint as n_words, round(r.s, 4) as log_score, round(r.s / nullif(len(w), 0), 6) as mean_log_score, coalesce(unseen, 0)::bigint as unseen from d left join r using (rid)"""

#: Rows of a word span for each passage of 50 words that occurs twice at least, joined where they overlap or touch.
REPEATED_SPANS = rf"""with {_DOCS},
starts as (select rid, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
win as (select starts.rid, i, array_to_string(w[i:i + 49], ' ') as x from starts join d using (rid)),
twice as (select x from win group by x having count(*) > 1),
hit as (select rid, i from win join twice using (x)),
runs as (select rid, i, case when i - lag(i) over q <= 50 then 0 else 1 end as new from hit window q as (partition by rid order by i)),
spans as (select rid, i, sum(new) over (partition by rid order by i) as run from runs)
select doc_id, min(i)::bigint - 1 as first_word, max(i)::bigint + 50 - min(i)::bigint as n_words from spans join d using (rid) group by rid, doc_id, run"""

#: CRC-32 over bytes, with its table made from the polynomial.
_CRC = """crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
bytes as (select rid, doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: (16 * (strpos('0123456789ABCDEF', x[1:1]) - 1) + strpos('0123456789ABCDEF', x[2:2]) - 1)::bigint) as b from d),
summed as (select rid, doc_id, strlen(text)::bigint + 1 as size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32 from bytes, crc)"""

SHARDING = f"""with {_DOCS}, {_CRC},
placed as (select *, sum(size) over (order by doc_id, text_crc32, size, rid rows unbounded preceding) - size as before, sum(size) over () as total from summed),
cut as (select *, least(15, (before * 16) // total)::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, text_crc32, size, rid) - 1 as slot, null::int as grown_shard from cut"""
