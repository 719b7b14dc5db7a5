"""The training-data operators against plain versions on small tables with all the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import cells, components, decontamination, embedding_dedup, language_id, lm_score, mixing, ngram_jaccard, passages, sharding, substring_dedup, suffix_dedup, toxicity
from brindle.llm import text as T

SEPARATE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score string, shard string, n string, key string"


def words(t):
    return SEPARATE.findall(t or "")


def corpus(seed=1):
    """Copies, near copies, shared passages, repeated words, short, empty and null texts, odd spaces, repeated rows and null ids."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(60), make(70)
    texts = [make(rng.choice([1, 3, 4, 5, 6, 40, 120])) for _ in range(50)]
    texts += [make(20) + "\n" + passage + "\t" + make(25) for _ in range(12)]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += ["same " * 90, "", "   ", "a b", "A  B\n", "x y", " ", base.upper(), "9 8 7", make(3000)]
    rows = [(i * 7 % 1009 + 1, t) for i, t in enumerate(texts)]
    return [*rows, (5000, None), rows[3], (5001, rows[3][1])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "b", "c", "d", "e", "f") for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_the_pattern():
    texts = [t for _, t in corpus()]
    w = T.words(pa.array(texts, pa.string()))
    assert [int(x) for x in np.diff(w.first)] == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    by = defaultdict(set)
    for x, h in zip(flat, w.hash.tolist(), strict=True):
        by[x].add(h)
    assert all(len(h) == 1 for h in by.values()) and len({h for s in by.values() for h in s}) == len(by)
    low = T.words(pa.array(["ABé É", None]), lower=True)
    assert low.hash[0] == T.words(pa.array(["abé"])).hash[0] and low.hash[1] == T.words(pa.array(["É"])).hash[0]


def test_chunked_hashes(monkeypatch):
    column = pa.array(["aa bbb " * 500, "c" * 900, ""])
    whole, runs = T.words(column).hash, T.runs(T.words(column).hash, 7)
    monkeypatch.setattr(T, "CHUNK", 64)
    assert (T.words(column).hash == whole).all() and (T.runs(whole, 7) == runs).all()


def test_cells_round_trip():
    raw = T.mix(np.arange(5000, dtype=np.uint64)) % np.uint64(3000) << np.uint64(50)
    own = cells.Keys(raw)
    assert (cells.unpack_keys(cells.pack_keys(own.keys)) == own.keys).all() and dict(zip(own.keys.tolist(), own.counts.tolist(), strict=True)) == Counter(raw.tolist())
    n = np.array([0, 1, 254, 255, 10**12])
    assert (cells.unpack_counts(cells.pack_counts(n), 5) == n).all()
    assert all(p == k * 1000 >> 64 for p, k in zip(cells.place_of(own.keys, 1000).tolist(), own.keys.tolist(), strict=True))


def thue_morse(n, a="a", b="b"):
    """Two words of 2**n letters whose difference, as a polynomial with any odd base, is 0 modulo 2**64 for n of 10 and more."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_of_regular_build_have_hashes_of_their_own():
    found = set()
    for n in range(13):
        found |= set(T.words(pa.array(thue_morse(n))).hash.tolist())
    assert len(found) == 26
    x, y = T.words(pa.array([" ".join(t) for t in thue_morse(10)])).hash.reshape(2, -1)
    assert len({int(T.runs(h, 1024)[0]) for h in (x, y)}) == 2
    assert len({int(T.runs(np.array(h, np.uint64), len(h))[0]) for h in ([1, 2, 3], [1, 3, 2], [2, 1, 3], [3, 2, 1], [1, 2], [2, 1])}) == 6


def test_texts_of_regular_build(spark):
    """Windows and sets that differ in one word only, a word of Thue and Morse, neither repeat nor link."""
    x, y = thue_morse(10)
    common = " ".join(f"w{i}" for i in range(34))
    d = spark.createDataFrame([(1, f"{common} {x}"), (2, f"{common} {y}"), (3, f"a b c d {x}"), (4, f"a b c d {y}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(d).collect()} == {0}
    assert {(r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_join(d.where("doc_id > 2")).collect()} == {(3, 3), (4, 4)}


@pytest.mark.parametrize("direct", [cells.DIRECT, 1])
@pytest.mark.parametrize("members", [False, True])
def test_key_counts_with_and_without_halls(spark, docs, direct, members):
    def keys_of(t):
        t = passages._ordered(t)
        w = T.words(t.column("text"))
        return w.hash, None, w.doc

    def finish(t, keys, counts, holders):
        bucket = t.column("bucket")[0].as_py() if t.num_rows else 0
        return pa.table({"bucket": np.full(len(keys), bucket), "key": keys.astype(np.int64), "n": counts, "holder": holders})

    got = cells.key_counts(docs, cells.text_bytes(docs), keys_of, finish, "bucket long, key long, n long, holder long", 2.0, members=members, bucket_bytes=2000, direct=direct).collect()
    want = Counter(h for _, t in corpus() for h in T.words(pa.array([t or ""])).hash.tolist())
    first = {}
    for r in got:
        key = r.key & (1 << 64) - 1
        assert r.n == want[key]
        first.setdefault(key, set()).add(r.holder)
    assert set(first) == set(want) and all(len(v) == 1 for v in first.values())
    assert not members or all((v == {-1}) == (want[k] == 1) for k, v in first.items())


def plain_windows(rows, size):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((d, w, gone))
    return out


@pytest.mark.parametrize("hot", [2000, 4])
def test_substring_dedup(docs, hot):
    want = Counter((d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for d, w, g in plain_windows(corpus(), 35))
    got = passages.repeated(docs, 35, 18, substring_dedup.resolver(35), passages.finish_rows, passages.FINISHED, hot=hot)
    assert Counter(map(tuple, got.collect())) == want


def test_clean_texts(docs):
    want = Counter((d, " ".join(x for x, y in zip(w, g, strict=True) if not y)) for d, w, g in plain_windows(corpus(), 35))
    assert Counter(map(tuple, substring_dedup.clean_texts(docs).collect())) == want


def test_suffix_dedup(docs):
    want = Counter()
    for d, w, g in plain_windows(corpus(), 50):
        spans, i = [], 0
        while i < len(g):
            j = i
            while j < len(g) and g[j] == g[i]:
                j += 1
            if g[i]:
                spans.append((i, j - i))
            i = j
        want[d, len(w), sum(g), tuple(spans)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_repeated, tuple((s["first"], s["words"]) for s in r.spans)) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == want


def test_automaton_counts_runs():
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    weights = [rng.choice([1, 1, 2]) for _ in texts]
    s = substring_dedup.SuffixAutomaton()
    for t, n in zip(texts, weights, strict=True):
        s.add(t, n)
    s.close()
    seen = Counter()
    for t, n in zip(texts, weights, strict=True):
        for i in range(len(t) - 4):
            seen[tuple(t[i : i + 5])] += n
    for t in texts:
        assert s.repeats(t, 5) == [seen[tuple(t[i : i + 5])] > 1 for i in range(len(t) - 4)]


def plain_classes(rows):
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    flat = [(d, s) for d, many in sets.items() for s in many if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return Counter((d, len(s), find(d)) for d, many in sets.items() for s in many)


def test_jaccard_join(docs):
    assert Counter(map(tuple, ngram_jaccard.jaccard_join(docs).collect())) == plain_classes(corpus())


def test_jaccard_join_splits_hot_groups(spark, docs):
    want = {d: c for d, _, c in plain_classes(corpus())}
    sizes, links = ngram_jaccard.links(docs, hot_at=5, piece_of=2)
    own = {r.id: r.component for r in components.components(links).collect()}
    assert {r.doc_id: own.get(r.doc_id, r.doc_id) for r in sizes.collect()} == want


def test_jaccard_join_keeps_digests_apart():
    """Digests link sets by 128 bits and not by their elements, so they must not meet part signatures."""
    ids = [i for i, t in corpus() if t]
    b = ngram_jaccard.Bucket(pa.table({"doc_id": ids, "text": [t for _, t in corpus() if t]}))
    keys, _, unit, _, must, _ = ngram_jaccard.signatures(ngram_jaccard.Sets(b, 5), ngram_jaccard.Bands(Fraction(4, 5)))
    assert ((keys & np.uint64(1) == 1) == (must[unit] == 0)).all()


def test_jaccard_join_starts_anew_where_digests_meet(spark, monkeypatch):
    """Different sets with one digest (here of 5 bits) must not be linked, nor lose their links."""
    rows = [(i, f"w{i // 3} x") for i in range(18)] + [(100 + i, f"a{i} b c d e f g") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    salts, plain = [], ngram_jaccard._found
    monkeypatch.setattr(ngram_jaccard, "_found", lambda *a: (salts.append(a[-2]), plain(*a))[1])
    sizes, links = ngram_jaccard.links(d, digest_bits=5)
    own = {r.id: r.component for r in components.components(links).collect()}
    assert Counter((r.doc_id, r.n_shingles, own.get(r.doc_id, r.doc_id)) for r in sizes.collect()) == plain_classes(rows) and len(salts) > 1


def test_relatives_of_many_sets():
    """In blocks, with leaders, and in one block: always the classes of brute force."""
    rng = np.random.default_rng(11)
    base = [np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64)) for n in (30, 200, 210, 900)]
    sets = []
    for _ in range(160):
        x = base[rng.integers(4)].copy()
        x[rng.integers(0, len(x), int(rng.integers(0, len(x) // 5)))] = rng.integers(0, 1 << 40)
        sets.append(np.unique(x))
    t = Fraction(4, 5)
    whole = ngram_jaccard.relatives(sets, t)
    root = {i: i for i in range(160)}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(160):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 5 >= (len(sets[i]) + len(sets[j]) - both) * 4:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert whole.tolist() == [find(i) for i in range(160)]
    for tile in (7, 40, 100):
        assert (ngram_jaccard.relatives(sets, t, tile) == whole).all()
        could = ngram_jaccard.near([ngram_jaccard.bitmap(x) for x in sets], np.array([len(x) for x in sets]), t, tile)
        assert all(could[i] == could[whole[i]] for i in range(160))


def test_jaccard_join_of_half_shared_texts(spark):
    """One long text, and many that share half of it each and hardly anything else: large groups, few links."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        at = rng.randrange(200)
        rows.append((i, " ".join(base[at : at + 200] + [f"o{i}_{j}" for j in range(rng.choice([0, 20, 60]))])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, ngram_jaccard.jaccard_join(d).collect())) == plain_classes(rows)


def test_jaccard_join_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (1, "A B C D E F")], "doc_id long, text string")
    assert Counter(map(tuple, ngram_jaccard.jaccard_join(d).collect())) == Counter({(None, 2, None): 2, (2, 2, 1): 1, (1, 2, 1): 1})


def test_bands_hold_all_similar_sizes():
    bands = ngram_jaccard.Bands(Fraction(4, 5))
    for r in range(1, 400):
        for s in range(r, 5 * r // 4 + 1):
            common = set(bands.of(r)) & set(bands.of(s))
            assert any(bands.parts(c)[1] >= (r + s) // 9 for c in common)


def test_parity_bitmaps_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 500, 700, 900, 3000)]
    sets.append(np.union1d(sets[1][:400], sets[2]))
    maps = [ngram_jaccard.bitmap(x) for x in sets]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            for size in {128, min(len(maps[i]), len(maps[j]))}:
                low = ngram_jaccard.least_distances(ngram_jaccard.folded(maps[i], size)[None, :], ngram_jaccard.folded(maps[j], size)[None, :])
                assert low[0, 0] <= len(np.setxor1d(x, y))


def test_lm_score(docs):
    rows = corpus()
    for order in (1, 2, 3, 4):
        c = [Counter() for _ in range(order)]
        for _, t in rows:
            w = words(t)
            for n in range(order):
                c[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
        total = sum(c[0].values())
        want = Counter()
        for d, t in rows:
            w = words(t)
            own = [Counter(tuple(w[i : i + n + 1]) for i in range(len(w) - n)) for n in range(order)]
            other = lambda g: c[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
            score = 0.0
            for i in range(len(w)):
                factor = 1.0
                for n in range(min(order, i + 1), 0, -1):
                    g = tuple(w[i - n + 1 : i + 1])
                    if n == 1:
                        score += math.log(factor * (other(g) / (total - len(w)) if other(g) else 0.4 / (total - len(w) + 1)))
                    elif other(g):
                        score += math.log(factor * other(g) / other(g[:-1]))
                        break
                    else:
                        factor *= 0.4
            want[d, len(w), round(score, 6) if w else None, sum(not other((x,)) for x in w)] += 1
        got = Counter((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 6), r.unseen) for r in lm_score.lm_score(docs, order, bucket_bytes=4000).collect())
        assert got == want
    plain = Counter((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 6), r.unseen) for r in lm_score.n_gram_scores(docs, 4).collect())
    assert plain == want


def test_sharding(docs):
    rows = sharding.shard_slots(docs).collect()
    want = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in corpus())
    total, before, slots = sum(x[2] for x in want), 0, Counter()
    expected = Counter()
    for d, crc, size in want:
        shard = min(15, before * 16 // total)
        expected[d, size, crc, "bytes", shard, slots[shard], None] += 1
        slots[shard] += 1
        before += size
    assert Counter(map(tuple, rows)) == expected
    with_shard = sharding.with_shard(docs)
    assert with_shard.columns == docs.columns and Counter((r.doc_id, r.shard) for r in with_shard.collect()) == Counter((r.doc_id, r.shard) for r in rows)


def test_sharding_splits_equal_rows(spark):
    """All rows but a few are equal: shards stay balanced, and slots have no gaps."""
    d = spark.createDataFrame([(None, None, 1)] * 3000 + [(i, "abc", 2) for i in range(100)], "doc_id long, text string, place int").repartition(6)
    n = Counter(r.shard for r in sharding.shard_slots(d).collect())
    total = 3000 + 100 * 4
    assert all(abs(v * (1 if s < 14 else 4) - total / 16) < total / 16 for s, v in n.items()) and len(n) == 16
    slots = defaultdict(list)
    for r in sharding.shard_slots(d).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    out = sharding.with_shard(d)
    # Of equal rows it is open which are where: sizes are near equal.
    size = Counter()
    for r in out.collect():
        size[r.shard] += len(r.text or "") + 1
    assert out.columns == ["doc_id", "text", "place", "shard"] and all(abs(v - total / 16) < total / 32 for v in size.values()) and len(size) == 16


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    near = x[:60] + rng.normal(size=(60, 16)) * 0.15
    hot = x[0] + rng.normal(size=(80, 16)) * 0.05
    every = np.concatenate([x, near, hot, x[:20]]).astype(np.float32)
    labels = np.concatenate([rng.integers(0, 3, 300), rng.integers(0, 3, 60), np.zeros(80), rng.integers(0, 3, 20)]).astype(int)
    rows = [(i * 3, v.tolist(), int(k), "extra") for i, (v, k) in enumerate(zip(every, labels, strict=True))]
    odd = [(9000, None, 0, ""), (9001, [0.0] * 16, 0, ""), (9002, [float("nan")] * 16, 0, ""), (9003, rows[0][1], None, ""), (9004, [], 0, ""), (9005, [1.0, None] * 8, 0, ""), (9006, [float("inf")] * 16, 0, ""), (9007, [1.0, 0.0], 0, ""), (None, rows[0][1], 0, ""), (9008, [0.93, (1 - 0.93**2) ** 0.5], 0, ""), (9009, [2.0, 0.0], 0, ""), (9009, [2.0, 0.0], 0, "again")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, cell string")
    good = {i: (np.array(v, np.float32).astype(float), k) for i, v, k, _ in [*rows, *odd[-3:], odd[7]]}
    n, root = Counter(), {i: i for i in [*good, *(r[0] for r in odd)]}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(good)
    for a in keys:
        for b in keys:
            (u, k), (v, m) = good[a], good[b]
            if a < b and k == m and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    want = {i: (n[i], find(i), find(i) == i) for i in root if i is not None} | {None: (0, None, False)}
    every = embedding_dedup.near_duplicates(df, block=16, per_cell=64).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in every}
    assert Counter(r.vec_id for r in every) == Counter(r[0] for r in rows + odd)
    linked = sum(v[0] for v in want.values())
    assert sum(v[0] for v in got.values()) >= 0.9 * linked and all(got[i][0] <= want[i][0] for i in want)
    assert got == want


def test_recall_with_hundreds_of_cells(spark):
    """Links and classes against brute force: nearly all through the nearest cells, all with the exact way."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 12))
    x = np.concatenate([x, x[:1500] + rng.normal(size=(1500, 12)) * rng.choice([0.05, 0.2, 0.3], (1500, 1))]).astype(np.float32)
    label = np.concatenate([np.arange(4000) % 2, np.arange(1500) % 2])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    alike = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    want = alike.sum(axis=1) - 1
    for options, least in (({"per_cell": 16}, 0.97), ({"reach": None}, 1.0)):
        got = np.zeros(len(x), np.int64)
        for r in embedding_dedup.near_duplicates(df, **options).select("vec_id", "n_links").collect():
            got[r.vec_id] = r.n_links
        assert (got <= want).all() and got.sum() >= least * want.sum()


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100} | {i: 500 for i in range(500, 560)}


LANGUAGES = {"aa": "banana karawa tamara salama", "bb": "thrun krelsh vorn twelth", "cc": "ñío éluë çàt ôrêz"}


def sentence(rng, lang, n=40):
    parts = LANGUAGES[lang].split()
    return " ".join(rng.choice(parts)[: rng.randrange(3, 8)] for _ in range(n))


def test_language_id(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, lang), lang if i % 11 else None, 1.0) for i in range(360) for lang in [rng.choice(list(LANGUAGES))]]
    truth = {i: lang for i, _, lang, _ in rows}
    rows += [(1000, None, "aa", 0.0), (1001, "", "bb", 0.0), (1002, "12 !! 34", "cc", 0.0), (1003, "qqzz xxjj wwqq zzyy " * 20, None, 0.0), (None, "banana", "aa", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    hold = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(got[i].lang_pred == truth[i] for i in hold if truth[i]) and not any(got[i].rejected for i in hold)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].rejected and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.known(df, language_id.fit(df, ~language_id.held_out()))
    assert kept.columns == df.columns and kept.count() == len(rows) - 4


UNLEARNED = "qqzz xxjj wwqq zzyy "


def test_stray_calibration_documents_do_not_lift_limits(spark):
    """One mislabelled calibration document, and a language with few documents: a language nobody learned is still rejected."""
    rng = random.Random(12)
    rows = [(i, sentence(rng, lang), lang) for i in range(260) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(i, sentence(rng, "cc"), "cc") for i in range(300, 312)]
    schema = "doc_id long, text string, lang string"
    drawn = language_id.sample_of(spark.createDataFrame(rows, schema), language_id.F.lit(True), 4000)
    stray = min(r.doc_id for r in drawn.where("lang = 'aa' and nth % 2 = 0").collect())  # those calibrate
    rows = [(i, UNLEARNED * 20 if i == stray else t, lang) for i, t, lang in rows]
    df = spark.createDataFrame([*rows, (500, "vyxx jqqz ywwz " * 25, None), (501, UNLEARNED * 9, None)], schema)
    model = language_id.fit(df, language_id.F.lit(True))
    assert all(math.isfinite(limit[3]) for limit in model["limits"])
    got = {r.doc_id: r.rejected for r in language_id.predict(df, model).collect()}
    assert got[500] and got[501] and got[stray] and not any(got[i] for i, *_ in rows if i != stray)


def test_limits_ignore_stray_documents():
    rng = np.random.default_rng(3)
    own = np.repeat([0, 1, 2], [300, 30, 6])
    entropy, size = rng.normal(1.5, 0.02, len(own)), np.full(len(own), 2000)
    clean = language_id.limits_of(own, entropy, size, 4)
    entropy[[5, 305]] = 5.0
    stray = language_id.limits_of(own, entropy, size, 4)
    for mean, wide, each, limit in [*clean, *stray]:
        assert (5.0 - mean) / math.sqrt(wide**2 + each**2 / 2000) > limit
    assert all(limit[3] == 8.0 for limit in clean)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 9, 4000).astype(np.uint64)
    packed, n = np.unique(c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:], return_counts=True)
    model = language_id.KneserNey(packed, n)
    context = packed[:20] & ~np.uint64(0xFFFF)
    p = np.exp(model.log_probability((context[:, None] | np.arange(1 << 16, dtype=np.uint64)[None, :]).ravel())).reshape(20, -1).sum(axis=1)
    assert np.abs(p - 1).max() < 1e-9


def test_distinct_grams():
    rng = np.random.default_rng(5)
    for top in (9, 3000):
        x = rng.integers(1, top, (4, 500)).astype(np.uint64)
        packed = x[0] << np.uint64(48) | x[1] << np.uint64(32) | x[2] << np.uint64(16) | x[3]
        found, at = language_id._distinct(packed)
        assert (np.sort(found) == np.unique(packed)).all() and (found[at] == packed).all()


def plain_symbols(text):
    """Lower-case letters, one blank for each run of others; three blanks in front of all."""
    return "   " + re.sub(r"(?s)[\x00]+", " ", "".join(c if c.isalpha() else "\0" for c in text.lower())) if text else "   "


def plain_model(texts):
    counts = [Counter() for _ in range(5)]
    for t in texts:
        c = plain_symbols(t)
        counts[4].update(c[i : i + 4] for i in range(len(c) - 3))
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    cut, totals, kinds = {}, {}, {}
    for order in (1, 2, 3, 4):
        ones, twos = (sum(n == k for n in counts[order].values()) for k in (1, 2))
        cut[order] = ones / (ones + 2 * twos) if ones and twos else 0.5
        totals[order], kinds[order] = Counter(), Counter()
        for g, n in counts[order].items():
            totals[order][g[:-1]] += n
            kinds[order][g[:-1]] += 1

    def probability(gram):
        p = 1 / 65536
        for order in (1, 2, 3, 4):
            g = gram[4 - order :]
            if totals[order][g[:-1]]:
                p = (max(counts[order][g] - cut[order], 0) + cut[order] * kinds[order][g[:-1]] * p) / totals[order][g[:-1]]
        return p

    return probability


def test_language_id_against_brute_force(spark):
    """Predictions, scores and entropies of the whole query, with models that are built from dictionaries."""
    rng = random.Random(18)
    rows = [(i, sentence(rng, lang, rng.choice([1, 5, 30])) + rng.choice(["", "!? 12", " 語言"]), lang if i % 7 else None) for i in range(150) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(900, "", "aa"), (901, None, "bb"), (902, "7 - 8", "cc"), (903, "банан", None), (None, "banana", "aa"), (5, "ñío", "cc"), (904, "ba\U00010400na", None), (905, "banana " * 5000, "aa")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, entropy double")
    drawn = language_id.sample_of(df, ~language_id.held_out(), 2 * language_id.PER_LANGUAGE).collect()
    assert {r.doc_id for r in drawn} == {i for i, t, lang in rows if t is not None and lang and i is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    models = {name: plain_model([r.text for r in drawn if r.lang == name and r.nth % 2]) for name in sorted({r.lang for r in drawn if r.nth % 2})}
    want = []
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und", 0.0, None))
            continue
        c = plain_symbols(t)
        entropy = {name: -sum(math.log(p(c[k : k + 4])) for k in range(len(c) - 3)) / (len(c) - 3) for name, p in models.items()}
        best = min(entropy, key=lambda name: (entropy[name], name))
        score = 1 / sum(math.exp(-language_id.SHARPNESS * (e - entropy[best])) for e in entropy.values())
        want.append((i, best, round(score, 9), round(entropy[best], 9)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 9), None if r.entropy is None else round(r.entropy, 9)) for r in language_id.identify(df).collect()]
    assert Counter(got) == Counter(want)


def test_sample_of_repeated_ids_is_bounded(spark):
    rows = [(1, f"banana {i}", "aa") for i in range(60)] + [(i, f"salama {i}", rng) for i in range(2, 400) for rng in ["aa" if i % 2 else "bb"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit in (16, 64):
        drawn = language_id.sample_of(df, language_id.F.lit(True), limit).collect()
        assert all(n <= limit for n in Counter(r.lang for r in drawn).values()) and len({r.doc_id for r in drawn}) == len(drawn)
    assert {r.lang for r in language_id.sample_of(df, language_id.F.lit(True), 64, most_languages=1).collect()} == {"aa"}


def plain_segments(v):
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += v[j]
                if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                    best = (i, j, s)
        if best:
            out.append(best)
            split(a, best[0])
            split(best[1] + 1, b)

    split(0, len(v))
    return sorted(out)


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 24)
        at = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        score = [rng.choice([-1.0, 1.25, 2.0, 0.75]) + rng.randrange(1000) / 65536 for _ in at]
        v = [-0.5] * n
        for i, s in zip(at, score, strict=True):
            v[i] = s
        assert sorted(toxicity.maximal_segments(at, score, 0.5)) == plain_segments(v)


def plain_toxicity(drawn, texts):
    """Scores of texts, from the drawn rows (text, toxic, fold): token by token, with the earlier scan."""
    token_of = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), m).encode() for m in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", t or "")]
    keys_of = lambda w: [(w, 0), *((w[:n], n) for n in (6, 5, 4) if len(w) > n)]
    base = sum(r.toxic > 0 for r in drawn) / len(drawn)
    seen = [(r.toxic > 0, r.fold, {k for w in token_of(r.text) for k in keys_of(w)}) for r in drawn]

    def table(fold, prior, least):
        n, count = [0, 0], defaultdict(lambda: [0, 0])
        for bad, f, keys in seen:
            if f != fold:
                n[bad] += len(keys)
                for k in keys:
                    count[k][bad] += 1
        every = Counter(k for _, _, keys in seen for k in keys)
        out = {}
        for k, (zero, one) in count.items():
            share = (zero + one) / sum(n)
            part = lambda x, y: x * math.log(x / y) if x else 0.0
            ratio = part(one, share * n[1]) + part(n[1] - one, (1 - share) * n[1]) + part(zero, share * n[0]) + part(n[0] - zero, (1 - share) * n[0])
            if every[k] >= 3 and math.sqrt(max(0.0, 2 * ratio)) >= least:
                both = (zero + one) * prior / sum(n)
                one, zero = one + both * n[1], zero + both * n[0]
                out[k] = math.log(one / (n[1] * (1 + prior) - one)) - math.log(zero / (n[0] * (1 + prior) - zero)), zero / (n[0] * (1 + prior))
        return out

    def scan(t, odds, prefixes, gap):
        w = token_of(t)
        hits = [(i, next((odds[k][0] for k in (keys_of(x) if prefixes else [(x, 0)]) if k in odds), None)) for i, x in enumerate(w)]
        hits = [(i, v) for i, v in hits if v is not None]
        return len(w), [s for _, _, s in earlier_segments([i for i, _ in hits], [v for _, v in hits], gap)]

    def root(odds, gap):
        f = lambda x: sum(p * math.exp(x * v) for v, p in odds.values()) + max(0.0, 1 - sum(p for _, p in odds.values())) * math.exp(-x * gap) - 1
        low, high = 1e-6, 1e-3
        while f(high) < 0 and high < 1e3:
            low, high = high, high * 2
        for _ in range(80):
            low, high = ((low + high) / 2, high) if f((low + high) / 2) < 0 else (low, (low + high) / 2)
        return high

    evidence = lambda n, s, lam, k: math.log1p(sum(max(0.0, lam * x - math.log(max(k * n, 1e-9))) for x in s))
    best = None
    for prior, least, prefixes in toxicity.SETTINGS:
        odds = {f: table(f, prior, least) for f in range(-1, 4)}
        gap = {f: max(0.1, 2 * sum(p * v for v, p in odds[f].values())) for f in odds}
        lam = {f: root(odds[f], gap[f]) if odds[f] else 1.0 for f in odds}
        got = [(r.toxic > 0, r.fold, *scan(r.text, odds[r.fold], prefixes, gap[r.fold])) for r in drawn]
        top = [(n, lam[f] * max(s)) for bad, f, n, s in got if not bad and s]
        k = min(1.0, len(top) / sum(n * math.exp(-x) for n, x in top)) if top else 1.0
        x = np.array([evidence(n, s, lam[f], k) for _, f, n, s in got])
        y = np.array([g[0] for g in got])
        slope, base = toxicity.logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + base, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -np.where(y, np.log(p), np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-12:
            best = loss, odds[-1], prefixes, gap[-1], lam[-1], k, slope, base
    _, odds, prefixes, gap, lam, k, slope, base = best
    return [1 / (1 + math.exp(-(slope * evidence(*scan(t, odds, prefixes, gap), lam, k) + base))) for t in texts]


def test_toxicity_against_brute_force(spark):
    """Scores of the whole query."""
    rng = random.Random(13)
    calm, bad = [f"word{i}é" for i in range(80)], ["scoundrel", "scoundrels", "wretch", "villainous"]
    rows, labels = [], []
    for i in range(260):
        w = [rng.choice(calm) for _ in range(rng.choice([5, 30, 60]))]
        toxic = rng.random() < 0.2
        for _ in range(3 if toxic else rng.random() < 0.02):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, rng.choice([" ", ", "]).join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "Wretch! scoundrel's villain " * 40), rows[3], (3, "other text"), (None, "wretch")]
    df = spark.createDataFrame([(*r, 0.5, []) for r in rows], "doc_id long, text string, score double, segments array<int>")
    lab = spark.createDataFrame([*labels, (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    drawn = toxicity._sample(df, lab, ~toxicity.held_out(4, 2), toxicity.SAMPLE).collect()
    want = Counter((d, round(s, 7), int(s >= 0.3)) for (d, _), s in zip(rows, plain_toxicity(drawn, [t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, round(r.score, 7), r.predicted) for r in toxicity.toxicity(df, lab).collect()) == want


def earlier_segments(at, score, gap):
    """The same, by looking at all candidates for each new one."""
    held, total, here = [], 0.0, 0
    for p, s in zip(at, score, strict=True):
        total -= gap * (p - here)
        here = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = p, before
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j -= 1
            if j < 0 or held[j][3] >= total:
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
        held.append((first, p, low, total))
    return [(a, b, high - low) for a, b, low, high in held]


def test_maximal_segments_takes_linear_time():
    import time

    rng = random.Random(7)
    for n in (500, 3000):
        at = sorted(rng.sample(range(20 * n), n))
        score = [rng.choice([1.0, 3.0, -2.0, 0.5]) for _ in at]
        assert toxicity.maximal_segments(at, score, 0.1) == earlier_segments(at, score, 0.1)
    for gap, step in ((1.0, 50), (0.1, 2)):  # each candidate begins lower than all before; candidates are joined again and again
        seconds = []
        for n in (20_000, 200_000):
            at, score = list(range(0, n * step, step)), [1.0 + (i * 7 % 11) / 10 for i in range(n)]
            began = time.perf_counter()
            assert toxicity.maximal_segments(at, score, gap)
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 40 * seconds[0] + 0.2 and seconds[1] < 5


def test_toxicity(spark):
    rng = random.Random(3)
    calm, bad = [f"word{i}" for i in range(200)], ["scoundrel", "wretch", "villain"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(calm) for _ in range(60)]
        toxic = rng.random() < 0.25
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    extra = [(2000, None), (2001, ""), (2002, "Scoundrel! wretch, VILLAIN scoundrel"), (None, "word1")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1, None), labels[2], (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    hold = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} >= set(hold) and sum(got[i].predicted == labels[i][1] for i in hold) >= 0.98 * len(hold)
    assert got[2002].predicted == 1 and len(got[2002].segments) >= 1 and got[2000].score == got[2001].score and got[2001].predicted == 0
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_decontamination(spark):
    item = "If John buys 5 apples for 2 dollars each then how much does she pay in total"
    items = spark.createDataFrame([(10, item), (11, None), (12, "hi"), (13, "2 + 2 = 4 and 3 + 3 = 6 so"), (10, item)], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "Some words. " + item + " more words"), (2, "So If Maria Lopez buys 12 apples for 3 euros each then how much does she pay in total ok"), (3, "if it rains the street is wet and nobody goes out"), (4, None), (5, ""),
            (6, "If John buys 5 apples for 2 dollars each."), (7, "x If John buys 5 apples for 2 dollars each then y"), (None, item), (8, "2 + 2 = 5 and 3 + 3 = 7 so"), (9, "we know 2 + 2 = 4 and 3 + 3 = 6 so well"),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()}
    assert {(1, 10), (2, 10), (None, 10), (9, 13)} <= got and not {3, 4, 5, 8} & {d for d, _ in got}
    kept = {r.doc_id for r in decontamination.decontaminate(docs, items).collect()}
    assert kept == {1, 2, 3, 4, 5, 6, 7, 8, 9, None} - {d for d, _ in got}
    blocks = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items, block_windows=10).collect()}
    assert blocks == got


def test_slots_must_be_consistent(spark):
    items = spark.createDataFrame([(1, "if Ann has 3 pears and then Ann eats 3 pears with her old friend today")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "if Bob has 7 pears and then Bob eats 7 pears with her old friend today"), (2, "if Bob has 7 pears and then Tim eats 9 pears with her odd friend today")], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.matches(docs, items).collect()} == {1}


def test_names_and_capitals(spark):
    """Copies in other capitals, items of few words behind other text, and names that open sentences."""
    items = [(1, "The old Wolf runs past every quiet farm on the long road to Trier"), (2, "Which river is the longest one in Peru"), (3, "Tom has 3 apples. Sara gives 4 apples more to the boy. How many are left")]
    rows = [
        (1, "x " + items[0][1].lower() + " y"), (2, items[0][1].upper()), (3, "He asked, " + items[1][1] + " and left"), (4, "so: which river is the longest one in peru"),
        (5, "Ann has 12 apples. Bob gives 5 apples more to the boy. How many are left"), (6, "now Ann has 12 apples. Bob gives 5 apples more to the boy. How many are left"), (7, "The boy has apples. How many rivers are left on the long road"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)}


UNITS = set(decontamination.UNITS)


def plain_readings(text):
    """(kind, value) of the tokens of a text, for each reading."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "")]
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    for openings in (False, True):
        out, before = [], None
        for i, (a, b, word) in enumerate(found):
            opens = i == 0 or re.search(r"[.!?\n]", text[found[i - 1][1] : a]) is not None
            kind = "number" if word[0] in "0123456789" else None
            if kind is None and i and low(word) in UNITS and not opens and found[i - 1][2][0] in "0123456789":
                kind = "unit"
            if kind is None and (word[0].isascii() and word[0].isupper() or "\xc0" <= word[0] <= "\xde") and (openings or not opens):
                kind = "name"
            between = text[found[i - 1][1] : a] if i else ""
            if kind and kind == before and (kind == "number" and between in (".", ",") or kind == "name" and between == " " and not opens):
                out[-1] = (kind, out[-1][1] + (low(word),))
            else:
                out.append((kind or low(word), (low(word),)))
            before = kind
        yield [(k, v, k in ("number", "unit", "name") and v != (k,)) for k, v in out]
    yield [(low(word), (low(word),), False) for _, _, word in found]


def plain_contaminated(docs, items, window=8, literal=4, least=5):
    out = []
    for d, text in docs:
        mine, hit, most = list(plain_readings(text)), set(), 0
        for item, other in items:
            if other is None:
                continue
            theirs = list(plain_readings(other))
            for i, x in [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]:
                t, u = mine[i], theirs[x]
                n = min(window, len(u))
                if len(u) < least:
                    continue
                for shift in range(-len(u), len(t) + 1):
                    told, covered = {}, set()
                    for p in range(len(u) - n + 1):
                        if not 0 <= shift + p <= len(t) - n:
                            continue
                        a, b = u[p : p + n], t[shift + p : shift + p + n]
                        if [k for k, _, _ in a] != [k for k, _, _ in b] or [s for _, _, s in a] != [s for _, _, s in b]:
                            continue
                        if sum(not s for _, _, s in a) < literal and [v for _, v, _ in a] != [v for _, v, _ in b]:
                            continue
                        trial = dict(told)
                        if all(trial.setdefault((k, v), w) == w for (k, v, s), (_, w, _) in zip(a, b, strict=True) if s):
                            told = trial
                            covered |= set(range(p, p + n))
                    if len(covered) >= 13 or len(covered) >= 0.6 * len(u) and covered:
                        hit.add(item)
                        most = max(most, len(covered))
        if hit:
            out.append((d, tuple(sorted(x for x in hit if x is not None)), most))
    return Counter(out)


def test_contaminated_against_brute_force(spark):
    """All rows of the query, on items and documents that are put together from few words, names, numbers and units."""
    rng = random.Random(31)
    pieces = ["Ann", "Bob", "Lee Roy", "3", "17", "4.5", "9 km", "8 kg", "the", "a", "boat", "goes", "to", "town.", "Then", "it", "rains!", "how", "many", "Äpfel", "are", "left?"]
    say = lambda n: " ".join(rng.choice(pieces) for _ in range(n))
    items = [(i, say(rng.choice([3, 5, 6, 9, 14, 20]))) for i in range(12)] + [(50, None), (51, "1 2 3 4 5 6 7 8 9 10"), (3, say(9)), (None, say(10))]
    rows = [(1, None), (2, ""), (3, " ".join(str(i % 10) for i in range(60))), (4, "1 2 3 4 5 6 7 8 9 10 11"), (None, items[0][1])]
    for i in range(40):
        other = rng.choice([x for _, x in items if x])
        w = other.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(pieces)
        text = f"{say(rng.randrange(4))} {' '.join(w)} {say(rng.randrange(4))}"
        rows.append((100 + i // 2, rng.choice([text, text, text.lower(), text.upper()])))
    rows.append((7, " ".join(say(8) for _ in range(150))))
    df = spark.createDataFrame([(d, t, [1], 2) for d, t in rows], "doc_id long, text string, item_ids array<int>, covered int")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contaminated(rows, items)
    for options in ({}, {"block_windows": 30}):
        assert Counter((r.doc_id, tuple(r.item_ids), r.covered) for r in decontamination.contaminated(df, it, **options).collect()) == want
    kept = decontamination.decontaminate(df, it)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows) - Counter(d for d, _, _ in want.elements())


def test_mixing(spark):
    rng = random.Random(6)
    kinds = {"clean": ("alpha beta gamma delta", 1, 0), "low": ("junk spam blah filler", 0, 0), "toxic": ("scum idiot moron trash", 1, 1)}
    rows, labels, truth = [], [], {}
    for i in range(1200):
        kind = rng.choices(list(kinds), [6, 2, 2])[0]
        w, q, t = kinds[kind]
        rows.append((i, " ".join(rng.choice(w.split()) + str(rng.randrange(9)) for _ in range(50)), "x"))
        truth[i] = kind
        if i % 2:
            labels.append((i, q, t))
    df = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x"), (None, "alpha1", "x")], "doc_id long, text string, rate string")
    lab = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.8, "low": 0.1, "toxic": 0.1}
    got = mixing.mixture(df, lab, targets).collect()
    assert len(got) == len(rows) + 3 and sum(r.domain == truth[r.doc_id] for r in got if r.doc_id in truth) > 0.97 * len(rows)
    sums = Counter()
    for r in got:
        for d, q in zip(("clean", "low", "toxic"), r.posterior, strict=True):
            sums[d] += r.rate * r.n_tokens * q
        assert 0 <= r.rate <= 1 and r.copies in (0, 1) and abs(sum(r.posterior) - 1) < 1e-9
    assert all(abs(sums[d] / sum(sums.values()) - targets[d]) < 0.03 for d in targets)
    kept = mixing.mix(df, lab, targets)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.copies)


def test_mixing_with_a_rare_domain(spark):
    """Toxic documents are 1 %, their target is 8 %: no clean document may go for it; with ``repeat`` the targets are met."""
    rng = random.Random(9)
    kinds = {"clean": ("alpha beta gamma delta", 1, 0), "low": ("junk spam blah filler", 0, 0), "toxic": ("scum idiot moron trash", 1, 1)}
    truth = {i: "toxic" if i % 100 == 7 else "low" if i % 5 == 0 else "clean" for i in range(1500)}
    rows = [(i, " ".join(rng.choice(kinds[k][0].split()) + str(rng.randrange(9)) for _ in range(50))) for i, k in truth.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, *kinds[k][1:]) for i, k in truth.items()], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.84, "low": 0.08, "toxic": 0.08}
    kept, there = Counter(truth[r.doc_id] for r in mixing.mix(df, lab, targets).collect()), Counter(truth.values())
    assert kept["clean"] >= 0.97 * there["clean"] and kept["toxic"] >= 0.8 * there["toxic"] and kept["low"] < 0.7 * there["low"]
    got = mixing.mixture(df, lab, targets, repeat=True).collect()
    sums = Counter()
    for r in got:
        sums[truth[r.doc_id]] += r.copies * r.n_tokens
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
    assert all(abs(sums[d] / sum(sums.values()) - targets[d]) < 0.03 for d in targets)
    assert sum(r.copies > 0 for r in got if truth[r.doc_id] == "clean") >= 0.97 * there["clean"]


def direct_rates(q, n, w):
    """Rates with the least objective, by cyclic exact minimisation of one rate after another."""
    p, total = n @ q / n.sum(), n.sum()
    r, gap = np.ones(len(q)), n @ q / n.sum() - w
    for _ in range(4000):
        before = r.copy()
        for i in range(len(q)):
            slope, curve = q[i] @ (gap / p) + mixing.RIDGE * (r[i] - 1), n[i] / total * (q[i] @ (q[i] / p)) + mixing.RIDGE
            new = max(0.0, r[i] - slope / curve)
            gap = gap + (new - r[i]) * n[i] / total * q[i]
            r[i] = new
        if np.abs(r - before).max() < 1e-10:
            break
    return r


@pytest.mark.parametrize("sharpness", [0.3, 3.0])
def test_solve_against_a_direct_solution(spark, sharpness):
    """Posteriors that overlap a little and much, targets far from what is there; rates of the distributed steps are those of the optimum."""
    rng = np.random.default_rng(17)
    z = rng.normal(size=(60, 3)) * sharpness + np.array([1.0, 0.0, -1.0])
    q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n = rng.integers(1, 400, 60).astype(float)
    narrow = spark.createDataFrame([(i, int(m), x.tolist()) for i, (m, x) in enumerate(zip(n, q, strict=True))] + [(99, 0, [1.0, 0.0, 0.0])], "doc_id long, n long, q array<double>")
    w = np.array([0.2, 0.5, 0.3])
    found = mixing.solve(narrow, w, repeat=True)
    r, best = mixing.rates(q, found["history"], found["eta"]), direct_rates(q, n, w)
    assert np.abs(r - best).max() < 0.05 and found["moved"] < mixing.ENOUGH and (r >= 0).all()
    assert np.abs((r * n) @ q / n.sum() - (best * n) @ q / n.sum()).max() < 1e-3 and np.abs(found["reached"] - (r * n) @ q / n.sum()).max() < 1e-9


def plain_posterior(text, model):
    """Tokens, and the posterior of a text: tokens and prefixes by their slots, shapes by their bins, one document at a time."""
    chosen, present = {int(x): i for i, x in enumerate(model["slots"])}, set()
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "")]
    if not found:
        return 0, model["prior"]
    for x in found:
        w = T.words(pa.array([x]), plain=True)
        present |= {int(w.hash[0] % np.uint64(mixing.SLOTS)), int(T.mix(T.prefix_hashes(w, mixing.PREFIX) + np.uint64(mixing.PREFIX))[0] % np.uint64(mixing.SLOTS))}
    size = len(text.encode())
    capitals, signs = (len(re.findall(p, text)) for p in ("[A-Z]", r"[!-/:-@\[-`{-~]"))
    share = [len(set(found)) / len(found), capitals / size * 4, signs / size * 4, sum(len(x.encode()) for x in found) / len(found) / mixing.BINS]
    present |= {mixing.SLOTS + i * mixing.BINS + min(mixing.BINS - 1, int(x * mixing.BINS)) for i, x in enumerate(share)}
    z = model["heat"] * (sum(model["weights"][chosen[x]] for x in present if x in chosen) + model["weights"][-1])
    return len(found), np.exp(z - z.max()) / np.exp(z - z.max()).sum()


@pytest.mark.parametrize("repeat", [True, False])
def test_mixture_against_brute_force(spark, repeat):
    """Tokens, posteriors, domains and rates of the whole query: posteriors text by text, rates one by one to the optimum."""
    rng = random.Random(26)
    kinds = {"clean": ("Alpha beta gamma delta, epsilon", 1, 0), "low": ("junk!! spam## blah filler", 0, 0), "toxic": ("scum idiot MORON trash", 1, 1)}
    rows, labels = [], []
    for i in range(150):
        kind = rng.choices(list(kinds), [6, 2, 2])[0]
        pool = kinds[kind][0].split() + (kinds["clean"][0].split() if rng.random() < 0.4 else [])
        rows.append((i, " ".join(rng.choice(pool) + rng.choice(["", str(rng.randrange(9))]) for _ in range(rng.choice([3, 20, 60]))), "x", 0.5))
        labels.append((i, *kinds[kind][1:]))
    rows += [(500, None, "x", 0.5), (501, "", "x", 0.5), (501, "!!", "x", 0.5), (None, "Alpha beta", "x", 0.5), rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, q string, u double")
    lab = spark.createDataFrame([*labels, labels[0], (1, None, None)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.6, "low": 0.2, "toxic": 0.2}
    model = mixing.fit(df, lab)
    n, q = zip(*(plain_posterior(t, model) for _, t, *_ in rows), strict=True)
    n, q = np.array(n, float), np.array(q)
    weights = mixing.target_weights(model, targets)
    r = direct_rates(q[n > 0], n[n > 0], weights if repeat else mixing.reachable(weights, n @ q / n.sum()))
    if not repeat:
        main = int(weights.argmax())
        p = n[n > 0] @ q[n > 0] / n.sum()
        gap = (n[n > 0] * r) @ q[n > 0] / n.sum() - mixing.reachable(weights, p)
        r = np.minimum(1.0, r / max(1e-12, 1 - gap[main] / p[main] / mixing.RIDGE))  # a document that is wholly of the main domain has rate 1
    want = {}
    for (d, t, *_), m, x in zip([row for row, k in zip(rows, n, strict=True) if k], n[n > 0], zip(q[n > 0], r, strict=True), strict=True):
        want[d, t] = (m, *x)
    got = mixing.mixture(df, lab, targets, repeat=repeat).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for row, k, x in zip(rows, n, q, strict=True):
        texts[row[0], int(k), tuple(np.round(x, 6))].append(row)
    for g in got:
        key = g.doc_id, g.n_tokens, tuple(np.round(g.posterior, 6))
        assert key in texts and g.domain == model["domains"][int(np.argmax(g.posterior))]
        if g.n_tokens:
            _, _, rate = want[texts[key][0][0], texts[key][0][1]]
            assert abs(g.rate - rate) < 0.05 and math.floor(g.rate) <= g.copies <= math.ceil(g.rate)


def test_regression_finds_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.random((300, 12)) < 0.3
    own = (x[:, 0] * 1 + (x[:, 1] & ~x[:, 0]) * 2 + (rng.random(300) < 0.1)).clip(0, 2).astype(np.int64)
    at, first = np.nonzero(x)[1], np.concatenate(([0], np.cumsum(x.sum(axis=1))))
    w = mixing.regress(at, first, own, 12, 3, rounds=300)

    def gradient(w):
        gap = (mixing._softmax(x @ w[:-1] + w[-1]) - np.eye(3)[own]) / 300
        return np.concatenate([x.T @ gap + 1e-4 * w[:-1], gap.sum(axis=0, keepdims=True)])

    assert np.abs(gradient(w)).max() < 2e-3 < np.abs(gradient(np.zeros((13, 3)))).max()


def test_totals_set_rates_beside_targets(spark):
    m = spark.createDataFrame([(10, 2.0, 2, [0.5, 0.5]), (20, 0.5, 1, [0.0, 1.0])], "n_tokens long, rate double, copies int, posterior array<double>")
    got = {r.domain: (r.target, round(r.expected, 6), round(r.drawn, 6)) for r in mixing.totals(m, ["a", "b"], {"a": 1.0, "b": 3.0}).collect()}
    assert got == {"a": (0.25, round(10 / 30, 6), 0.25), "b": (0.75, round(20 / 30, 6), 0.75)}


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (
        ngram_jaccard.jaccard_join(nothing), language_id.identify(nothing), toxicity.toxicity(nothing, labels), lm_score.lm_score(nothing), decontamination.contaminated(nothing, items), substring_dedup.substring_dedup(nothing),
        embedding_dedup.near_duplicates(vectors), mixing.mixture(nothing, labels), sharding.shard_slots(nothing), suffix_dedup.suffix_dedup(nothing), ngram_jaccard.deduplicate(nothing), sharding.with_shard(nothing),
    ):
        assert df.count() == 0


def test_nothing_to_learn_from(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert {(r.rate, r.copies) for r in mixing.mixture(docs, labels).collect()} == {(1.0, 1)}
    bare = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.identify(bare).collect()} == {"und"}
