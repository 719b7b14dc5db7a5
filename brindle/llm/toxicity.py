"""Toxic passages as maximal scoring segments of token log-odds.

Each token has a log-odds score between toxic and other documents, smoothed by a Dirichlet prior in proportion to its
frequency in both.  A token that is too rare for odds of its own takes those of its longest prefix (of 6, 5 or 4 bytes)
that has; tokens whose classes don't differ significantly (signed root of the likelihood ratio) cost ``gap`` each.  One linear scan finds all maximal
scoring segments of a document (tokens between hits only lower the running sum, so the scan visits hits alone).  Scores of segments are put on
the scale of extreme-value statistics: with lambda the root of E[exp(lambda s)] = 1 over other documents and K fitted to their
best segments, ``lambda S - log(K n)`` says how far a segment is above what n tokens give by chance.  A document's sum over
significant segments is turned into a probability by a logistic fit.

Learning uses a bounded sample of labelled rows (``sample``, those with the least hash of their id), dealt into ``FOLDS`` folds.  Each fold is judged
by odds that were counted on the others; the strength of the prior, the threshold of significance and whether prefixes count are those of
``SETTINGS`` with the least log loss over all folds, and the logistic curve and K are fitted to the same judgements.  Rows that may not be learned
from have no part in any of it.  Scoring covers all tokens of all documents.  What is broadcast are tokens that are significant in the sample: each
occurs in three of its documents at least, so there are at most a third as many as the sample has different tokens in documents.

Defined results: null and empty texts have no segments and get the score of a text without evidence; if several label rows
share a ``doc_id``, it is toxic if one of them says so; of documents that share an id one text is learned from, the first in order; equal texts are one; null
labels teach nothing; without both classes the score is the share of toxic labels (0 without labels); further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as T
from brindle.llm.language_id import held_out
from brindle.llm.shared import checkpoint, least_hashed, one_text

SAMPLE = 24_000
FOLDS = 4
GAP = 0.1
#: Pseudo-counts of a token in a class, as a share of what its frequency in both classes makes one expect there; least significance; whether prefixes count.
SETTINGS = [(prior, z, prefixes) for prior in (0.05, 0.5) for z in (2.5, 3.5, 4.5) for prefixes in (True, False)]


def maximal_segments(at: list[int], score: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score): scores ``score[i]`` at ``at[i]``, minus ``gap`` elsewhere.

    Candidates are held with the running sum before and after them, and the nearest one before that begins lower (``lower``).  A new one looks for its
    own along these: what it passes over, no later one visits again, as that begins from the new one.  If none begins lower, all that are held
    are final and leave.  If the one found ends lower too, it is joined with the new one and all between.  So each is visited a fixed number of times.
    """
    done: list[tuple[int, int, float]] = []
    first, last, low, high, lower = [], [], [], [], []  # of held candidates
    total, here = 0.0, 0
    for p, s in zip(at, score, strict=True):
        total -= gap * (p - here)
        here = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        begin, least, j = p, before, len(first) - 1
        while j >= 0 and low[j] >= least:
            j = lower[j]
        while j >= 0 and high[j] < total:
            begin, least = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:]
            j = lower[j]
            del lower[len(first) :]
        if j < 0:
            done += [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]
            first, last, low, high, lower = [], [], [], [], []
        first.append(begin)
        last.append(p)
        low.append(least)
        high.append(total)
        lower.append(j)
    return done + [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]


PREFIXES = (6, 5, 4)


def features(w: T.Words) -> list[np.ndarray]:
    """Hashes of the tokens and of their prefixes; a token shorter than a prefix has none of that length (0)."""
    out = [w.hash]
    for n in PREFIXES:
        long = w.end - w.start > n
        h = T.prefix_hashes(w, n, lower=True)
        out.append(np.where(long, T.mix(h + np.uint64(n)), np.uint64(0)))
    return out


def _sample(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int) -> DataFrame:
    """``text, toxic, fold`` of at most ``sample`` documents."""
    rows = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    ids = least_hashed(rows, "doc_id", sample, 13).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Copies would count as evidence again: equal texts are one.
    texts = one_text(docs, ids).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    return checkpoint(texts.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))


def _present(batches):
    """Documents that have each token, by class and fold (class * FOLDS + fold); token 0: the sums over all tokens."""
    for batch in T.batches(batches):
        w = T.words(batch.column("text"), lower=True, plain=True)
        group = batch.column("toxic").to_numpy().clip(0, 1) * FOLDS + batch.column("fold").to_numpy()
        every = features(w)
        h, doc = np.concatenate(every), np.tile(w.doc, len(every))
        h, doc = h[h != 0], doc[h != 0]
        key = np.lexsort((h, doc))
        h, d = h[key], doc[key]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        found, at = np.unique(h[new], return_inverse=True)
        n = np.bincount(at * 2 * FOLDS + group[d[new]], minlength=2 * FOLDS * len(found)).reshape(-1, 2 * FOLDS)
        found, n = np.append(found, np.uint64(0)), np.concatenate([n, n.sum(axis=0, keepdims=True)])
        yield pa.record_batch([pa.array(found.astype(np.int64)), *(pa.array(n[:, i]) for i in range(2 * FOLDS))], names=["token", *(f"n{i}" for i in range(2 * FOLDS))])


def _without(fold: int, kind: int) -> Column:
    """Documents of a class outside a fold (-1: all)."""
    return sum((F.col(f"n{kind * FOLDS + f}") for f in range(FOLDS) if f != fold), F.lit(0))


def significance(ones: Column, zeros: Column, n1: float, n0: float) -> Column:
    """Root of the likelihood ratio of one share in both classes against a share in each."""
    share = (ones + zeros) / (n1 + n0)
    part = lambda n, p: F.when(n > 0, n * F.log(n / p)).otherwise(0.0)
    ratio = part(ones, share * n1) + part(n1 - ones, (1 - share) * n1) + part(zeros, share * n0) + part(n0 - zeros, (1 - share) * n0)
    return F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def odds(drawn: DataFrame) -> dict | None:
    """Sorted tokens that are significant without some fold (or without none), and for each such count and each setting their log-odds (NaN: no odds) and their
    share of the tokens of other documents; None without both classes."""
    counts = drawn.mapInArrow(_present, ", ".join(["token long", *(f"n{i} long" for i in range(2 * FOLDS))])).groupBy("token").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(2 * FOLDS)))
    counts = checkpoint(counts)
    sums = counts.where("token = 0").first()
    if sums is None:
        return None
    size = np.array([[sum(sums[f"n{kind * FOLDS + f}"] for f in range(FOLDS) if f != fold) for kind in (0, 1)] for fold in range(-1, FOLDS)], float)
    if not size[0].all():
        return None
    usable = [i for i in range(FOLDS + 1) if size[i].all()]
    z = [significance(_without(i - 1, 1), _without(i - 1, 0), size[i][1], size[i][0]).alias(f"z{i}") for i in usable]
    found = counts.where("token <> 0").where(F.expr("n" + " + n".join(map(str, range(2 * FOLDS)))) >= 3).select("token", *(f"n{i}" for i in range(2 * FOLDS)), *z)
    rows = found.where(F.greatest(*(F.col(f"z{i}") for i in usable), F.lit(0.0)) >= min(s[1] for s in SETTINGS)).toArrow()
    token = rows.column("token").to_numpy().astype(np.uint64)
    order = np.argsort(token)
    n = np.stack([rows.column(f"n{i}").to_numpy()[order] for i in range(2 * FOLDS)], axis=1).astype(float).reshape(-1, 2, FOLDS)
    value, share = np.full((FOLDS + 1, len(SETTINGS), len(token)), np.nan), np.zeros((FOLDS + 1, len(SETTINGS), len(token)))
    for i in usable:
        mine = n.sum(axis=2) - (n[:, :, i - 1] if i else 0)
        n0, n1 = size[i]
        z = rows.column(f"z{i}").to_numpy()[order]
        for k, (prior, least, _) in enumerate(SETTINGS):
            both = mine.sum(axis=1) * prior / (n0 + n1)
            one, zero = mine[:, 1] + both * n1, mine[:, 0] + both * n0
            good = (z >= least) & (one > 0) & (zero > 0)
            one, zero = np.where(good, one, 1.0), np.where(good, zero, 1.0)
            more = 1 + prior
            value[i, k] = np.where(good, np.log(one / (n1 * more - one)) - np.log(zero / (n0 * more - zero)), np.nan)
            share[i, k] = np.where(good, zero / (n0 * more), 0.0)
    return {"tokens": token[order], "value": value, "share": share}


def _root(score: np.ndarray, share: np.ndarray, gap: float) -> float:
    """The positive root of E[exp(x s)] = 1, s being -gap but for the given scores."""
    rest = max(0.0, 1 - share.sum())
    value = lambda x: (share * np.exp(np.minimum(x * score, 500))).sum() + rest * np.exp(-x * gap) - 1
    low, high = 1e-6, 1e-3
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _places(w: T.Words, tokens: np.ndarray, prefixes: bool) -> list[np.ndarray]:
    """For each feature of each token its place among ``tokens``, or -1; whole tokens first, then the longest prefixes."""
    out = []
    for h in features(w) if prefixes else [w.hash]:
        at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
        out.append(np.where(tokens[at] == h, at, -1))
    return out


def _values(places: list[np.ndarray], value: np.ndarray, prefixes: bool) -> np.ndarray:
    """Log-odds of each token; NaN without."""
    out = np.full(len(places[0]), np.nan)
    for at in reversed(places if prefixes else places[:1]):
        here = np.where(at >= 0, value[at], np.nan)
        out = np.where(np.isnan(here), out, here)
    return out


def _hits(w: T.Words, value: np.ndarray):
    """For each text: number of tokens, positions of hits, their scores."""
    hit = np.flatnonzero(~np.isnan(value))
    bounds = np.searchsorted(hit, w.first)
    value = value[hit]
    for d, n in enumerate(np.diff(w.first).tolist()):
        a, b = bounds[d], bounds[d + 1]
        yield n, (hit[a:b] - w.first[d]).tolist(), value[a:b].tolist()


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> dict:
    drawn = _sample(docs, labels, may_learn, sample)
    model = {"tokens": np.zeros(0, np.uint64), "value": np.zeros(0), "prefixes": False, "gap": GAP, "lambda": 1.0, "k": 1.0, "slope": 0.0, "base": 0.0}
    share = drawn.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    model["base"] = share or 0.0
    table = odds(drawn)
    if table is None or not len(table["tokens"]):
        return model
    # A drift that is negative in other documents, whatever the share of hits there.
    known = np.nan_to_num(table["value"])
    gaps = np.maximum(GAP, 2 * (table["share"] * known).sum(axis=2))
    shared = docs.sparkSession.sparkContext.broadcast((table["tokens"], table["value"], gaps))

    def judge(batches):
        tokens, value, gap = shared.value
        for batch in T.batches(batches):
            w = T.words(batch.column("text"), lower=True, plain=True)
            places, fold = _places(w, tokens, True), batch.column("fold").to_numpy()
            held, rows = fold[w.doc], [[] for _ in fold]
            for k, (_, _, prefixes) in enumerate(SETTINGS):
                # Each document by the odds of the other folds.
                each = np.full(len(w.hash), np.nan)
                for f in np.unique(fold):
                    mine = np.flatnonzero(held == f)
                    each[mine] = _values([p[mine] for p in places], value[f + 1, k], prefixes)
                for d, (_, at, score) in enumerate(_hits(w, each)):
                    rows[d].append([s for _, _, s in maximal_segments(at, score, gap[fold[d] + 1, k])])
            yield pa.record_batch([batch.column("toxic"), batch.column("fold"), pa.array(np.diff(w.first), pa.int64()), pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=["toxic", "fold", "n", "segments"])

    seen = drawn.mapInArrow(judge, "toxic int, fold int, n long, segments array<array<double>>").toArrow()  # bounded by the sample
    y, fold, n = seen.column("toxic").to_numpy() > 0, seen.column("fold").to_numpy(), seen.column("n").to_numpy()
    segments = seen.column("segments").to_pylist()
    best = None
    for k in range(len(SETTINGS)):
        lam = np.array([_root(known[i, k], table["share"][i, k], gaps[i, k]) if table["share"][i, k].any() else 1.0 for i in range(FOLDS + 1)])
        top = [(m, lam[f + 1] * max(s[k])) for m, f, s, bad in zip(n, fold, segments, y, strict=True) if not bad and s[k]]
        k_fit = min(1.0, len(top) / sum(m * np.exp(-s) for m, s in top)) if top else 1.0
        x = np.array([evidence(m, s[k], lam[f + 1], k_fit) for m, f, s in zip(n, fold, segments, strict=True)])
        slope, base = logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + base, -30, 30))), 1e-9, 1 - 1e-9)
        loss = float(-np.where(y, np.log(p), np.log(1 - p)).mean())
        if best is None or loss < best[0] - 1e-12:
            best = (loss, k, float(lam[0]), float(k_fit), slope, base)
    _, k, lam, k_fit, slope, base = best
    good = ~np.isnan(table["value"][0, k])
    return {"tokens": table["tokens"][good], "value": table["value"][0, k][good], "prefixes": SETTINGS[k][2], "gap": float(gaps[0, k]), "lambda": lam, "k": k_fit, "slope": slope, "base": base}


def evidence(n: int, segments: list[float], lam: float, k: float) -> float:
    """Sum over segments of how far each is above chance; 0 without a significant one."""
    chance = np.log(max(k * n, 1e-9))
    return float(np.log1p(sum(max(0.0, lam * s - chance) for s in segments)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base logit of a logistic curve, by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, segments``: segments that stand out, as first token, tokens and log-odds above chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shared.value
        for batch in T.batches(batches):
            scores, spans = [], []
            w = T.words(batch.column("text"), lower=True, plain=True)
            value = _values(_places(w, m["tokens"], m["prefixes"]), m["value"], m["prefixes"]) if len(m["tokens"]) else np.full(len(w.hash), np.nan)
            for n, at, value in _hits(w, value):
                found = maximal_segments(at, value, m["gap"]) if at else []
                chance = np.log(max(m["k"] * n, 1e-9))
                spans.append([{"first": a, "tokens": b - a + 1, "excess": m["lambda"] * s - chance} for a, b, s in found if m["lambda"] * s > chance])
                if m["slope"]:
                    x = evidence(n, [s for _, _, s in found], m["lambda"], m["k"])
                    scores.append(float(1 / (1 + np.exp(-np.clip(m["slope"] * x + m["base"], -700, 700)))))
                else:
                    scores.append(float(m["base"]))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("tokens", pa.int64()), ("excess", pa.float64())]))),
            ], names=["doc_id", "score", "predicted", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, segments array<struct<first: long, tokens: long, excess: double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, segments``; learns from labels that aren't held out."""
    out = held_out(4, 2)
    return score(docs, fit(docs, labels, ~out)).select("doc_id", out.alias("held_out"), "score", "predicted", "segments")


__all__ = ["fit", "maximal_segments", "odds", "score", "toxicity"]
