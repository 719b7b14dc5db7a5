"""Language identification with interpolated Kneser-Ney models over characters.

For each language a 4-gram model over lower-case letters (every letter is a symbol of its own, every run of other characters one break) is kept as sorted
arrays of packed n-grams with their discounted probabilities, and of contexts with their back-off weights; a probability is a chain of binary searches.
A document gets the language of lowest cross-entropy per character over its whole text, and is rejected if that entropy is far above
what texts of that language and length show in a calibration sample: above its 99.5 % quantile and 8 spreads, or 16 spreads at most, so that
stray documents of the sample don't set the limit.  Languages with fewer than 20 calibration documents take spreads and limit of all
languages together; one without any (a single labelled document) also takes the highest usual entropy of the others.

Models are fitted on a bounded sample of labelled documents: of each language ``per_language`` for the model and about as many for calibration, twice as many in all at most, those
with the least hash of their id, and the ``most_languages`` languages with most documents.  How small a hash must be is read off a histogram of ``CELLS`` cells a
language, so nothing is ranked.  Documents that share an id count once.  n-grams of the sample are counted on the executors; the driver gets distinct n-grams, and a few numbers for each calibration document.

Defined results: a text that is null or has no letter, or any text if nothing could be learned, is ``und`` with score 0 and rejected;
without any calibration document in any language only those are rejected; letters beyond the first 65,536 code points share 2048 symbols;
ties go to the language that sorts first; rows with null ``doc_id`` are scored and never learned from; rows with null ``lang`` likewise; of documents that share
an id the first language in order is learned from, and the first text; columns named as those of a result are replaced, others kept.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as T
from brindle.llm.shared import checkpoint

ORDER = 4
BREAK = 1  # symbol of all that is no letter
SYMBOLS = 1 << 16
PER_LANGUAGE = 2000
CELLS = 1024
LANGUAGES = 200
STRAY = 0.005  # share of a language's calibration documents that may be noise or wrongly labelled
LIMITS = (8.0, 16.0)  # least and largest rejection limit, in spreads


@cache
def _symbols() -> np.ndarray:
    """The symbol of each of the first 65,536 code points: a letter's own number, which is 65 at least, else BREAK."""
    return np.array([i if chr(i).isalpha() else BREAK for i in range(SYMBOLS)], np.uint16)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each after three breaks; and where each text begins."""
    parts, first, at = [], [0], 0
    for t in column.to_pylist():
        c = np.frombuffer(("   " + (t or "").lower()).encode("utf-32-le", "replace"), np.uint32)
        parts.append(c)
        at += len(c)
        first.append(at)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(first)


def symbols(points: np.ndarray) -> np.ndarray:
    high = points >= SYMBOLS
    out = _symbols()[np.where(high, 32, points)]
    if high.any():
        found, at = np.unique(points[high], return_inverse=True)
        # Surrogates are no letters: their 2048 numbers are free.
        out[high] = np.array([0xD800 + i % 2048 if chr(i).isalpha() else BREAK for i in found], np.uint16)[at]
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts, the text of each, and whether each text has a letter. Runs of non-letters are one break."""
    points, first = code_points(column)
    c = symbols(points)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BREAK) | (c[:-1] != BREAK)
    for i in range(3):
        keep[first[:-1] + i] = True
    before = np.zeros(len(c) + 1, np.int64)
    np.cumsum(c != BREAK, out=before[1:])
    has = before[first[1:]] > before[first[:-1]]
    c, doc = c[keep].astype(np.uint64), doc[keep]
    if len(c) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    packed = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
    own = doc[3:] == doc[:-3]
    return packed[own], doc[3:][own], has


class KneserNey:
    """Interpolated Kneser-Ney from counts of packed 4-grams."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray):
        self.levels = []
        codes, n = packed.astype(np.uint64), counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            where = np.argsort(codes)
            codes, n = codes[where], n[where]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            cut = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, first = np.unique(codes >> np.uint64(16), return_index=True)
            total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(n)))
            at = np.searchsorted(context, codes >> np.uint64(16))
            self.levels.append((codes, np.maximum(n - cut, 0) / total[at], context, cut * kinds / total))
            # Below the highest order, a gram counts once for each symbol that comes before it.
            shorter = codes & np.uint64((1 << 16 * (order - 1)) - 1)
            codes, n = np.unique(shorter, return_counts=True)
            n = n.astype(np.float64)
        self.levels.reverse()

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        p = np.full(len(packed), 1 / SYMBOLS)
        for order, (codes, share, context, weight) in enumerate(self.levels, 1):
            asked = packed & np.uint64((1 << 16 * order) - 1)
            at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
            c = np.minimum(np.searchsorted(context, asked >> np.uint64(16)), len(context) - 1)
            known = context[c] == asked >> np.uint64(16)
            p = np.where(codes[at] == asked, share[at], 0.0) + np.where(known, weight[c], 1.0) * p
        return np.log(p)


class Scorer:
    """Log-probabilities of n-grams in all languages; those seen before are kept."""

    LIMIT = 1 << 20

    def __init__(self, models: list[KneserNey]):
        self.models = models
        self.codes, self.values = np.zeros(0, np.uint64), np.zeros((0, len(models)))

    def sums(self, packed: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities for each text and language, and the n-grams of each text."""
        found, at = _distinct(packed)
        new = found[~np.isin(found, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) > self.LIMIT:
                self.codes, self.values, new = new[:0], self.values[:0], found
            codes = np.concatenate([self.codes, new])
            values = np.concatenate([self.values, np.stack([m.log_probability(new) for m in self.models], axis=1)])
            order = np.argsort(codes)
            self.codes, self.values = codes[order], values[order]
        own = self.values[np.searchsorted(self.codes, found)]
        n = np.bincount(doc, minlength=n_docs)
        out = np.zeros((n_docs, len(self.models)))
        first = np.cumsum(n) - n
        full = np.flatnonzero(n)
        for i in range(len(self.models)):
            out[full, i] = np.add.reduceat(own[:, i][at], first[full]) if len(full) else 0
        return out, n


def _distinct(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse; by counting where few different symbols occur."""
    there = np.zeros(SYMBOLS, bool)
    parts = [(packed >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in (3, 2, 1, 0)]
    for p in parts:
        there[p] = True
    present = np.flatnonzero(there)
    d = len(present)
    if d**4 > 1 << 24:
        return np.unique(packed, return_inverse=True)
    rank = np.zeros(SYMBOLS, np.int32)
    rank[present] = np.arange(d)
    cell = np.zeros(len(packed), np.int32)
    for p in parts:
        cell = cell * np.int32(d) + rank[p]
    seen = np.zeros(d**4, bool)
    seen[cell] = True
    full = np.flatnonzero(seen)
    place = np.zeros(d**4, np.int32)
    place[full] = np.arange(len(full))
    found, rest = np.zeros(len(full), np.uint64), full
    for i in range(4):
        found |= present[rest % d].astype(np.uint64) << np.uint64(16 * i)
        rest = rest // d
    return found, place[cell]


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def sample_of(docs: DataFrame, may_learn: Column, per_language: int, most_languages: int = LANGUAGES) -> DataFrame:
    """``doc_id, lang, text, nth`` of at most ``per_language`` labelled documents of each language; ``nth`` counts cells of the hash's range from the first that has any."""
    ids = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    # Of a language with many documents only those with a small hash can be drawn: about four times as many as are wanted.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language + 400) / F.col("n"))
    place = F.xxhash64(F.lit(11), "doc_id").cast("double") / float(1 << 64) + 0.5
    near = ids.join(F.broadcast(sizes), "lang").where(place <= share).withColumn("cell", F.floor(place / share * CELLS).cast("int"))
    near = checkpoint(near.groupBy("doc_id").agg(F.min(F.struct("lang", "cell")).alias("x")).select("doc_id", "x.lang", "x.cell"))
    drawn: dict[str, list] = {}
    for r in near.groupBy("lang", "cell").agg(F.count("*").alias("n")).orderBy("lang", "cell").collect():  # CELLS rows a language at most
        own = drawn.setdefault(r.lang, [r.cell, -1, 0, False])  # first and last cell, documents, whether it is full
        if not own[3] and own[2] + r.n <= per_language:
            own[1], own[2] = r.cell, own[2] + r.n
        else:
            own[3] = True
    cut = docs.sparkSession.createDataFrame([(lang, first, last) for lang, (first, last, _, _) in drawn.items()], "lang string, first int, last int")
    chosen = near.join(F.broadcast(cut), "lang").where(F.col("cell") <= F.col("last")).select("doc_id", "lang", (F.col("cell") - F.col("first") + 1).alias("nth"))
    texts = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"])
    return texts.groupBy("doc_id", "lang", "nth").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE, most_languages: int = LANGUAGES) -> dict:
    """Models and rejection limits, from at most twice ``per_language`` documents a language."""
    drawn = checkpoint(sample_of(docs, may_learn, 2 * per_language, most_languages))

    def count(batches):
        for batch in T.batches(batches):
            packed, doc, _ = grams(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            names, index = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            for i, name in enumerate(names):
                found, n = np.unique(packed[index[doc] == i], return_counts=True)
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = drawn.where(F.col("nth") % 2 == 1).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    lang = np.array(rows.column("lang").to_pylist(), object)
    gram, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    names = sorted(set(lang))
    models = [KneserNey(gram[lang == name], n[lang == name]) for name in names]
    model = {"languages": names, "models": models, "limits": None}
    if names:
        spread = drawn.where(F.col("nth") % 2 == 0).select("text", "lang").mapInArrow(_calibrate(docs.sparkSession.sparkContext.broadcast(model)), "lang int, entropy double, n long").toArrow()
        own, entropy, size = spread.column("lang").to_numpy(), spread.column("entropy").to_numpy(), spread.column("n").to_numpy()
        model["limits"] = limits_of(own, entropy, size, len(names))
    return model


def _spread(e: np.ndarray, m: np.ndarray, mean: float, least: int) -> tuple[float, float, float]:
    """Spread of long texts, spread that a letter adds, and rejection limit, from entropies ``e`` of texts with ``m`` n-grams."""
    long = e[m >= np.median(m)]
    wide = max(1e-3, 1.4826 * np.median(np.abs(long - np.median(long))))
    each = np.median(np.abs(e - mean) * np.sqrt(m)) * 1.4826
    z = np.sort((e - mean) / np.sqrt(wide**2 + each**2 / m))
    # The worst documents (one at least) don't count: they may be noise or wrongly labelled.
    worst = max(1, math.ceil(STRAY * len(z)))
    return wide, each, float(np.clip(z[-1 - worst], *LIMITS)) if len(z) >= least else LIMITS[0]


def limits_of(own: np.ndarray, entropy: np.ndarray, size: np.ndarray, languages: int, least: int = 20) -> list[tuple[float, float, float, float]]:
    """Usual entropy, spreads and rejection limit of each language; one with fewer than ``least`` documents takes spreads and limit of all together."""
    if not len(own):
        return [(0.0, 1.0, 1.0, np.inf)] * languages
    means = np.full(languages, np.nan)
    for i in np.unique(own):
        e, m = entropy[own == i], size[own == i]
        means[i] = np.median(e[m >= np.median(m)])
    counts = np.bincount(own, minlength=languages)
    # Languages with enough documents say what is usual; if there is none, all do.
    rich = counts[own] >= least
    rich = rich if rich.any() else np.ones(len(own), bool)
    pooled = _spread(entropy[rich] - means[own[rich]], size[rich], 0.0, least)
    usual = float(means[np.unique(own[rich])].max())
    limits = []
    for i in range(languages):
        e, m = entropy[own == i], size[own == i]
        if len(e) >= least:
            limits.append((float(means[i]), *_spread(e, m, means[i], least)))
            continue
        # Models of few documents fit unevenly: their own spread counts if it is larger.
        wide = max(pooled[0], 1.4826 * float(np.median(np.abs(e - means[i])))) if len(e) else pooled[0]
        limits.append((float(means[i]) if len(e) else usual, wide, *pooled[1:]))
    return limits


def _entropies(model, scorer: Scorer, column: pa.Array):
    packed, doc, has = grams(column)
    sums, n = scorer.sums(packed, doc, len(has))
    return -sums / np.maximum(n, 1)[:, None], n, has


def _calibrate(shared):
    def run(batches):
        scorer = Scorer(shared.value["models"])
        for batch in T.batches(batches):
            entropy, n, has = _entropies(shared.value, scorer, batch.column("text"))
            own = np.array([shared.value["languages"].index(x) if x in shared.value["languages"] else -1 for x in batch.column("lang").to_pylist()])
            at = np.flatnonzero(has & (n > 0) & (own >= 0))
            yield pa.record_batch([pa.array(own[at].astype(np.int32)), pa.array(entropy[at, own[at]]), pa.array(n[at])], names=["lang", "entropy", "n"])

    return run


SHARPNESS = 8.0  # letters' worth of entropy difference that count for the score


def _judge(m: dict, scorer: Scorer, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, entropy (NaN without letters) and whether it is rejected, for each text."""
    size, names = len(column), m["languages"]
    pred, score, bits, reject = np.array(["und"] * size, object), np.zeros(size), np.full(size, np.nan), np.ones(size, bool)
    if names:
        entropy, n, has = _entropies(m, scorer, column)
        best = np.argmin(entropy, axis=1)
        low = entropy[np.arange(size), best]
        weight = np.exp(-SHARPNESS * (entropy - low[:, None]))
        mean, wide, each, limit = (np.array(x)[best] for x in zip(*m["limits"], strict=True))
        z = (low - mean) / np.sqrt(wide**2 + each**2 / np.maximum(n, 1))
        pred[has] = np.array(names, object)[best[has]]
        score[has] = (1 / weight.sum(axis=1))[has]
        bits[has] = low[has]
        reject = ~has | (z > limit)
    return pred, score, bits, reject


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred, score, entropy, rejected`` (columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "entropy", "rejected")]

    def run(batches):
        scorer = Scorer(shared.value["models"])
        for batch in T.batches(batches):
            pred, score, bits, reject = _judge(shared.value, scorer, batch.column("text"))
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits)), pa.array(reject)], names=[*batch.schema.names, "lang_pred", "score", "entropy", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep).mapInArrow(run, f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value["models"])
        for batch in T.batches(batches):
            reject = _judge(shared.value, scorer, batch.column("text"))[3]
            yield batch.filter(pa.array(~reject))

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int = 3, rest: int = 1) -> Column:
    """Whether the remainder of the id's checksum is ``rest``; false for a null id."""
    return F.coalesce(crc_of_id() % modulus == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected``; learns from documents that aren't held out."""
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
