"""Mixing to target weights with soft domain membership.

Domains are the classes of the labelled table (quality and toxicity).  A softmax regression over the ``CHOSEN`` hashed tokens and
token prefixes that tell the domains apart best and over the shape of the text (share of different tokens, of capitals, of signs, length of tokens), fitted on a
bounded sample of labelled documents (``SAMPLE`` rows, those with the least hash of their id) and tempered on a part of the sample that it wasn't fitted on, gives each document a posterior over domains.  Nonnegative document rates r then minimise

    1/2 sum_d (sum_i r_i n_i q_id / N - w_d)^2 / p_d  +  mu/2 sum_i n_i / N (r_i - 1)^2

(n tokens, q posteriors, w target weights, p expected shares at rate 1, so that rare domains converge as fast as frequent ones): expected domain tokens meet their targets, and rates stay near 1 where targets
leave a choice.  It is solved by projected gradient steps with momentum.  A step needs one small vector of domain totals, summed on the executors over a narrow
table; rates are never stored, as each is a function of the document's posterior and the vectors so far.  The first steps are taken on a summary of the table
(tokens and mean posteriors in cells of a grid of ``GRID`` steps a domain, of which there are a few hundred), the rest on the table itself, until what a step still moves is below ``ENOUGH`` (as a
share of all tokens) or ``STEPS`` are done, which warns.  ``totals`` sets what rates give beside the targets.
With ``repeat`` rates stay as they are, also above 1: ``copies`` is their whole part, and one more by a hash of id and text as often as the rest says.
Without it documents are kept or dropped only.  The domain with the largest target is then kept whole: rates are divided by its rate, and a domain
that is rarer beside it than its target gets what is there as its target (or the others would be thinned to make up for documents that don't exist).

Defined results: a text without tokens has the class shares as its posterior and adds no tokens to any domain; without usable labels there is one domain
and every rate is 1; if several label rows share a ``doc_id``, the highest class counts; null labels teach nothing; each row is a document
of its own, also with equal or null ``doc_id``; targets of domains that no label has are ignored, the others are scaled to sum to 1.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as T
from brindle.llm.shared import checkpoint, least_hashed, one_text, unused

SAMPLE = 16_000
SLOTS = 1 << 17
PREFIX = 5
RIDGE = 0.01
STEPS = 60
GRID = 24
ENOUGH = 2e-4
BINS = 16
SHAPES = 4
CHOSEN = 1024
WIDTH = SLOTS + SHAPES * BINS
TARGETS = {"low": 0.08, "clean": 0.90, "toxic": 0.02}


def domain_of() -> Column:
    """``toxic``, else ``low`` for quality 0 and ``clean`` for the rest; null where a label is null."""
    return F.when(F.col("toxic") > 0, F.lit("toxic")).when(F.col("toxic").isNull() | F.col("quality").isNull(), F.lit(None)).when(F.col("quality") > 0, F.lit("clean")).otherwise(F.lit("low"))


def slots(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of tokens and of their prefixes."""
    prefix = T.mix(T.prefix_hashes(w, PREFIX, lower=True) + np.uint64(PREFIX))
    return (w.hash % np.uint64(SLOTS)).astype(np.int64), (prefix % np.uint64(SLOTS)).astype(np.int64)


def shapes(w: T.Words) -> np.ndarray:
    """SHAPES slots for each text, after the SLOTS of tokens."""
    n = np.diff(w.first)
    safe = np.maximum(n, 1)
    doc = w.doc
    different = _different(w, doc, len(n))
    bytes_of = w.off
    upto = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    capital = upto((w.data >= 65) & (w.data <= 90))
    sign = upto((w.data >= 33) & (w.data <= 47) | (w.data >= 58) & (w.data <= 64) | (w.data >= 91) & (w.data <= 96) | (w.data >= 123) & (w.data <= 126))
    length = np.maximum(1, bytes_of[1:] - bytes_of[:-1])
    letters = np.bincount(doc, w.end - w.start, len(n))
    share = [different / safe, (capital[bytes_of[1:]] - capital[bytes_of[:-1]]) / length * 4, (sign[bytes_of[1:]] - sign[bytes_of[:-1]]) / length * 4, letters / safe / BINS]
    bins = [np.minimum(BINS - 1, (x * BINS).astype(np.int64)) for x in share]
    return np.stack([SLOTS + i * BINS + b for i, b in enumerate(bins)], axis=1)


def _different(w: T.Words, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of different tokens of each text."""
    return np.bincount(T.Distinct(w.hash).pairs(doc), minlength=n)


def features(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``chosen`` of the slots that each text has, end to end; where each text's begin; its number of tokens."""
    w = T.words(column, lower=True, plain=True)
    n = np.diff(w.first)
    table = np.full(WIDTH, -1, np.int32)
    table[chosen] = np.arange(len(chosen), dtype=np.int32)
    doc, keys = [], []
    for s in slots(w):
        at = table[s]
        hit = np.flatnonzero(at >= 0)
        doc.append(np.searchsorted(w.first, hit, "right") - 1)
        keys.append(at[hit])
    shape = table[shapes(w)]
    full = np.repeat(np.flatnonzero(n), SHAPES)
    doc.append(full)
    keys.append(shape[n > 0].ravel())
    doc, keys = np.concatenate(doc).astype(np.int64), np.concatenate(keys)
    both = np.unique(doc[keys >= 0] << 32 | keys[keys >= 0])
    return (both & 0xFFFFFFFF).astype(np.int64), np.searchsorted(both >> 32, np.arange(len(n) + 1)), n


def _scores(at: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, weights.shape[1]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(weights[at], first[full], axis=0)
    return out


def regress(at: np.ndarray, first: np.ndarray, own: np.ndarray, n_features: int, n_domains: int, rounds: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a softmax regression (the last row is the intercept): quasi-Newton steps with the last eight changes (L-BFGS)."""
    docs = len(first) - 1
    row = np.repeat(np.arange(docs), np.diff(first))
    truth = np.eye(n_domains)[own]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        w = w.reshape(n_features + 1, n_domains)
        p = _softmax(_scores(at, first, w[:-1]) + w[-1])
        gap = (p - truth) / docs
        g = np.stack([np.append(np.bincount(at, gap[row, d], n_features), gap[:, d].sum()) for d in range(n_domains)], axis=1)
        g[:-1] += ridge * w[:-1]
        return float(-np.log(np.maximum(p[np.arange(docs), own], 1e-300)).mean() + ridge / 2 * (w[:-1] ** 2).sum()), g.ravel()

    w = np.zeros((n_features + 1) * n_domains)
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, back = -g, []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            back.append(a)
            step = step - a * y
        if past:
            step *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(back), strict=True):
            step = step + (a - y @ step / (s @ y)) * s
        size, slope = 1.0 if past else min(1.0, 1 / max(1e-12, np.abs(g).sum())), g @ step
        for _ in range(30):
            new, h = loss(w + size * step)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * step, h - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y)]
        done = value - new < 1e-7
        w, value, g = w + s, new, h
        if done:
            break
    return w.reshape(n_features + 1, n_domains)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Domains, class shares, feature slots and their weights, temperature."""
    rows = labels.where("doc_id is not null").select("doc_id", domain_of().alias("domain")).where("domain is not null")
    ids = least_hashed(rows, "doc_id", sample, 19).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    # Equal texts are one piece of evidence.
    drawn = one_text(docs, ids).groupBy("text").agg(F.max("domain").alias("domain"))
    drawn = checkpoint(drawn.withColumn("fit", F.pmod(F.xxhash64(F.lit(23), "text"), F.lit(4)) < 3))
    shares = {r["domain"]: r["n"] for r in drawn.where("fit").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(shares)
    if len(names) < 2:
        return {"domains": names or ["all"], "prior": np.ones(1), "slots": np.zeros(0, np.int64), "weights": np.zeros((1, 1)), "heat": 1.0}
    size = np.array([shares[x] for x in names], float)[:, None]

    def count(batches):
        for batch in T.batches(batches):
            w = T.words(batch.column("text"), lower=True, plain=True)
            domain = np.array([names.index(x) for x in batch.column("domain").to_pylist()])
            shape = shapes(w)
            every = np.concatenate([*(w.doc * WIDTH + s for s in slots(w)), (np.arange(len(shape))[:, None] * WIDTH + shape).ravel()])
            every = np.unique(every)  # a slot counts once for each document
            key, n = np.unique(domain[every // WIDTH] * WIDTH + every % WIDTH, return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    got = drawn.where("fit").select("text", "domain").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most WIDTH for each domain
    table = np.zeros(len(names) * WIDTH)
    table[got.column("key").to_numpy()] = got.column("n").to_numpy()
    table = table.reshape(len(names), WIDTH)
    expected = table.sum(axis=0)[None, :] / size.sum() * size
    stands_out = (np.abs(table - expected) / np.sqrt(expected + 1)).max(axis=0)
    stands_out[SLOTS:] = np.inf
    chosen = np.sort(np.argsort(-stands_out, kind="stable")[: CHOSEN + SHAPES * BINS])

    def vectors(batches):
        for batch in T.batches(batches):
            at, first, _ = features(batch.column("text"), chosen)
            own = [names.index(x) if x in names else -1 for x in batch.column("domain").to_pylist()]
            yield pa.record_batch([batch.column("fit"), pa.array(own, pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32()))], names=["fit", "own", "at"])

    seen = drawn.select("text", "domain", "fit").mapInArrow(vectors, "fit boolean, own int, at array<int>").toArrow()  # bounded by the sample
    fitting, own, lists = np.array(seen.column("fit").to_pylist(), bool), seen.column("own").to_numpy(), seen.column("at").to_pylist()

    def part(mask: np.ndarray):
        which = np.flatnonzero(mask & (own >= 0))
        sizes = [len(lists[i]) for i in which]
        return np.array([x for i in which for x in lists[i]], np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), own[which]

    at, first, mine = part(fitting)
    weights = regress(at, first, mine, len(chosen), len(names))
    model = {"domains": names, "prior": (size / size.sum()).ravel(), "slots": chosen, "weights": weights, "heat": 1.0}
    at, first, mine = part(~fitting)
    if len(mine):
        z = _scores(at, first, weights[:-1]) + weights[-1]
        heats = np.geomspace(0.1, 4, 60)
        model["heat"] = float(max(heats, key=lambda h: np.log(np.maximum(_softmax(h * z)[np.arange(len(mine)), mine], 1e-12)).mean()))
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def posteriors(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each text over the domains, and its number of tokens."""
    at, first, n = features(column, model["slots"])
    q = _softmax(model["heat"] * (_scores(at, first, model["weights"][:-1]) + model["weights"][-1]))
    q[n == 0] = model["prior"]
    return q, n


def target_weights(model: dict, targets: dict) -> np.ndarray:
    w = np.array([targets.get(d, 0.0) for d in model["domains"]], float)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def rates(q: np.ndarray, steps: list[np.ndarray], eta: float) -> np.ndarray:
    """Rates of documents with posteriors q after the given gradient vectors."""
    return ahead(q, steps, eta)[0]


def ahead(q: np.ndarray, steps: list[np.ndarray], eta: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and the point at which the next gradient is taken: beyond the rates by the share of the last move that suits a problem as curved as the ridge makes it."""
    root = np.sqrt(eta * RIDGE)
    r = y = np.ones(len(q))
    for g in steps:
        new = np.maximum(0.0, y - eta * (q @ g + RIDGE * (y - 1)))
        r, y = new, new + (1 - root) / (1 + root) * (new - r)
    return r, y


def reachable(weights: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Targets that can be met without repeating documents, while the domain with the largest target is kept whole."""
    main = int(weights.argmax())
    kept = share * np.minimum(1.0, weights / share / (weights[main] / share[main]))
    return kept / kept.sum()


def sums(n: np.ndarray, q: np.ndarray, history: list[np.ndarray], eta: float) -> np.ndarray:
    """Tokens; domain totals at the point ahead, and at the rates; how much the last step moved; second moments of the posteriors."""
    r, y = ahead(q, history, eta)
    moved = np.abs(r - rates(q, history[:-1], eta)) @ n if history else 0.0
    return np.concatenate([[n.sum()], (y * n) @ q, (r * n) @ q, [moved], ((q * n[:, None]).T @ q).ravel()])


def solve(narrow: DataFrame, weights: np.ndarray, steps: int = STEPS, repeat: bool = False) -> dict:
    """Projected gradient over ``narrow(n, q)``; the state is one vector for each step."""
    d = len(weights)

    def over_table(history: list[np.ndarray], eta: float) -> np.ndarray:
        def run(batches):
            out = np.zeros(2 + 2 * d + d * d)
            for batch in batches:
                if batch.num_rows:
                    out += sums(batch.column("n").to_numpy().astype(float), batch.column("q").flatten().to_numpy().reshape(-1, d), history, eta)
            yield pa.record_batch([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])

        # One row for each partition, added up on the executors.
        cells = narrow.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(2 + 2 * d + d * d)
        for row in cells:
            out[row["at"]] = row["x"]
        return out

    first = over_table([], 0.0)
    total = max(first[0], 1.0)
    share = np.maximum(first[1 : 1 + d] / total, 1e-6)
    main = int(weights.argmax())
    if not repeat:
        weights = reachable(weights, share)
    gram = first[2 + 2 * d :].reshape(d, d) / total / np.sqrt(np.outer(share, share))
    eta = 1.0 / (float(np.linalg.eigvalsh(gram).max()) + RIDGE)
    history: list[np.ndarray] = []

    def descend(totals, limit: int) -> tuple[np.ndarray, float]:
        now, moved = totals(history, eta), np.inf
        for _ in range(limit):
            history.append((now[1 : 1 + d] / total - weights) / share)
            now = totals(history, eta)
            moved = now[1 + 2 * d] / total
            if moved < ENOUGH:
                break
        return now[1 + d : 1 + 2 * d] / total, moved

    cell = F.transform("q", lambda x: F.round(x * GRID).cast("int"))
    grid = narrow.where("n > 0").groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col("q")[i]).alias(f"s{i}") for i in range(d))).toArrow()
    n = grid.column("n").to_numpy().astype(float)
    mean = np.stack([grid.column(f"s{i}").to_numpy() / n for i in range(d)], axis=1)
    if len(n):
        # Each step is worth as many rounds as it takes there; on the table a few remain.
        descend(lambda history, eta: sums(n, mean, history, eta), 400)
    reached, moved = descend(over_table, steps)
    if moved >= ENOUGH:
        warnings.warn(f"rates still move by {moved:.2g} of all tokens a step", stacklevel=2)
    top = 1.0 if repeat else max(1e-12, float(rates(np.eye(d)[[main]], history, eta)[0]))
    return {"history": history, "eta": eta, "top": top, "reached": reached, "weights": weights, "moved": moved}


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict | None = None, repeat: bool = False) -> tuple[dict, dict, DataFrame]:
    """The classifier, the solution, and the narrow table ``doc_id, n, q, u`` (u: what a document's rate is compared with)."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CHOSEN weights for each domain

    def classify(batches):
        for batch in T.batches(batches):
            q, n = posteriors(batch.column("text"), shared.value)
            yield pa.record_batch([batch.column("doc_id"), batch.column("u"), pa.array(n, pa.int64()), pa.array(list(q), pa.list_(pa.float64()))], names=["doc_id", "u", "n", "q"])

    narrow = checkpoint(docs.select("doc_id", "text", chance().alias("u")).mapInArrow(classify, "doc_id long, u double, n long, q array<double>"))
    return model, solve(narrow, target_weights(model, targets or TARGETS), repeat=repeat), narrow


def chance() -> Column:
    """A number from 0 to 1 that the id and the text decide."""
    return (F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).cast("double")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict | None = None, repeat: bool = False) -> DataFrame:
    """``doc_id, n_tokens, domain, posterior, rate, copies`` for each row of ``docs``."""
    model, fitted, narrow = fit_mixture(docs, labels, targets, repeat)
    names, d = model["domains"], len(model["domains"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q = batch.column("q").flatten().to_numpy().reshape(-1, d)
                r = np.minimum(np.inf if repeat else 1.0, rates(q, fitted["history"], fitted["eta"]) / fitted["top"])
                yield pa.record_batch([
                    batch.column("doc_id"), batch.column("n"), pa.array([names[i] for i in q.argmax(axis=1)], pa.string()), batch.column("q"), pa.array(r),
                    pa.array((np.floor(r) + (batch.column("u").to_numpy() < r - np.floor(r))).astype(np.int32)),
                ], names=["doc_id", "n_tokens", "domain", "posterior", "rate", "copies"])

    return narrow.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior array<double>, rate double, copies int")


def totals(mixed: DataFrame, model_domains: list[str], targets: dict) -> DataFrame:
    """``domain, target, expected, drawn``: shares of tokens that targets, rates and copies of a ``mixture`` give each domain, by posteriors."""
    each = mixed.select("n_tokens", "rate", "copies", F.posexplode("posterior").alias("at", "q"))
    sums = each.groupBy("at").agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col("q")).alias("expected"), F.sum(F.col("n_tokens") * F.col("copies") * F.col("q")).alias("drawn"))
    every = sums.agg(F.sum("expected").alias("e"), F.sum("drawn").alias("d"))
    scale = sum(targets.get(x, 0.0) for x in model_domains) or 1.0
    told = mixed.sparkSession.createDataFrame([(i, x, targets.get(x, 0.0) / scale) for i, x in enumerate(model_domains)], "at int, domain string, target double")
    return told.join(sums, "at", "left").crossJoin(F.broadcast(every)).select("domain", "target", (F.col("expected") / F.col("e")).alias("expected"), (F.col("drawn") / F.col("d")).alias("drawn"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that the fitted rates keep. Posteriors are computed anew, which is cheaper than moving texts to a join."""
    model, fitted, _ = fit_mixture(docs, labels, targets)
    shared = docs.sparkSession.sparkContext.broadcast((model, fitted))
    mark = unused(docs, "chance")

    def run(batches):
        m, f = shared.value
        for batch in T.batches(batches):
            q, _ = posteriors(batch.column("text"), m)
            r = np.minimum(1.0, rates(q, f["history"], f["eta"]) / f["top"])
            yield batch.filter(pa.array(batch.column(mark).to_numpy() < r)).drop_columns([mark])

    return docs.withColumn(mark, chance()).mapInArrow(run, docs.schema)
