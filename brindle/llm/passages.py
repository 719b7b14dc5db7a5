"""Word windows that occur more than once in a corpus, found through content-selected anchors.

Every window of ``window`` words is owned by its minimiser: the leftmost of its k-grams with the least hash.
Equal windows have equal owners at equal offsets, so only windows whose owner occurs twice can repeat.

1. Anchors are counted over all documents (``cells.key_counts``).
2. Consecutive windows with one owner form a context.  Contexts of anchors that occur twice go, once per bucket
   of documents and as text, to the shard of their anchor.  An anchor with more than ``hot`` occurrences
   is split: each of its windows travels alone and is routed by its own hash.
3. A resolver, given all contexts of its anchors, says which windows occur twice; it compares words, not hashes.
4. Answers meet the documents again, bucket by bucket.

Hashes only choose who is compared with whom: contexts count as one only where their words are equal.  An answer names a context by the place of its
first occurrence in the bucket, whose rows are brought into an order that ids and texts decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brindle.llm import cells
from brindle.llm import text as T

U64 = np.uint64
CONTEXT = "shard long, key long, bucket long, place long, n long, shift int, ctx string"
ANSWER = "bucket long, place binary, size binary, mask binary"
#: Bytes of contexts that one resolving task gets.
SHARD = 1 << 20


class Contexts:
    """The contexts of a bucket: ``key[i]``, words ``begin[i]`` to ``end[i]``, ``shift[i]`` words before the anchor."""

    def __init__(self, column: pa.Array, window: int, k: int):
        self.window, self.k, self.words = window, k, T.words(column)
        w, m = self.words, window - k + 1
        total = len(w.hash)
        self.grams = T.runs(w.hash, k, salt=k)
        starts = np.flatnonzero(T.inside(w.first, window, total))
        if len(starts):
            least = np.empty(total - window + 1, np.int64)
            views = np.lib.stride_tricks.sliding_window_view(self.grams, m)
            for a in range(0, len(least), T.CHUNK):
                b = min(len(least), a + T.CHUNK)
                least[a:b] = np.argmin(views[a:b], axis=1) + np.arange(a, b)
            owner = least[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
            at = np.flatnonzero(new)
            self.begin, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
            self.end, self.shift = last + window, owner[at] - self.begin
            self.key = T.mix(self.grams[owner[at]])  # least hashes lie together: spread them again
        else:
            self.begin = self.end = self.shift = np.zeros(0, np.int64)
            self.key = np.zeros(0, U64)

    def chosen(self, keys: np.ndarray, counts: np.ndarray, hot: int) -> None:
        """Keeps the contexts of anchors that occur twice, and takes those of hot anchors apart."""
        n = cells.lookup(keys, counts, self.key) if len(self.key) else np.zeros(0, np.int64)
        calm, apart = (n > 1) & (n <= hot), np.flatnonzero(n > hot)
        begin, end, shift, key = self.begin[calm], self.end[calm], self.shift[calm], self.key[calm]
        if len(apart):
            one, each, step = self.singles(apart)
            begin, end = np.append(begin, one), np.append(end, one + self.window)
            shift = np.append(shift, np.repeat(self.shift[apart], each) - step)
            key = np.append(key, T.runs(self.words.hash, self.window, salt=1)[one])
        self.begin, self.end, self.shift, self.key = begin, end, shift, key

    def singles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of contexts one by one: where each begins; how many each context has; the number of each in its context."""
        each = self.end[which] - self.begin[which] - self.window + 1
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(self.begin[which], each) + step, each, step

    @cached_property
    def text_at(self) -> np.ndarray:
        """Where each word begins in ``flat``."""
        w = self.words
        at = np.zeros(len(w.start) + 1, np.int64)
        np.cumsum(w.end - w.start + 1, out=at[1:])
        return at

    @cached_property
    def flat(self) -> bytes:
        """All words, each followed by a space."""
        w = self.words
        size = w.end - w.start
        out = np.full(self.text_at[-1], 32, np.uint8)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(self.text_at[:-1], size) + step] = w.data[np.repeat(w.start, size) + step]
        return out.tobytes()


def _ordered(table: pa.Table) -> pa.Table:
    """Rows by id, those with one id by text."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])) if table.num_rows > 1 else table


def repeated(
    docs: DataFrame,
    window: int,
    k: int,
    resolver: Callable[[list], list],
    finish: Callable[[pa.Table, T.Words, np.ndarray], pa.Table],
    schema: str,
    hot: int = 2000,
    bucket_bytes: int = cells.BUCKET,
) -> DataFrame:
    """``finish(bucket, words, covered)`` for each bucket; ``covered``: words of windows that occur elsewhere too.

    ``resolver(groups)`` gets, for each anchor, its distinct contexts as ``(words, shift, n)`` and returns, for each group
    and context, a bool for each window.
    """
    total = cells.text_bytes(docs)
    shards = max(64, math.ceil(total / SHARD))

    def anchors(table: pa.Table) -> tuple:
        return Contexts(table.column("text"), window, k).key, None, None

    def found(table: pa.Table, keys: np.ndarray, counts: np.ndarray, _) -> pa.Table:
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        c = Contexts(_ordered(table).column("text"), window, k)
        c.chosen(keys, counts, hot)
        raw, at = c.flat, c.text_at
        # Contexts with equal words are sent once, under the first of them.
        first: dict[tuple[int, bytes], list[int]] = {}
        for i, (key, a, b) in enumerate(zip(c.key.tolist(), at[c.begin].tolist(), (at[c.end] - 1).tolist(), strict=True)):
            first.setdefault((key, raw[a:b]), [i, 0])[1] += 1
        i = np.array([x for x, _ in first.values()], np.int64)
        return pa.table({
            "shard": pa.array((c.key[i] % U64(shards)).astype(np.int64)), "key": pa.array(c.key[i].astype(np.int64)), "bucket": pa.array(np.full(len(i), bucket), pa.int64()),
            "place": pa.array(c.begin[i], pa.int64()), "n": pa.array([n for _, n in first.values()], pa.int64()), "shift": pa.array(c.shift[i], pa.int32()),
            "ctx": pa.array([t for _, t in first], pa.binary()).cast(pa.string()),
        })

    def resolve(table: pa.Table) -> pa.Table:
        # Rows with one anchor and one text are one context, wherever they come from.
        key, place, bucket, n, shift = (table.column(x).to_numpy() for x in ("key", "place", "bucket", "n", "shift"))
        ctx = table.column("ctx")
        ctx = ctx.combine_chunks() if isinstance(ctx, pa.ChunkedArray) else ctx
        groups, members, before = [], [], None
        for i in np.lexsort((place, bucket, key)).tolist():
            if key[i] != before:
                groups.append({})
                before = key[i]
            text = ctx[i].as_py()
            if text in groups[-1]:
                groups[-1][text][1] += int(n[i])
                members[groups[-1][text][2]].append(i)
            else:
                groups[-1][text] = [int(shift[i]), int(n[i]), len(members)]
                members.append([i])
        ask, masks = [], [None] * len(members)
        for g in groups:
            if len(g) > 1:
                ask.append([(text.split(" "), s, c) for text, (s, c, _) in g.items()])
            else:
                (text, (_, c, at)) = next(iter(g.items()))
                masks[at] = [c > 1] * (text.count(" ") + 2 - window)
        answers = iter(resolver(ask))
        for g in groups:
            if len(g) > 1:
                for (_, _, at), got in zip(g.values(), next(answers), strict=True):
                    masks[at] = got
        rows: dict[int, tuple] = {}
        for mask, ids in zip(masks, members, strict=True):
            if any(mask):
                packed = np.packbits(mask)
                for i in ids:
                    h, s, m = rows.setdefault(int(bucket[i]), ([], [], []))
                    h.append(place[i])
                    s.append(len(mask))
                    m.append(packed)
        return pa.table({
            "bucket": pa.array(list(rows), pa.int64()), "place": pa.array([np.array(h, "<i8").tobytes() for h, _, _ in rows.values()], pa.binary()),
            "size": pa.array([np.array(s, "<i2").tobytes() for _, s, _ in rows.values()], pa.binary()), "mask": pa.array([np.concatenate(m).tobytes() for _, _, m in rows.values()], pa.binary()),
        })

    def meet(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table)
        c = Contexts(table.column("text") if table.num_rows else pa.array([], pa.string()), window, k)
        edge = np.zeros(len(c.words.hash) + 1, np.int64)
        if answers.num_rows and len(c.begin):
            _mark(c, answers, edge)
        return finish(table, c.words, np.cumsum(edge)[:-1] > 0)

    contexts = cells.key_counts(docs, total, anchors, found, CONTEXT, bytes_per_byte=0.3, bucket_bytes=bucket_bytes)
    answers = contexts.groupBy("shard").applyInArrow(resolve, ANSWER)
    rows = cells.bucketed(docs, total, bucket_bytes)
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(meet, schema)


def _mark(c: Contexts, answers: pa.Table, edge: np.ndarray) -> None:
    """Adds to ``edge`` where windows that repeat begin, and takes off where they end."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in answers.column(name)])
    place, size, mask = read("place", "<i8"), read("size", "<i2").astype(np.int64), np.unpackbits(read("mask", np.uint8))
    off = 8 * (np.cumsum((size + 7) // 8) - (size + 7) // 8)
    window, raw, at = c.window, c.flat, c.text_at
    window_hash = T.runs(c.words.hash, window, salt=2)

    def hashes(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of spans of n windows, at most as many as a window has words: the first and the last window hold all words."""
        return T.joined(window_hash[begin], window_hash[begin + n - 1] + n.astype(U64))

    def text(begin: int, n: int) -> bytes:
        return raw[at[begin] : at[begin + n + window - 1] - 1]

    told = {text(p, n): i for i, (p, n) in enumerate(zip(place.tolist(), size.tolist(), strict=True))}
    known = np.sort(hashes(place, size))
    whole = (c.begin, c.end - c.begin - window + 1)
    one = c.singles(np.arange(len(c.begin)))[0] if (size == 1).any() else np.zeros(0, np.int64)
    # As whole contexts, and as the single windows that a hot anchor's contexts were taken into.
    for begin, n in (whole, (one, np.ones(len(one), np.int64))):
        h = hashes(begin, n)
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        own = np.array([told.get(text(p, m), -1) for p, m in zip(begin[hit].tolist(), n[hit].tolist(), strict=True)], np.int64)
        hit, own = hit[own >= 0], own[own >= 0]
        step = np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
        start = np.repeat(begin[hit], n[hit]) + step
        start = start[mask[np.repeat(off[own], n[hit]) + step] > 0]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)


def finish_rows(table: pa.Table, w: T.Words, covered: np.ndarray) -> pa.Table:
    """doc_id, n_words, n_removed, kept_sha256 of each document of a bucket."""
    import hashlib

    keep = ~covered
    n_words = np.diff(w.first)
    before = np.zeros(len(w.hash) + 1, np.int64)
    np.cumsum(covered, out=before[1:])
    removed = before[w.first[1:]] - before[w.first[:-1]]
    raw = w.data.tobytes()
    shas = []
    for d in range(len(n_words)):
        a, b = w.first[d], w.first[d + 1]
        at = np.arange(a, b)[keep[a:b]]
        shas.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])).hexdigest())
    return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


FINISHED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_text(table: pa.Table, w: T.Words, covered: np.ndarray) -> list[str]:
    raw = w.data.tobytes()
    out = []
    for d in range(len(w.first) - 1):
        at = np.arange(w.first[d], w.first[d + 1])
        at = at[~covered[at]]
        out.append(b" ".join([raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]).decode("utf-8", "replace"))
    return out


__all__ = ["CONTEXT", "Contexts", "FINISHED", "finish_rows", "kept_text", "repeated"]
