"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, names and units are typed placeholders, everything else is the lower-cased
word without punctuation.  Windows of ``window`` template tokens of benchmark items are hash-joined with those of every document.  Matched windows
that lie on one diagonal (document position minus item position) are one alignment; an alignment counts only as far as its slots are
consistent: one value of the item's always stands for one value of the document's.  So a question that was copied with other
numbers, names or units is found as well as a literal copy.  Windows with fewer than ``literal`` words that are not placeholders are joined by their values
and not by their placeholders, so a table of numbers meets only items with the same numbers.  A document is contaminated by an item if
consistent windows cover 13 of its tokens or 60 % of them.

A capitalised word that opens a sentence may be a name or not: both readings of items are joined with both readings of documents.  Words as they are, lower-cased and
without placeholders, are a third reading, so a copy in other capitals is found too.

Items are broadcast in blocks of about ``block_windows`` words, one pass over the documents for each block, so what is broadcast never grows; documents don't move.
Pairs of windows of a batch are expanded at most ``PAIRS`` at a time (those of one document and item together).

Defined results: null and empty texts match nothing; items of fewer than ``least`` template tokens are not searched for; items of fewer than ``window``
tokens are one window; each row of documents or items counts for itself, also with equal or null ids (``item_ids`` leaves null ids out); empty tables give no rows;
further columns are kept by ``decontaminate`` and ignored elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as T

# Units of measure that a question may state a number in.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons percent degree degrees dollar dollars cent cents euro euros usd eur gbp "
    "kb mb gb tb hz khz mhz ghz w kw v a kwh j kj cal kcal pa bar k c f"
).split()
NUMBER, NAME, UNIT = (T.mix(np.array([x], np.uint64))[0] for x in (101, 102, 103))


def _unit_hashes() -> np.ndarray:
    return np.sort(T.words(pa.array([" ".join(UNITS)]), lower=True, plain=True).hash)


_UNITS = _unit_hashes()


PAIRS = 4_000_000


class Template:
    """Tokens of texts: ``kind`` (hash of the word or placeholder), ``value`` (hash of the word), ``slot`` (0: a word), ``first`` of each text."""

    def __init__(self, w: T.Words, openings: bool):
        """``openings``: whether capitalised words that open a sentence are names."""
        n = len(w.hash)
        self.first = w.first
        self.kind, self.value, self.slot = w.hash, w.hash, np.zeros(n, np.int8)
        if not n:
            return
        lead = w.data[w.start]
        number = (lead >= 48) & (lead <= 57)
        # A sentence begins where a text does, and after . ! ? or a line break.
        ends = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_END[w.data], out=ends[1:])
        opens = np.ones(n, bool)
        opens[1:] = ends[w.start[1:]] > ends[w.end[:-1]]
        opens[w.first[:-1][w.first[:-1] < n]] = True
        second = w.data[np.minimum(w.start + 1, len(w.data) - 1)]
        upper = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        name = upper & (openings | ~opens)
        unit = np.zeros(n, bool)
        at = np.minimum(np.searchsorted(_UNITS, w.hash), len(_UNITS) - 1)
        unit[1:] = (_UNITS[at] == w.hash)[1:] & number[:-1] & ~opens[1:]
        slot = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8)
        kind = np.where(slot == 1, NUMBER, np.where(slot == 2, NAME, np.where(slot == 3, UNIT, w.hash)))
        # Numbers with separators and names of several words are one slot.
        gap = w.start[1:] - w.end[:-1] == 1
        between = w.data[w.end[:-1]]
        joined = np.zeros(n, bool)
        joined[1:] = (slot[1:] == slot[:-1]) & gap & ((slot[1:] == 1) & ((between == 46) | (between == 44)) | (slot[1:] == 2) & (between == 32) & ~opens[1:])
        joined[w.first[:-1][w.first[:-1] < n]] = False
        head = np.flatnonzero(~joined)
        size = np.diff(np.append(head, n))
        mixed = T.mix(w.hash + (np.arange(n) - np.repeat(head, size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.value = np.add.reduceat(mixed, head)
        self.kind, self.slot = kind[head], slot[head]
        self.first = np.searchsorted(head, w.first)


_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


class Literal:
    """Words as they are, with the columns of a ``Template``."""

    def __init__(self, w: T.Words):
        self.first, self.kind, self.value, self.slot = w.first, w.hash, w.hash, np.zeros(len(w.hash), np.int8)


def _windows(t, n: int, literal: int) -> np.ndarray:
    """Keys of the windows of n tokens: of their kinds, or of their values where few of them are words."""
    free = np.zeros(len(t.slot) + 1, np.int64)
    np.cumsum(t.slot == 0, out=free[1:])
    m = max(0, len(t.kind) - n + 1)
    kinds = T.runs(t.kind, n, salt=n)
    strict = np.flatnonzero(free[n : n + m] - free[:m] < literal)
    if len(strict):
        kinds[strict] = T.runs(t.value, n, salt=n + 1000)[strict]
    return kinds


def _table(readings: list, window: int, literal: int, least: int) -> dict:
    """Sorted window keys of items with reading and position; ``row``: the item of a reading. ``readings``: of all items, one after another."""
    parts, kinds, values, slots, firsts, rows, done, before = [], [], [], [], [0], [], 0, None
    for t in readings:
        sizes = np.diff(t.first)
        # A second reading of an item that is like its first one says nothing new.
        same = np.zeros(len(sizes), bool) if before is None else np.array([np.array_equal(before.kind[a:b], t.kind[c:d]) for a, b, c, d in zip(before.first[:-1], before.first[1:], t.first[:-1], t.first[1:], strict=True)], bool)
        use = (sizes >= least) & ~same
        for n in sorted({int(min(window, s)) for s in sizes[use]}):
            start = np.flatnonzero(T.inside(t.first, n, len(t.kind)))
            own = np.searchsorted(t.first, start, "right") - 1
            right = use[own] & (np.minimum(sizes[own], window) == n)
            start, own = start[right], own[right]
            parts.append((_windows(t, n, literal)[start], own + done, start - t.first[own], np.full(len(start), n)))
        kinds.append(t.kind)
        values.append(t.value)
        slots.append(t.slot)
        firsts += (t.first[1:] + firsts[-1]).tolist()
        rows += range(len(sizes))
        done += len(sizes)
        before = t
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
    order = np.lexsort((columns[1], columns[0]))
    hashes, item, place, size = (x[order] for x in columns)
    return {"hash": hashes, "item": item, "place": place, "size": size, "first": np.array(firsts), "kind": np.concatenate(kinds), "value": np.concatenate(values), "slot": np.concatenate(slots), "row": np.array(rows, np.int64)}


def _items(rows: list, window: int, literal: int, least: int) -> dict:
    w = T.words(pa.array([r["text"] for r in rows], pa.string()), lower=True, plain=True)
    return {"template": _table([Template(w, False), Template(w, True)], window, literal, least), "literal": _table([Literal(w)], window, literal, least), "ids": [r["item_id"] for r in rows], "least_literal": literal}


def _aligned(table: dict, t, at: np.ndarray, which: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, covered tokens, windows) from matches of the windows at ``at`` of documents ``doc`` with rows ``which`` of the table."""
    item, place, size = table["item"][which], table["place"][which], table["size"][which]
    shift = at - t.first[doc] - place
    order = np.lexsort((place, shift, item, doc))
    doc, item, shift, place, size = doc[order], item[order], shift[order], place[order], size[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
    first = np.flatnonzero(new)
    reach = size.copy()
    inner = np.flatnonzero(~new) - 1
    reach[inner] = np.minimum(size[inner], place[inner + 1] - place[inner])
    most, n = np.add.reduceat(reach, first), np.diff(table["first"])[item[first]]
    stop = np.append(first[1:], len(doc))
    out = []
    # Only alignments that cover enough if all their windows are consistent.
    for g in np.flatnonzero((most >= 13) | (most >= 0.6 * n)).tolist():
        a, b, i, d = first[g], stop[g], int(item[first[g]]), int(doc[first[g]])
        base, here = int(table["first"][i]), int(t.first[d] + shift[first[g]])
        told: dict[tuple[int, int], int] = {}
        covered, good = np.zeros(int(n[g]), bool), 0
        for p, m in zip(place[a:b].tolist(), size[a:b].tolist(), strict=True):
            mine, theirs = slice(base + p, base + p + m), slice(here + p, here + p + m)
            slot = table["slot"][mine]
            if (table["kind"][mine] != t.kind[theirs]).any():
                continue
            pairs = [((s, x), y) for s, x, y in zip(slot.tolist(), table["value"][mine].tolist(), t.value[theirs].tolist(), strict=True) if s]
            trial = dict(told)
            if all(trial.setdefault(x, y) == y for x, y in pairs):
                told = trial
                covered[p : p + m] = True
                good += 1
        c = int(covered.sum())
        if c >= 13 or c >= 0.6 * len(covered):
            out.append((d, int(table["row"][i]), c, good))
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, literal: int, least: int, block_windows: int):
    """Broadcasts of the searched items, each of about ``block_windows`` words."""
    items = benchmark.where("text is not null").select("item_id", "text")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / block_windows))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(F.lit(5), "item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        yield docs.sparkSession.sparkContext.broadcast(_items(rows, window, literal, least))


def _joined(t, table: dict, literal: int) -> list[tuple[int, int, int, int]]:
    """(document, item, covered tokens, windows) for one reading of all texts of a batch."""
    hashes, out = table["hash"], []
    if not len(hashes) or not len(t.kind):
        return out
    owner = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    at, low, n = [], [], []
    for size in np.unique(table["size"]).tolist():
        h = _windows(t, size, literal)
        a = np.searchsorted(hashes, h)
        hit = np.flatnonzero(hashes[np.minimum(a, len(hashes) - 1)] == h)
        hit = hit[T.inside(t.first, size, len(t.kind))[hit]] if len(hit) else hit
        at.append(hit)
        low.append(a[hit])
        n.append(np.searchsorted(hashes, h[hit], "right") - a[hit])
    at, low, n = (np.concatenate(x) for x in (at, low, n))
    order = np.argsort(at, kind="stable")
    at, low, n = at[order], low[order], n[order]
    upto, doc, a = np.cumsum(n), owner[at], 0
    while a < len(at):
        # Whole documents, about PAIRS pairs at a time.
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        b = int(np.searchsorted(doc, doc[b - 1], "right")) if b == a + 1 or doc[b - 1] == doc[a] else b if b == len(at) or doc[b] != doc[b - 1] else int(np.searchsorted(doc, doc[b - 1]))
        out += _expanded(table, t, at[a:b], low[a:b], n[a:b], doc[a:b])
        a = b
    return out


def _expanded(table: dict, t, at: np.ndarray, low: np.ndarray, n: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """As ``_aligned``; a document with too many pairs takes one range of items after another."""
    total = int(n.sum())
    parts = -(-total // PAIRS)
    out = []
    bounds = np.linspace(0, len(table["row"]), parts + 1).astype(np.int64)
    for p in range(parts):
        which = [np.arange(a, a + k) for a, k in zip(low.tolist(), n.tolist(), strict=True)] if parts > 1 else None
        if which is None:
            rows = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            out += _aligned(table, t, np.repeat(at, n), rows, np.repeat(doc, n))
            continue
        # Rows of one key are sorted by item.
        inside = [x[np.searchsorted(table["item"][x], bounds[p]) : np.searchsorted(table["item"][x], bounds[p + 1])] for x in which]
        size = np.array([len(x) for x in inside])
        if size.sum():
            out += _aligned(table, t, np.repeat(at, size), np.concatenate(inside), np.repeat(doc, size))
    return out


def _found(column: pa.Array, items: dict) -> dict[tuple[int, int], tuple[int, int]]:
    """Covered tokens and windows by row of a column and row of the items: the best of all readings."""
    w, best = T.words(column, lower=True, plain=True), {}
    for t, table in ((Template(w, False), "template"), (Template(w, True), "template"), (Literal(w), "literal")):
        for d, i, c, g in _joined(t, items[table], items["least_literal"]):
            best[d, i] = max(best.get((d, i), (0, 0)), (c, g))
    return best


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, literal: int = 4, least: int = 5, block_windows: int = 300_000) -> DataFrame:
    """``doc_id, item_id, covered, windows`` for each document row and item row that contaminates it."""
    out = None
    for shared in _blocks(docs, benchmark, window, literal, least, block_windows):

        def look(batches, shared=shared):
            items = shared.value
            for batch in T.batches(batches):
                ids = batch.column("doc_id").to_pylist()
                got = [(ids[d], items["ids"][i], c, g) for (d, i), (c, g) in _found(batch.column("text"), items).items()]
                columns = list(zip(*got, strict=True)) or [[], [], [], []]
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "item_id", "covered", "windows"])

        part = docs.select("doc_id", "text").mapInArrow(look, "doc_id long, item_id long, covered int, windows int")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, literal: int = 4, least: int = 5, block_windows: int = 300_000) -> DataFrame:
    """``doc_id, item_ids, covered``: a row for each contaminated row of ``docs``, with the items found in it. Blocks of items add to a row where it is."""
    out = docs.select("doc_id", "text", F.lit(None).cast("array<long>").alias("item_ids"), F.lit(0).alias("covered"))
    for shared in _blocks(docs, benchmark, window, literal, least, block_windows):

        def look(batches, shared=shared):
            items = shared.value
            for batch in T.batches(batches):
                ids, most = batch.column("item_ids").to_pylist(), batch.column("covered").to_pylist()
                for (d, i), (c, _) in _found(batch.column("text"), items).items():
                    ids[d] = sorted({*(ids[d] or []), *([items["ids"][i]] if items["ids"][i] is not None else [])})
                    most[d] = max(most[d], c)
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int64())), pa.array(most, pa.int32())], names=["doc_id", "text", "item_ids", "covered"])

        out = out.mapInArrow(look, "doc_id long, text string, item_ids array<long>, covered int")
    return out.where("covered > 0").drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, literal: int = 4, least: int = 5, block_windows: int = 300_000) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; decided where the texts are, so none moves."""
    out = docs
    for shared in _blocks(docs, benchmark, window, literal, least, block_windows):

        def clean(batches, shared=shared):
            for batch in T.batches(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in _found(batch.column("text"), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
