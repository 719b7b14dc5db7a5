"""Deduplication by sparse suffix arrays.

Only suffixes at minimiser positions are kept.  Suffixes that begin with the same k words are sorted by their words, and
neighbours are compared; matches are then extended left from the shared position, so that every passage of ``window`` words that
occurs twice is found: it holds a shared minimiser.  A suffix is cut where no window of its position reaches further.

Sorting each group of suffixes with one k-word prefix, prefix by prefix, is sorting the suffix array in pieces: the order between
groups has no influence, as neighbours across groups share fewer than k words.

Defined results: null or empty texts have no spans; each row is a document of its own, also with equal or null ``doc_id``;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm import passages


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compare(group: list, size: int) -> list[list[bool]]:
    """Windows of ``size`` words of each suffix context that another context (or another copy of it) has too."""
    order = sorted(range(len(group)), key=lambda i: group[i][0][group[i][1] :])
    right = [group[i][0][group[i][1] :] for i in order]
    left = [group[i][0][: group[i][1]][::-1] for i in order]
    count = [group[i][2] for i in order]
    windows = [len(group[i][0]) - size + 1 for i in order]
    common = [_common(a, b) for a, b in zip(right, right[1:], strict=False)]
    out = [[c > 1] * n for c, n in zip(count, windows, strict=True)]
    if len(group) == 2:
        reach = _common(*left)
        for i in (0, 1):
            for start in range(windows[i]):
                back = len(left[i]) - start
                out[i][start] |= 0 <= back <= reach and common[0] >= size - back
        return [out[order.index(i)] for i in range(2)]
    for back in range(max(map(len, left)) + 1):
        # Runs of neighbours that share size - back words to the right; in a run, those with the same words to the left.
        run, a = [], 0
        for b in range(1, len(order) + 1):
            if b == len(order) or common[b - 1] < size - back:
                if b - a > 1:
                    run.append(range(a, b))
                a = b
        for members in run:
            alike: dict[tuple, list[int]] = {}
            for i in members:
                start = len(left[i]) - back
                if 0 <= start < windows[i]:
                    alike.setdefault(tuple(left[i][:back]), []).append(i)
            for same in alike.values():
                if len(same) > 1:
                    for i in same:
                        out[i][len(left[i]) - back] = True
    back_to = [None] * len(order)
    for at, i in enumerate(order):
        back_to[i] = out[at]
    return back_to


def resolver(size: int):
    return lambda groups: [compare(g, size) for g in groups]


def _spans(table: pa.Table, w, covered: np.ndarray) -> pa.Table:
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    cut = np.zeros(len(covered) + 1, bool)
    cut[w.first] = True
    begins = np.flatnonzero((edge == 1) | (cut & np.append(covered, False) & (edge == 0)))
    ends = np.flatnonzero((edge == -1) | (cut & np.append(covered, False) & (edge == 0) & (np.arange(len(edge)) > 0)))
    doc = np.searchsorted(w.first, begins, "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(w.first)))
    n_words = np.diff(w.first)
    before = np.zeros(len(covered) + 1, np.int64)
    np.cumsum(covered, out=before[1:])
    spans = [[{"first": int(begins[i] - w.first[d]), "words": int(ends[i] - begins[i])} for i in range(bounds[d], bounds[d + 1])] for d in range(len(n_words))]
    return pa.table({
        "doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_repeated": pa.array(before[w.first[1:]] - before[w.first[:-1]], pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
    })


def suffix_dedup(docs: DataFrame, window: int = 50, k: int = 12) -> DataFrame:
    """``doc_id, n_words, n_repeated, spans``: maximal spans of words covered by windows that occur twice."""
    return passages.repeated(docs, window, k, resolver(window), _spans, "doc_id long, n_words long, n_repeated long, spans array<struct<first: long, words: long>>")
