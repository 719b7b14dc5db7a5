"""Substring deduplication by suffix automata of reference shards.

A shard of reference passages is turned into one generalised suffix automaton over words; passages are streamed through
it for their matching statistics, and a window is repeated where the state that holds it has two end positions at least.

The whole corpus is its own reference, so shards are not broadcast to every document: that work would grow with the square of
the corpus.  Instead passages are routed by content to the one shard that can match them (``passages.repeated``); each shard
is bounded, and its automaton lives in one task.

Defined results: null or empty texts have 0 words and the hash of the empty string; each row is a document of its own,
also with equal or null ``doc_id``; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.llm import passages

#: Words of passages in one automaton, unless one anchor alone has more (it has at most ``hot`` contexts).
SHARD_WORDS = 50_000


class SuffixAutomaton:
    """Generalised suffix automaton over hashable symbols, with weighted end positions."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, symbol) -> int:
        following, link, length = self.next, self.link, self.length
        q = following[last].get(symbol)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, q, symbol)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = following[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
        return new

    def _split(self, p: int, q: int, symbol) -> int:
        following, link = self.next, self.link
        copy = self._state(self.length[p] + 1, dict(following[q]), link[q])
        link[q] = copy
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = copy
            p = link[p]
        return copy

    def add(self, symbols: list, weight: int = 1) -> None:
        last = 0
        for x in symbols:
            last = self._extend(last, x)
            self.weight[last] += weight

    def close(self) -> None:
        """Hands the weight of end positions up the suffix links, longest states first."""
        weight, link, length = self.weight, self.link, self.length
        by = [[] for _ in range(max(length) + 1)]
        for v, n in enumerate(length):
            by[n].append(v)
        for states in reversed(by[1:]):
            for v in states:
                weight[link[v]] += weight[v]

    def repeats(self, symbols: list, size: int) -> list[bool]:
        """For each run of ``size`` symbols, whether its end positions weigh two or more."""
        following, link, length, weight = self.next, self.link, self.length, self.weight
        out, v, n = [], 0, 0
        for i, x in enumerate(symbols):
            while v and x not in following[v]:
                v = link[v]
                n = length[v]
            v = following[v].get(x, 0)
            n = n + 1 if v else 0
            while v and length[link[v]] >= size:
                v = link[v]
                n = length[v]
            if i + 1 >= size:
                out.append(n >= size and weight[v] > 1)
        return out


def resolver(size: int):
    def run(groups: list) -> list:
        out, a = [], 0
        while a < len(groups):
            b, load = a, 0
            while b < len(groups) and (b == a or load + sum(len(x) for x, _, _ in groups[b]) <= SHARD_WORDS):
                load += sum(len(x) for x, _, _ in groups[b])
                b += 1
            shard = SuffixAutomaton()
            for group in groups[a:b]:
                for symbols, _, n in group:
                    shard.add(symbols, n)
            shard.close()
            out += [[shard.repeats(symbols, size) for symbols, _, _ in group] for group in groups[a:b]]
            a = b
        return out

    return run


def substring_dedup(docs: DataFrame, window: int = 35, k: int = 18) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` after removing every word of a window that starts elsewhere too."""
    return passages.repeated(docs, window, k, resolver(window), passages.finish_rows, passages.FINISHED)


def clean_texts(docs: DataFrame, window: int = 35, k: int = 18) -> DataFrame:
    """``doc_id, text``: what is left of each document, words joined by one space."""
    import pyarrow as pa

    def finish(table, w, covered):
        return pa.table({"doc_id": table.column("doc_id"), "text": pa.array(passages.kept_text(table, w, covered), pa.string())})

    return passages.repeated(docs, window, k, resolver(window), finish, "doc_id long, text string")
