"""Stupid-backoff language-model scores with counts from the whole corpus.

The corpus is its own model: n-grams of all documents are exploded, counted in tables that are partitioned by hash, joined back to
the n-grams of each document and summed.  ``n_gram_scores`` says so with DataFrame operations, one row for each n-gram of a document.  At length those
rows are many times the text (README has figures), so ``lm_score`` moves the same tables packed (``cells``): a bucket of documents
sends each of its distinct n-grams once to the partition of the count table that its hash falls in, and the join's answers come back packed.  A frequent
n-gram is never a large group.  A document's own n-grams are taken off the counts, or each text would vouch for itself.

Orders above two are asked for in rounds of their own, and only n-grams of which both parts one word shorter occur in other documents: where one
doesn't, the longer one can't.  (If two documents have an n-gram, each has its parts in the other, so both ask; counts are whole.)

S(w | u) is count(u w) / count(u) where other documents have the n-gram, else ``backoff`` times S for a context shorter by one word;
a word that no other document has counts as ``1 / (N + 1)`` at the end, N being the words of the other documents.

Defined results: null and empty texts have 0 words and null scores; each row is a document of its own, also with equal or null ``doc_id``
(equal rows then vouch for each other); further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import cells
from brindle.llm import text as T

#: Key of the number of words.
ALL = np.uint64(0x5BF0363546BDB1A5)


SCHEMA = "doc_id long, n_words long, log_score double, mean_log_score double, unseen long"
BUCKET = 8 << 20


class Grams:
    """n-grams of a bucket: for each order, how often those that begin at each word occur in other documents."""

    def __init__(self, column: pa.Array, order: int):
        self.w, self.order = T.words(column), order
        self.doc, self.total = self.w.doc, len(self.w.hash)
        self.others: list[np.ndarray] = []  # by order; 0 where no n-gram begins
        self.words = 0  # of all documents
        self.found: dict[int, tuple[np.ndarray, T.Distinct]] = {}

    def asks(self, n: int) -> tuple[np.ndarray, T.Distinct]:
        """Where n-grams begin that may occur in other documents, and which they are."""
        if n not in self.found:
            at = np.flatnonzero(T.inside(self.w.first, n, self.total))
            if n > 2:
                shorter = self.others[n - 2]
                at = at[(shorter[at] > 0) & (shorter[at + 1] > 0)]
            self.found[n] = at, T.Distinct((T.runs(self.w.hash, n, salt=n) if n > 1 else T.mix(self.w.hash + np.uint64(1)))[at])
        return self.found[n]

    def orders(self, turn: int) -> range:
        return range(turn + 2, turn + 3) if turn else range(1, min(2, self.order) + 1)

    def keys(self, turn: int) -> cells.Keys:
        """What a bucket asks for in a round: first for words, pairs and the number of words, then for one order after another."""
        parts = [self.asks(n)[1] for n in self.orders(turn)]
        if turn:
            return cells.Keys(parts[0].keys, parts[0].counts)
        return cells.Keys(np.concatenate([*(x.keys for x in parts), [ALL]]).astype(np.uint64), np.concatenate([*(x.counts for x in parts), [self.total]]))

    def learn(self, turn: int, own: cells.Keys, counts: np.ndarray) -> None:
        if not turn:
            self.words = int(cells.lookup(own.keys, counts, np.array([ALL]))[0]) if len(own.keys) else 0
        for n in self.orders(turn):
            at, grams = self.asks(n)
            out = np.zeros(self.total + 1, np.int64)
            if len(at):
                out[at] = cells.lookup(own.keys, counts, grams.keys)[grams.which] - grams.own(self.doc[at])
            self.others.append(out)
            self.found[n] = at, None

    def scores(self, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Log of S of each word, and whether no other document has the word."""
        n_words = np.diff(self.w.first)
        others, place = (self.words - n_words)[self.doc], np.arange(self.total) - self.w.first[self.doc]
        one = self.others[0][: self.total]
        value = np.where(one > 0, one / np.maximum(others, 1), backoff / (others + 1))
        for n in range(2, self.order + 1):
            here, context = (np.concatenate([np.zeros(n - 1, np.int64), self.others[k - 1]])[: self.total] for k in (n, n - 1))
            reach = place >= n - 1
            value = np.where(reach & (here > 0), here / np.maximum(context, 1), np.where(reach, backoff * value, value))
        return np.log(value), one <= 0


def lm_score(docs: DataFrame, order: int = 3, backoff: float = 0.4, bucket_bytes: int = BUCKET) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score, unseen``: summed and mean natural logs of S, and words no other document has."""
    size = cells.text_bytes(docs)
    rows = cells.bucketed(docs, size, bucket_bytes)
    ranges = [cells.Ranges(size, 3.0 if turn == 0 else 2.0, bucket_bytes) for turn in range(max(1, order - 1))]

    def told(table: pa.Table, replies: pa.Table, turns: int) -> Grams:
        g = Grams(table.column("text") if table.num_rows else pa.array([], pa.string()), order)
        for turn in range(turns):
            own = g.keys(turn) if table.num_rows else cells.Keys(np.zeros(0, np.uint64), np.zeros(0, np.int64))
            mine = replies.filter(pc.equal(replies.column("turn"), turn)) if turns > 1 else replies
            g.learn(turn, own, cells.answers(own, mine, ranges[turn])[0])
        return g

    def send(turn: int):
        def first(table: pa.Table) -> pa.Table:
            return cells.cells_of(told(table, None, 0).keys(0), table.column("bucket")[0].as_py(), ranges[0])

        def later(table: pa.Table, replies: pa.Table) -> pa.Table:
            return cells.cells_of(told(table, replies, turn).keys(turn), table.column("bucket")[0].as_py(), ranges[turn])

        return later if turn else first

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        g = told(table, replies, len(ranges))
        value, unseen = g.scores(backoff)
        n_words = np.diff(g.w.first)
        score = np.array([value[a:b].sum() for a, b in zip(g.w.first[:-1], g.w.first[1:], strict=True)])
        none = n_words == 0
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(score, mask=none),
            "mean_log_score": pa.array(score / np.maximum(n_words, 1), mask=none), "unseen": pa.array(np.bincount(g.doc, unseen, len(n_words)).astype(np.int64), pa.int64()),
        })

    replies = cells.asked(rows.groupBy("bucket").applyInArrow(send(0), cells.CELL), ranges[0]).withColumn("turn", F.lit(0))
    for turn in range(1, len(ranges)):
        sent = rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(send(turn), cells.CELL)
        replies = replies.unionByName(cells.asked(sent, ranges[turn]).withColumn("turn", F.lit(turn)))
    return rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(finish, SCHEMA)


def n_gram_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4) -> DataFrame:
    """As ``lm_score``, with a row for each n-gram of each document: exploded, counted by n-gram, joined, summed. For moderate tables, and to test with.

    Words of a document are numbered; documents are told apart by id and text, so of equal rows one result is returned for each.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("w"))
    total = d.agg(F.sum(F.size("w"))).first()[0] or 0
    grams = None
    for n in range(1, order + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        part = d.select("row", F.explode(starts).alias("i"), "w").select("row", (F.col("i") + (n - 1)).alias("i"), F.lit(n).alias("n"), F.array_join(F.slice("w", F.col("i"), n), " ").alias("gram"))
        grams = part if grams is None else grams.unionByName(part)
    own = grams.groupBy("row", "n", "gram").agg(F.count("*").alias("own"))
    counts = own.groupBy("n", "gram").agg(F.sum("own").alias("every"))
    others = own.join(counts, ["n", "gram"]).select("row", "n", "gram", (F.col("every") - F.col("own")).alias("others"))
    at = grams.join(others, ["row", "n", "gram"]).groupBy("row", "i").pivot("n", list(range(1, order + 1))).agg(F.first("others"))
    context = at.select("row", (F.col("i") + 1).alias("i"), *(F.col(str(n)).alias(f"c{n}") for n in range(1, order)))
    at = at.join(context, ["row", "i"], "left").join(d.select("row", (F.lit(total) - F.size("w")).alias("rest")), "row")
    value = F.when(F.col("1") > 0, F.col("1") / F.col("rest")).otherwise(backoff / (F.col("rest") + 1))
    for n in range(2, order + 1):
        value = F.when(F.col("i") < n, value).otherwise(F.when(F.col(str(n)) > 0, F.col(str(n)) / F.col(f"c{n - 1}")).otherwise(backoff * value))
    sums = at.groupBy("row").agg(F.sum(F.log(value)).alias("log_score"), F.count_if(F.col("1") <= 0).alias("unseen"))
    n_words = F.size("w").cast("long")
    return d.join(sums, "row", "left").select("doc_id", n_words.alias("n_words"), "log_score", (F.col("log_score") / n_words).alias("mean_log_score"), F.coalesce("unseen", F.lit(0)).cast("long").alias("unseen"))
