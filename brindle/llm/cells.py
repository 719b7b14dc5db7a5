"""Counts of 64-bit keys over all documents, answered back to the documents.

Documents are dealt into buckets of a fixed number of text bytes by a hash of their id.  A bucket sends its distinct keys, with their counts, as one
packed row ("cell") for each range of keys; whoever owns a range adds up its cells and answers each cell; a bucket's answers meet its documents
again.  However frequent a key is, a bucket sends it once, so no key makes a task large; what moves is a few bytes for each distinct key
of a bucket, and the documents are shuffled once (both passes read the same exchange).

Keys are whole: 64 bits at every size.  Buckets hold ``BUCKET`` bytes of text and ranges ``PART`` bytes of keys, at every size, so a task's memory
does not grow with the input.  With B buckets and P ranges there are up to B * P cells, which would grow with the square of the input.  So where
B * P is above ``DIRECT``, cells go through halls: a hall takes the keys of one coarse range from one group of buckets, is itself a bucket towards the
owners of the ranges within its coarse range, and hands the answers back.  There are about sqrt(P) coarse ranges, so cells grow with the
1.5th power of the input, and a cell keeps hundreds of keys up to some 100 TB.  Counts are the same either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
BUCKET = 2 << 20
PART = 16 << 20
DIRECT = 1 << 27


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts."""
    return max(1, df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def bucketed(docs: DataFrame, total: int, bucket_bytes: int = BUCKET) -> DataFrame:
    """``doc_id, text, bucket``: ready for groupBy("bucket"). ``total``: bytes of all texts."""
    n = max(1, math.ceil(total / bucket_bytes))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(n)).cast("long").alias("bucket"))


def place_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges each key lies in."""
    high, low = keys >> U64(32), keys & U64(0xFFFFFFFF)
    n = U64(parts)
    return ((high * n + (low * n >> U64(32))) >> U64(32)).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as Elias and Fano do: low bits side by side, and the steps of the rest as a bitmap; about 2 bits a key more than needed."""
    n = len(keys)
    x = keys - keys[0]
    width = max(0, (int(x[-1]) // n).bit_length() - 1)
    high = (x >> U64(width)).astype(np.int64) + np.arange(n)
    steps = np.zeros(int(high[-1]) + 1, bool)
    steps[high] = True
    low = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - width :]
    return np.array([n, width, keys[0]], "<u8").tobytes() + np.packbits(low).tobytes() + np.packbits(steps).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    n, width, first = np.frombuffer(raw[:24], "<u8").tolist()
    cut = 24 + (n * width + 7) // 8
    low = np.zeros((n, 64), np.uint8)
    low[:, 64 - width :] = np.unpackbits(np.frombuffer(raw[24:cut], np.uint8))[: n * width].reshape(n, width)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw[cut:], np.uint8)))[:n] - np.arange(n)
    return (np.packbits(low, axis=1).view(">u8").ravel().astype(U64) | high.astype(U64) << U64(width)) + U64(first)


def pack_numbers(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: planes that hardly change are removed by the shuffle's compression."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    """A bit for each count that isn't 1, then a byte for each of those; those of 255 or more follow at full length."""
    odd = counts != 1
    rest = counts[odd]
    large = rest >= 255
    return np.packbits(odd).tobytes() + np.where(large, 255, rest).astype(np.uint8).tobytes() + pack_numbers(rest[large])


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    flags = (n + 7) // 8
    odd = np.flatnonzero(np.unpackbits(np.frombuffer(raw[:flags], np.uint8))[:n])
    rest = np.frombuffer(raw[flags : flags + len(odd)], np.uint8).astype(np.int64)
    rest[rest == 255] = unpack_numbers(raw[flags + len(odd) :])
    out = np.ones(n, np.int64)
    out[odd] = rest
    return out


class Keys:
    """Sorted distinct keys, how often each occurs, and with ``members`` its first holder (``bucket << 32 | row``)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray | None = None, holders: np.ndarray | None = None):
        order = None if counts is None and holders is None else np.argsort(keys)
        keys = np.sort(keys) if order is None else keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        self.keys = keys[at]
        self.counts = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts.astype(np.int64)[order], at) if len(at) else none
        self.holders = None if holders is None else np.minimum.reduceat(holders[order], at) if len(at) else none


CELL = "part long, bucket long, keys binary, counts binary, holders binary"
REPLY = "bucket long, part long, reply binary"


def _cells(own: Keys, bucket: int, bounds: np.ndarray, parts: np.ndarray) -> pa.Table:
    """One row for each range (``bounds``: where each begins in the keys) that has keys."""
    full = np.flatnonzero(np.diff(bounds))
    spans = [(bounds[p], bounds[p + 1]) for p in full]
    holders = [None] * len(full) if own.holders is None else [pack_numbers(own.holders[a:b]) for a, b in spans]
    return pa.table({
        "part": pa.array(parts[full], pa.int64()), "bucket": pa.array(np.full(len(full), bucket), pa.int64()), "keys": pa.array([pack_keys(own.keys[a:b]) for a, b in spans], pa.binary()),
        "counts": pa.array([pack_counts(own.counts[a:b]) for a, b in spans], pa.binary()), "holders": pa.array(holders, pa.binary()),
    })


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges begins in sorted keys."""
    full, first = np.unique(place_of(keys, parts), return_index=True)
    out = np.searchsorted(full, np.arange(parts + 1))
    return np.append(first, len(keys))[out]


def _merged(table: pa.Table) -> tuple[Keys, list[np.ndarray]]:
    """The keys of all cells together, and the keys of each cell."""
    keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
    counts = [unpack_counts(x.as_py(), len(k)) for x, k in zip(table.column("counts"), keys, strict=True)]
    held = [unpack_numbers(x.as_py()) for x in table.column("holders") if x.is_valid]
    return Keys(np.concatenate(keys), np.concatenate(counts), np.concatenate(held) if held else None), keys


def _reply(counts: np.ndarray, holders: np.ndarray | None, flags: bool) -> bytes:
    """Which keys occur twice at least; unless only that is asked for, their counts, and their first holders."""
    twice = counts > 1
    raw = np.packbits(twice).tobytes()
    if flags:
        return raw
    held = b"" if holders is None else pack_numbers(holders[twice])
    return raw + held + pack_counts(counts[twice])


def _answers(own: Keys, bounds: np.ndarray, replies: pa.Table, members: bool, flags: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the keys in all documents (with ``flags`` 1 or 2), and holders (-1 for keys that occur once)."""
    counts, holders = np.ones(len(own.keys), np.int64), np.full(len(own.keys), -1)
    if (np.diff(bounds) > 0).sum() != replies.num_rows:
        raise RuntimeError("answers do not match the keys of their bucket")
    for part, raw in zip(replies.column("part").to_pylist(), replies.column("reply").to_pylist(), strict=True):
        a, b = bounds[part], bounds[part + 1]
        size = (b - a + 7) // 8
        hit = a + np.flatnonzero(np.unpackbits(np.frombuffer(raw[:size], np.uint8))[: b - a])
        if flags:
            counts[hit] = 2
            continue
        if members:
            holders[hit] = unpack_numbers(raw[size : size + 8 * len(hit)])
            size += 8 * len(hit)
        counts[hit] = unpack_counts(raw[size:], len(hit))
    return counts, holders


def _replies(own: Keys, every: list[np.ndarray], counts: np.ndarray, holders: np.ndarray | None, flags: bool) -> list[bytes]:
    out = []
    for keys in every:
        at = np.searchsorted(own.keys, keys)
        out.append(_reply(counts[at], None if holders is None else holders[at], flags))
    return out


class Ranges:
    """How many buckets and key ranges there are, and whether cells go through halls."""

    def __init__(self, total: int, bytes_per_byte: float, bucket_bytes: int = BUCKET, direct: int | None = None):
        """``total``: bytes of all texts; ``bytes_per_byte``: of keys for each of text."""
        buckets, parts = max(1, math.ceil(total / bucket_bytes)), max(64, math.ceil(total * bytes_per_byte / PART))
        self.halls = buckets * parts > (DIRECT if direct is None else direct)
        self.coarse = max(2, math.isqrt(parts)) if self.halls else parts
        self.fine = self.groups = -(-parts // self.coarse)

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where the ranges that a bucket tells apart begin in its keys."""
        return _bounds(keys, self.coarse)


def asked(sent: DataFrame, ranges: Ranges, members: bool = False, flags: bool = False) -> DataFrame:
    """Answers (``REPLY``) to the cells that buckets send."""

    def add(table: pa.Table) -> pa.Table:
        own, every = _merged(table)
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "reply": pa.array(_replies(own, every, own.counts, own.holders, flags), pa.binary())})

    def within(keys: np.ndarray) -> np.ndarray:
        """Bounds of the fine ranges in keys of one coarse range."""
        return _bounds(keys, ranges.coarse * ranges.fine)

    def forward(table: pa.Table) -> pa.Table:
        own, _ = _merged(table)
        return _cells(own, table.column("part")[0].as_py(), within(own.keys), np.arange(ranges.coarse * ranges.fine))

    def back(table: pa.Table, replies: pa.Table) -> pa.Table:
        own, every = _merged(table)
        counts, holders = _answers(own, within(own.keys), replies, members, flags)
        part = table.column("hall").to_numpy() % ranges.coarse
        return pa.table({"bucket": table.column("bucket"), "part": pa.array(part, pa.int64()), "reply": pa.array(_replies(own, every, counts, holders if members else None, flags), pa.binary())})

    if not ranges.halls:
        return sent.groupBy("part").applyInArrow(add, REPLY)
    told = sent.groupBy("part").applyInArrow(forward, CELL).groupBy("part").applyInArrow(add, REPLY)
    told = told.select(F.col("bucket").alias("hall"), "part", "reply").groupBy("hall")
    return sent.withColumnRenamed("part", "hall").groupBy("hall").cogroup(told).applyInArrow(back, REPLY)


def cells_of(own: Keys, bucket: int, ranges: Ranges) -> pa.Table:
    """What a bucket sends: ``CELL`` rows for ``asked``."""
    first = (bucket % ranges.groups) * ranges.coarse if ranges.halls else 0
    return _cells(own, bucket, ranges.bounds(own.keys), first + np.arange(ranges.coarse))


def answers(own: Keys, replies: pa.Table, ranges: Ranges, members: bool = False, flags: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What a bucket was answered: counts of its keys in all documents (with ``flags`` 2 for all above 1), and holders (-1 for keys that occur once)."""
    return _answers(own, ranges.bounds(own.keys), replies, members, flags)


def key_counts(
    docs: DataFrame,
    total: int,
    keys_of: Callable[[pa.Table], tuple],
    finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table],
    schema: str,
    bytes_per_byte: float,
    members: bool = False,
    flags: bool = False,
    bucket_bytes: int = BUCKET,
    direct: int | None = None,
) -> DataFrame:
    """Runs ``finish(bucket, keys, counts, holders)`` on each bucket of documents.

    ``keys_of(bucket)`` gives all keys of a bucket, their weights (None: 1 each), and with ``members`` the row of each (rows must come in an order that
    the documents decide).  ``keys`` are its distinct keys in order, ``counts`` their weights in all documents, ``holders`` the first
    ``bucket << 32 | row`` that has a key (see ``answers``).
    """
    rows, ranges = bucketed(docs, total, bucket_bytes), Ranges(total, bytes_per_byte, bucket_bytes, direct)

    def own_of(table: pa.Table) -> Keys:
        if not table.num_rows:
            return Keys(np.zeros(0, U64), holders=np.zeros(0, np.int64) if members else None)
        keys, weights, row = keys_of(table)
        return Keys(keys, weights, np.int64(table.column("bucket")[0].as_py()) << 32 | row if members else None)

    def send(table: pa.Table) -> pa.Table:
        return cells_of(own_of(table), table.column("bucket")[0].as_py(), ranges)

    def meet(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = own_of(table)
        return finish(table, own.keys, *answers(own, replies, ranges, members, flags))

    replies = asked(rows.groupBy("bucket").applyInArrow(send, CELL), ranges, members, flags)
    return rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(meet, schema)


def lookup(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of ``asked`` keys, all of which are among ``keys``."""
    return counts[np.searchsorted(keys, asked)]
