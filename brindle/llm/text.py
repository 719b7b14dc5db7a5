"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``.  Every word gets a 64-bit hash that depends on its bytes alone, so equal
words have equal hashes in every task: its bytes are taken eight at a time, each block is mixed with its place in the word by a function that is
not linear in it, and the mixed blocks are added up.  Runs of words are hashed by putting hashes of shorter runs together, half and half, again
mixed at every step.  No step is a polynomial in bytes or words, whose differences cancel for texts of regular build (modulo 2**64 those of
Thue and Morse cancel for every base).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Words or blocks hashed at a time: bounds the arrays of 8 bytes for each, however long a text is.
CHUNK = 1 << 20
_STEP = U64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of a pair of hashes, in order; one to one in each of them."""
    x = (left ^ (left >> U64(29))) * _STEP + U64(seed * 0xD6E8FEB86659FD93 + 1 & _MASK)
    return mix((x ^ (x >> U64(32))) + right)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.ones(256, bool)
_PUNCT[128:] = _PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = False
#: Bits of the first n bytes of a block.
_FRONT = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


@dataclass
class Words:
    """Words of n_docs texts: byte spans in ``data``, hashes, word range of each text in ``first``, and its byte range in ``off``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_docs + 1
    off: np.ndarray  # n_docs + 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(column: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Splits and hashes all texts of a column; ``lower`` folds A-Z only; ``plain`` also splits at ASCII punctuation."""
    data, off = flat(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(off), np.int64), off)
    solid = ~(_PUNCT if plain else _SPACE)[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[inner < n]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = off[1:]
    inner = inner[inner > 0] - 1
    ends[inner] = solid[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, _word_hashes(data, start, end, lower), np.searchsorted(start, off), off)


def prefix_hashes(w: Words, size: int, lower: bool = False) -> np.ndarray:
    """Hashes of the first ``size`` bytes of each word; of the whole word where it is shorter."""
    return _word_hashes(w.data, w.start, np.minimum(w.end, w.start + size), lower)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Sum over the blocks of a word of the mixed block, and the length; all words at once, ``CHUNK`` blocks at a time."""
    data = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    size = end - start
    blocks = (size + 7) // 8
    upto = np.cumsum(blocks)
    out = np.empty(len(start), U64)
    a = 0
    while a < len(start):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
        n = blocks[a:b]
        if n.max() == 1:
            sums = _blocks(eight, start[a:b], size[a:b], U64(0))
        elif b == a + 1 and n[0] > CHUNK:  # one huge word
            sums = np.zeros(1, U64)
            for c in range(0, int(n[0]), CHUNK):
                place = np.arange(c, min(int(n[0]), c + CHUNK))
                sums += _blocks(eight, start[a] + 8 * place, size[a] - 8 * place, place.astype(U64)).sum()
        else:
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            sums = np.add.reduceat(_blocks(eight, np.repeat(start[a:b], n) + 8 * place, np.repeat(size[a:b], n) - 8 * place, place.astype(U64)), first)
        out[a:b] = mix(sums + size[a:b].astype(U64) * _STEP)
        a = b
    return out


def _blocks(eight: np.ndarray, at: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The mixed blocks that begin at ``at``, of words with ``left`` bytes from there on; ``place``: number of the block in its word."""
    raw = eight[at].view("<u8").ravel() & _FRONT[np.minimum(left, 8)]
    return mix(mix(raw + U64(0x2545F4914F6CDD1D)) + (place + U64(1)) * _STEP)


def runs(word_hash: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive words, regardless of text borders (see ``inside``)."""
    m = len(word_hash)
    if m < size:
        return np.zeros(0, U64)
    out = np.empty(m - size + 1, U64)
    for a in range(0, m - size + 1, CHUNK):
        b = min(m - size + 1, a + CHUNK)
        out[a:b] = _runs(word_hash[a : b + size - 1], size, salt)
    return out


def _runs(h: np.ndarray, size: int, salt: int) -> np.ndarray:
    """By the bits of ``size`` from the top: twice as many words are two halves side by side, one more word is put behind."""
    have, now = 1, mix(h + U64(salt * int(_STEP) & _MASK))
    for bit in bin(size)[3:]:
        now = joined(now[: len(now) - have], now[have:], have)
        have *= 2
        if bit == "1":
            now = joined(now[:-1], h[have:], have)
            have += 1
    return now


def inside(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether the run of ``size`` words that begins at each word stays within its text."""
    m = max(0, total - size + 1)
    ok = np.ones(m, bool)
    for back in range(1, size):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


class Distinct:
    """Distinct hashes in order, and which of them each of the given ones is."""

    def __init__(self, h: np.ndarray):
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.keys, self.counts = ranked[new], np.diff(np.append(np.flatnonzero(new), len(h)))
        self.which = np.empty(len(h), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def own(self, doc: np.ndarray) -> np.ndarray:
        """How often each hash occurs in its own document."""
        code = doc * len(self.keys) + self.which
        order = np.argsort(code)
        ranked = code[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(code) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(code)))
        out = np.empty(len(code), np.int64)
        out[order] = np.repeat(size, size)
        return out

    def pairs(self, doc: np.ndarray) -> np.ndarray:
        """Documents, once for each of their different hashes."""
        code = np.sort(doc * max(1, len(self.keys)) + self.which)
        return code[np.append(True, code[1:] != code[:-1])] // max(1, len(self.keys)) if len(code) else code


def batches(rows, limit: int = 2 << 20):
    """Cuts Arrow batches so that each holds at most ``limit`` text bytes, or one text. Column ``text`` must be there."""
    for batch in rows:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        upto, a = np.cumsum(size), 0
        while a < len(size):
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + limit, "right")))
            yield batch.slice(a, b - a)
            a = b
