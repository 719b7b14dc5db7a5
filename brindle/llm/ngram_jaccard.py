"""Exact Jaccard join of word n-gram sets with PartEnum signatures.

Sets are put into bands by size, so that two sets with Jaccard ``threshold`` or more share a band and differ there in at most
k elements.  Each band partitions the domain of n-grams into k + 1 + e parts by a hash; similar sets agree on 1 + e parts at least, and the
contents of one part are one signature.  Two things would make signatures useless, and neither is skipped:

* parts that are empty in a set carry no signature.  A set with more than e empty parts also signs a second partition (and so on,
  ``LEVELS`` times), and signs its empty parts in the last: if two similar sets agree on empty parts only, both have more than e.
* a signature that more than ``HOT`` sets share (a passage that many documents quote) is used only by sets
  of which more than e parts are empty or hot: if two similar sets agree on such parts only, both are of that kind.

Every signature that occurs twice names its first holder, and all who share it meet in the holder's group; so similar sets always meet.
Groups of hot signatures are dealt into salted pieces, each of which also gets the holder; what does not link up with
the holder in its piece is compared with the other pieces block by block.  A group of a set with P signatures has ``HOT`` * P members at most.
It is compared in blocks of ``TILE`` members: parity bitmaps (whose distance never exceeds that of the sets) rule out most candidates before any
set moves, the bitmaps of a large group are folded to ``FOLD`` bytes in all, and blocks whose sizes can't be similar, or whose members
are known to hang together, are passed over.  Links are decided on whole sets.

Equal sets within a bucket of documents are one, and equal sets of different buckets are linked by digests of 64 bits, if their sizes and a second digest of
64 bits agree; if any don't, all is done anew under another salt.  Links within a group are returned as a spanning forest, so copies never
become all pairs.

Defined results: a text without words or null text has an empty set and links with nothing; a text of fewer than n words is one n-gram;
rows that share a ``doc_id`` are one vertex; rows with null ``doc_id`` have null components; further columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import cells
from brindle.llm import text as T
from brindle.llm.components import components
from brindle.llm.shared import checkpoint, unused

U64 = np.uint64
HOT = 256
PIECE = 128
LEVELS = 4
BITS = 1024
WEIGHT = 1 << 19  # n-grams in a piece, about
EQUALS = 4096
TILE = 512
FOLD = 128 << 20


class Bands:
    """Size bands for a Jaccard threshold: ``low[c]`` is the least size of a smaller set in band c."""

    def __init__(self, threshold: Fraction, width: float = 2.0, top: int = 1 << 40):
        self.t = threshold
        low = [1]
        while low[-1] < top:
            low.append(max(low[-1] + 1, math.ceil(float(1 / threshold) ** (width * len(low)))))
        self.low = np.array(low)

    def of(self, size: int) -> range:
        """Bands of the sets that a set of this size can be similar to."""
        least = -(-size * self.t.numerator // self.t.denominator)
        return range(int(np.searchsorted(self.low, least, "right")) - 1, int(np.searchsorted(self.low, size, "right")))

    def parts(self, c: int) -> tuple[int, int]:
        """Number of parts, and k: the most elements in which similar sets of the band differ."""
        small = int(self.low[c + 1]) - 1
        large = small * self.t.denominator // self.t.numerator
        # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
        k = math.floor((1 - self.t) / (1 + self.t) * (small + large))
        n = k + 1
        if k:
            for _ in range(3):
                empty = n * (1 - 1 / n) ** int(self.low[c])
                n = k + 1 + math.ceil(empty + math.sqrt(empty) + 0.02 * n) if empty > 0.25 else k + 1
        return n, k


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, end to end, and where each text's begin."""
    w = T.words(column, lower=True)
    size = np.diff(w.first)
    count = np.where(size >= n, size - n + 1, size > 0)
    first = np.concatenate(([0], np.cumsum(count)))
    h = np.empty(first[-1], U64)
    h[np.repeat(size >= n, count)] = T.runs(w.hash, n, salt=n)[T.inside(w.first, n, len(w.hash))]
    for m in range(1, n):
        short = np.flatnonzero(size == m)
        if len(short):
            h[first[short]] = T.runs(w.hash, m, salt=m)[w.first[short]]
    # Text by text: far faster than one sort by text and hash.
    for d in np.flatnonzero(count > 1).tolist():
        h[first[d] : first[d + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][count > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[first]


class Bucket:
    """Documents of a bucket in an order that their ids and texts decide."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id")
        self.null = np.array(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((self.ids, self.null))
        same = (self.ids[order][1:] == self.ids[order][:-1]) & (self.null[order][1:] == self.null[order][:-1])
        if same.any():  # rows that share an id: by text
            texts = table.column("text").to_pylist()
            order = np.array(sorted(range(len(order)), key=lambda i: (self.null[i], self.ids[i], texts[i] or "")))
        self.ids, self.null, self.text = self.ids[order], self.null[order], table.column("text").take(pa.array(order))


class Sets:
    """Sets of the texts of a bucket, and the first row with each set."""

    def __init__(self, b: Bucket, n: int, salt: int = 0, digest_bits: int = 64):
        self.h, self.first = sets_of(b.text, n)
        self.size = np.diff(self.first)
        self.digest, self.second = (self._digests(2 * salt + i) for i in (1, 2))
        self.digest &= U64((1 << digest_bits) - 1)
        rows = np.flatnonzero(~b.null & (self.size > 0))
        both = np.stack([self.digest[rows], self.second[rows]], axis=1)
        _, first, at = np.unique(both, axis=0, return_index=True, return_inverse=True)
        lead = rows[first][at.ravel()]
        self.kept = rows[lead == rows]
        self.copies = np.stack([rows[lead != rows], lead[lead != rows]], axis=1)

    def _digests(self, salt: int) -> np.ndarray:
        sums = np.zeros(len(self.h) + 1, U64)
        np.cumsum(T.mix(self.h + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), out=sums[1:])
        return T.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U64))

    def set(self, row: int) -> np.ndarray:
        return self.h[self.first[row] : self.first[row + 1]]


#: Added to the digest of a set to get the key that equal sets share.
EQUAL = U64(0x51ED270B9F1C3A77)


def signatures(s: Sets, bands: Bands) -> tuple[np.ndarray, ...]:
    """Keys of all kept sets of a bucket, the row of each, and its unit (a set in one band and level); for each unit the number of its parts
    that are empty, how many parts similar sets must share, and the least size in its band. The first unit of a set is its digest. Keys of digests are odd, those of parts
    even: equal sets are linked by their digest alone, so no part may take its place."""
    keys, row, unit, empties, musts, lows, cache = [], [], [], [], [], [], {}
    for r in s.kept.tolist():
        x = s.set(r)
        keys.append(T.mix(s.digest[r : r + 1] + EQUAL) | U64(1))
        row.append(r)
        unit.append(1)
        empties.append(0)
        musts.append(0)
        lows.append(1)
        for c in bands.of(len(x)):
            if c not in cache:
                cache[c] = bands.parts(c)
            n, k = cache[c]
            for level in range(LEVELS):
                salt = c * LEVELS + level + 1
                part = ((T.mix(x + U64(salt * 0x9E3779B9)) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
                # Sums over a part need no order within it.
                sums = np.zeros(n, U64)
                np.add.at(sums, part, T.mix(x ^ U64(0xA5A5A5A5)))
                full = np.bincount(part, minlength=n) > 0
                at = np.flatnonzero(full)
                got = T.mix(sums[at] + T.mix(at.astype(U64) + U64(salt << 32)))
                empty = n - len(at)
                if level == LEVELS - 1 and empty >= n - k:
                    missing = np.flatnonzero(~full)
                    got = np.append(got, T.mix(T.mix(missing.astype(U64) + U64(salt << 32)) + U64(7)))
                    empty = 0
                keys.append(got & ~U64(1))
                row.append(r)
                unit.append(len(got))
                empties.append(empty)
                musts.append(n - k)
                lows.append(int(bands.low[c]))
                if empty < n - k:
                    break
    sizes = np.array(unit, np.int64)
    return (
        np.concatenate(keys) if keys else np.zeros(0, U64), np.repeat(np.array(row, np.int64), sizes), np.repeat(np.arange(len(sizes)), sizes),
        np.array(empties, np.int64), np.array(musts, np.int64), np.array(lows, np.int64),
    )


def bitmap(x: np.ndarray) -> bytes:
    """Parity of the number of elements that hash to each place; twice as many places as elements, a power of two, 1024 at least."""
    places = max(BITS, 1 << (2 * len(x) - 1).bit_length())
    n = np.bincount((T.mix(x) & U64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes from one that is as long or longer by a power of two: still no farther from others than the sets are."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=0)


def least_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each two bitmaps (rows of a and b, of one length) a bound below the size of the symmetric difference of their sets."""
    x, y = (np.unpackbits(m, axis=1).astype(np.float32) for m in (a, b))
    return x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, _KINDS[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


class Forest:
    """Members that hang together; each names the least of them that is known so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            i = int(self.root[i])
        return i

    def settle(self) -> np.ndarray:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        return self.root

    def absorb(self, rows: np.ndarray, cols: np.ndarray, alike: np.ndarray) -> None:
        """Joins what a block of comparisons (rows by columns) links."""
        far = len(self.root)
        a, b = old = self.root[rows], self.root[cols]
        while True:
            c = np.minimum(a, np.where(alike, b[None, :], far).min(axis=1))
            d = np.minimum(b, np.where(alike, c[:, None], far).min(axis=0))
            if (c == a).all() and (d == b).all():
                break
            a, b = c, d
        for was, now in set(zip(np.append(*old).tolist(), np.append(a, b).tolist(), strict=True)):
            x, y = sorted((self.find(was), self.find(now)))
            self.root[y] = x
        self.settle()


def blocks(forest: Forest, size: np.ndarray, t: Fraction, tile: int = TILE):
    """Pairs of blocks of members that may hold links not yet known: of sizes that can be similar, and not all in one tree."""
    order = np.lexsort((size, forest.root)) if len(size) > tile else np.arange(len(size))
    parts = [order[i : i + tile] for i in range(0, len(order), tile)]
    for i, a in enumerate(parts):
        for b in parts[i:]:
            low, high = sorted(((size[a].min(), size[a].max()), (size[b].min(), size[b].max())))
            if low[1] * t.denominator < high[0] * t.numerator:
                continue
            roots = forest.root[np.append(a, b)]
            if (roots != roots[0]).any():
                yield a, b


def overlaps(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two bounded lists of sets."""
    found, at = np.unique(np.concatenate(a + b), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(a), len(b)))
    for low in range(0, len(found), step):
        i, j = np.searchsorted(at, (low, low + step))
        m = np.zeros((len(a) + len(b), step), np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def relatives(sets: list[np.ndarray], t: Fraction, tile: int = 128) -> np.ndarray:
    """The least set that each is connected with by similarity. Of many, those that are like one of a few leaders need no comparison with each other."""
    size, forest = np.array([len(x) for x in sets]), Forest(len(sets))
    alike = lambda both, x, y: both * t.denominator >= (size[x][:, None] + size[y][None, :] - both) * t.numerator
    rest = np.argsort(size, kind="stable")
    for _ in range(8):
        if len(rest) <= tile:
            break
        lead, every = rest[len(rest) // 2 : len(rest) // 2 + 1], np.concatenate([sets[i] for i in rest])
        one = sets[lead[0]]
        inside = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        both = np.add.reduceat(inside.astype(np.int64), np.cumsum(size[rest]) - size[rest])
        hit = alike(both[None, :], lead, rest)
        forest.absorb(lead, rest, hit)
        rest = rest[~hit[0]]
    for a, b in blocks(forest, size, t, tile):
        forest.absorb(a, b, alike(overlaps([sets[i] for i in a], [sets[i] for i in b]), a, b))
    return forest.root


def near(maps: list[bytes], size: np.ndarray, t: Fraction, tile: int = TILE) -> np.ndarray:
    """The least member that each may be connected with, as far as bitmaps can tell."""
    most = max(BITS // 8, 1 << (FOLD // len(maps)).bit_length() - 1)
    length = np.minimum([len(m) for m in maps], most)
    forest = Forest(len(maps))
    for a, b in blocks(forest, size, t, tile):
        low = int(min(length[a].min(), length[b].min()))
        x = np.stack([folded(maps[i], low) for i in a])
        apart = least_distances(x, x if a is b else np.stack([folded(maps[i], low) for i in b]))
        p, q = size[a][:, None], size[b][None, :]
        alike = apart * (t.numerator + t.denominator) <= (p + q) * (t.denominator - t.numerator)
        forest.absorb(a, b, alike & (np.minimum(p, q) * t.denominator >= np.maximum(p, q) * t.numerator))
    return forest.root


#: ``pieces``: how many pieces a group has; 0 links ids a and b; -1 id a has b n-grams; -2 id a has the holder's digest, ``bits`` being the second
#: one; -3 sets with one digest differ.
MEMBER = "shard int, holder long, pieces int, piece int, node long, bucket long, size int, bits binary, a long, b long"
ASKED = "bucket long, grp long, pieces int, piece int, node long, holds boolean, a long, b long"
WHOLE = "shard int, grp long, pieces int, piece int, node long, holds boolean, doc_id long, grams binary, a long, b long"
LINK = "a long, b long, grp long, pieces int, piece int, node long, doc_id long, grams binary"


def links(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), bucket_bytes: int = cells.BUCKET, hot_at: int = HOT, piece_of: int = PIECE, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles`` of each row, and ``a, b``: links that connect exactly the documents that similarity connects. Fewer ``digest_bits`` only make a new salt likelier."""
    total = cells.text_bytes(docs)
    for salt in range(8):
        found = _found(docs, n, threshold, total, bucket_bytes, hot_at, piece_of, salt, digest_bits)
        kinds = {r[0] for r in found.where("pieces = -3 or pieces > 1").select(F.signum("pieces")).distinct().collect()}
        if -1 not in kinds:
            break
    else:
        raise RuntimeError("no salt tells different sets apart")
    out = found.where("pieces = 0 and a <> b").select("a", "b")
    if kinds:
        # Sets of salted groups; b: whether they did not link up with the holder.
        salted = found.where("pieces > 1").drop("a")
        apart = salted.where("b = 1").drop("b")
        out = out.unionByName(_across(salted.drop("b"), apart, threshold).where("a <> b"))
    return found.where("pieces = -1").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles")), out


def _found(docs: DataFrame, n: int, threshold: Fraction, total: int, bucket_bytes: int, hot_at: int, piece_of: int, salt: int, digest_bits: int) -> DataFrame:
    """Rows of ``LINK``, checkpointed."""
    bands = Bands(threshold)
    shards = max(64, math.ceil(total / (1 << 20)))

    def keys_of(table: pa.Table) -> tuple:
        keys, row, *_ = signatures(Sets(Bucket(table), n, salt, digest_bits), bands)
        return keys, None, row

    def shard_of(*parts) -> np.ndarray:
        x = np.zeros(np.broadcast(*parts).shape, U64)
        for p in parts:
            x = T.mix(x ^ np.asarray(p, np.int64).astype(U64))
        return (x % U64(shards)).astype(np.int32)

    def members(table: pa.Table, keys: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> pa.Table:
        if not table.num_rows:
            return arrow(MEMBER, [])
        b = Bucket(table)
        s = Sets(b, n, salt, digest_bits)
        bucket = table.column("bucket")[0].as_py()
        ids = [None if null else i for i, null in zip(b.ids.tolist(), b.null.tolist(), strict=True)]
        spread = shard_of(bucket, np.arange(len(ids))).tolist()
        # holder, pieces, piece, node, bucket, size, bits, a, b, shard
        rows = [(0, -1, 0, 0, bucket, 0, None, i, m, sh) for i, m, sh in zip(ids, s.size.tolist(), spread, strict=True)]
        rows += [(0, 0, 0, 0, bucket, 0, None, ids[r], ids[first], spread[r]) for r, first in s.copies.tolist()]
        got, row, unit, empty, must, low = signatures(s, bands)
        if len(got):
            at = np.searchsorted(keys, got)
            count, holder = counts[at], holders[at]
            node = np.int64(bucket) << 32 | row
            # A set that an earlier one equals is linked with it, and takes no part otherwise.
            lead = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]) & (must[unit] == 0))
            later = lead[(count[lead] > 1) & (holder[lead] != node[lead])]
            equal = np.zeros(len(s.size), bool)
            equal[row[later]] = True
            heads = lead[count[lead] > 1]
            for i, c in zip(heads.tolist(), count[heads].tolist()):
                r, m, h, me = int(row[i]), -(-c // EQUALS), int(holder[i]), int(node[i])
                # Many equal sets are dealt into pieces, to each of which the holder goes.
                for p in range(m) if h == me else (int(T.mix(node[i : i + 1].astype(U64))[0] % U64(m)),):
                    rows.append((h, -2, p, me, bucket, int(s.size[r]), s.second[r : r + 1].tobytes(), ids[r], None, None))
            hot = count > hot_at
            hots = np.bincount(unit, hot, len(must)).astype(np.int64)
            use = (count > 1) & (must[unit] > 0) & ~equal[row] & (~hot | ((empty + hots) >= must)[unit] | (holder == node))
            # Members of a band are of like sizes: a piece has ``piece_of`` long sets, or up to 32 times as many short ones.
            each = np.clip(WEIGHT // low[unit], piece_of, 32 * piece_of)
            pieces = np.where(count > hot_at, 1 << np.ceil(np.log2(np.maximum(count, 1) / each)).astype(np.int64).clip(1), 1)
            # Each row once with each holder and number of pieces (powers of two): one number for the three.
            names, which = np.unique(holder[use], return_inverse=True)
            code = np.unique((row[use] * len(names) + which) * 64 + np.log2(pieces[use]).astype(np.int64))
            asked = np.stack([code // 64 // max(1, len(names)), names[code // 64 % max(1, len(names))] if len(names) else code, 1 << code % 64], axis=1)
            own = T.mix(np.int64(bucket).astype(U64) << U64(32) | asked[:, 0].astype(U64))
            bits: dict[int, bytes] = {}
            for (r, h, m), o in zip(asked.tolist(), own.tolist(), strict=True):
                me = bucket << 32 | r
                if m == 1 and r not in bits:
                    bits[r] = bitmap(s.set(r))
                for p in range(m) if h == me else (o % m,):
                    rows.append((h, m, p, me, bucket, int(s.size[r]), bits[r] if m == 1 else None, None, None, None))
            # Groups are spread by their holder, pieces and piece.
            todo = [i for i, x in enumerate(rows) if x[9] is None]
            if todo:
                sh = shard_of(*(np.array([rows[i][c] for i in todo], np.int64) for c in (0, 1, 2)))
                for i, x in zip(todo, sh.tolist(), strict=True):
                    rows[i] = (*rows[i][:9], x)
        return arrow(MEMBER, [(x[9], *x[:9]) for x in rows])

    def groups_of(table: pa.Table, *names: str):
        columns = [table.column(x).to_numpy() for x in names]
        order = np.lexsort(columns[::-1])
        changed = np.ones(len(order), bool)
        changed[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        return np.split(order, np.flatnonzero(changed)[1:]) if len(order) else []

    def candidates(table: pa.Table) -> pa.Table:
        holder, pieces, piece, node, bucket, size = (table.column(c).to_numpy() for c in ("holder", "pieces", "piece", "node", "bucket", "size"))
        bits, a, b = (table.column(c).to_pylist() for c in ("bits", "a", "b"))
        out = []
        for g in groups_of(table, "holder", "pieces", "piece"):
            if pieces[g[0]] in (0, -1, -3):  # these only pass through
                out += [(int(bucket[i]), 0, int(pieces[i]), 0, 0, False, a[i], b[i]) for i in g]
                continue
            if pieces[g[0]] == -2:
                lead = next(i for i in g if node[i] == holder[i])
                out += [(int(bucket[i]), 0, 0 if bits[i] == bits[lead] and size[i] == size[lead] else -3, 0, 0, False, a[i], a[lead]) for i in g if i != lead]
                continue
            if pieces[g[0]] > 1:
                out += [(int(bucket[i]), int(holder[i]), int(pieces[i]), int(piece[i]), int(node[i]), bool(node[i] == holder[i]), None, None) for i in g]
                continue
            if len(g) < 2:
                continue
            root = near([bits[i] for i in g], size[g].astype(np.int64), threshold)
            for r in np.unique(root):
                same = g[root == r]
                if len(same) > 1:
                    grp = int(T.mix(np.array([int(holder[g[0]]) ^ (int(node[g[r]]) << 1)], U64)).astype(np.int64)[0])
                    out += [(int(bucket[i]), grp, 1, 0, int(node[i]), False, None, None) for i in same]
        return arrow(ASKED, out)

    def whole(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return arrow(WHOLE, [])
        b = Bucket(table)
        rows = list(zip(*(asked.column(c).to_pylist() for c in ("grp", "pieces", "piece", "node", "holds", "a", "b")), strict=True))
        need = sorted({r[3] & 0xFFFFFFFF for r in rows if r[1] > 0})
        h, first = sets_of(b.text.take(pa.array(need, pa.int64())), n)
        place = {r: i for i, r in enumerate(need)}
        shard = shard_of(*(np.array([(r[c] or 0) for r in rows], np.int64) for c in (0, 1, 2, 5)))
        out = []
        for (grp, pieces, piece, node, holds, x, y), sh in zip(rows, shard.tolist(), strict=True):
            r = node & 0xFFFFFFFF
            grams = h[first[place[r]] : first[place[r] + 1]].tobytes() if pieces > 0 else None
            out.append((sh, grp, pieces, piece, node, holds, int(b.ids[r]) if pieces > 0 else None, grams, x, y))
        return arrow(WHOLE, out)

    def verify(table: pa.Table) -> pa.Table:
        """Spanning links of each group; of salted groups also the sets, and whether they link up with the holder."""
        nodes = table.column("node").to_numpy()
        grp, pieces, piece, holds = (table.column(c).to_pylist() for c in ("grp", "pieces", "piece", "holds"))
        raw, a, b = table.column("grams"), table.column("a").to_pylist(), table.column("b").to_pylist()
        ids = table.column("doc_id").to_pylist()
        out = []
        for g in groups_of(table, "grp", "pieces", "piece"):
            kind = pieces[g[0]]
            if kind <= 0:
                out += [(a[i], b[i], None, kind, None, None, None, None) for i in g]
                continue
            g = g[np.unique(nodes[g], return_index=True)[1]]
            if len(g) < 2:
                continue
            sets = [np.frombuffer(raw[int(i)].as_py(), U64) for i in g]
            root = relatives(sets, threshold)
            out += [(int(ids[g[i]]), int(ids[g[root[i]]]), None, 0, None, None, None, None) for i in range(len(g)) if root[i] != i]
            if pieces[g[0]] > 1:
                main = [root[i] for i in range(len(g)) if holds[g[i]]]
                out += [(None, int(root[i] not in main), grp[j], pieces[j], piece[j], int(nodes[j]), int(ids[j]), sets[i].tobytes()) for i, j in enumerate(g)]
        return arrow(LINK, out)

    base = cells.key_counts(docs, total, keys_of, members, MEMBER, bytes_per_byte=1.2, members=True, bucket_bytes=bucket_bytes)
    rows = cells.bucketed(docs, total, bucket_bytes)

    def sets_for(asked: DataFrame) -> DataFrame:
        return rows.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(whole, WHOLE)

    asked = base.groupBy("shard").applyInArrow(candidates, ASKED)
    # One job, so that all passes over the texts read one exchange.
    return checkpoint(sets_for(asked).groupBy("shard").applyInArrow(verify, LINK))


def _across(every: DataFrame, apart: DataFrame, t: Fraction) -> DataFrame:
    """Links between sets that did not link up in their piece and the other pieces of their group, a pair of pieces at a time."""
    blocks = apart.select("grp", "pieces", F.col("piece").alias("own")).distinct()
    others = every.join(blocks, ["grp", "pieces"]).where("piece <> own").select("grp", "pieces", "own", "piece", "doc_id", "grams")
    asking = apart.select(F.col("grp").alias("grp"), F.col("pieces").alias("pieces"), F.col("piece").alias("own"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("doc_id").alias("doc_id"), F.col("grams").alias("grams")).where("piece <> own")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids = np.append(left.column("doc_id").to_numpy(), right.column("doc_id").to_numpy())
            sets = [np.frombuffer(x.as_py(), U64) for c in (left, right) for x in c.column("grams")]
            root = relatives(sets, t)
            at = np.flatnonzero(root != np.arange(len(root)))
            a, b = ids[at], ids[root[at]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["grp", "pieces", "own", "piece"]
    return asking.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``id, component`` of the documents that have links."""
    return components(links(docs, n, threshold)[1])


def jaccard_join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    sizes, found = links(docs, n, threshold)
    own = components(found).withColumnRenamed("id", "doc_id")
    return sizes.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` without all but the least ``doc_id`` of each class; of rows with the same id and text one stays."""
    losers = classes(docs, n, threshold).where("id <> component").select(F.col("id").alias("doc_id"))
    kept = docs.join(losers, "doc_id", "left_anti").select(docs.columns)
    mark = unused(docs, "digest")
    # Already dealt by doc_id, so this moves nothing again.
    return kept.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
