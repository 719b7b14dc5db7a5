"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative for each group.

There is a cell for each ``per_cell`` vectors, up to ``max_cells``.  Centroids are trained on a bounded sample (``sample`` vectors, four for each cell at
least, those with the least hash of their id); every vector is then put into its ``reach`` nearest cells, so that a pair is missed only if no
cell is near to both.  ``reach=None`` is the exact way: all vectors of a label are one cell, and no pair is missed.  Equal vectors are one vector
with a weight.  A cell is compared block by block: a cell of more than ``block`` vectors is dealt into blocks by a hash, and
each pair of blocks is one task, whatever the size of the cell.  A pair of vectors counts in the first cell that they share.

Dense spots would make cells large and their comparison quadratic.  Where a hundredth of the sample lies within half the threshold angle of one of its
vectors, that vector leads a tight group: all members are linked with each other without a comparison, by the triangle inequality, and only the
vectors around a group are compared with its members, block by block.  There are a hundred leaders at most.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and rows with null label or null ``vec_id``,
link with nothing (0 links, own component; ``kept`` is false for a null id).  ``vec_id`` is the identity of a vector: rows that
repeat an id get one result each, the same.  Vectors of different lengths are never compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import components
from brindle.llm.shared import checkpoint, least_hashed

SAMPLE = 16384
MAX_CELLS = 16384


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of the rows of x (unit vectors)."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def leaders(x: np.ndarray, threshold: float, share: float = 0.01, least: int = 32) -> np.ndarray:
    """Rows of x (unit vectors) around each of which a ``share`` of all rows, and ``least`` rows, lie within half the threshold angle; no row is counted twice."""
    inner = np.cos(np.arccos(threshold) / 2 - 1e-6)
    n = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 1024):
        n[a : a + 1024] = (x[a : a + 1024] @ x.T >= inner).sum(axis=1)
    need, free, out = max(least, share * len(x)), np.ones(len(x), bool), []
    for i in np.argsort(-n, kind="stable"):
        if n[i] < need:
            break
        own = (x @ x[i] >= inner) & free
        if free[i] and own.sum() >= need:
            out.append(i)
            free &= ~own
    return x[out]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def links_within(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, cells: np.ndarray, cell: int, left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """Links between rows ``left`` and ``right``: weight of each row's partners, and the least id each is joined to."""
    n = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    a, b = _unit(x[left]), _unit(x[right])
    pairs = []
    for at in range(0, len(left), 512):
        i, j = np.nonzero(a[at : at + 512] @ b.T >= threshold - 1e-9)
        i, j = left[i + at], right[j]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            dot = np.einsum("ij,ij->i", x[p], x[q])
            size = np.sqrt(np.einsum("ij,ij->i", x[p], x[p])) * np.sqrt(np.einsum("ij,ij->i", x[q], x[q]))
            common = np.where((cells[p][:, :, None] == cells[q][:, None, :]).any(axis=2), cells[p], np.iinfo(np.int32).max).min(axis=1)
            keep = dot / size >= threshold
            p, q, first = p[keep], q[keep], common[keep] == cell
            np.add.at(n, p[first], weight[q[first]])
            np.add.at(n, q[first], weight[p[first]])
            pairs.append((p, q))
    if pairs:
        p, q = (np.concatenate(v) for v in zip(*pairs, strict=True))
        while True:  # least label over links, with labels of labels
            before = root.copy()
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == before).all():
                break
    return n, root


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, reach: int | None = 4, block: int = 1024, per_cell: int = 256, max_cells: int = MAX_CELLS, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    good = vectors.where(fit).select("vec_id", "label", "embedding")
    # Equal vectors of a label are one, under the least id.
    distinct = checkpoint(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("weight")))
    n = distinct.count()
    cells = max(1, min(max_cells, n // per_cell))
    drawn = least_hashed(distinct.select("id", "embedding"), "id", max(sample, 4 * cells), 31).select("embedding").toPandas()["embedding"]
    by_size: dict[int, list] = {}
    for v in drawn:
        by_size.setdefault(len(v), []).append(v)
    centres = {d: k_means(_unit(np.array(v, np.float64)), min(cells, len(v))) for d, v in by_size.items()} if reach else {}
    # Of a large sample an even part suffices to find spots that hold a hundredth of it.
    tight = {d: leaders(_unit(np.array(v[:: max(1, len(v) // SAMPLE)], np.float64)), threshold) for d, v in by_size.items()}
    half = np.arccos(threshold) / 2 - 1e-6
    inner, outer = float(np.cos(half)), float(np.cos(np.arccos(threshold) + half + 1e-6))
    shared = spark.sparkContext.broadcast((centres, tight))  # at most max_cells centroids and 100 leaders for each vector length in the sample

    def assign(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("embedding").value_lengths())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                x, c, lead = _unit(_matrix(part.column("embedding"))), shared.value[0].get(int(d)), shared.value[1].get(int(d))
                near = x @ lead.T if lead is not None and len(lead) else np.zeros((len(x), 0))
                inside = near >= inner
                own = np.where(inside.any(axis=1), inside.argmax(axis=1), -1) if near.shape[1] else np.full(len(x), -1)
                # A member visits only groups before its own, so that two groups meet once.
                visits = [np.flatnonzero((v >= outer) & ((np.arange(len(v)) < o) | (o < 0))).astype(np.int32) for v, o in zip(near, own, strict=True)]
                top = np.zeros((len(x), 1), np.int64) if c is None else np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :reach]
                cells = [np.sort(t).astype(np.int32) for t in top]
                yield pa.record_batch([part.column("id"), part.column("weight"), part.column("label"), part.column("embedding"), pa.array(cells, pa.list_(pa.int32())), pa.array(own, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["id", "weight", "label", "embedding", "cells", "leader", "visits"])

    label = distinct.schema["label"].dataType.simpleString()
    kind = distinct.schema["embedding"].dataType.simpleString()
    placed = checkpoint(distinct.select("id", "weight", "label", "embedding").mapInArrow(assign, f"id long, weight long, label {label}, embedding {kind}, cells array<int>, leader int, visits array<int>")).withColumn("dims", F.size("embedding"))
    keyed = placed.where("leader < 0").select("*", F.explode("cells").alias("cell"))
    sizes = checkpoint(keyed.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    dealt = keyed.join(sizes, ["label", "dims", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        ids, weight, own = (table.column(c).to_numpy() for c in ("id", "weight", "own"))
        x, cells = _matrix(table.column("embedding")), _matrix(table.column("cells")).astype(np.int32)
        low, high, cell = (table.column(c)[0].as_py() for c in ("low", "high", "cell"))
        order = np.argsort(ids)  # so that the least position is the least id
        ids, weight, own, x, cells = ids[order], weight[order], own[order], x[order], cells[order]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        count, root = links_within(ids, weight, x, cells, cell, left, right, threshold, low == high)
        hit = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        return pa.table({"id": ids[hit], "n": count[hit], "root": ids[root[hit]]})

    def around(table: pa.Table) -> pa.Table:
        """Links between visitors and a block of members of a tight group."""
        ids, weight, guest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight", "guest"))
        x = _matrix(table.column("embedding"))
        order = np.argsort(ids)
        ids, weight, guest, x = ids[order], weight[order], guest[order].astype(bool), x[order]
        count, root = links_within(ids, weight, x, np.zeros((len(ids), 1), np.int32), 0, np.flatnonzero(guest), np.flatnonzero(~guest), threshold, False)
        hit = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        return pa.table({"id": ids[hit], "n": count[hit], "root": ids[root[hit]]})

    within = pairs.groupBy("label", "dims", "cell", "low", "high").applyInArrow(compare, "id long, n long, root long")
    group = ["label", "dims", "leader"]
    totals = checkpoint(placed.where("leader >= 0").groupBy(*group).agg(F.min("id").alias("root"), F.sum("weight").alias("total"), F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    inmates = placed.where("leader >= 0").join(totals, group)
    tied = inmates.select("id", (F.col("total") - F.col("weight")).alias("n"), "root")
    columns = [*group, "id", "weight", "embedding"]
    members = inmates.select(*columns, F.lit(False).alias("guest"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("piece"))
    guests = placed.select("id", "weight", "label", "dims", "embedding", F.explode("visits").alias("leader")).join(totals, group)
    guests = guests.select(*columns, F.lit(True).alias("guest"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("piece"))
    beside = members.unionByName(guests).groupBy(*group, "piece").applyInArrow(around, "id long, n long, root long")
    found = checkpoint(within.unionByName(tied).unionByName(beside))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    # A copy has the links of its vector, and those to the other copies.
    reps = distinct.select("id", "weight", "label", "embedding").join(counts, "id", "left").join(groups, "id", "left")
    # Only vectors with a copy or a link are joined back by value.
    told = reps.where("n is not null or weight > 1 or component is not null").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    per_id = good.join(told, ["label", "embedding"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select("vec_id").join(per_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
