"""Near-duplicate embeddings by collision-counting projections.

A vector is projected onto many random lines.  Two vectors collide on a line
if one lies within a window centred at the other; vectors of cosine 0.95 or
more do so on most lines, others on few.  So pairs are counted over the lines
and only those with the calibrated number of collisions are verified, by exact
cosine in double precision.

To count without meeting all pairs, some of the lines are also cut into cells,
in several groups of a few lines each: a group's cells are the places where
its vectors are sorted along the group's first line, and only the window of
that sorted line is counted on the other lines.  The number of groups is taken
so that a pair at 0.95 shares a cell in some group with probability 0.9999;
the number of lines in a group grows with the logarithm of the number of
vectors, so that cells stay about as full at any size.

Equal vectors enter once, with their number.  A crowded cell is dealt into
blocks, and every two blocks meet in a task of their own.  A pair is counted
in the first group that holds it in one cell; a task returns counts and a
spanning forest of its links, never the pairs.

Cases: a vector that is null, empty, zero or holds null or non-finite values
links with nothing and is its own component, as does one whose length differs
from all others; rows that repeat a vec_id are one vector (should they differ, the
smallest in Spark's order of arrays); rows with a null id are left out; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ids as column_ids
from .base import prepare, staged
from .components import components

COSINE = 0.95
#: Lines on which collisions are counted.
LINES = 48
#: Half a window, in standard deviations of the distance of a pair at COSINE along a line.
WINDOW = 2.0
#: Chance that a pair at COSINE has too few collisions, and that no group holds it in one cell.
MISS = 1e-5
LOSS = 1e-4
#: Width of a cell, in standard deviations of the vectors along a line.
CELL = 2.0
#: Vectors that a cell of unrelated ones should hold.
FILL = 64
#: Vectors of a block.
BLOCK = 1024
_SEED = 20240601


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def needed_collisions(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The most collisions that a pair at COSINE reaches with probability 1 - miss."""
    p = 2 * _normal_cdf(window) - 1
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p ** k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


class Plan:
    """Lines, cells and windows for ``n`` vectors of ``dim`` values."""

    def __init__(self, n: int, dim: int):
        apart = math.sqrt(2 * (1 - COSINE))                  # distance of unit vectors at COSINE
        spread = 1 / math.sqrt(dim)                          # standard deviation along a line of unit length
        self.step = apart * spread
        self.width = CELL * spread
        same = 1 - self.step * math.sqrt(2 / math.pi) / self.width if self.width > self.step else 0.5
        other = 0.42                                         # chance of two unrelated vectors to share a cell of one line
        self.size = max(2, math.ceil(math.log(max(n, 2) / FILL, 1 / other))) if n > FILL else 1
        self.groups = max(1, math.ceil(math.log(LOSS) / math.log(1 - same ** self.size)))
        rng = np.random.default_rng(_SEED)
        g = rng.standard_normal((dim, max(LINES, 1)))
        self.lines = g / np.linalg.norm(g, axis=0)
        c = rng.standard_normal((dim, self.groups * self.size))
        self.cuts = c / np.linalg.norm(c, axis=0)
        self.shift = rng.uniform(0, self.width, self.groups * self.size)
        self.needed = needed_collisions()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Number of each vector's cell in each group."""
        at = np.floor((unit @ self.cuts + self.shift) / self.width).astype(np.int64).view(np.uint64)
        out = np.zeros((len(unit), self.groups), np.uint64)
        for g in range(self.groups):
            x = np.full(len(unit), g + 1, np.uint64)
            for j in range(g * self.size, (g + 1) * self.size):
                x = (x ^ at[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
            out[:, g] = x
        return out


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision of a column of lists of ``dim`` values."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)             # so that no square overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def links(left: np.ndarray, right: np.ndarray, plan: Plan, group: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of vectors of two blocks of one cell with cosine >= COSINE, first held by this group.

    same: the blocks are one block, and only i < j are meant.
    """
    first = left @ plan.lines
    second = first if same else right @ plan.lines
    window = WINDOW * plan.step
    own, other = plan.cells(left), None
    other = own if same else plan.cells(right)
    order = np.argsort(second[:, 0], kind="stable")
    line = second[order, 0]
    out_i, out_j = [], []
    for a in range(0, len(left), 64):
        chunk = np.arange(a, min(a + 64, len(left)))
        chunk = chunk[np.argsort(first[chunk, 0])]
        lo = np.searchsorted(line, first[chunk[0], 0] - window, "left")
        hi = np.searchsorted(line, first[chunk[-1], 0] + window, "right")
        near = order[lo:hi]
        if not len(near):
            continue
        count = np.zeros((len(chunk), len(near)), np.uint8)
        for k in range(LINES):
            count += np.abs(first[chunk, k][:, None] - second[near, k][None, :]) <= window
        i, j = np.nonzero(count >= plan.needed)
        i, j = chunk[i], near[j]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            sure = np.einsum("ij,ij->i", left[i], right[j]) >= COSINE
            i, j = i[sure], j[sure]
            shared = own[i] == other[j]
            keep = shared.argmax(axis=1) == group
            out_i.append(i[keep])
            out_j.append(j[keep])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that links reach from each of n places."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    return label


def _task(plan_sent, dim: int):
    def run(table: pa.Table) -> pa.Table:
        plan = plan_sent.value
        group, bi, bj = (table.column(c)[0].as_py() for c in ("group", "bi", "bj"))
        block = table.column("block").to_numpy()
        rep = table.column("rep").combine_chunks()
        many = table.column("times").to_numpy()
        unit = _units(table.column("embedding"), dim)
        a = np.flatnonzero(block == bi)
        b = a if bi == bj else np.flatnonzero(block == bj)
        i, j = links(unit[a], unit[b], plan, group, bi == bj)
        i, j = a[i], b[j]
        count = np.bincount(i, weights=many[j], minlength=len(block)) + np.bincount(j, weights=many[i], minlength=len(block))
        # places in the order of their ids, so that the smallest place is the smallest id
        order = pc.array_sort_indices(rep).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = order[forest(len(order), rank[i], rank[j])][rank]
        used = np.flatnonzero(count > 0)
        return pa.table({"rep": rep.take(pa.array(used)), "n": pa.array(count[used].astype(np.int64)),
                         "root": rep.take(pa.array(root[used]))})
    return run


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    spark = prepare(vectors.sparkSession)
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
            .filter("id is not null").groupBy("id").agg(F.min("embedding").alias("embedding")))
    limit = float("inf")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)) | ~F.exists("embedding", lambda x: x != 0)
    good = rows.filter(F.col("embedding").isNotNull() & ~bad)
    kind = dict(rows.dtypes)["id"]
    alike = staged(good.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("times")), "vectors")
    member = good.join(alike, "embedding").select("id", "rep", "times")
    sizes = [r[0] for r in alike.select(F.size("embedding").alias("d")).distinct().collect()]
    counts, roots = [], []
    for dim in sizes:                                        # vectors of different lengths never link
        own = alike.filter(F.size("embedding") == dim)
        plan = Plan(own.count(), dim)
        sent = spark.sparkContext.broadcast(plan)

        def celled(batches, sent=sent, dim=dim):
            for batch in batches:
                if batch.num_rows:
                    cells = sent.value.cells(_units(column_ids(batch, "embedding"), dim)).view(np.int64)
                    n, g = cells.shape
                    yield pa.RecordBatch.from_arrays(
                        [column_ids(batch, "rep").take(pa.array(np.repeat(np.arange(n), g))),
                         pa.array(np.tile(np.arange(g, dtype=np.int32), n)), pa.array(cells.reshape(-1))], ["rep", "group", "cell"])
        cells = staged(own.mapInArrow(celled, f"rep {kind}, group int, cell long"), "cells")
        full = cells.groupBy("group", "cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn(
            "blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        placed = cells.join(full, ["group", "cell"]).withColumn(
            "block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
        # block b meets every block: as the first of the pair, or as the second
        placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "rep", "group", "cell", "block", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"))
        found = staged(placed.join(own, "rep").groupBy("group", "cell", "bi", "bj").applyInArrow(
            _task(sent, dim), f"rep {kind}, n long, root {kind}"), "counts")
        counts.append(found.groupBy("rep").agg(F.sum("n").alias("n")))
        roots.append(found.filter("rep <> root").select("rep", "root").distinct())
    out = rows.select("id").join(member, "id", "left")
    if not counts:
        return out.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                          F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n, root = counts[0], roots[0]
    for x, y in zip(counts[1:], roots[1:]):
        n, root = n.unionByName(x), root.unionByName(y)
    # equal vectors under different ids hang on their smallest id
    comp = components(root, "rep", "root", "vectors").select(F.col("id").alias("rep"), "component")
    return (out.join(n, "rep", "left").join(comp, "rep", "left")
            .select(F.col("id").alias(id_col),
                    (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).cast("long").alias("n_links"),
                    F.coalesce("component", "rep", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))
