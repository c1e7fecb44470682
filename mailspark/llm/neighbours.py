"""Nearest neighbours by inner product over learned partitions.

A bounded sample of the vectors is joined to a graph, each vector with its
nearest ones.  The graph is cut into parts of equal size with few edges
between them: a first cut by medians, then rounds in which vectors move to the
part that holds most of their neighbours, as far as parts have room.  A small
network learns, from a vector, which parts hold its neighbours.  It places
every row of the table in its likeliest part, and routes a query to its
likeliest parts, until they hold a share ``mass`` of the probability; the rows
of those parts are scored exactly.

``mass`` is measured, not chosen: on sample vectors that neither the graph nor
the network has seen it is the least that finds ``RECALL`` of the true
neighbours.  Vectors without any structure need many parts, at worst all,
where the search is exact; so it is in a table of one part.

Equal vectors are scored once, with their smallest ids (no answer can need
more than ``k`` + 1 of them).  The rows of a part are dealt into blocks and so
are its queries; two blocks meet in one task, which returns its best ``k`` + 1
of each query, and windows merge those lists.  A query goes to its ``FIRST``
likeliest parts first; the other parts return only what is no worse than the
last of the ``k`` + 1 found there.  The sample, the network and one count a
part are all that the driver sees.

Cases: vectors that are null, empty, zero or hold null or non-finite values
take no part, nor do rows without an id; equal rows are one row; rows that
share an id but not the vector are rows of their own, and a query leaves out
its own row only; vectors of different lengths are searched apart; ties go to
the smaller id; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import ids as column_ids
from .base import prepare, staged

K = 20
#: Rows whose id is divisible by this are the queries.
EVERY = 20
#: Most vectors that the graph and the network are fitted on.
SAMPLE = 16_384
#: Sample vectors kept from the fit, to measure recall on.
HELD_OUT = 1024
RECALL = 0.96
#: Vectors that a part should hold, and sample vectors that a part needs at least.
FILL, LEAST = 500, 64
#: Edges of a vector in the graph.
EDGES = 20
#: A part may be larger than the mean by this share.
SLACK = 0.05
HIDDEN, EPOCHS, RATE = 128, 12, 3e-3
#: Parts that a query is sent to first, for a bound on its answers.
FIRST = 4
#: Rows, and queries, of one block.
ROWS, QUERIES = 8192, 2048
_SEED = 20240613


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first value to the last."""
    out = np.zeros(len(left))
    for j in range(left.shape[1]):
        out += left[:, j] * right[:, j]
    return out


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` largest inner products of each query, with all that may tie with the last.

    bound: least score that each query asks for.
    """
    out = []
    scale = np.abs(rows).max(initial=0.0) * np.abs(queries).max(initial=0.0) * rows.shape[1]
    for a in range(0, len(queries), 256):
        s = queries[a:a + 256] @ rows.T
        if k < s.shape[1]:
            last = np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], bound[a:a + 256])
        else:
            last = bound[a:a + 256]
        q, r = np.nonzero(s >= last[:, None] - 1e-12 * scale)
        out.append((q + a, r))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, r = (np.concatenate(x) for x in zip(*out))
    score = exact(queries[q], rows[r])
    keep = score >= bound[q]
    return q[keep], r[keep], score[keep]


def graph(x: np.ndarray, edges: int = EDGES) -> np.ndarray:
    """Indexes of the ``edges`` nearest others of each vector."""
    edges = min(edges, len(x) - 1)
    out = np.empty((len(x), edges), np.int32)
    for a in range(0, len(x), 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(s, s.shape[1] - edges, axis=1)[:, s.shape[1] - edges:]
    return out


def _medians(x: np.ndarray, parts: int, rng) -> np.ndarray:
    """A first balanced cut: halves along the widest of a few directions, again and again."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        own, first, n = todo.pop()
        if n == 1:
            label[own] = first
            continue
        y = x[own] - x[own].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(4):                                   # towards the first principal direction
            d = y.T @ (y @ d)
            d /= np.linalg.norm(d) or 1.0
        left = n // 2
        order = np.argsort(y @ d, kind="stable")
        cut = len(own) * left // n
        todo += [(own[order[:cut]], first, left), (own[order[cut:]], first + left, n - left)]
    return label


def balanced_parts(near: np.ndarray, label: np.ndarray, parts: int, rounds: int = 10) -> np.ndarray:
    """Parts of the graph with fewer edges between them; none above its room."""
    n = len(label)
    room = math.ceil(n / parts * (1 + SLACK))
    a = np.repeat(np.arange(n), near.shape[1])
    b = near.reshape(-1)
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    label = label.copy()
    for turn in range(rounds):
        held = np.bincount(ends * parts + label[others], minlength=n * parts).reshape(n, parts).astype(np.int32)
        own = held[np.arange(n), label]
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - own
        wish = np.flatnonzero(gain > 0)
        if not len(wish):
            break
        wish = wish[np.argsort(-gain[wish], kind="stable")]
        if turn % 2:                                         # every other round moves half of them, so that pairs don't trade places
            wish = wish[::2]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in wish:
            to = best[i]
            if size[to] < room:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Probability of each part from a vector: one hidden layer."""

    def __init__(self, dim: int, parts: int, scale: float):
        rng = np.random.default_rng(_SEED)
        self.scale = scale
        self.parts = parts
        self.w = [rng.standard_normal((dim, HIDDEN)) * math.sqrt(2 / dim), np.zeros(HIDDEN),
                  rng.standard_normal((HIDDEN, parts)) * math.sqrt(1 / HIDDEN), np.zeros(parts)]

    def _layers(self, x: np.ndarray):
        h = np.maximum(x / self.scale @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return h, p / p.sum(axis=1, keepdims=True)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[1]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The likeliest part of each row."""
        return np.concatenate([self.chances(x[a:a + 4096]).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def fit(self, x: np.ndarray, target: np.ndarray) -> None:
        """Minibatch descent (Adam) on the cross entropy against ``target``, a distribution over parts a row."""
        rng = np.random.default_rng(_SEED + 1)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 128):
                i = order[a:a + 128]
                h, p = self._layers(x[i])
                dz = (p - target[i]) / len(i)
                dh = (dz @ self.w[2].T) * (h > 0)
                grad = [(x[i] / self.scale).T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * math.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for w, g, m1, v1 in zip(self.w, grad, m, v):
                    m1 += 0.1 * (g - m1)
                    v1 += 0.001 * (g * g - v1)
                    w -= rate * m1 / (np.sqrt(v1) + 1e-8)

    def routes(self, x: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, place): the likeliest parts of each row that together hold ``mass``, from place 0 on."""
        p = self.chances(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        q, rank = np.nonzero(before < mass)
        return q, order[q, rank], rank


def learn(x: np.ndarray, parts: int, k: int = K, recall: float = RECALL) -> tuple[Router, float]:
    """Router over ``parts`` and the probability mass that finds ``recall`` of the neighbours of vectors it has not seen."""
    rng = np.random.default_rng(_SEED + 2)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    router = Router(x.shape[1], parts, scale)
    if parts == 1:
        return router, 1.0
    order = rng.permutation(len(x))
    out = min(HELD_OUT, len(x) // 8)
    test, seen = order[:out], order[out:]
    known = x[seen]
    near = graph(known)
    label = balanced_parts(near, _medians(known, parts, rng), parts)
    n = len(known)
    target = np.bincount(np.repeat(np.arange(n), near.shape[1]) * parts + label[near.reshape(-1)], minlength=n * parts).reshape(n, parts)
    target = target + np.eye(parts)[label]
    router.fit(known, target / target.sum(axis=1, keepdims=True))
    # what share of the probability must be searched: measured on the vectors kept apart
    place = router.place(x)
    p = router.chances(x[test])
    rank = np.argsort(-p, axis=1, kind="stable")
    sorted_p = np.take_along_axis(p, rank, axis=1)
    before = np.empty_like(p)                                # probability of the parts that come before a part
    np.put_along_axis(before, rank, np.cumsum(sorted_p, axis=1) - sorted_p, axis=1)
    s = x[test] @ x.T
    s[np.arange(out), test] = -np.inf
    true = np.argpartition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k:] if k < len(x) else np.tile(np.arange(len(x)), (out, 1))
    needed = np.sort(before[np.arange(out)[:, None], place[true]].reshape(-1))
    at = needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]
    return router, float(np.nextafter(at, 2))                # a part is searched if less than this comes before it


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _expanded(names: pa.Array, digests: pa.Array, picked: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """All ids of the picked rows: (which pick, id, digest)."""
    lists = names.take(pa.array(picked))
    which = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return which, lists.flatten(), digests.take(pa.array(picked[which]))


def _search(dim: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        a, b = np.flatnonzero(asked), np.flatnonzero(~asked)
        vec = table.column("vec")
        x = _matrix(vec, dim)
        q, r, score = nearest(x[a], x[b], k, table.column("bound").to_numpy()[a])
        names = table.column("ids").combine_chunks()
        digest = table.column("h").combine_chunks()
        first = names.values.to_numpy(zero_copy_only=False)[names.offsets.to_numpy()[:-1]] if pa.types.is_integer(names.type.value_type) else \
            np.argsort(np.argsort(np.array([v[0] for v in names.to_pylist()])))
        # the best k vectors of a query, then the best k of their ids
        order = np.lexsort((first[b[r]], -score, q))
        q, r, score = q[order], r[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        q, r, score = q[keep], r[keep], score[keep]
        which, name, own = _expanded(names, digest, b[r])
        q, score = q[which], score[which]
        rep = table.column("rep").combine_chunks()
        return pa.table({"rep": rep.take(pa.array(a[q])), "h": digest.take(pa.array(a[q])), "id": name, "id_h": own, "score": pa.array(score)})
    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding",
           fill: int = FILL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row whose id is divisible by ``every``."""
    spark = prepare(vectors.sparkSession)
    limit = float("inf")
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)) | ~F.exists(v, lambda x: x != 0)
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
            .filter(F.col("id").isNotNull() & v.isNotNull()).filter(~bad)
            .withColumn("h", F.xxhash64("vec")).distinct())
    kind = dict(rows.dtypes)["id"]
    top = Window.partitionBy("vec").orderBy("id")
    alike = staged(rows.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
                   .groupBy("vec", "h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                   .withColumn("rep", F.col("ids")[0]), "alike")
    # which distinct vector a query has; the same for equal queries
    asking = staged(rows.filter(F.col("id") % every == 0).join(alike.select("vec", "rep"), "vec").select("id", "h", "rep"), "asking")
    queries = alike.join(asking.select("rep", "h").distinct(), ["rep", "h"], "left_semi")
    found = None
    for dim in [r[0] for r in alike.select(F.size("vec").alias("d")).distinct().collect()]:
        own, ask = alike.filter(F.size("vec") == dim), queries.filter(F.size("vec") == dim)
        n = own.count()
        sample = _sample(own, n, dim)
        parts = max(1, min(math.ceil(n / fill), len(sample) // LEAST))
        sent = spark.sparkContext.broadcast(learn(sample, parts, k))

        def routed(batches, sent=sent, dim=dim, asked=False):
            router, mass = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(column_ids(batch, "vec"), dim)
                at, part, place = router.routes(x, mass) if asked else (np.arange(len(x)), router.place(x), np.zeros(len(x)))
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part.astype(np.int32)), pa.array(place.astype(np.int32))],
                                                 [*out.schema.names, "part", "place"])
        shape = f"vec {dict(own.dtypes)['vec']}, h long, ids array<{kind}>, rep {kind}, part int, place int"
        columns = ["vec", "h", "ids", "rep"]
        placed = staged(own.select(columns).mapInArrow(routed, shape), "placed")
        routes = staged(ask.select(columns).mapInArrow(lambda b, f=routed: f(b, asked=True), shape), "routes")
        low = F.lit(-math.inf)
        near = _best(_met(placed, routes.filter(F.col("place") < FIRST).withColumn("bound", low), dim, k + 1, kind), k + 1)
        if parts > FIRST:
            near = staged(near, "first")
            last = near.filter(F.col("n") == k + 1).select("rep", "h", F.col("score").alias("bound"))
            later = routes.filter(F.col("place") >= FIRST).join(last, ["rep", "h"], "left").withColumn("bound", F.coalesce("bound", low))
            near = _best(near.drop("n").unionByName(_met(placed, later, dim, k + 1, kind)), k + 1)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    found = staged(found, "nearest")
    pairs = (asking.withColumnRenamed("id", "query_id").join(found, ["rep", "h"])
             .filter((F.col("id") != F.col("query_id")) | (F.col("id_h") != F.col("h"))))
    mine = Window.partitionBy("query_id", "h").orderBy("n")
    return (pairs.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def _met(placed: DataFrame, routes: DataFrame, dim: int, k: int, kind: str) -> DataFrame:
    """rep, h, id, id_h, score of the best ``k`` rows of each block of a part for each query that is sent there."""
    sizes = (placed.groupBy("part").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("nr"))
             .join(routes.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")), "part"))
    sizes = F.broadcast(sizes)                               # one row a part, SAMPLE / LEAST at most
    block = F.pmod(F.xxhash64("rep", "h"), F.lit(1 << 30)).cast("int")
    columns = ["part", "rb", "qb", "asked", "bound", "vec", "h", "ids", "rep"]
    rows = (placed.join(sizes, "part").withColumn("rb", block % F.col("nr")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
            .withColumn("asked", F.lit(False)).withColumn("bound", F.lit(0.0)))
    asking = (routes.join(sizes, "part").withColumn("qb", block % F.col("nq"))
              .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("asked", F.lit(True)))
    return rows.select(columns).unionByName(asking.select(columns)).groupBy("part", "rb", "qb").applyInArrow(
        _search(dim, k), f"rep {kind}, h long, id {kind}, id_h long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rep", "h").orderBy(F.desc("score"), "id", "id_h")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def _sample(own: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most SAMPLE vectors, those of the least hashes: the same at every run."""
    if n > SAMPLE:
        share = min(1.0, (SAMPLE + 6 * math.sqrt(SAMPLE)) / n)   # a hash range that holds SAMPLE, all but surely
        own = own.filter(F.xxhash64("h", F.lit(_SEED)) <= F.lit(min(int(-(1 << 63) + share * (1 << 64)), (1 << 63) - 1)))
        own = own.orderBy(F.xxhash64("h", F.lit(_SEED)), "rep").limit(SAMPLE)
    t = own.select("rep", "h", "vec").orderBy("h", "rep").toArrow()
    return _matrix(t.column("vec"), dim) if t.num_rows else np.zeros((0, dim))
