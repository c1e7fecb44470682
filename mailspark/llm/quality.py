"""Quality classifier by supervised subword embeddings.

A document is the average of the learned vectors of its features: hashed words
(stretches without white space), a mark for a word that repeats the one before
it, and hashed character n-grams over the text's bytes.  A softmax over two
classes follows.  Vectors and output weights are trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents: of either label
the ``SAMPLE`` documents with the smallest hash of their id.  As the sample is
balanced, the score is moved by the log odds of all labels.

Output is linear in the average, so scoring needs one number a feature
(vector times weight difference) instead of its vector.

Learning reads labels only of ids whose crc32 mod 4 is not 2.  Labels,
language, source and id are never inputs of a score.

Cases: null and empty texts have no features and score by the label odds alone;
without labels the score is 0.5, with one class only it is that class's share;
rows that repeat an id are scored row by row; labels that contradict each
other count as 0; rows with a null id are scored (their remainder is null, so
held_out is false); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ids as column_ids
from .base import kept_rows, mix, prepare, text_slices
from .words import IS_SPACE, Words

#: Labelled documents of each class that training reads at most.
SAMPLE = 1000
BUCKETS = 1 << 18
DIM = 8
EPOCHS = 8
RATE = 0.5
NGRAMS = (2, 4)
THRESHOLD = 0.7
_REPEAT = 1                                                  # bucket of "same word as before"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row per kind, as (bucket, text) arrays."""
    w = Words(texts, ~IS_SPACE, lower=False)
    mask = np.uint64(BUCKETS - 1)
    h = w.hashes()
    out, doc = [(h & mask).astype(np.int32)], [w.doc]
    if len(h) > 1:
        same = np.flatnonzero((h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1
        out.append(np.full(len(same), _REPEAT, np.int32))
        doc.append(w.doc[same])
    d = w.data.astype(np.uint64)
    size = np.diff(w.offsets)
    of = np.repeat(np.arange(w.n_docs), size)
    left = np.repeat(w.offsets[1:], size) - np.arange(len(d))   # bytes of the text from here on, its end mark with them
    for n in NGRAMS:
        if len(d) < n:
            continue
        x = np.full(len(d) - n + 1, n, np.uint64)
        for j in range(n):
            x = (x * np.uint64(257)) + d[j:len(d) - n + 1 + j]
        x *= np.uint64(0x9E3779B97F4A7C15)
        own = left[:len(x)] >= n
        out.append((x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)[own])
        doc.append(of[:len(x)][own])
    return np.concatenate(out), np.concatenate(doc)


def logits(texts: pa.Array, value: np.ndarray) -> np.ndarray:
    """Mean value of each text's features (0 without any)."""
    bucket, doc = features(texts)
    n = np.bincount(doc, minlength=len(texts))
    total = np.bincount(doc, weights=value[bucket], minlength=len(texts))
    empty = np.diff(Words(texts, ~IS_SPACE, lower=False).first) == 0
    return np.where(empty, 0.0, total / np.maximum(n, 1))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> np.ndarray:
    """Value of each bucket after training on (label, buckets, weights) rows; weights of a row sum to 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, bucket, weight = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weight @ vectors[bucket]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            vectors[bucket] -= (rate * len(bucket) ** 0.5) * np.outer(weight, back).astype(np.float32)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)


def remainder(id_col: Column | str, n: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


class Model:
    """value: of each bucket; offset: log odds added to each score."""

    def __init__(self, value: np.ndarray, offset: float):
        self.value, self.offset = value, offset

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(logits(texts, self.value).astype(np.float64) + self.offset)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    prepare(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (remainder("id", 4) != 2))
             .groupBy("id").agg(F.min("label").alias("label")))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        odds = np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))
        return Model(np.zeros(BUCKETS, np.float32), float(odds))
    tops = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for k in (0, 1)]
    chosen = F.broadcast(tops[0].unionByName(tops[1]))       # 2 * SAMPLE ids at most

    def run(batches):
        for batch in batches:
            label = column_ids(batch, "label")
            for a, b, texts in text_slices(batch, "text"):
                bucket, doc = features(texts)
                found, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
                first = np.searchsorted(found, np.arange(b - a + 1) * BUCKETS)
                yield pa.RecordBatch.from_arrays([
                    column_ids(batch, "id").slice(a, b - a), label.slice(a, b - a),
                    pa.array([(found[x:y] % BUCKETS).astype("<i4").tobytes() for x, y in zip(first, first[1:])], pa.binary()),
                    pa.array([times[x:y].astype("<i4").tobytes() for x, y in zip(first, first[1:])], pa.binary())],
                    ["id", "label", "buckets", "times"])
    kind = dict(docs.dtypes)[id_col]
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
            .mapInArrow(run, f"id {kind}, label int, buckets binary, times binary").collect())
    data = []
    for r in sorted(rows, key=lambda r: (r["id"], r["buckets"])):
        times = np.frombuffer(r["times"], "<i4").astype(np.float32)
        if len(times):
            data.append((r["label"], np.frombuffer(r["buckets"], "<i4"), times / times.sum()))
    ones = sum(x[0] for x in data)
    if not 0 < ones < len(data):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(n[1] / n[0])))
    return Model(train(data), float(np.log(n[1] / n[0]) - np.log(ones / (len(data) - ones))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)               # BUCKETS numbers
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    [column_ids(batch, id_col).slice(a, b - a), pa.array(sent.value.score(texts), pa.float64())], ["id", "score"])
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 4) == 2, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; every row is judged by its own text, whatever its id."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))   # BUCKETS numbers
    return kept_rows(docs, "text", lambda: lambda texts: sent.value.score(texts) >= THRESHOLD)
