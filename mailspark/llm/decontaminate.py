"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every run of ten consecutive words of a benchmark item is a test string (an
item of fewer words, but not none, is one test string).  The strings are
searched in the documents' normalised bytes (words lower-cased and joined by
one space): a shift table over hashed blocks says how far a window may jump,
blocks that end some string select its bucket of strings, and a direct
comparison of the bytes confirms an occurrence.  Many text positions move at
once, each in its own stretch of the bytes, so numpy does the scanning.

The benchmark is read in blocks of a bounded number of bytes; each block is
one set of tables for one pass over the documents, so its size never decides
what a task holds.  What several passes found is joined by id and text, and
as many rows come out as went in.

Cases: null and empty texts have no words and are not contaminated; repeated
rows are answered (and dropped by ``clean``) row by row; a null id is kept; an item without an id is searched
like any other but has no place in the list of items; an empty benchmark leaves all
documents clean; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ids, kept_rows, prepare, text_slices
from .words import Words

WINDOW = 10
#: Bytes of benchmark text searched in one pass.
BLOCK_BYTES = 8 << 20
_SPACE, _END = 0x20, 0x01
#: Strings are searched in classes by length, so that one short string does not shorten all jumps.
CLASSES = (24, 8, 1)
_LANE = 1024


def normalised(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, their bytes with one byte between words, and the words' starts and ends in these."""
    w = Words(texts)
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    inside[w.starts] = 1
    inside[w.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    last = np.zeros(len(w.data), dtype=bool)
    last[w.offsets[1:] - 1] = True
    keep = inside | last
    keep[1:] |= inside[:-1]
    flat = np.where(inside, w.data, np.where(last, np.uint8(_END), np.uint8(_SPACE)))[keep]
    place = np.cumsum(keep) - 1
    # the byte after a word is always kept, so an end's place is where it was moved
    return w, flat, place[w.starts], place[w.ends]


class TestStrings:
    """The test strings of some benchmark items and their search tables."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = pa.array(["" if t is None else t for _, t in items], pa.string())
        strings: dict[bytes, set[int]] = {}
        sizes: dict[bytes, int] = {}
        if items:
            w, flat, starts, ends = normalised(texts)
            raw = flat.tobytes()
            for i in range(len(items)):
                a, b = int(w.first[i]), int(w.first[i + 1])
                n = min(window, b - a)
                for j in range(a, b - n + 1) if n else ():
                    s = raw[starts[j]:ends[j + n - 1]]
                    strings.setdefault(s, set()).add(i)
                    sizes[s] = n
        self.items = [None if k is None else str(k) for k, _ in items]
        self.groups = []
        top = 1 << 62
        for least in CLASSES:
            own = sorted(s for s in strings if least <= len(s) < top)
            top = least
            if own:
                self.groups.append(_Tables(own, [sorted(strings[s]) for s in own], [sizes[s] for s in own]))


class _Tables:
    def __init__(self, strings: list[bytes], items: list[list[int]], words: list[int]):
        self.strings, self.items = strings, items
        self.words = np.array(words)
        self.m = m = min(map(len, strings))
        self.block = b = min(8, m)
        self.bits = 22 if b == 8 else 16
        self.jump = m - b + 1
        heads = np.frombuffer(b"".join(s[:m] for s in strings), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << self.bits, min(self.jump, 255), np.uint8)
        for end in range(b, m + 1):                          # blocks that end earlier allow longer jumps
            np.minimum.at(self.shift, self.block_hash(heads[:, end - b:end]), min(m - end, 255))
        suffix = self.block_hash(heads[:, m - b:])
        order = np.argsort(suffix, kind="stable")
        self.bucket = order
        self.keys, first = np.unique(suffix[order], return_index=True)
        self.first = np.append(first, len(order))

    def block_hash(self, blocks: np.ndarray) -> np.ndarray:
        b = np.zeros((len(blocks), 8), np.uint8)
        b[:, :self.block] = blocks
        x = b.view("<u8")[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of all strings that occur between word ends."""
        n, m, b = len(flat), self.m, self.block
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.lib.stride_tricks.sliding_window_view(flat, b)
        begin = np.arange(0, n - m + 1, _LANE)               # window starts; each lane owns _LANE of them
        at, stop = begin.copy(), np.minimum(begin + _LANE, n - m + 1)
        places, buckets = [], []
        while len(at):
            h = self.block_hash(blocks[at + (m - b)])
            jump = self.shift[h].astype(np.int64)
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                k = np.searchsorted(self.keys, h[hit])
                k = np.minimum(k, len(self.keys) - 1)
                own = self.keys[k] == h[hit]
                places.append(at[hit][own])
                buckets.append(k[own])
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, bucket = np.concatenate(places), np.concatenate(buckets)
        edge = (place == 0) | (flat[np.maximum(place - 1, 0)] == _SPACE) | (flat[np.maximum(place - 1, 0)] == _END)
        place, bucket = place[edge], bucket[edge]
        raw = flat.tobytes()
        found_at, found = [], []
        for p, k in zip(place.tolist(), bucket.tolist()):
            for s in self.bucket[self.first[k]:self.first[k + 1]].tolist():
                text = self.strings[s]
                if raw.startswith(text, p) and raw[p + len(text)] in (_SPACE, _END):
                    found_at.append(p)
                    found.append(s)
        return np.array(found_at, np.int64), np.array(found, np.int64)


def scan(texts: pa.Array, tests: TestStrings) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """Words of each text, its hit stretches of words (merged, half open), and the items found in it."""
    w, flat, starts, _ = normalised(texts)
    mark = np.zeros(len(starts) + 1, np.int32)
    items: list[set[int]] = [set() for _ in range(len(texts))]
    for g in tests.groups:
        place, found = g.find(flat)
        if len(place):
            first = np.searchsorted(starts, place)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + g.words[found], -1)
            for d, s in set(zip(w.doc[first].tolist(), found.tolist())):
                items[d].update(g.items[s])
    hit = np.cumsum(mark[:-1]) > 0
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    if hit.any():
        # a stretch ends at its text's end too
        change = np.flatnonzero(hit & (np.append(True, ~hit[:-1]) | np.append(True, w.doc[1:] != w.doc[:-1])))
        until = np.flatnonzero(hit & (np.append(~hit[1:], True) | np.append(w.doc[1:] != w.doc[:-1], True))) + 1
        for a, b in zip(change.tolist(), until.tolist()):
            d = int(w.doc[a])
            spans[d].append((a - int(w.first[d]), b - int(w.first[d])))
    return w.counts, spans, items


SPANS = "spans array<struct<start:int,stop:int>>"


def _scanner(tests, id_col: str, text_col: str, key_col: str | None = None):
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        t = TestStrings(tests.value)
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                n, spans, items = scan(texts, t)
                key = [ids(batch, key_col).slice(a, b - a)] if key_col else []
                yield pa.RecordBatch.from_arrays([
                    *key, ids(batch, id_col).slice(a, b - a), pa.array(n, pa.int64()),
                    pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], span),
                    pa.array([sorted({t.items[i] for i in s} - {None}) for s in items], pa.list_(pa.string()))],
                    [*([key_col] if key_col else []), "id", "n_words", "spans", "items"])
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark's rows in lists of at most BLOCK_BYTES of text (a longer item alone)."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        n = len((r[1] or "").encode())
        if rows and size + n > BLOCK_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield rows


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: id, n_words, spans (hit stretches of words), items (ids of items found, sorted)."""
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_words long, {SPANS}, items array<string>"
    blocks = [spark.sparkContext.broadcast(rows) for rows in _blocks(benchmark, item_col, item_text_col)] or [spark.sparkContext.broadcast([])]
    if len(blocks) == 1:
        return docs.select(id_col, text_col).mapInArrow(_scanner(blocks[0], id_col, text_col), schema)
    # several passes: what they found for an id and text joins; rows alike in both come out as often as they were there
    keyed = docs.select(id_col, text_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("_llm_key"))
    out = None
    for rows in blocks:
        p = keyed.mapInArrow(_scanner(rows, id_col, text_col, "_llm_key"), f"_llm_key string, {schema}")
        out = p if out is None else out.unionByName(p)
    out = (out.groupBy("id", "_llm_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
                                             F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                                             (F.count("*") / len(blocks)).cast("long").alias("times")))
    return (out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
            .select("id", "n_words", "spans", "items"))


def n_hit(spans):
    """Words in the union of ``spans`` (which may overlap after several passes)."""
    s = F.array_sort(spans)
    state = F.aggregate(
        s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["upto"]))).cast("long").alias("n"),
            F.greatest(acc["upto"], x["stop"]).alias("upto")))
    return state["n"]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``find``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    f = find(docs, benchmark)
    hits = n_hit(F.col("spans"))
    return f.select(F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (hits > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; every row is judged by its own text, whatever its id.

    The benchmark's blocks filter one after another within one scan: no join, no shuffle.
    """
    spark = prepare(docs.sparkSession)

    def judge(tests):
        def start():
            t = TestStrings(tests.value)
            return lambda texts: [not s for s in scan(texts, t)[1]]
        return start
    for rows in _blocks(benchmark, item_col, item_text_col):
        docs = kept_rows(docs, "text", judge(spark.sparkContext.broadcast(rows)))
    return docs


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
