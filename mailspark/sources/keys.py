"""Which messages a table has: a narrow store of their keys, so that an append need not read the table (K1, St1).

A message's key is its id, or without one its place and content.  Keys are
dealt into buckets by hash.  Every append adds a batch: its keys, in a folder a
bucket, and a Bloom filter of each bucket's keys.  Looking up a batch of new
keys reads the filters of its buckets, and then only those key folders whose
filter lets one of its keys through: few, as most mail is new.  Batches of one
level are merged into one of the next when there are ``MERGE`` of them, so the
number of filters a bucket has grows with the logarithm of the appends.

A batch counts once it is committed, which is done after the table's own
append.  What a stopped append has left uncommitted is settled before the next
one: those of its keys that have reached the table are kept, the rest goes.
The store is a set, so merging twice or half way changes nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import ship_package

BUCKETS = 256
#: Bits a key in a filter, and how many of them a key sets: 1 of 1,000 unknown keys passes.
BITS, PROBES = 16, 6
#: Batches of one level that are merged.
MERGE = 16


def message_key() -> Column:
    """A message's key: by id, or by place and content (an id starts with 'i', a place with 'p')."""
    content = F.xxhash64("headers_json", "body_text", "mbox_size").cast("string")
    return F.when(F.col("message_id").isNotNull(), F.concat(F.lit("i"), "message_id")).otherwise(
        F.concat_ws("\u0000", F.lit("p"), "path", F.col("mbox_offset").cast("string"), content))


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Places of each key's bits in a filter of ``bits`` (a power of two)."""
    step = h2.view(np.uint64) | np.uint64(1)
    return ((h1.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def make_filter(h1: np.ndarray, h2: np.ndarray) -> bytes:
    bits = max(64, 1 << (BITS * max(len(h1), 1) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[_places(h1, h2, bits)] = True
    return np.packbits(held, bitorder="little").tobytes()


def may_hold(own: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    held = np.frombuffer(own, np.uint8)
    at = _places(h1, h2, 8 * len(held))
    return (held[at >> 3] >> (at & 7) & 1).astype(bool).all(axis=1)


def _filters(name: str):
    def run(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        return pa.table({"bucket": table.column("bucket")[:1], "name": [name], "bits": pa.array([make_filter(h1, h2)], pa.binary())})
    return run


def _candidates(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Which keys of one bucket may be in which batch."""
    h1, h2 = (keys.column(c).to_numpy() for c in ("h1", "h2"))
    out = []
    for name, bits in zip(filters.column("name").to_pylist(), filters.column("bits").to_pylist()):
        hit = np.flatnonzero(may_hold(bits, h1, h2))
        if len(hit):
            own = keys.select(["key", "bucket"]).take(pa.array(hit))
            out.append(own.append_column("name", pa.array([name] * len(hit))))
    return pa.concat_tables(out) if out else pa.table({"key": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()),
                                                       "name": pa.array([], pa.string())})


class KeyStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        ship_package(spark)
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        p = self._p(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _keyed(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket"),
                           F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"))

    # ------------------------------------------------------------- lookup
    def batches(self) -> list[str]:
        """Committed batches; a name starts with its level."""
        return self._names("committed")

    def maybe(self, keys: DataFrame) -> DataFrame:
        """(key, bucket, name): batches that may hold a key, by the filters of the keys' buckets."""
        live = self.batches()
        if not live:
            return self.spark.createDataFrame([], "key string, bucket int, name string")
        filters = self.spark.read.schema("bucket int, name string, bits binary").parquet(*[f"{self.path}/filters/{n}" for n in live])
        return (self._keyed(keys).groupBy("bucket").cogroup(filters.groupBy("bucket"))
                .applyInArrow(_candidates, "key string, bucket int, name string"))

    def stored(self, places: list[tuple[str, int]]) -> DataFrame:
        """Keys of some (batch, bucket) folders, and no others."""
        if not places:
            return self.spark.createDataFrame([], "key string")
        return self._read(*[f"{n}/bucket={b}" for n, b in places])

    def _read(self, *folders: str) -> DataFrame:
        # the folders are named one by one, so Spark need not learn their bucket from their names
        return self.spark.read.schema("key string").option("recursiveFileLookup", "true").parquet(*[f"{self.path}/keys/{f}" for f in folders])

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (one column, ``key``) that a committed batch holds."""
        none = self.spark.createDataFrame([], "key string")
        if not self.batches():
            return none
        maybe = self.maybe(keys).persist()
        try:
            # at most a folder a batch and bucket
            places = [(r["name"], r["bucket"]) for r in maybe.select("name", "bucket").distinct().collect()]
            if not places:
                return none
            out = maybe.select("key").distinct().join(self.stored(sorted(places)), "key", "left_semi")
            from ..session import checkpoint_dir

            path = checkpoint_dir(self.spark, f"known-{uuid.uuid4().hex}")
            out.write.parquet(path)
        finally:
            maybe.unpersist()
        return self.spark.read.schema("key string").parquet(path)

    # ------------------------------------------------------------- append
    def write(self, name: str, keys: DataFrame, level: int = 0) -> str:
        """Store a batch's keys and filters; it counts after ``commit``.  Returns its full name."""
        full = f"{level}-{name}"
        keyed = self._keyed(keys)
        (keyed.select("key", "bucket").repartition("bucket").sortWithinPartitions("bucket", "key")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/{full}"))
        (keyed.groupBy("bucket").applyInArrow(_filters(full), "bucket int, name string, bits binary")
         .write.mode("overwrite").parquet(f"{self.path}/filters/{full}"))
        return full

    def commit(self, full: str) -> None:
        self._fs.create(self._p(f"committed/{full}"), True).close()

    def _drop(self, full: str) -> None:
        for folder in ("committed", "keys", "filters"):      # first it no longer counts
            self._fs.delete(self._p(f"{folder}/{full}"), True)

    def forget(self, full: str) -> None:
        """Drop a batch, as before it is written again."""
        if full in self._names("keys"):
            self._drop(full)

    def recover(self, table_keys) -> None:
        """Settle what a stopped append has left; ``table_keys()`` gives the keys that the table has."""
        left = [n for n in self._names("keys") if n not in set(self.batches())]
        for full in left:
            keys = self._read(full) if self._fs.exists(self._p(f"keys/{full}/_SUCCESS")) else None
            own = table_keys() if keys is not None else None
            if own is not None:                              # its folder is rewritten under a name of its own
                self.commit(self.write(f"recovered-{uuid.uuid4().hex}", own.join(keys, "key", "left_semi").distinct()))
            self._drop(full)

    def merge(self) -> None:
        """Merge the batches of a level into one of the next where there are enough of them."""
        level = 0
        while True:
            own = [n for n in self.batches() if n.startswith(f"{level}-")]
            if not any(int(n.split("-")[0]) >= level for n in self.batches()):
                return
            if len(own) >= MERGE:
                keys = self._read(*own).distinct()
                self.commit(self.write(uuid.uuid4().hex, keys, level + 1))
                for n in own:
                    self._drop(n)
            level += 1
