"""Streaming ingest (St1) and streaming dedup (St2).

``readStream.format("mbox")`` emits raw messages by byte offset (the
checkpoint replaces the reference's import ledger).  Each micro-batch is
parsed, de-duplicated inside the batch (K1) and anti-joined against what the
target table already holds (by message id, and by (path, offset) for rows
without an id), then appended: a restart or a replayed batch never
duplicates a message.  What the target holds is asked of the key store beside
it (``sources.keys``), of which a batch reads only what may hold its keys; the
target itself is read only after an append that was stopped.

Exact streaming deduplication without a table (St2) keeps each id as keyed
state for a time limit (``first_messages``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import checkpoint_dir
from ..sources import mbox as MB
from ..sources import parse as P
from ..sources.keys import KeyStore, message_key
from ..sources.lists import exists


def key_store(spark: SparkSession, target: str) -> KeyStore:
    """The key store beside a target table, filled from the table if that is older than its store."""
    path = target.rstrip("/") + "_keys"
    fresh = not exists(spark, path + "/committed")
    store = KeyStore(spark, path)
    if fresh and exists(spark, target):
        store.commit(store.write("table", _table_keys(spark, target).distinct()))
    return store


def _table_keys(spark: SparkSession, target: str) -> DataFrame | None:
    return spark.read.parquet(target).select(message_key().alias("key")) if exists(spark, target) else None


def append_new(spark: SparkSession, rows: DataFrame, target: str, name: str) -> DataFrame:
    """K1 against a stored table: append the rows whose keys the table lacks.  Returns them.

    The chosen rows are staged, the store takes their keys, the table its
    rows, and then the keys count; a run that stops in between is settled by
    the next (``KeyStore.recover``).
    """
    store = key_store(spark, target)
    store.recover(lambda: _table_keys(spark, target))
    own = P.dedup_messages(rows).withColumn("key", message_key())
    known = store.known(own.select("key"))
    chosen = checkpoint_dir(spark, f"ingest-{uuid.uuid4().hex}")
    fresh = own.join(known, "key", "left_anti")
    fresh.write.parquet(chosen)
    fresh = spark.read.schema(fresh.schema).parquet(chosen)
    full = store.write(f"{name}-{uuid.uuid4().hex}", fresh.select("key").distinct())
    fresh = fresh.drop("key").select(*rows.columns)
    P.write_messages(fresh, target, "append")
    store.commit(full)
    store.merge()
    return fresh


def ingest_batch(spark: SparkSession, target: str, quarantine: str | None = None, parsed_input: bool = False):
    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = P.with_derived_columns(batch) if parsed_input else P.parse_messages(batch)
        good, bad = P.split_parsed(parsed)
        good = good.persist()
        append_new(batch.sparkSession, good, target, f"batch{batch_id}")
        good.unpersist()
        if quarantine:
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(quarantine)
    return run


def ingest_stream(spark: SparkSession, source_path: str, target: str, checkpoint: str,
                  quarantine: str | None = None, eof_complete: bool = False, split_size: int = MB.DEFAULT_SPLIT,
                  parse_in_reader: bool = True):
    """Start the ingest stream; returns the StreamingQuery.

    A file's last message comes with the next trigger that finds the file
    unchanged.  By default the reader parses messages as it reads them (no raw bytes
    through the JVM); ``parse_in_reader=False`` ships raw messages to the
    Arrow parse job instead.
    """
    MB.register(spark)
    raw = (spark.readStream.format("mbox").option("path", source_path)
           .option("splitSize", str(split_size)).option("eofComplete", str(eof_complete).lower())
           .option("parse", str(parse_in_reader).lower()).load())
    return (raw.writeStream.foreachBatch(ingest_batch(spark, target, quarantine, parse_in_reader))
               .option("checkpointLocation", checkpoint).start())


def dedup_within_watermark(stream: DataFrame, ts_col: str = "ts", delay: str = "7 days") -> DataFrame:
    """St2 (bounded-state variant): drop repeated message ids seen within the watermark delay."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["message_id"])


class _FirstOfKey(StatefulProcessor):
    """Lets the first row of a key pass, and remembers the key for a time limit."""

    def __init__(self, limit_ms: int):
        self._limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "at long", self._limit)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = None
        new = not self._seen.exists()
        for batch in rows:                                   # a key's rows of one trigger, in any order
            if new and len(batch):
                own = batch.sort_values(["path", "mbox_offset"], kind="stable").head(1)
                best = own if best is None else pd.concat([best, own]).sort_values(["path", "mbox_offset"], kind="stable").head(1)
        if best is not None:
            self._seen.update((1,))
            yield best.drop(columns="key")

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_messages(stream: DataFrame, limit_ms: int = 0) -> DataFrame:
    """St2, exact: the first row of each message key (first file and offset within a trigger), over all triggers.

    The keys seen are keyed state (RocksDB), spread over the executors, and
    travel with the query's checkpoint: a restart goes on where it was.  A key
    is forgotten ``limit_ms`` after it was first seen; 0 keeps it for good.
    Rows without an id are keyed by place and content.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = stream.withColumn("key", message_key())
    return keyed.groupBy("key").transformWithStateInPandas(
        _FirstOfKey(limit_ms), stream.schema, "Append", "ProcessingTime" if limit_ms else "None")


_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _ledger_rows(spark: SparkSession, rows: list[dict], ledger_path: str) -> None:
    """Append ledger rows; ids ascend over runs (microseconds, then the row's number), so "latest" has no ties."""
    import time

    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), _STAMP).alias("t")).first()["t"]
    base = time.time_ns() // 1000 * 1000
    data = [(base + i, r["path"], r["size"], r["offset"], r["seen"], r["new"], r.get("started") or stamp, stamp,
             stamp if r["offset"] >= r["size"] else None) for i, r in enumerate(rows)]
    schema = P.LEDGER_SCHEMA.replace("messages_imported long,", "messages_imported long, messages_new long,")
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(ledger_path)


def ingest_files(spark: SparkSession, source_path: str, target: str, ledger_path: str | None = None,
                 quarantine: str | None = None, split_size: int = MB.DEFAULT_SPLIT, wave_bytes: int = 64 << 30) -> dict:
    """Batch ingest (S1 -> S2 -> K1 -> table, K2 ledger).

    Files go in waves of about ``wave_bytes`` bytes.  A wave is parsed once
    into a staged table in the shared folder, what the target lacks is
    appended, unparseable messages are quarantined, and each file's ledger row
    is written: how far it is read, messages seen and messages new, and when it
    was completed.  A later run reads the ledger, leaves completed files
    alone and takes up the others where their last row ends; a file whose size
    changed is read anew.  Returns the counts of this run.
    """
    left = []
    state: dict[tuple[str, int], dict] = {}
    if ledger_path and exists(spark, ledger_path):
        rows = spark.read.parquet(ledger_path)
        for r in P.update_ledger(rows.limit(0), rows).collect():          # a row a file
            state[r["mbox_path"], r["mbox_size_bytes"]] = {
                "offset": r["last_offset"], "seen": r["messages_imported"], "new": r["messages_new"], "started": r["started_at"]}
    for path, size in MB.list_files(source_path):
        at = state.get((path, size), {}).get("offset", 0)
        if at < size:
            left.append([path, size, at])
    counts = {"seen": 0, "new": 0, "quarantined": 0}
    while left:
        ranges, room, rest = [], wave_bytes, []
        for path, size, at in left:
            if room <= 0:
                rest.append([path, size, at])
                continue
            stop = min(size, at + room)
            ranges.append([path, at, stop])
            room -= stop - at
            if stop < size:
                rest.append([path, size, stop])
        sizes = {path: size for path, size, _ in left}
        staged = checkpoint_dir(spark, f"ingest-{uuid.uuid4().hex}")
        P.read_parsed(spark, source_path, split_size, ranges=ranges).write.parquet(staged)
        good, bad = P.split_parsed(spark.read.parquet(staged))
        fresh = append_new(spark, good, target, "wave")
        n_bad = bad.count()
        if quarantine and n_bad:
            bad.write.mode("append").parquet(quarantine)
        per_file = {r["path"]: r["n"] for r in good.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
        per_new = {r["path"]: r["n"] for r in fresh.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {"seen": counts["seen"] + sum(per_file.values()), "new": counts["new"] + sum(per_new.values()),
                  "quarantined": counts["quarantined"] + n_bad}
        out = []
        for path, _, stop in ranges:
            own = state.setdefault((path, sizes[path]), {"seen": 0, "new": 0, "started": None})
            own.update(offset=stop, seen=own["seen"] + per_file.get(path, 0), new=(own["new"] or 0) + per_new.get(path, 0))
            out.append({"path": path, "size": sizes[path], **own})
        if ledger_path:
            _ledger_rows(spark, out, ledger_path)
        left = rest
    return counts
