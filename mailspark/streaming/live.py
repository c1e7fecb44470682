"""Live scoring (St3) as Structured Streaming.

Stream of API messages in the inbox -> exclusions in the reference's order:
already checkpointed (J5: by the rows given and by this sink's own), sender is
a contact (J1), Reference label, thread already replied to (J2: by the ids given
and by sent mail that the stream has seen) -> per micro-batch: sanitise (HTML stripped: Q14) -> every
model (J12) -> batched classifier (D3) -> parse (F7) -> unanimous vote (A27)
-> action label (F17).

The sink is ``foreachBatch`` with a write-ahead order (K8): the checkpoint /
audit rows of a batch are written before its action rows, both as the
batch's own partition (``batch_id=<n>``, overwritten on replay), so a replayed
batch never duplicates output.  A dry run writes its actions (``applied=False``)
and no checkpoint, so the real run scores the same messages again; applying labels to a mailbox is outside Spark (remote side effects).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as TX
from ..operators import classify as K
from ..operators import score as SC
from ..sources import api as API
from ..sources.keys import KeyStore
from ..sources.lists import exists


# Labels of the mailbox API.
INBOX, SENT = "INBOX", "SENT"


def live_candidates(api: DataFrame, checkpointed: DataFrame, contacts: DataFrame,
                    replied_threads: DataFrame) -> DataFrame:
    """The exclusions, in order, against the lookup sides given."""
    m = API.api_to_messages(api).where(F.array_contains("label_ids", INBOX))
    m = m.join(checkpointed.select("message_id").distinct(), "message_id", "left_anti")
    m = m.join(contacts.select(F.lower(F.trim("email")).alias("from_email")).distinct(), "from_email", "left_anti")
    m = m.where(~F.col("has_reference"))
    m = m.join(replied_threads.select("thread_id").distinct(), "thread_id", "left_anti")
    return m


def score_batch(batch: DataFrame, models: list[str], fn, system_prompt: str, version: str) -> DataFrame:
    """One micro-batch: turns -> classifier -> votes -> action labels."""
    turns = batch.select("message_id", TX.build_user_turn(
        "from_email", "from_name", "subject", "date_str", TX.sanitize("body_text", True)).alias("user_turn"))
    raw = SC.classify(K.fan_out(turns, models), fn, system_prompt, version, models=models)
    scored = SC.parse_scored(raw)
    votes = K.vote(scored)
    return votes.withColumn("action_label", C.action_label("vote"))


_CHECKPOINT = "ts string, category string, message_id string, label string, prompt_version string, batch_id long"
Side = DataFrame | Callable[[], DataFrame]


def _now(side: Side) -> DataFrame:
    """A lookup side as it is now: a function is asked anew for every batch, so that a changed file counts."""
    return side() if callable(side) else side


def _state(spark: SparkSession, path: str, batch_id: int, start: Callable[[], DataFrame | None]) -> KeyStore:
    """A set of keys that the stream keeps (see ``sources.keys``); ``start`` gives those of an older run without it.

    What a stopped try of this batch has left is dropped: the batch is done again.
    """
    store = KeyStore(spark, path, buckets=16)
    if not exists(spark, path + "/committed"):
        keys = start()
        if keys is not None:
            store.commit(store.write("start", keys.select("key").where("key IS NOT NULL").distinct()))
    store.forget(f"0-batch{batch_id}")
    store.recover(lambda: None)
    store.merge()
    return store


def _add(store: KeyStore, batch_id: int, keys: DataFrame) -> None:
    store.commit(store.write(f"batch{batch_id}", keys.where("key IS NOT NULL").distinct()))


def live_sink(out_dir: str, models: list[str], fn, system_prompt: str, version: str, checkpointed: Side, contacts: Side,
              replied_threads: Side, dry_run: bool = True):
    """Micro-batch sink over API messages.

    The stream keeps two sets of its own under ``out_dir``: the messages it
    has scored, and the threads in which it has seen sent mail.  A batch reads
    only the parts of them that may hold its keys, never the audit history.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        audit_dir = out_dir + "/audit"
        replied = _state(spark, out_dir + "/replied", batch_id, lambda: None)
        scored = _state(spark, out_dir + "/scored", batch_id, lambda: spark.read.schema(_CHECKPOINT).json(audit_dir)
                        .where(F.col("batch_id") != batch_id).select(F.col("message_id").alias("key")) if exists(spark, audit_dir) else None)
        sent = (API.api_to_messages(batch).where(F.array_contains("label_ids", SENT))
                .select(F.col("thread_id").alias("key")).where("key IS NOT NULL").distinct())
        _add(replied, batch_id, sent.join(replied.known(sent), "key", "left_anti"))
        cands = live_candidates(batch, _now(checkpointed), _now(contacts), _now(replied_threads)).persist()
        done = scored.known(cands.select(F.col("message_id").alias("key")).where("key IS NOT NULL").distinct())
        answered = replied.known(cands.select(F.col("thread_id").alias("key")).where("key IS NOT NULL").distinct())
        fresh = (cands.join(done.withColumnRenamed("key", "message_id"), "message_id", "left_anti")
                 .join(answered.withColumnRenamed("key", "thread_id"), "thread_id", "left_anti"))
        res = score_batch(fresh, models, fn, system_prompt, version).cache()
        ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        audit = res.select(ts.alias("ts"), F.lit("ai_classify").alias("category"), "message_id",
                           F.col("action_label").alias("label"), F.lit(version).alias("prompt_version"),
                           F.lit(batch_id).alias("batch_id"))
        if not dry_run:
            (audit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                  .partitionBy("batch_id").json(audit_dir))
            _add(scored, batch_id, res.select(F.col("message_id").alias("key")))
        actions = res.select("message_id", "vote", "action_label", F.lit(not dry_run).alias("applied"),
                             F.lit(batch_id).alias("batch_id"))
        (actions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(out_dir + "/actions"))
        for df in (res, cands, batch):
            df.unpersist()
    return run


def start_live(spark: SparkSession, api_dir: str, out_dir: str, checkpoint: str, checkpointed: Side,
               contacts: Side, replied_threads: Side, models: list[str], fn, system_prompt: str,
               version: str, dry_run: bool = True, trigger_once: bool = False):
    """Start live scoring; returns the StreamingQuery.

    The three lookup sides are DataFrames, or functions that give one and are
    asked again for every batch (``lambda: read_contacts(spark, path)``).
    """
    stream = spark.readStream.schema(API.API_SCHEMA).json(api_dir)
    w = stream.writeStream.foreachBatch(live_sink(out_dir, models, fn, system_prompt, version, checkpointed, contacts,
                                                  replied_threads, dry_run)).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
