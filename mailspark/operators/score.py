"""Scoring pipeline (D3, D4, K4) and a native rule-based classifier.

Flow: messages -> scoring input (B4) -> user turn (F5/F6, native) -> x models
(J12, a generator) -> minus already scored (J4) -> classifier -> parse (F7,
native) -> valid rows (K3 upsert) / error rows (K4).

The classifier is a user-supplied function ``fn(model, system_prompt, turns)
-> list[str | None]`` run by ``mapInArrow``, or a factory ``fn(model)`` that a
task calls once and that returns ``call(system_prompt, turns)``.  Rows go to
(model, hash bucket) partitions by number, so a task has one model and loads
it once, while no model is a single hot task; a resource profile can be given
for that stage.

D4: each task counts consecutive hard errors (``None`` / exceptions).  A job
of its own (``classify``) fails after ``max_hard_errors`` of them.  In a corpus
pass (``scoring_run``) the task stops calling and ends well, so that no retry
calls again and all replies of the wave are kept; the driver then looks at the
whole pass and ends it.  J4 resumes from what is there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.predicates import category_is, sender_any, subject_any
from ..util import col, names, ship_package

CIRCUIT_BREAKER_THRESHOLD = 5
#: ``fn(model, system_prompt, turns)``, or with ``factory`` ``fn(model)`` that gives ``call(system_prompt, turns)``.
Responder = Callable[..., list] | Callable[[str], Callable[[str, list[str]], list]]

RAW_SCHEMA = "message_id string, model string, prompt_version string, raw_response string, error string"
RAW_COLUMNS = [c.split()[0] for c in RAW_SCHEMA.split(", ")]


def user_turns(m: DataFrame, strip_html: bool = False) -> DataFrame:
    """F5 + F6 over the scoring input: one user turn per message with an id."""
    body = F.col("body_text") if "body_text" in m.columns else F.lit(None).cast("string")
    date_str = F.col("date_str") if "date_str" in m.columns else F.lit(None).cast("string")
    return m.where(F.col("message_id").isNotNull()).select(
        F.col("message_id").cast("string").alias("message_id"),
        TX.build_user_turn(F.col("from_email"), F.col("from_name"), F.col("subject"), date_str,
                           TX.sanitize(body, strip_html)).alias("user_turn"))


class ErrorBudgetExceeded(RuntimeError):
    pass


def _replies(fn: Responder, model: str, system_prompt: str, turns: list[str]):
    """A reply or an exception for each turn.

    Turns go to the model in one call; if a call fails it is halved, down to
    single turns, so that one bad message costs no other its reply.
    """
    try:
        out = list(fn(model, system_prompt, turns))
        if len(out) != len(turns):
            raise ValueError(f"{len(out)} replies to {len(turns)} turns")
        yield from out
    except Exception as exc:  # noqa: BLE001 - a hard error of the responder
        if len(turns) == 1:
            yield exc
        else:
            half = len(turns) // 2
            yield from _replies(fn, model, system_prompt, turns[:half])
            yield from _replies(fn, model, system_prompt, turns[half:])


#: How the error of the row begins at which a task stopped calling.
SPENT = "error budget spent"


def _classify_partition(fn: Responder, system_prompt: str, version: str, max_hard_errors: int, factory: bool = False, stop: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streak, model, call = 0, None, None
        for batch in batches:
            if not batch.num_rows or streak >= max_hard_errors:   # what is left is read, not scored
                continue
            own = batch.column(1)
            if call is None:
                model = own[0].as_py()
                opened = fn(model) if factory else None
                call = (lambda _, prompt, turns: opened(prompt, turns)) if factory else fn
            if not pc.all(pc.equal(own, pa.scalar(model, own.type)), skip_nulls=False).as_py():
                raise ValueError("a task holds one model")
            raws, errs = [], []
            for r in _replies(call, model, system_prompt, batch.column(2).to_pylist()):
                if r is None or isinstance(r, Exception):
                    streak += 1
                    raws.append(None)
                    errs.append(str(r) if isinstance(r, Exception) else "no response")
                    if streak >= max_hard_errors:
                        if not stop:
                            raise ErrorBudgetExceeded(
                                f"{streak} consecutive hard errors for model {model}: aborting the pass")
                        errs[-1] = f"{SPENT}: {errs[-1]}"
                        break
                else:
                    streak = 0
                    raws.append(str(r))
                    errs.append(None)
            n, text = len(raws), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, n).cast(text), pa.array([model] * n, text), pa.array([version] * n, text),
                                              pa.array(raws, text), pa.array(errs, text)], RAW_COLUMNS)
    return run


def classify(pairs: DataFrame, fn: Responder, system_prompt: str, version: str,
             max_hard_errors: int = CIRCUIT_BREAKER_THRESHOLD, partitions: int | None = None,
             checkpoint: bool = True, models: list[str] | None = None, factory: bool = False, stop: bool = False,
             profile: ResourceProfile | None = None) -> DataFrame:
    """D3: run the classifier over (message_id, model, user_turn) rows, a task for each (model, bucket).

    About ``partitions`` tasks share the models evenly.  ``models`` are the
    names in ``pairs`` (looked up if not given).  ``factory``: ``fn(model)``
    opens the model.  ``profile``: resources of the stage, such as GPUs.
    ``stop``: a task out of budget ends without failing the job.  With
    ``checkpoint`` (default) the raw replies are written to the session's
    checkpoint folder before anything else reads them: model calls are the
    expensive, non-repeatable part, and a lost executor later in the plan must
    not re-run them.  ``scoring_run`` stores replies as it goes.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if models is None:
        models = sorted(r[0] for r in pairs.select("model").distinct().collect())
    buckets = max(1, n // max(1, len(models)))
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")) - 1 if models else F.lit(0)
    task = (place * buckets + F.pmod(F.xxhash64("message_id"), F.lit(buckets))).cast("int")
    dealt = (pairs.where(F.col("model").isin(models)).select("message_id", "model", "user_turn")
             .repartitionById(buckets * max(1, len(models)), task).sortWithinPartitions("message_id"))
    raw = dealt.mapInArrow(_classify_partition(fn, system_prompt, version, max_hard_errors, factory, stop), RAW_SCHEMA, profile=profile)
    if checkpoint:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(raw.sparkSession)
        raw = raw.checkpoint(eager=True)
    return raw


def scoring_run(spark, m: DataFrame, models: list[str], fn: Responder, system_prompt: str, version: str, store: str,
                waves: int = 8, strip_html: bool = False, max_hard_errors: int = CIRCUIT_BREAKER_THRESHOLD,
                partitions: int | None = None, factory: bool = False, profile: ResourceProfile | None = None) -> dict[str, str]:
    """A corpus scoring run: J4 -> D3 -> K3, K4, K5 under the folder ``store``.

    The pending (message, model) pairs are written once, dealt into waves of
    whole messages; each wave reads its own part, and its raw replies are
    committed to ``store/replies`` before the next begins.  The first wave is
    a small one, a task a model, so a model that is down costs a few calls.

    D4 for the whole pass: after a wave, a model is out of budget if one of
    its tasks was, or if it has had ``max_hard_errors`` hard errors since its
    last reply, over however many tasks.  Then the pass ends with
    ``ErrorBudgetExceeded``; what it has paid for is kept and the next run
    takes up the rest.  At the end the latest reply of each pair gives
    ``votes`` (K3), ``errors`` (K4) and ``disagreements`` (K5).  Returns their
    paths.
    """
    from datetime import datetime, timezone
    import uuid

    from ..session import checkpoint_dir
    from ..sources.lists import exists
    from . import classify as K

    replies = store.rstrip("/") + "/replies"
    schema = RAW_SCHEMA + ", classified_at string"
    known = spark.read.schema(schema).parquet(replies) if exists(spark, replies) else spark.createDataFrame([], schema)
    done = known.where("raw_response IS NOT NULL").select("message_id", "model", "prompt_version").distinct()
    part = F.pmod(F.xxhash64("message_id"), F.lit(8 * waves))
    todo = K.pending(user_turns(m, strip_html), models, done, version).select("message_id", "model", "user_turn")
    staged = checkpoint_dir(spark, f"pending-{uuid.uuid4().hex}")
    (todo.withColumn("wave", F.when(part == 0, 0).otherwise(1 + part % waves).cast("int"))
     .write.partitionBy("wave").parquet(staged))
    todo = spark.read.schema("message_id string, model string, user_turn string, wave int").parquet(staged)
    streak = dict.fromkeys(models, 0)
    for wave in range(waves + 1):
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        (classify(todo.where(F.col("wave") == wave), fn, system_prompt, version, max_hard_errors,
                  len(models) if wave == 0 else partitions, False, models, factory, True, profile)
         .withColumn("classified_at", F.lit(now)).write.mode("append").parquet(replies))
        spent = []
        # a row a model
        for r in (spark.read.schema(schema).parquet(replies).where(F.col("classified_at") == now).groupBy("model")
                  .agg(F.count("raw_response").alias("ok"), F.count_if(F.col("raw_response").isNull()).alias("hard"),
                       F.coalesce(F.bool_or(F.startswith("error", F.lit(SPENT))), F.lit(False)).alias("spent")).collect()):
            streak[r["model"]] = 0 if r["ok"] else streak[r["model"]] + r["hard"]
            if r["spent"] or streak[r["model"]] >= max_hard_errors:
                spent.append(r["model"])
        if spent:
            raise ErrorBudgetExceeded(f"{max_hard_errors} consecutive hard errors for model {', '.join(sorted(spent))}: aborting the pass")
    raw = spark.read.schema(schema).parquet(replies)
    key = ["message_id", "model", "prompt_version"]
    latest = K._first(raw, key, [F.col("raw_response").isNotNull().desc(), F.col("classified_at").desc()])
    scored = parse_scored(latest.drop("classified_at")).drop("classified_at").join(latest.select(*key, "classified_at"), key)
    stored, errors = split_errors(scored)
    paths = {k: store.rstrip("/") + "/" + k for k in ("votes", "errors", "disagreements")}
    stored.write.mode("overwrite").parquet(paths["votes"])
    errors.write.mode("overwrite").json(paths["errors"])
    K.disagreements(spark.read.parquet(paths["votes"]), models, version).write.mode("overwrite").json(paths["disagreements"])
    return {"replies": replies, **paths}


def parse_scored(raw: DataFrame, classified_at: str | None = None) -> DataFrame:
    """F7 on the raw replies; hard errors keep NULL raw_response."""
    out = TX.parse_label_responses(raw.withColumnRenamed("error", "_hard"), "raw_response", prefix="p_")
    ts = F.lit(classified_at) if classified_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select("message_id", "model", "prompt_version", F.col("p_label").alias("label"),
                      F.col("p_confidence").alias("confidence"), F.col("p_reason").alias("reason"),
                      "raw_response", F.coalesce(F.col("_hard"), F.col("p_error")).alias("error"),
                      ts.alias("classified_at"))


def split_errors(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: (rows to store, error log rows).

    A hard error (no raw response) is logged and NOT stored, so a resume
    retries it; a parse error is stored as 'uncertain' and also logged.
    """
    hard = F.col("raw_response").isNull()
    stored = scored.where(~hard).drop("error")
    errors = scored.where(F.col("error").isNotNull()).select("message_id", "model", "prompt_version", "error",
                                                             "raw_response", "classified_at")
    return stored, errors


# ------------------------------------------------------- rule classifier
# Our own ordered clause list distilled from the prompt's keep/delete criteria.
# Phrases and sender names the clauses use.
AUTOREPLY = ("automatic reply", "out of office", "ooo", "autosvar")
RECEIPTS = ("receipt", "order confirmation", "ticket", "statement", "tax form", "boarding pass", "itinerary", "invoice")
SIGNATURE_DOMAINS = ("docusign.net",)
NOTICES = ("verification code", "reset your password", "password reset", "new sign-in", "security alert",
           "delivered", "out for delivery", "reminder", "arriving in")
BULK_CATEGORIES = ("promotions", "social")
NO_REPLY_RE = "^(no-?reply|do-?not-?reply)[^@]*@"
FWD_RE = "^\\s*(fwd|fw):"
LIST_RE = "^\\s*\\[[^\\]]+\\]"


def _clauses() -> list[tuple[str, str, float | None, Column]]:
    subj = F.lower(F.coalesce(col("subject"), F.lit("")))
    return [
        ("forwarded", "keep", 0.8, subj.rlike(FWD_RE)),
        ("auto_reply", "delete", 0.9, subject_any(AUTOREPLY)),
        ("contact", "keep", 0.9, F.coalesce(col("is_contact"), F.lit(False))),
        ("replied_thread", "keep", 0.9, F.coalesce(col("replied"), F.lit(False))),
        ("receipt_or_travel", "keep", 0.85, subject_any(RECEIPTS)),
        ("signature_request", "keep", 0.85, sender_any(SIGNATURE_DOMAINS)),
        ("mailing_list", "delete", 0.8, subj.rlike(LIST_RE)),
        ("expired_notice", "delete", 0.8, subject_any(NOTICES)),
        ("bulk_category", "delete", 0.7, category_is(BULK_CATEGORIES)),
        ("no_reply_sender", "delete", 0.6, F.coalesce(F.lower(col("from_email")).rlike(NO_REPLY_RE), F.lit(False))),
    ]


# model name -> clause it leaves out (None = full rule set)
RULE_MODELS = {"rules-full": None, "rules-no-contact": "contact", "rules-no-category": "bulk_category"}


def _verdict(drop: str | None) -> Column:
    out = None
    for name, label, conf, cond in _clauses():
        if name == drop:
            continue
        v = F.struct(F.lit(label).alias("label"), F.lit(conf).cast("double").alias("confidence"),
                     F.lit(name).alias("reason"))
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(F.struct(F.lit("uncertain").alias("label"), F.lit(None).cast("double").alias("confidence"),
                                  F.lit("no_rule").alias("reason")))


def rule_classify(m: DataFrame, version: str, models: dict[str, str | None] | None = None,
                  key: str = "message_id") -> DataFrame:
    """Deterministic classifier over messages with ``is_contact`` / ``replied`` flags.

    One row per (message, model variant), produced by a generator over the
    variants (no join); every verdict is a native CASE chain.
    """
    models = models or RULE_MODELS
    variants = F.array(*[F.struct(F.lit(name).alias("model"), _verdict(drop).alias("v"))
                         for name, drop in models.items()])
    x = m.select(*names(key), F.explode(variants).alias("mv"))
    return x.select(*names(key), F.col("mv.model").alias("model"), F.lit(version).alias("prompt_version"),
                    F.col("mv.v.label").alias("label"), F.col("mv.v.confidence").alias("confidence"),
                    F.col("mv.v.reason").alias("reason"))


def rule_vote(m: DataFrame, version: str, models: dict[str, str | None] | None = None, key: str = "message_id") -> DataFrame:
    """A27 over ``rule_classify``: unanimous label of the variants, taken in place (no explode, no shuffle)."""
    models = models or RULE_MODELS
    labels = F.array_distinct(F.array(*[_verdict(drop)["label"] for drop in models.values()]))
    x = m.select(*names(key), labels.alias("_l"))
    return x.select(*names(key), F.lit(version).alias("prompt_version"),
                    F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise("uncertain").alias("vote"),
                    F.lit(len(models)).cast("long").alias("n_votes"))


def with_protection_flags(m: DataFrame, contacts: DataFrame, email_col: str = "email") -> DataFrame:
    """Adds ``is_contact`` and ``replied`` (J1/J2 as flags, rows never multiplied)."""
    from .rules import protect
    return protect(m, contacts, m, email_col, keep_flags=True).drop("protected_by")


KEEP_WORDS, DELETE_WORDS = re.compile("invoice|statement|boarding"), re.compile("verification|alert|digest")


def keyword_responder(model: str, system_prompt: str, turns: list[str]) -> list[str]:
    """Example plug-in for tests and demos: a JSON reply per turn from subject keywords."""
    out = []
    for turn in turns:
        start = turn.find("\n") + 1
        stop = turn.find("\n", start)
        subject = turn[start:stop if stop >= 0 else None].lower() if start else ""
        if KEEP_WORDS.search(subject):
            out.append('{"label": "keep", "confidence": 0.9, "reason": "document"}')
        elif DELETE_WORDS.search(subject):
            out.append('```json\n{"label": "Delete", "confidence": 0.8, "reason": "notice"}\n```')
        else:
            out.append("I cannot decide.")
    return out
