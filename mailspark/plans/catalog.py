"""Registry of runnable queries: name -> (Spark builder, DuckDB oracle SQL).

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables (through the derived views of ``mailspark.fixtures``).
The oracle text inlines the same view definitions as CTEs, so DuckDB answers
the same question from the same parquet files.  Column names and types are
aligned on both sides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..fixtures import duck_with as W
from ..operators import messages as M
from ..operators.score_store import ScoreStore
from ..session import checkpoint_dir
from ..sources.versioned import VersionedTable
from . import duck as D

AS_OF = fx.AS_OF_EPOCH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _m(spark, sf):
    return fx.messages(spark, sf)


# ---------------------------------------------------------------- A1-A20
_VOL = f"""COUNT(*) AS total, {D.isum('is_unread')} AS unread, {D.isum('is_starred')} AS starred,
  {D.count_if('in_inbox = 1')} AS inbox, {D.count_if('in_sent = 1')} AS sent,
  {D.isum('has_attachments')} AS with_attachments"""

register("by_month", W(["messages"], f"""
SELECT year_month, {_VOL} FROM messages WHERE year_month IS NOT NULL GROUP BY year_month"""))(
    lambda s, sf: M.by_month(_m(s, sf)))

register("by_year", W(["messages"], f"""
SELECT year, {_VOL} FROM messages WHERE year IS NOT NULL GROUP BY year"""))(
    lambda s, sf: M.by_year(_m(s, sf)))

register("received_per_year", W(["messages"], f"""
SELECT year, COUNT(*) AS received, {D.isum('is_unread')} AS still_unread, {D.isum('is_starred')} AS starred
FROM messages WHERE year IS NOT NULL AND (in_sent = 0 OR in_sent IS NULL) GROUP BY year"""))(
    lambda s, sf: M.received_per_year(_m(s, sf)))

register("sent_per_year", W(["messages"], """
SELECT year, COUNT(*) AS sent FROM messages WHERE year IS NOT NULL AND in_sent = 1 GROUP BY year"""))(
    lambda s, sf: M.sent_per_year(_m(s, sf)))

_RS = f"""COUNT(*) AS total, {D.count_if('in_sent = 0 OR in_sent IS NULL')} AS received,
  {D.count_if('in_sent = 1')} AS sent"""

register("by_day_of_week", W(["messages"], f"""
SELECT CASE strftime({D.ts('date_ts')}, '%w') WHEN '0' THEN '0 – Sun' WHEN '1' THEN '1 – Mon'
  WHEN '2' THEN '2 – Tue' WHEN '3' THEN '3 – Wed' WHEN '4' THEN '4 – Thu' WHEN '5' THEN '5 – Fri'
  WHEN '6' THEN '6 – Sat' END AS day_of_week, {_RS}
FROM messages WHERE date_ts IS NOT NULL GROUP BY day_of_week"""))(
    lambda s, sf: M.by_day_of_week(_m(s, sf)))

register("by_hour_of_day", W(["messages"], f"""
SELECT CAST(hour({D.ts('date_ts')}) AS INTEGER) AS hour_utc, {_RS}
FROM messages WHERE date_ts IS NOT NULL GROUP BY hour_utc"""))(
    lambda s, sf: M.by_hour_of_day(_m(s, sf)))

register("top_senders", W(["messages"], f"""
SELECT from_email, arg_max_null(from_name, {D.newest()}) AS from_name, COUNT(*) AS message_count,
  {D.isum('is_unread')} AS unread, {D.isum('is_starred')} AS starred,
  {D.epoch_text('MIN(date_ts)')} AS first_seen, {D.epoch_text('MAX(date_ts)')} AS last_seen
FROM messages WHERE from_email IS NOT NULL GROUP BY from_email
ORDER BY message_count DESC, from_email LIMIT 200"""))(
    lambda s, sf: M.top_senders(_m(s, sf)))

register("top_senders_inbox", W(["messages"], f"""
SELECT from_email, arg_max_null(from_name, {D.newest()}) AS from_name, COUNT(*) AS message_count,
  {D.isum('is_unread')} AS unread, {D.epoch_text('MAX(date_ts)')} AS last_message
FROM messages WHERE in_inbox = 1 AND from_email IS NOT NULL GROUP BY from_email
ORDER BY message_count DESC, from_email LIMIT 200"""))(
    lambda s, sf: M.top_senders_inbox(_m(s, sf)))

register("top_senders_trash", W(["messages"], f"""
SELECT from_email, arg_max_null(from_name, {D.newest()}) AS from_name, COUNT(*) AS trashed_count,
  {D.epoch_text('MAX(date_ts)')} AS last_trashed
FROM messages WHERE in_trash = 1 AND from_email IS NOT NULL GROUP BY from_email
ORDER BY trashed_count DESC, from_email LIMIT 100"""))(
    lambda s, sf: M.top_senders_trash(_m(s, sf)))

register("storage_by_sender", W(["messages"], f"""
SELECT from_email, from_name, message_count,
  {D.fixed_text('total_bytes', '1048576', 1, ' MB')} AS total_size,
  {D.fixed_text('total_bytes', 'message_count * 1024', 1, ' KB')} AS avg_size, total_bytes
FROM (SELECT from_email, arg_max_null(from_name, {D.newest()}) AS from_name, COUNT(*) AS message_count,
        {D.isum('body_size_bytes')} AS total_bytes
      FROM messages WHERE from_email IS NOT NULL GROUP BY from_email) g
ORDER BY total_bytes DESC, from_email LIMIT 100"""))(
    lambda s, sf: M.storage_by_sender(_m(s, sf)))

register("busiest_threads", W(["messages"], f"""
SELECT thread_id, COUNT(*) AS message_count, {D.epoch_text('MIN(date_ts)')} AS started,
  {D.epoch_text('MAX(date_ts)')} AS last_message, COUNT(DISTINCT from_email) AS participants,
  MAX(subject) AS subject
FROM messages WHERE thread_id IS NOT NULL GROUP BY thread_id
ORDER BY message_count DESC, thread_id LIMIT 100"""))(
    lambda s, sf: M.busiest_threads(_m(s, sf)))

register("attachment_types", W(["messages"], """
SELECT lower(CASE WHEN instr(value, '.') > 0 THEN substr(value, instr(value, '.') + 1)
  ELSE '(no extension)' END) AS extension, COUNT(*) AS count
FROM (SELECT unnest(attachment_names) AS value FROM messages WHERE attachment_names IS NOT NULL) a
GROUP BY extension ORDER BY count DESC, extension LIMIT 50"""))(
    lambda s, sf: M.attachment_types(_m(s, sf)))

register("by_label", W(["messages"], """
SELECT label, COUNT(*) AS message_count
FROM (SELECT unnest(labels) AS label FROM messages WHERE labels IS NOT NULL) a GROUP BY label"""))(
    lambda s, sf: M.by_label(_m(s, sf)))

register("top_recipients", W(["messages"], f"""
SELECT to_raw, COUNT(*) AS sent_count, {D.epoch_text('MAX(date_ts)')} AS last_sent
FROM messages WHERE in_sent = 1 AND to_raw IS NOT NULL GROUP BY to_raw
ORDER BY sent_count DESC, to_raw LIMIT 100"""))(
    lambda s, sf: M.top_recipients(_m(s, sf)))

register("inbox_age_buckets", W(["messages"], f"""
SELECT CASE WHEN date_ts >= {AS_OF - 7 * 86400} THEN '1 – this week'
  WHEN date_ts >= {AS_OF - 30 * 86400} THEN '2 – this month'
  WHEN date_ts >= {AS_OF - 180 * 86400} THEN '3 – 1–6 months'
  WHEN date_ts >= {AS_OF - 365 * 86400} THEN '4 – 6–12 months'
  ELSE '5 – over a year' END AS age_bucket, COUNT(*) AS messages, {D.isum('is_unread')} AS unread
FROM messages WHERE in_inbox = 1 GROUP BY age_bucket"""))(
    lambda s, sf: M.inbox_age_buckets(_m(s, sf), AS_OF))

register("unread_by_sender", W(["messages"], f"""
SELECT from_email, from_name, total_received, unread,
  {D.fixed_text('unread * 100', 'total_received', 0, '%')} AS unread_pct, {D.epoch_text('last_ts')} AS last_message
FROM (SELECT from_email, arg_max_null(from_name, {D.newest()}) AS from_name, COUNT(*) AS total_received,
        {D.isum('is_unread')} AS unread, MAX(date_ts) AS last_ts
      FROM messages WHERE (in_sent = 0 OR in_sent IS NULL) AND from_email IS NOT NULL
      GROUP BY from_email) g
WHERE unread > 0 ORDER BY unread DESC, from_email LIMIT 200"""))(
    lambda s, sf: M.unread_by_sender(_m(s, sf)))

register("sender_domain_volume", W(["messages"], f"""
SELECT lower(substr(from_email, instr(from_email, '@') + 1)) AS domain,
  COUNT(DISTINCT from_email) AS distinct_addresses, COUNT(*) AS message_count,
  {D.isum('is_unread')} AS unread, {D.epoch_text('MAX(date_ts)')} AS last_message
FROM messages WHERE from_email LIKE '%@%' GROUP BY domain
ORDER BY message_count DESC, domain LIMIT 100"""))(
    lambda s, sf: M.sender_domain_volume(_m(s, sf)))

_ONE_WAY = f"""
SELECT r.thread_id, COUNT(*) AS received_count, MAX(r.subject) AS subject,
  arg_max_null(r.from_email, {D.newest('r.date_ts', 'r.')}) AS primary_sender,
  {D.epoch_text('MAX(r.date_ts)')} AS last_received
FROM messages r
WHERE (r.in_sent = 0 OR r.in_sent IS NULL) AND r.thread_id IS NOT NULL AND {{cond}}
GROUP BY r.thread_id ORDER BY received_count DESC, r.thread_id LIMIT 200"""

register("one_way_threads", W(["messages"], _ONE_WAY.replace("{cond}", (
    "NOT EXISTS (SELECT 1 FROM messages s WHERE s.in_sent = 1 AND s.thread_id = r.thread_id)"))))(
    lambda s, sf: M.one_way_threads(_m(s, sf)))

register("one_way_threads_null_aware", W(["messages"], _ONE_WAY.replace("{cond}", (
    "r.thread_id NOT IN (SELECT DISTINCT thread_id FROM messages WHERE in_sent = 1)"))))(
    lambda s, sf: M.one_way_threads(_m(s, sf), null_aware=True))

register("monthly_unread_rate", W(["messages"], f"""
SELECT year_month, received, unread, {D.fixed_text('unread * 100', 'received', 1, '%')} AS unread_rate
FROM (SELECT year_month, COUNT(*) AS received, {D.isum('is_unread')} AS unread FROM messages
      WHERE year_month IS NOT NULL AND (in_sent = 0 OR in_sent IS NULL) GROUP BY year_month) g"""))(
    lambda s, sf: M.monthly_unread_rate(_m(s, sf)))

register("messages_without_date", W(["messages"], """
SELECT message_id, from_email, subject, CAST(NULL AS VARCHAR) AS date_str, path, mbox_offset
FROM messages WHERE date_ts IS NULL ORDER BY path, mbox_offset LIMIT 200"""))(
    lambda s, sf: M.messages_without_date(_m(s, sf)))

# ---------------------------------------------------------------- T1-T5
register("unread_inbox", W(["messages"], f"""
SELECT {D.epoch_text('date_ts')} AS date, from_email, from_name, subject,
  CAST(to_json(labels) AS VARCHAR) AS labels, message_id
FROM messages WHERE in_inbox = 1 AND is_unread = 1
ORDER BY date_ts DESC NULLS LAST, path, mbox_offset LIMIT 500"""))(
    lambda s, sf: M.unread_inbox(_m(s, sf)))

register("starred", W(["messages"], f"""
SELECT {D.epoch_text('date_ts')} AS date, from_email, subject, CAST(to_json(labels) AS VARCHAR) AS labels, message_id
FROM messages WHERE is_starred = 1 ORDER BY date_ts DESC NULLS LAST, path, mbox_offset LIMIT 500"""))(
    lambda s, sf: M.starred(_m(s, sf)))

register("oldest_unread", W(["messages"], f"""
SELECT {D.epoch_text('date_ts')} AS date, from_email, subject, CAST(to_json(labels) AS VARCHAR) AS labels, message_id
FROM messages WHERE is_unread = 1 ORDER BY date_ts ASC NULLS FIRST, path, mbox_offset LIMIT 200"""))(
    lambda s, sf: M.oldest_unread(_m(s, sf)))

register("largest_messages", W(["messages"], f"""
SELECT {D.epoch_text('date_ts')} AS date, from_email, subject,
  {D.fixed_text('body_size_bytes', '1048576', 1, ' MB')} AS size, body_size_bytes, has_attachments,
  CAST(to_json(attachment_names) AS VARCHAR) AS attachment_names, message_id
FROM messages ORDER BY body_size_bytes DESC NULLS LAST, path, mbox_offset LIMIT 100"""))(
    lambda s, sf: M.largest_messages(_m(s, sf)))

register("with_attachments", W(["messages"], f"""
SELECT {D.epoch_text('date_ts')} AS date, from_email, subject,
  CAST(to_json(attachment_names) AS VARCHAR) AS attachment_names,
  {D.fixed_text('body_size_bytes', '1048576', 1, ' MB')} AS size, message_id
FROM messages WHERE has_attachments = 1 ORDER BY date_ts DESC NULLS LAST, path, mbox_offset LIMIT 500"""))(
    lambda s, sf: M.with_attachments(_m(s, sf)))

# ---------------------------------------------------------------- B1-B4
register("browse", W(["messages"], """
SELECT message_id, thread_id, date_ts, from_email, from_name, to_raw, subject, body_size_bytes,
  is_unread, is_starred, is_important, in_inbox, in_sent, in_trash, category,
  CAST(to_json(labels) AS VARCHAR) AS labels, CAST(to_json(attachment_names) AS VARCHAR) AS attachment_names,
  has_attachments, ts, year, year_month
FROM messages ORDER BY date_ts DESC NULLS LAST, message_id"""))(
    lambda s, sf: M.browse(_m(s, sf)))

_FACETS = ["year_month", "from_email", "is_unread", "is_starred", "in_inbox", "in_sent", "in_trash", "has_attachments"]
register("facets", W(["messages"], """
SELECT facet, value, count FROM (
  SELECT facet, value, count, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value ASC NULLS FIRST) AS rn
  FROM (SELECT facet, value, COUNT(*) AS count FROM (
    """ + "\n    UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value FROM messages" for c in _FACETS) + """
  ) u GROUP BY facet, value) g) r WHERE rn <= 30"""))(
    lambda s, sf: M.facets(_m(s, sf), _FACETS))

register("scoring_input", W(["messages", "full_messages"], """
SELECT message_id, from_email, from_name, subject, date_str, body_text FROM full_messages WHERE message_id IS NOT NULL"""))(
    lambda s, sf: M.scoring_input(fx.full_messages(s, sf)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["prune"](spark, sf)


# ---------------------------------------------------------------- classifications
from pyspark.sql import functions as F  # noqa: E402

from ..operators import classify as K  # noqa: E402


def _c(spark, sf):
    return fx.classifications(spark, sf)


def _docs_as_messages(spark, sf):
    """Documents seen as scored mail: doc_id is the message id of ``classifications``."""
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("message_id"), "lang", "source", "n_chars", "text")


MODELS = ["mA", "mB", "mC"]

register("label_distribution", W(["classifications"], f"""
SELECT model, prompt_version, label, count, {D.fixed_text('count * 100', 'tot', 1, '%')} AS pct
FROM (SELECT model, prompt_version, label, COUNT(*) AS count,
        SUM(COUNT(*)) OVER (PARTITION BY model, prompt_version) AS tot
      FROM classifications GROUP BY model, prompt_version, label) g"""))(
    lambda s, sf: K.label_distribution(_c(s, sf)))

register("uncertain_rate_by_version", W(["classifications"], f"""
SELECT prompt_version, model, uncertain, total, {D.fixed_text('uncertain * 100', 'total', 1, '%')} AS uncertain_rate,
  CASE WHEN CAST(uncertain AS DOUBLE) / total > 0.30 THEN 'WARN: refine prompt before Stage 3' ELSE 'OK' END AS gate_status
FROM (SELECT prompt_version, model, {D.count_if("label = 'uncertain'")} AS uncertain, COUNT(*) AS total
      FROM classifications GROUP BY prompt_version, model) g"""))(
    lambda s, sf: K.uncertain_rate_by_version(_c(s, sf)))

register("disagreement_rate", W(["classifications"], f"""
SELECT prompt_version, total_messages, disagreements,
  {D.fixed_text('disagreements * 100', 'total_messages', 1, '%')} AS disagreement_rate
FROM (SELECT prompt_version, COUNT(*) AS total_messages, {D.count_if('lo <> hi')} AS disagreements
      FROM (SELECT message_id, prompt_version, MIN(label) AS lo, MAX(label) AS hi
            FROM classifications GROUP BY message_id, prompt_version) pm GROUP BY prompt_version) g"""))(
    lambda s, sf: K.disagreement_rate(_c(s, sf)))

register("ensemble_verdict", W(["classifications"], f"""
SELECT prompt_version, verdict, messages, {D.fixed_text('messages * 100', 'tot', 1, '%')} AS pct
FROM (SELECT prompt_version, verdict, COUNT(*) AS messages, SUM(COUNT(*)) OVER (PARTITION BY prompt_version) AS tot
      FROM (SELECT message_id, prompt_version,
              CASE WHEN MIN(label) = MAX(label) AND MAX(label) = 'keep' THEN 'unanimous keep'
                   WHEN MIN(label) = MAX(label) AND MAX(label) = 'delete' THEN 'unanimous delete'
                   WHEN MIN(label) = MAX(label) AND MAX(label) = 'uncertain' THEN 'all uncertain'
                   ELSE 'disagreement' END AS verdict
            FROM classifications GROUP BY message_id, prompt_version) pm
      GROUP BY prompt_version, verdict) g"""))(
    lambda s, sf: K.ensemble_verdict(_c(s, sf)))

_MAJ = """WITH lc AS (SELECT message_id, prompt_version, label, COUNT(*) AS n FROM classifications GROUP BY ALL),
top AS (SELECT message_id, prompt_version, MAX(n) AS top, COUNT(*) AS nl FROM lc GROUP BY ALL),
maj AS (SELECT lc.message_id, lc.prompt_version, MIN(lc.label) AS majority_label
        FROM lc JOIN top ON lc.message_id = top.message_id AND lc.prompt_version = top.prompt_version
        WHERE lc.n = top.top AND top.nl > 1 GROUP BY ALL HAVING COUNT(*) = 1),
mv AS (SELECT c.*, maj.majority_label FROM classifications c
       JOIN maj ON c.message_id = maj.message_id AND c.prompt_version = maj.prompt_version
       WHERE c.label <> maj.majority_label)
"""

register("outlier_by_model", W(["classifications"], _MAJ + """
SELECT prompt_version, model, COUNT(*) AS outlier_votes FROM mv GROUP BY prompt_version, model"""))(
    lambda s, sf: K.outlier_by_model(_c(s, sf)))

register("minority_votes", W(["classifications"], _MAJ + """
SELECT message_id, model, prompt_version, label, confidence, majority_label, true AS disagree FROM mv"""))(
    lambda s, sf: K.minority_votes(_c(s, sf)))

register("outlier_directions", W(["classifications"], _MAJ + f"""
SELECT prompt_version, model, COUNT(*) AS outlier_votes,
  {D.count_if("label = 'delete' AND majority_label = 'keep'")} AS false_deletes,
  {D.count_if("label = 'keep' AND majority_label = 'delete'")} AS false_keeps,
  {D.count_if("label = 'uncertain'")} AS uncertain
FROM mv GROUP BY prompt_version, model"""))(
    lambda s, sf: K.outlier_directions(_c(s, sf)))

register("disagreeing_keys", W(["classifications"], """
SELECT message_id, prompt_version FROM classifications GROUP BY message_id, prompt_version
HAVING MIN(label) <> MAX(label)"""))(
    lambda s, sf: K.disagreeing_keys(_c(s, sf)))

def _docs_category(spark, sf):
    return _docs_as_messages(spark, sf).select("message_id", F.col("source").alias("category"))


register("disagreement_rate_by_category", W(["classifications"], f"""
SELECT prompt_version, category, total_messages, disagreements,
  {D.fixed_text('disagreements * 100', 'total_messages', 1, '%')} AS disagreement_rate
FROM (SELECT pm.prompt_version, d.source AS category, COUNT(*) AS total_messages, {D.count_if('lo <> hi')} AS disagreements
      FROM (SELECT message_id, prompt_version, MIN(label) AS lo, MAX(label) AS hi
            FROM classifications GROUP BY message_id, prompt_version) pm
      LEFT JOIN documents d ON d.doc_id = pm.message_id
      GROUP BY pm.prompt_version, d.source) g"""))(
    lambda s, sf: K.disagreement_rate(_c(s, sf), _docs_category(s, sf)))

register("disagreement_history", W(["classifications"], f"""
SELECT prompt_version, models, sample, disagreements, {D.fixed_text('disagreements * 100', 'sample', 1, '%')} AS disagreement_rate
FROM (SELECT prompt_version, models, COUNT(*) AS sample, {D.count_if('dis')} AS disagreements
      FROM (SELECT message_id, prompt_version, array_to_string(list_sort(list(DISTINCT model)), ',') AS models,
              MIN(label) <> MAX(label) AS dis
            FROM classifications GROUP BY message_id, prompt_version) pm
      GROUP BY prompt_version, models) g"""))(
    lambda s, sf: K.disagreement_history(_c(s, sf)))

register("high_confidence_disagreements", W(["classifications"], """
SELECT message_id, prompt_version,
  string_agg(model || ':' || label || '(' || CAST(round(confidence, 2) AS VARCHAR) || ')', '  '
             ORDER BY model || ':' || label || '(' || CAST(round(confidence, 2) AS VARCHAR) || ')') AS votes,
  MAX(confidence) AS max_confidence
FROM classifications GROUP BY message_id, prompt_version
HAVING MIN(label) <> MAX(label) AND MAX(confidence) >= 0.9
ORDER BY max_confidence DESC, prompt_version, message_id LIMIT 200"""))(
    lambda s, sf: K.high_confidence_disagreements(_c(s, sf)))

register("confidence_distribution", W(["classifications"], """
SELECT model, prompt_version, label, round(CAST(trunc(confidence * 10) AS DOUBLE) / 10, 1) AS confidence_bucket,
  COUNT(*) AS count
FROM classifications GROUP BY model, prompt_version, label, confidence_bucket"""))(
    lambda s, sf: K.confidence_distribution(_c(s, sf)))

register("label_drift_by_model", W(["classifications"], f"""
SELECT model, prompt_version, total, deletes, keeps, uncertain,
  {D.fixed_text('deletes * 100', 'total', 1, '%')} AS delete_rate
FROM (SELECT model, prompt_version, COUNT(*) AS total, {D.count_if("label = 'delete'")} AS deletes,
        {D.count_if("label = 'keep'")} AS keeps, {D.count_if("label = 'uncertain'")} AS uncertain
      FROM classifications GROUP BY model, prompt_version) g"""))(
    lambda s, sf: K.label_drift_by_model(_c(s, sf)))

register("vote", W(["classifications"], """
SELECT message_id, prompt_version, CASE WHEN MIN(label) = MAX(label) THEN MIN(label) ELSE 'uncertain' END AS vote,
  COUNT(label) AS n_votes
FROM classifications GROUP BY message_id, prompt_version"""))(
    lambda s, sf: K.vote(_c(s, sf)))

register("single_model_uncertain_rate", W(["classifications"], f"""
SELECT 'mA' AS model, 'v1.1.0' AS prompt_version, uncertain, total,
  CASE WHEN total > 0 THEN CAST(uncertain AS DOUBLE) / total END AS uncertain_rate,
  coalesce(CAST(uncertain AS DOUBLE) / NULLIF(total, 0) > 0.3, false) AS gate_warn
FROM (SELECT {D.count_if("label = 'uncertain'")} AS uncertain, COUNT(*) AS total FROM classifications
      WHERE model = 'mA' AND prompt_version = 'v1.1.0') g"""))(
    lambda s, sf: K.single_model_uncertain_rate(_c(s, sf), "mA", "v1.1.0"))

register("disagreement_log", W(["classifications"], """
SELECT message_id, prompt_version, MAX(label) FILTER (WHERE model = 'mA') AS mA_label,
  MAX(label) FILTER (WHERE model = 'mB') AS mB_label, MAX(label) FILTER (WHERE model = 'mC') AS mC_label
FROM classifications WHERE model IN ('mA', 'mB', 'mC') GROUP BY message_id, prompt_version
HAVING least(mA_label, mB_label, mC_label) <> greatest(mA_label, mB_label, mC_label)"""))(
    lambda s, sf: K.disagreements(_c(s, sf), MODELS))


def _upsert(spark, sf):
    c = _c(spark, sf)
    old = c.withColumn("classified_at", F.lit("2026-01-01T00:00:00+00:00"))
    rerun = (c.where(F.col("model") == "mB").withColumn("label", F.lit("uncertain"))
              .withColumn("classified_at", F.lit("2026-02-01T00:00:00+00:00")))
    return K.upsert_classifications(old, rerun)


def _score_store(spark, sf):
    return ScoreStore(spark, checkpoint_dir(spark, f"scores-{uuid.uuid4().hex}"), buckets=8)


def _upsert_stored(spark, sf):
    """K3 on the bucketed store: version 0 holds the first run, version 1 the second over it."""
    c = _c(spark, sf)
    store = _score_store(spark, sf).create(c.withColumn("classified_at", F.lit("2026-01-01T00:00:00+00:00")))
    store.upsert(c.where(F.col("model") == "mB").withColumn("label", F.lit("uncertain"))
                 .withColumn("classified_at", F.lit("2026-02-01T00:00:00+00:00")))
    return store.read()


def _vote_stored(spark, sf):
    return K.vote(_score_store(spark, sf).create(_c(spark, sf).withColumn("classified_at", F.lit("t"))).read())


_UPSERT_SQL = W(["classifications"], """
SELECT message_id, model, prompt_version, label, confidence, classified_at FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id, model, prompt_version ORDER BY classified_at DESC) AS rn
  FROM (SELECT *, '2026-01-01T00:00:00+00:00' AS classified_at FROM classifications
        UNION ALL
        SELECT message_id, model, prompt_version, 'uncertain' AS label, confidence, '2026-02-01T00:00:00+00:00'
        FROM classifications WHERE model = 'mB') u) r WHERE rn = 1""")
register("upsert_classifications", _UPSERT_SQL)(_upsert)
register("upsert_score_store", _UPSERT_SQL)(_upsert_stored)
register("vote_score_store", ORACLE["vote"])(_vote_stored)

_LATEST = """latest AS (SELECT message_id, prompt_version, human_label, corrected_at FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id, prompt_version ORDER BY coalesce(corrected_at, '') DESC) AS rn
  FROM corrections) r WHERE rn = 1)"""
_VOTES = """votes AS (SELECT message_id, prompt_version,
  CASE WHEN MIN(label) = MAX(label) THEN MIN(label) ELSE 'uncertain' END AS vote, COUNT(label) AS n_votes
  FROM classifications GROUP BY message_id, prompt_version)"""

register("latest_corrections", W(["corrections"], f"WITH {_LATEST} SELECT * FROM latest"))(
    lambda s, sf: K.latest_corrections(fx.corrections(s, sf)))

register("corrections_vs_votes", W(["corrections", "classifications"], f"""WITH {_LATEST}, {_VOTES}
SELECT l.message_id, l.prompt_version, l.human_label, l.corrected_at, v.vote, v.n_votes
FROM latest l JOIN votes v ON l.message_id = v.message_id AND l.prompt_version = v.prompt_version"""))(
    lambda s, sf: K.corrections_vs_votes(fx.corrections(s, sf), _c(s, sf)))

_ERR = f"""err AS (SELECT l.prompt_version, COUNT(*) AS total, {D.count_if('v.vote = l.human_label')} AS correct
  FROM latest l JOIN votes v ON l.message_id = v.message_id AND l.prompt_version = v.prompt_version
  GROUP BY l.prompt_version)"""

register("corrections_error_rate", W(["corrections", "classifications"], f"""WITH {_LATEST}, {_VOTES}, {_ERR}
SELECT prompt_version, total, correct, 1.0 - CAST(correct AS DOUBLE) / total AS error_rate FROM err"""))(
    lambda s, sf: K.corrections_error_rate(fx.corrections(s, sf), _c(s, sf)))

register("deployment_gate", W(["corrections", "classifications"], f"""WITH {_LATEST}, {_VOTES}, {_ERR},
vs AS (SELECT DISTINCT prompt_version FROM classifications),
j AS (SELECT vs.prompt_version, err.total, err.correct, 1.0 - CAST(err.correct AS DOUBLE) / err.total AS error_rate,
        list_transform(string_split(regexp_replace(vs.prompt_version, '^v', ''), '.'), lambda x: TRY_CAST(x AS INTEGER))
          >= [1, 1, 0] AS version_ok
      FROM vs LEFT JOIN err ON vs.prompt_version = err.prompt_version)
SELECT prompt_version, version_ok, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, error_rate,
  CASE WHEN NOT version_ok THEN 'fail_version' WHEN total IS NULL THEN 'unmeasured'
       WHEN error_rate >= 0.05 THEN 'fail_error_rate' ELSE 'pass' END AS status
FROM j"""))(
    lambda s, sf: K.deployment_gate(fx.corrections(s, sf), _c(s, sf), _c(s, sf).select("prompt_version")))


def _review(spark, sf):
    q = K.review_queue(_c(spark, sf), "v1.1.0")
    q = K.exclude_corrected(q, fx.corrections(spark, sf))
    q = K.enrich_review(q, _docs_as_messages(spark, sf), ["lang", "source"])
    return q.withColumn("votes", F.to_json("votes", {"ignoreNullFields": "false"}))


register("review_queue", W(["classifications", "corrections"], """
SELECT q.message_id, CAST(to_json(q.votes) AS VARCHAR) AS votes, 'v1.1.0' AS prompt_version, d.lang, d.source
FROM (SELECT message_id, list_sort(list({'model': model, 'label': label, 'reason': CAST(NULL AS VARCHAR)})) AS votes
      FROM classifications WHERE prompt_version = 'v1.1.0' AND label = 'uncertain' GROUP BY message_id) q
LEFT JOIN documents d ON d.doc_id = q.message_id
WHERE NOT EXISTS (SELECT 1 FROM corrections r WHERE r.message_id = q.message_id AND r.prompt_version = 'v1.1.0')"""))(
    _review)

register("pending", W(["classifications"], """
SELECT d.doc_id AS message_id, d.lang, d.source, d.n_chars, d.text, k.model, 'v1.1.0' AS prompt_version
FROM documents d CROSS JOIN (VALUES ('mA'), ('mB'), ('mC'), ('mD')) k(model)
WHERE NOT EXISTS (SELECT 1 FROM classifications c WHERE c.message_id = d.doc_id AND c.model = k.model
                  AND c.prompt_version = 'v1.1.0')"""))(
    lambda s, sf: K.pending(_docs_as_messages(s, sf), MODELS + ["mD"], _c(s, sf), "v1.1.0"))

_STRATA_SQL = [
    ("read_inbox", "in_inbox = 1 AND is_unread = 0"),
    ("unread_inbox", "in_inbox = 1 AND is_unread = 1"),
    ("promotions", "list_bool_or(list_transform(labels, lambda l: contains(lower(l), 'promotions')))"),
    ("social", "list_bool_or(list_transform(labels, lambda l: contains(lower(l), 'social')))"),
    ("updates", "list_bool_or(list_transform(labels, lambda l: contains(lower(l), 'updates')))"),
]
register("stratified_sample", W(["messages"], "\nUNION ALL\n".join(
    f"""(SELECT '{n}' AS stratum, message_id, from_email, from_name, subject FROM messages
   WHERE message_id IS NOT NULL AND coalesce({cond}, false) ORDER BY date_ts DESC NULLS LAST, path, mbox_offset LIMIT 40)"""
    for n, cond in _STRATA_SQL)))(
    lambda s, sf: K.stratified_sample(_m(s, sf), 200, ["message_id", "from_email", "from_name", "subject"]))


# ---------------------------------------------------------------- retention rules
from ..operators import audit as AU  # noqa: E402
from ..operators import rule_index as RI  # noqa: E402
from ..operators import rules as R  # noqa: E402
from . import duck_rules as DR  # noqa: E402

# Derived from the driver data: the fixture's own sender population.
NOISY_PLAIN = ["noreply@medium.com"]
NOISY_EXCL = [("ship@amazon.com", ["invoice", "statement"]), ("d3.example.com", ["re-order", "Payment due"]),
              ("example.com", ["policy update"])]
INDUSTRY = [("Parcel carriers", ["track@mail.ups.com", "fedex.com"])]
ALL_PRUNE_RULES = R.STANDING_RULES + R.industry_rules(INDUSTRY) + R.noisy_rules(NOISY_PLAIN, NOISY_EXCL)


def _cand_sql(rules, cols="path, mbox_offset, message_id, thread_id, from_email, subject"):
    return f"""cand AS (SELECT {cols}, rule_no, {DR.names(rules)}[rule_no] AS category
  FROM (SELECT *, {DR.first_match(rules, AS_OF)} AS rule_no FROM messages) x WHERE rule_no IS NOT NULL)"""


def _prune_sql(rules):
    return f"""WITH {_cand_sql(rules)},
ct AS (SELECT DISTINCT lower(trim(email)) AS from_email, true AS is_contact FROM contacts),
rt AS (SELECT DISTINCT thread_id, true AS replied FROM messages WHERE in_sent = 1 AND thread_id IS NOT NULL),
p AS (SELECT c.*, CASE WHEN ct.is_contact THEN 'contact' WHEN rt.replied THEN 'replied_thread' END AS protected_by
      FROM cand c LEFT JOIN ct ON c.from_email = ct.from_email LEFT JOIN rt ON c.thread_id = rt.thread_id)
"""


def _prune(rules):
    return lambda s, sf: R.prune(_m(s, sf), rules, fx.contacts(s, sf), AS_OF)


_PRUNE_COLS = "path, mbox_offset, message_id, from_email, subject, rule_no, category, protected_by"
register("prune", W(["messages", "contacts"], _prune_sql(R.STANDING_RULES) + f"""
SELECT {_PRUNE_COLS}, CASE WHEN protected_by IS NULL THEN 'prune' ELSE 'skip' END AS decision FROM p"""))(
    _prune(R.STANDING_RULES))

register("prune_all_rules", W(["messages", "contacts"], _prune_sql(ALL_PRUNE_RULES) + f"""
SELECT {_PRUNE_COLS}, CASE WHEN protected_by IS NULL THEN 'prune' ELSE 'skip' END AS decision FROM p"""))(
    _prune(ALL_PRUNE_RULES))

# the same rules as rows, found by a join on senders and subject words
register("prune_rule_table", W(["messages", "contacts"], _prune_sql(ALL_PRUNE_RULES) + f"""
SELECT {_PRUNE_COLS}, CASE WHEN protected_by IS NULL THEN 'prune' ELSE 'skip' END AS decision FROM p"""))(
    lambda s, sf: RI.prune_by_table(_m(s, sf), RI.rule_rows(s, ALL_PRUNE_RULES), fx.contacts(s, sf), AS_OF))


def _prune_noisy_join(spark, sf):
    lines = [(a, []) for a in NOISY_PLAIN] + NOISY_EXCL
    noisy = spark.createDataFrame([(a, k, i) for i, (a, k) in enumerate(lines)], "address string, exclude_keywords array<string>, line_no long")
    return R.prune_with_noisy(_m(spark, sf), R.STANDING_RULES + R.industry_rules(INDUSTRY), noisy, fx.contacts(spark, sf), AS_OF)


register("prune_noisy_join", W(["messages", "contacts"], _prune_sql(ALL_PRUNE_RULES) + f"""
SELECT {_PRUNE_COLS}, CASE WHEN protected_by IS NULL THEN 'prune' ELSE 'skip' END AS decision FROM p"""))(
    _prune_noisy_join)

register("run_summary", W(["messages", "contacts"], _prune_sql(R.STANDING_RULES) + """
SELECT category, CAST(SUM(CASE WHEN protected_by IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS moved,
  CAST(SUM(CASE WHEN protected_by IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed
FROM p GROUP BY category"""))(
    lambda s, sf: R.run_summary(_prune(R.STANDING_RULES)(s, sf)))

register("rescue", W(["messages"], f"""WITH {_cand_sql(R.RESCUE_RULES, 'path, mbox_offset, message_id, from_email, subject')}
SELECT * FROM cand"""))(
    lambda s, sf: R.rescue(_m(s, sf), R.RESCUE_RULES, AS_OF))

register("label_reference", W(["messages"], f"""WITH {_cand_sql(R.REFERENCE_RULES, 'path, mbox_offset, message_id, from_email, subject')}
SELECT * FROM cand"""))(
    lambda s, sf: R.label_reference(_m(s, sf), R.REFERENCE_RULES, AS_OF))


def _applied(spark, sf):
    m = _m(spark, sf)
    out = R.apply_actions(m, _prune(R.STANDING_RULES)(spark, sf), "prune")
    return out.select("path", "mbox_offset", "in_trash", F.to_json("labels").alias("labels"))


_APPLIED_SQL = W(["messages", "contacts"], _prune_sql(R.STANDING_RULES) + """
SELECT m.path, m.mbox_offset, CASE WHEN p.category IS NOT NULL THEN 1 ELSE m.in_trash END AS in_trash,
  CAST(to_json(CASE WHEN p.category IS NOT NULL
       THEN list_concat(coalesce(m.labels, CAST([] AS VARCHAR[])), list_filter(['Trash', 'Audit/Pruned/' || p.category],
                   lambda x: NOT list_contains(coalesce(m.labels, CAST([] AS VARCHAR[])), x)))
       ELSE m.labels END) AS VARCHAR) AS labels
FROM messages m LEFT JOIN (SELECT * FROM p WHERE protected_by IS NULL) p ON m.path = p.path AND m.mbox_offset = p.mbox_offset""")
register("apply_prune_actions", _APPLIED_SQL)(_applied)


@register("apply_prune_by_file", _APPLIED_SQL)
def _applied_by_file(spark, sf):
    """R5 on a versioned table: version 0 holds the messages, version 1 names new files where the run has hits."""
    table = VersionedTable(spark, checkpoint_dir(spark, f"versioned-{uuid.uuid4().hex}")).create(_m(spark, sf))
    R.apply_by_file(table, _prune(R.STANDING_RULES)(spark, sf), "prune")
    return table.read().select("path", "mbox_offset", "in_trash", F.to_json("labels").alias("labels"))


def _applied_rescue(spark, sf):
    m = _m(spark, sf)
    out = R.apply_actions(m, R.rescue(m, R.RESCUE_RULES, AS_OF), "rescue")
    return out.select("path", "mbox_offset", "in_trash", F.to_json("labels").alias("labels"))


register("apply_rescue_actions", W(["messages"], f"""WITH {_cand_sql(R.RESCUE_RULES, 'path, mbox_offset')}
SELECT m.path, m.mbox_offset, CASE WHEN c.category IS NOT NULL THEN 0 ELSE m.in_trash END AS in_trash,
  CAST(to_json(CASE WHEN c.category IS NOT NULL
       THEN list_concat(list_filter(coalesce(m.labels, CAST([] AS VARCHAR[])), lambda x: x <> 'Trash'),
                   list_filter(['Reference', 'Audit/Rescued/' || c.category],
                               lambda x: NOT list_contains(coalesce(m.labels, CAST([] AS VARCHAR[])), x)))
       ELSE m.labels END) AS VARCHAR) AS labels
FROM messages m LEFT JOIN cand c ON m.path = c.path AND m.mbox_offset = c.mbox_offset"""))(
    _applied_rescue)

_PREVIEW_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN {DR.predicate(r, AS_OF)} THEN {i} END" for i, r in enumerate(R.STANDING_RULES, 1)) + "], lambda x: x IS NOT NULL)"
register("preview", W(["messages"], f"""WITH x AS (
  SELECT path, mbox_offset, message_id, date_ts, from_email, subject, unnest({_PREVIEW_HITS}) AS rule_no FROM messages),
counts AS (SELECT rule_no, COUNT(*) AS matches FROM x GROUP BY rule_no),
top AS (SELECT *, row_number() OVER (PARTITION BY rule_no ORDER BY date_ts DESC NULLS LAST, path, mbox_offset) AS rank FROM x)
SELECT t.rule_no, {DR.names(R.STANDING_RULES)}[t.rule_no] AS category, c.matches, CAST(t.rank AS INTEGER) AS rank,
  t.path, t.mbox_offset, t.message_id, t.date_ts, t.from_email, t.subject
FROM top t JOIN counts c ON t.rule_no = c.rule_no WHERE t.rank <= 10"""))(
    lambda s, sf: R.preview(_m(s, sf), R.STANDING_RULES, AS_OF, 10))

_NOISY_RULE = R.Rule("noisy", category_any=R.NOISY_CATEGORIES, older_than="180d", not_starred=True,
                     not_important=True, not_reference=True, in_trash=False)
register("noisy_senders", W(["messages"], f"""
SELECT from_email, count, read_pct, starred FROM (
  SELECT lower(from_email) AS from_email, COUNT(*) AS count,
    CAST(floor(CAST(SUM(CASE WHEN coalesce(is_unread, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) * 100 / COUNT(*)) AS BIGINT) AS read_pct,
    CAST(SUM(coalesce(is_starred, 0)) AS BIGINT) AS starred
  FROM messages WHERE {DR.predicate(_NOISY_RULE, AS_OF)} AND from_email IS NOT NULL GROUP BY lower(from_email)) g
WHERE count >= 5 AND read_pct <= 10"""))(
    lambda s, sf: R.noisy_senders(_m(s, sf), AS_OF))

register("exclude_contacts", W(["messages", "contacts"], """
SELECT path, mbox_offset, from_email FROM messages m
WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE lower(trim(c.email)) = m.from_email)"""))(
    lambda s, sf: R.exclude_contacts(_m(s, sf), fx.contacts(s, sf)).select("path", "mbox_offset", "from_email"))

for _null_aware, _name in ((False, "threads_without_reply"), (True, "threads_without_reply_null_aware")):
    register(_name, W(["messages"], "SELECT path, mbox_offset, thread_id FROM messages m WHERE thread_id IS NOT NULL AND " + (
        "thread_id NOT IN (SELECT DISTINCT thread_id FROM messages WHERE in_sent = 1)" if _null_aware else
        "NOT EXISTS (SELECT 1 FROM messages s WHERE s.in_sent = 1 AND s.thread_id = m.thread_id)")))(
        (lambda n: lambda s, sf: M.threads_without_reply(_m(s, sf), null_aware=n).select("path", "mbox_offset", "thread_id"))(_null_aware))

# mail in which no sent message lacks a thread: NOT IN has rows to give
_THREADED = "(SELECT * FROM messages WHERE thread_id IS NOT NULL OR in_sent = 0)"


def _threaded(spark, sf):
    return _m(spark, sf).where("thread_id IS NOT NULL OR in_sent = 0")


register("threads_without_reply_null_aware_threaded", W(["messages"], f"""
SELECT path, mbox_offset, thread_id FROM {_THREADED} m WHERE thread_id IS NOT NULL
  AND thread_id NOT IN (SELECT DISTINCT thread_id FROM {_THREADED} s WHERE in_sent = 1)"""))(
    lambda s, sf: M.threads_without_reply(_threaded(s, sf), null_aware=True).select("path", "mbox_offset", "thread_id"))

register("one_way_threads_null_aware_threaded", W(["messages"], _ONE_WAY.replace("FROM messages r", f"FROM {_THREADED} r").replace("{cond}", (
    f"r.thread_id NOT IN (SELECT DISTINCT thread_id FROM {_THREADED} s WHERE in_sent = 1)"))))(
    lambda s, sf: M.one_way_threads(_threaded(s, sf), null_aware=True))

register("exclude_replied", W(["messages"], """
SELECT path, mbox_offset, thread_id FROM messages m
WHERE NOT EXISTS (SELECT 1 FROM messages s WHERE s.in_sent = 1 AND s.thread_id = m.thread_id)"""))(
    lambda s, sf: R.exclude_replied(_m(s, sf), _m(s, sf)).select("path", "mbox_offset", "thread_id"))

register("exclude_replied_conversations", W(["conversation_messages"], """
SELECT message_id, thread_id FROM conversation_messages m
WHERE NOT EXISTS (SELECT 1 FROM conversation_messages s WHERE s.in_sent = 1 AND s.thread_id = m.thread_id)"""))(
    lambda s, sf: R.exclude_replied(fx.conversation_messages(s, sf), fx.conversation_messages(s, sf))
                   .select("message_id", "thread_id"))


# ---------------------------------------------------------------- audit
def _a(spark, sf):
    return fx.audit(spark, sf)


_P = "action IN ('pruned', 'trash')"
_R = "action IN ('rescued', 'rescue')"
register("audit_totals", W(["audit"], f"SELECT {D.count_if(_P)} AS pruned, {D.count_if(_R)} AS rescued FROM audit"))(
    lambda s, sf: AU.audit_totals(_a(s, sf)))

register("audit_totals_since", W(["audit"], f"""
SELECT {D.count_if(_P)} AS pruned, {D.count_if(_R)} AS rescued FROM audit WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'"""))(
    lambda s, sf: AU.audit_totals(_a(s, sf), since="2024-01-15 00:00:00"))

register("audit_by_category", W(["audit"], f"""
SELECT category, {D.count_if(_P)} AS pruned, {D.count_if(_R)} AS rescued FROM audit GROUP BY category"""))(
    lambda s, sf: AU.audit_by_category(_a(s, sf)))

register("audit_conflict_senders", W(["audit"], f"""
SELECT sender, pruned, rescued FROM (SELECT sender, {D.count_if(_P)} AS pruned, {D.count_if(_R)} AS rescued
  FROM audit WHERE sender IS NOT NULL AND sender <> '' GROUP BY sender) g WHERE pruned > 0 AND rescued > 0"""))(
    lambda s, sf: AU.audit_conflict_senders(_a(s, sf)))

_NEAR = f"""
SELECT message_id, p.category AS pruned_as, r.category AS rescued_as, p.sender AS sender, p.subject AS subject FROM (
  SELECT message_id,
    arg_min({{'ts': ts, 'category': category, 'sender': sender, 'subject': subject}}, {{'t': ts, 'l': event_id}}) FILTER (WHERE {_P}) AS p,
    arg_min({{'ts': ts, 'category': category, 'sender': sender, 'subject': subject}}, {{'t': ts, 'l': event_id}}) FILTER (WHERE {_R}) AS r
  FROM audit WHERE message_id IS NOT NULL GROUP BY message_id) g
WHERE p IS NOT NULL AND r IS NOT NULL"""
register("audit_near_misses", W(["audit"], _NEAR))(lambda s, sf: AU.audit_near_misses(_a(s, sf)))
register("audit_near_misses_strict", W(["audit"], _NEAR + " AND r.ts > p.ts"))(
    lambda s, sf: AU.audit_near_misses(_a(s, sf), strict_order=True))


# ---------------------------------------------------------------- text
from ..functions import text as TX  # noqa: E402
from . import duck_text as DT  # noqa: E402


def _pages(spark, sf):
    return fx.table(spark, sf, "pages")


register("strip_html", f"SELECT page_id, {DT.strip_html('html')} AS text FROM pages")(
    lambda s, sf: _pages(s, sf).select("page_id", TX.strip_html("html").alias("text")))

register("redact_injection", W(["injected_bodies"], f"""
SELECT doc_id, {DT.redact_injection('body_text')} AS body FROM injected_bodies"""))(
    lambda s, sf: fx.injected_bodies(s, sf).select("doc_id", TX.redact_injection("body_text").alias("body")))

register("redact_pii", W(["injected_bodies"], f"""
SELECT doc_id, {DT.redact_pii('body_text')} AS body FROM injected_bodies"""))(
    lambda s, sf: fx.injected_bodies(s, sf).select("doc_id", TX.redact_pii("body_text").alias("body")))

register("sanitize", W(["injected_bodies"], f"""
SELECT doc_id, {DT.sanitize('body_text', False, True)} AS body FROM injected_bodies"""))(
    lambda s, sf: fx.injected_bodies(s, sf).select("doc_id", TX.sanitize("body_text", False, True).alias("body")))

register("sanitize_html", f"""
SELECT page_id, {DT.sanitize('html', True, False)} AS body FROM pages""")(
    lambda s, sf: _pages(s, sf).select("page_id", TX.sanitize("html", True, False).alias("body")))


def _turns(spark, sf):
    d = fx.injected_bodies(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return d.select("doc_id", TX.build_user_turn(
        F.concat(F.col("source"), F.lit("@docs.example")), F.col("lang"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))),
        F.lit(None).cast("string"), TX.sanitize("body_text", False)).alias("user_turn"))


register("build_user_turn", W(["injected_bodies"], f"""
SELECT b.doc_id, 'From: ' || d.source || '@docs.example' || chr(10) || 'Subject: '
  || CASE WHEN b.doc_id % 4 <> 0 THEN 'Doc ' || CAST(b.doc_id AS VARCHAR) ELSE '(no subject)' END
  || chr(10) || 'Date: ' || chr(10) || chr(10) || {DT.sanitize('b.body_text', False, False)} AS user_turn
FROM injected_bodies b JOIN documents d ON b.doc_id = d.doc_id"""))(_turns)


def _preview(spark, sf):
    p, trunc = TX.body_preview("text")
    return fx.table(spark, sf, "documents").select("doc_id", p.alias("preview"), trunc.alias("truncated"))


_SAN_DOC = DT.sanitize("text", False, False)
_PREV_BODY = DT.strip(f"replace(replace({_SAN_DOC}, '[EMAIL_CONTENT]', ''), '[/EMAIL_CONTENT]', '')")
register("body_preview", f"""
SELECT doc_id, substr(b, 1, 400) AS preview, length(b) > 400 AS truncated
FROM (SELECT doc_id, {_PREV_BODY} AS b FROM documents) x""")(_preview)


def _responses(spark, sf):
    return TX.parse_label_responses(fx.responses(spark, sf)).drop("raw_response")


_T0 = DT.strip("raw_response")
_T = DT.strip("CASE WHEN ends_with(fb, '```') THEN substr(fb, 1, length(fb) - 3) ELSE fb END")
register("parse_label_response", W(["responses"], f"""
SELECT doc_id,
  CASE WHEN p IS NULL THEN 'uncertain'
       WHEN lower(json_extract_string(p, '$.label')) IN ('keep', 'delete', 'uncertain') THEN lower(json_extract_string(p, '$.label'))
       ELSE 'uncertain' END AS label,
  TRY_CAST(json_extract_string(p, '$.confidence') AS DOUBLE) AS confidence,
  json_extract_string(p, '$.reason') AS reason,
  CASE WHEN p IS NULL THEN 'json_parse_error' END AS error
FROM (SELECT doc_id,
        CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t
             WHEN lb > 1 AND json_valid(substr(t, 1, lb)) AND json_type(substr(t, 1, lb)) = 'OBJECT' THEN substr(t, 1, lb)
             WHEN lb > 1 AND substr(t, lb - 1, 1) <> '"' AND json_valid(substr(t, 1, lb - 1) || '"' || substr(t, lb))
               THEN substr(t, 1, lb - 1) || '"' || substr(t, lb) END AS p
      FROM (SELECT doc_id, t, CASE WHEN instr(reverse(t), '}}') > 0 THEN length(t) - instr(reverse(t), '}}') + 1 END AS lb
            FROM (SELECT doc_id, CASE WHEN fb IS NULL THEN t0 ELSE {_T} END AS t
                  FROM (SELECT doc_id, t0, CASE WHEN starts_with(t0, '```') THEN
                          CASE WHEN instr(t0, chr(10)) > 0 THEN substr(t0, instr(t0, chr(10)) + 1) ELSE substr(t0, 4) END
                        END AS fb
                        FROM (SELECT doc_id, {_T0} AS t0 FROM responses) a) b) c) d) e"""))(_responses)


# ---------------------------------------------------------------- search
from ..operators import search as SE  # noqa: E402

_DUCK_TOK = "list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _duck_tokens(x):
    return _DUCK_TOK.format(x=x)


def _doc_index(spark, sf):
    return SE.build_index(fx.table(spark, sf, "documents"), "doc_id", ["text"])


register("build_index", f"""
SELECT 'text' AS field, token, doc_id, COUNT(*) AS tf
FROM (SELECT doc_id, unnest({_duck_tokens('text')}) AS token FROM documents) x GROUP BY token, doc_id""")(_doc_index)


def _search_sql(query, n):
    toks = ", ".join(f"'{t}'" for t in query.split())
    return f"""
SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE d.doc_id IN (
  SELECT doc_id FROM (SELECT doc_id, unnest({_duck_tokens('text')}) AS token FROM documents) x
  WHERE token IN ({toks}) GROUP BY doc_id HAVING COUNT(DISTINCT token) = {n})"""


for _q in ("the of", "queeux ouch"):
    register("search_" + _q.replace(" ", "_"), _search_sql(_q, len(_q.split())))(
        (lambda q: lambda s, sf: SE.search(fx.table(s, sf, "documents").select("doc_id", "lang", "n_chars"),
                                           _doc_index(s, sf), q, "doc_id"))(_q))

def _msg_search_sql(tokens):
    found = "\n    UNION ALL ".join(f"SELECT path, mbox_offset, unnest({_duck_tokens(f)}) AS token FROM full_messages" for f in SE.INDEX_FIELDS)
    return f"""
SELECT path, mbox_offset, subject, from_email FROM full_messages SEMI JOIN (
  SELECT path, mbox_offset FROM ({found}) x
  WHERE token IN ({', '.join(repr(t) for t in tokens)}) GROUP BY path, mbox_offset HAVING COUNT(DISTINCT token) = {len(tokens)}) k
  USING (path, mbox_offset)"""


def _message_index(spark, sf):
    """The messages' stored index; written once a session and state of the tables, as a mail store keeps its own."""
    full = fx.full_messages(spark, sf)
    # file, length and time of what the index was made of
    made_of = full.inputFiles()
    root = checkpoint_dir(spark, "index-" + hashlib.sha256(repr((spark.sparkContext.applicationId, _stamps(spark, made_of))).encode()).hexdigest()[:24])
    index = SE.StoredIndex(spark, root)
    if not index.additions():
        index.add(SE.build_index(full, M.KEY, packed="blocks"), "all")
    return index


def _stamps(spark, files):
    out = []
    for f in sorted(files):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((f, s.getLen(), s.getModificationTime()))
    return out


for _name, _q, _toks in (("search_messages", "Google ALERT", ["google", "alert"]), ("search_messages_folded", "Etre queeau", ["etre", "queeau"])):
    register(_name, W(["messages", "full_messages"], _msg_search_sql(_toks)))(
        (lambda q: lambda s, sf: SE.search(_m(s, sf).select("path", "mbox_offset", "subject", "from_email"),
                                           _message_index(s, sf), q, M.KEY))(_q))


# ---------------------------------------------------------------- scoring
from ..operators import score as SC  # noqa: E402


def _flagged(spark, sf):
    return SC.with_protection_flags(_m(spark, sf), fx.contacts(spark, sf))


def _duck_clause_chain(drop):
    subj = "lower(coalesce(subject, ''))"
    clauses = [
        ("forwarded", "keep", "0.8", f"regexp_matches({subj}, '{SC.FWD_RE}')"),
        ("auto_reply", "delete", "0.9", DR._subject(SC.AUTOREPLY)),
        ("contact", "keep", "0.9", "coalesce(is_contact, false)"),
        ("replied_thread", "keep", "0.9", "coalesce(replied, false)"),
        ("receipt_or_travel", "keep", "0.85", DR._subject(SC.RECEIPTS)),
        ("signature_request", "keep", "0.85", DR._sender(SC.SIGNATURE_DOMAINS)),
        ("mailing_list", "delete", "0.8", f"regexp_matches({subj}, '{SC.LIST_RE}')"),
        ("expired_notice", "delete", "0.8", DR._subject(SC.NOTICES)),
        ("bulk_category", "delete", "0.7", "coalesce(lower(category) IN ('promotions', 'social'), false)"),
        ("no_reply_sender", "delete", "0.6", f"coalesce(regexp_matches(lower(from_email), '{SC.NO_REPLY_RE}'), false)"),
    ]
    whens = " ".join(f"WHEN {c} THEN {{'label': '{lab}', 'confidence': CAST({conf} AS DOUBLE), 'reason': '{n}'}}"
                     for n, lab, conf, c in clauses if n != drop)
    return f"CASE {whens} ELSE {{'label': 'uncertain', 'confidence': CAST(NULL AS DOUBLE), 'reason': 'no_rule'}} END"


_FLAGS = """flagged AS (SELECT m.*, ct.from_email IS NOT NULL AS is_contact,
    rt.thread_id IS NOT NULL AS replied
  FROM messages m
  LEFT JOIN (SELECT DISTINCT lower(trim(email)) AS from_email FROM contacts) ct ON m.from_email = ct.from_email
  LEFT JOIN (SELECT DISTINCT thread_id FROM messages WHERE in_sent = 1 AND thread_id IS NOT NULL) rt
    ON m.thread_id = rt.thread_id)"""
register("rule_classify", W(["messages", "contacts"], f"""WITH {_FLAGS},
v AS (""" + "\nUNION ALL\n".join(
    f"SELECT path, mbox_offset, '{name}' AS model, {_duck_clause_chain(drop)} AS v FROM flagged"
    for name, drop in SC.RULE_MODELS.items()) + """)
SELECT path, mbox_offset, model, 'v1.7.0' AS prompt_version, v.label AS label, v.confidence AS confidence, v.reason AS reason
FROM v"""))(
    lambda s, sf: SC.rule_classify(_flagged(s, sf), "v1.7.0", key=M.KEY))


register("rule_vote", W(["messages", "contacts"], f"""WITH {_FLAGS},
v AS (""" + "\nUNION ALL\n".join(
    f"SELECT path, mbox_offset, {_duck_clause_chain(drop)}.label AS label FROM flagged"
    for name, drop in SC.RULE_MODELS.items()) + """)
SELECT path, mbox_offset, 'v1.7.0' AS prompt_version,
  CASE WHEN MIN(label) = MAX(label) THEN MIN(label) ELSE 'uncertain' END AS vote, COUNT(label) AS n_votes
FROM v GROUP BY path, mbox_offset"""))(
    lambda s, sf: SC.rule_vote(_flagged(s, sf), "v1.7.0", key=M.KEY))


def _score_pipeline(spark, sf):
    """Plug-in path end to end: turns -> pending pairs -> batched classifier -> parse -> stored rows."""
    turns = SC.user_turns(fx.full_messages(spark, sf))
    done = (_m(spark, sf).where("mbox_offset % 3 = 0 AND message_id IS NOT NULL").select("message_id").distinct()
            .select("message_id", F.lit("kw-a").alias("model"), F.lit("v1.7.0").alias("prompt_version")))
    pairs = K.pending(turns, ["kw-a", "kw-b"], done, "v1.7.0")
    raw = SC.classify(pairs, SC.keyword_responder, "system", "v1.7.0", models=["kw-a", "kw-b"])
    stored, _errors = SC.split_errors(SC.parse_scored(raw, "2026-06-18T00:00:00Z"))
    return stored.drop("raw_response")


register("score_pipeline", W(["messages"], """
SELECT m.message_id, k.model, 'v1.7.0' AS prompt_version,
  CASE WHEN keep THEN 'keep' WHEN del THEN 'delete' ELSE 'uncertain' END AS label,
  CASE WHEN keep THEN 0.9::DOUBLE WHEN del THEN 0.8::DOUBLE END AS confidence,
  CASE WHEN keep THEN 'document' WHEN del THEN 'notice' END AS reason, '2026-06-18T00:00:00Z' AS classified_at
FROM (SELECT *, regexp_matches(lower(subject), 'invoice|statement|boarding') AS keep,
        regexp_matches(lower(subject), 'verification|alert|digest') AS del FROM messages) m
CROSS JOIN (VALUES ('kw-a'), ('kw-b')) k(model)
WHERE m.message_id IS NOT NULL AND NOT (k.model = 'kw-a' AND m.message_id IN (
  SELECT message_id FROM messages WHERE mbox_offset % 3 = 0 AND message_id IS NOT NULL))"""))(_score_pipeline)


register("browse_classifications", W(["classifications"], """
SELECT message_id, model, prompt_version, label, confidence, classified_at FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id, model, prompt_version ORDER BY classified_at DESC) AS rn
  FROM (SELECT *, '2026-01-01T00:00:00+00:00' AS classified_at FROM classifications
        UNION ALL
        SELECT message_id, model, prompt_version, 'uncertain' AS label, confidence, '2026-02-01T00:00:00+00:00'
        FROM classifications WHERE model = 'mB') u) r WHERE rn = 1
ORDER BY classified_at DESC, message_id, model, prompt_version"""))(
    lambda s, sf: K.browse_classifications(_upsert(s, sf)))

register("classification_facets", W(["classifications"], """
SELECT facet, value, count FROM (
  SELECT facet, value, count, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value ASC NULLS FIRST) AS rn
  FROM (SELECT facet, value, COUNT(*) AS count FROM (
    SELECT 'model' AS facet, model AS value FROM classifications
    UNION ALL SELECT 'prompt_version', prompt_version FROM classifications
    UNION ALL SELECT 'label', label FROM classifications) u GROUP BY facet, value) g) r WHERE rn <= 30"""))(
    lambda s, sf: M.facets(_c(s, sf), K.CLASSIFICATION_FACETS))

register("exclude_checkpointed", W(["audit"], """
SELECT d.doc_id AS message_id, d.lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.category = 'ai_classify' AND a.message_id = CAST(d.doc_id AS VARCHAR))"""))(
    lambda s, sf: K.exclude_checkpointed(_docs_as_messages(s, sf).select("message_id", "lang"), _a(s, sf)))

from ..functions import columns as C  # noqa: E402

register("sender_display", W(["messages"], """
SELECT path, mbox_offset, CASE WHEN coalesce(from_name, '') <> '' THEN from_name || ' <' || coalesce(from_email, '') || '>'
                         WHEN coalesce(from_email, '') <> '' THEN from_email ELSE '(unknown)' END AS sender
FROM messages"""))(
    lambda s, sf: _m(s, sf).select("path", "mbox_offset", C.sender_display("from_email", "from_name").alias("sender")))

register("vote_actions", W(["classifications"], """
SELECT message_id, prompt_version, vote, n_votes,
  CASE vote WHEN 'keep' THEN 'AI/Keep' WHEN 'delete' THEN 'AI/Delete' ELSE 'AI/Uncertain' END AS action_label
FROM (SELECT message_id, prompt_version, CASE WHEN MIN(label) = MAX(label) THEN MIN(label) ELSE 'uncertain' END AS vote,
        COUNT(label) AS n_votes FROM classifications GROUP BY message_id, prompt_version) v"""))(
    lambda s, sf: K.vote(_c(s, sf)).withColumn("action_label", C.action_label("vote")))


# ---------------------------------------------------------------- contact export, sender extraction
from ..sources import api as API  # noqa: E402
from ..sources import lists as LS  # noqa: E402


def _contact_exports(spark, sf):
    """People-API-shaped exports derived from the driver tables.

    connections: one person per customer, addresses in mixed case (a second
    one for every third customer); other contacts: one per supplier.
    """
    cust = fx.table(spark, sf, "customer")
    first = F.struct(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("@D"),
                              (F.col("c_custkey") % 13).cast("string"), F.lit(".Example.com")).alias("value"))
    second = F.struct(F.concat(F.lit("alt"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("value"))
    conns = cust.select(F.when(F.col("c_custkey") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
                        .alias("emailAddresses"))
    sup = fx.table(spark, sf, "supplier")
    other = sup.select(F.array(F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"),
                                                 F.lit("@Supply.example")).alias("value"))).alias("emailAddresses"))
    return conns, other


register("build_contacts", """
SELECT DISTINCT lower(email) AS email FROM (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) || '@D' || CAST(c_custkey % 13 AS VARCHAR) || '.Example.com' AS email FROM customer
  UNION ALL SELECT 'alt' || CAST(c_custkey AS VARCHAR) || '@x.org' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR) || '@Supply.example' FROM supplier) u
ORDER BY email""")(lambda s, sf: LS.build_contacts(*_contact_exports(s, sf)))

register("sender_extract", W(["messages"], """
SELECT path, mbox_offset,
  CASE WHEN e <> '' THEN e ELSE lower(from_raw) END AS sender
FROM (SELECT path, mbox_offset, from_raw,
        regexp_replace(lower(regexp_extract(from_raw, '[^<\\s]+@[^>\\s]+', 0)), '^[<>]+|[<>]+$', '', 'g') AS e
      FROM (SELECT path, mbox_offset, coalesce(from_name, '') || ' <' || upper(coalesce(from_email, 'nobody')) || '>' AS from_raw
            FROM messages) r) x"""))(
    lambda s, sf: _m(s, sf).select("path", "mbox_offset", F.concat(F.coalesce("from_name", F.lit("")), F.lit(" <"),
                                                         F.upper(F.coalesce("from_email", F.lit("nobody"))),
                                                         F.lit(">")).alias("from_raw"))
                   .select("path", "mbox_offset", API.sender_email(F.col("from_raw")).alias("sender")))


def _parsed_messages(spark, sf):
    from ..sources import parse as P
    return P.dedup_messages(_m(spark, sf)).select("path", "mbox_offset", "message_id", "subject")


register("dedup_messages", W(["messages"], """
SELECT path, mbox_offset, message_id, subject FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY path, mbox_offset) AS rn FROM messages) x
WHERE message_id IS NULL OR rn = 1"""))(_parsed_messages)


def _api_documents(spark, sf):
    """Documents as mailbox-API messages: a plain part and, for some, an HTML part, base64url without padding."""
    d = fx.table(spark, sf, "documents")
    data = F.regexp_replace(F.translate(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "+/", "-_"), "[=\\s]", "")
    part = lambda kind, c: F.struct(F.lit(kind).alias("mimeType"), F.struct(c.alias("data")).alias("body"))
    parts = F.when(F.col("doc_id") % 3 == 0, F.array(part("text/html", data))).when(
        F.col("doc_id") % 3 == 1, F.array(part("text/plain", data), part("image/png", F.lit("AA"))))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(header("FROM", F.concat(F.lit("Doc <D"), F.col("doc_id").cast("string"), F.lit("@X.example>"))),
                      header("Subject", F.col("source")))
    api = d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("threadId"), F.array(F.lit("INBOX")).alias("labelIds"),
                   F.struct(F.lit("multipart/mixed").alias("mimeType"), headers.alias("headers"),
                            F.struct(F.when(F.col("doc_id") % 3 == 2, data).alias("data")).alias("body"), parts.alias("parts")).alias("payload"))
    return API.api_to_messages(api).select("message_id", "thread_id", "from_email", "subject", "body_text", "has_reference")


register("api_messages", """
SELECT CAST(doc_id AS VARCHAR) AS message_id, lang AS thread_id, 'd' || doc_id || '@x.example' AS from_email,
  coalesce(source, '(no subject)') AS subject, coalesce(text, '') AS body_text, false AS has_reference FROM documents""")(_api_documents)
