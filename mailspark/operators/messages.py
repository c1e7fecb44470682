"""Queries over the ``messages`` table.

Each function takes the messages DataFrame (plus options) and returns a
DataFrame with exactly the documented columns.  All of them are single-scan
aggregations or top-k plans: Spark runs them as partial HashAggregate ->
shuffle on the group key -> final HashAggregate, or as TakeOrderedAndProject
(per-partition top-k, then a merge of k rows per partition) for top-k lists.
No operator collects a group or a table to the driver.

Determinism: SQLite's bare columns are replaced by ``max_by(col, newest_key)``
(the newest message, the message key breaking ties), and every top-k list
gets the group key as a final tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..util import KEY, count_if, flag, names, newest_key, sort_small

# Columns hidden in the default table browse (B1).
HIDDEN_COLUMNS = ["headers_json", "path", "mbox_offset", "mbox_size", "references_hdr",
                  "x_received", "bcc_raw", "delivered_to", "content_type"]
# Default facet columns.
FACET_COLUMNS = ["year_month", "from_email", "is_unread", "is_starred", "in_inbox",
                 "in_sent", "in_trash", "has_attachments"]
# Classifier input columns.
SCORING_COLUMNS = ["message_id", "from_email", "from_name", "subject", "date_str", "body_text"]


def _received(m: DataFrame) -> DataFrame:
    """P12: 'not sent' = in_sent = 0 OR in_sent IS NULL."""
    return m.where(~flag("in_sent"))


def _volume_aggs():
    return [
        F.count(F.lit(1)).alias("total"),
        F.sum("is_unread").cast("long").alias("unread"),
        F.sum("is_starred").cast("long").alias("starred"),
        count_if(F.col("in_inbox") == 1).alias("inbox"),
        count_if(F.col("in_sent") == 1).alias("sent"),
        F.sum("has_attachments").cast("long").alias("with_attachments"),
    ]


def by_month(m: DataFrame) -> DataFrame:
    """A1: message volume by year_month, newest month first."""
    return (m.where(F.col("year_month").isNotNull())
             .groupBy("year_month").agg(*_volume_aggs())
             .transform(lambda d: sort_small(d, F.col("year_month").desc())))


def by_year(m: DataFrame) -> DataFrame:
    """A2: message volume by year."""
    return (m.where(F.col("year").isNotNull())
             .groupBy("year").agg(*_volume_aggs())
             .transform(lambda d: sort_small(d, F.col("year").desc())))


def received_per_year(m: DataFrame) -> DataFrame:
    """A3: received (not sent) mail per year."""
    return (_received(m.where(F.col("year").isNotNull()))
            .groupBy("year")
            .agg(F.count(F.lit(1)).alias("received"),
                 F.sum("is_unread").cast("long").alias("still_unread"),
                 F.sum("is_starred").cast("long").alias("starred"))
            .transform(lambda d: sort_small(d, F.col("year").desc())))


def sent_per_year(m: DataFrame) -> DataFrame:
    """A4: sent mail per year."""
    return (m.where(F.col("year").isNotNull() & (F.col("in_sent") == 1))
             .groupBy("year").agg(F.count(F.lit(1)).alias("sent"))
             .transform(lambda d: sort_small(d, F.col("year").desc())))


def _received_sent_aggs():
    return [F.count(F.lit(1)).alias("total"),
            count_if(~flag("in_sent")).alias("received"),
            count_if(F.col("in_sent") == 1).alias("sent")]


def by_day_of_week(m: DataFrame) -> DataFrame:
    """A5: volume by UTC day of week, labelled '0 – Sun' .. '6 – Sat'."""
    return (m.where(F.col("date_ts").isNotNull())
             .groupBy(C.day_of_week_label(C.ts_of("date_ts")).alias("day_of_week"))
             .agg(*_received_sent_aggs())
             .transform(lambda d: sort_small(d, "day_of_week")))


def by_hour_of_day(m: DataFrame) -> DataFrame:
    """Volume by UTC hour."""
    return (m.where(F.col("date_ts").isNotNull())
             .groupBy(F.hour(C.ts_of("date_ts")).alias("hour_utc"))
             .agg(*_received_sent_aggs())
             .transform(lambda d: sort_small(d, "hour_utc")))


def _with_newest(top: DataFrame, rows: DataFrame, by: str, value: str, key, out: str) -> DataFrame:
    """``out``: the newest row's ``value`` of each ``by`` in ``top`` (the first k of a report, so few of the rows meet)."""
    w = Window.partitionBy(by).orderBy(newest_key(key=key).desc())
    named = (rows.select(by, value, "date_ts", *names(key)).join(F.broadcast(top.select(by)), by, "left_semi")
                 .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(by, F.col(value).alias(out)))
    return top.join(named, by, "left")


def top_senders(m: DataFrame, k: int = 200, key=KEY) -> DataFrame:
    """Top senders by message count; numbers first (a hash aggregate), names for the first k only."""
    rows = m.where(F.col("from_email").isNotNull())
    top = (rows.groupBy("from_email")
               .agg(F.count(F.lit(1)).alias("message_count"), F.sum("is_unread").cast("long").alias("unread"),
                    F.sum("is_starred").cast("long").alias("starred"), F.min("date_ts").alias("_lo"), F.max("date_ts").alias("_hi"))
               .orderBy(F.col("message_count").desc(), F.col("from_email")).limit(k))
    return (_with_newest(top, rows, "from_email", "from_name", key, "from_name")
            .select("from_email", "from_name", "message_count", "unread", "starred",
                    C.epoch_text("_lo").alias("first_seen"), C.epoch_text("_hi").alias("last_seen"))
            .orderBy(F.col("message_count").desc(), F.col("from_email")))


def top_senders_inbox(m: DataFrame, k: int = 200, key=KEY) -> DataFrame:
    """Top senders among inbox messages."""
    rows = m.where((F.col("in_inbox") == 1) & F.col("from_email").isNotNull())
    top = (rows.groupBy("from_email")
               .agg(F.count(F.lit(1)).alias("message_count"), F.sum("is_unread").cast("long").alias("unread"),
                    F.max("date_ts").alias("_hi"))
               .orderBy(F.col("message_count").desc(), F.col("from_email")).limit(k))
    return (_with_newest(top, rows, "from_email", "from_name", key, "from_name")
            .select("from_email", "from_name", "message_count", "unread", C.epoch_text("_hi").alias("last_message"))
            .orderBy(F.col("message_count").desc(), F.col("from_email")))


def top_senders_trash(m: DataFrame, k: int = 100, key=KEY) -> DataFrame:
    """Top senders among trashed messages (unsubscribe candidates)."""
    rows = m.where((F.col("in_trash") == 1) & F.col("from_email").isNotNull())
    top = (rows.groupBy("from_email").agg(F.count(F.lit(1)).alias("trashed_count"), F.max("date_ts").alias("_hi"))
               .orderBy(F.col("trashed_count").desc(), F.col("from_email")).limit(k))
    return (_with_newest(top, rows, "from_email", "from_name", key, "from_name")
            .select("from_email", "from_name", "trashed_count", C.epoch_text("_hi").alias("last_trashed"))
            .orderBy(F.col("trashed_count").desc(), F.col("from_email")))


def storage_by_sender(m: DataFrame, k: int = 100, key=KEY) -> DataFrame:
    """A10: storage footprint by sender; text sizes plus the exact byte total."""
    rows = m.where(F.col("from_email").isNotNull())
    top = (rows.groupBy("from_email")
               .agg(F.count(F.lit(1)).alias("message_count"), F.sum("body_size_bytes").cast("long").alias("total_bytes"))
               .orderBy(F.col("total_bytes").desc(), F.col("from_email")).limit(k))
    return (_with_newest(top, rows, "from_email", "from_name", key, "from_name")
            .select("from_email", "from_name", "message_count",
                    C.fixed_text("total_bytes", F.lit(1048576), 1, " MB").alias("total_size"),
                    C.fixed_text("total_bytes", F.col("message_count") * 1024, 1, " KB").alias("avg_size"),
                    "total_bytes")
            .orderBy(F.col("total_bytes").desc(), F.col("from_email")))


def _with_greatest(top: DataFrame, rows: DataFrame, by: str, value: str) -> DataFrame:
    """``value``: the greatest text of each ``by`` in ``top``."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc_nulls_last())
    found = (rows.select(by, value).join(F.broadcast(top.select(by)), by, "left_semi")
                 .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))
    return top.join(found, by, "left")


def busiest_threads(m: DataFrame, k: int = 100) -> DataFrame:
    """Most active threads; participants and subject are looked up for the first k only."""
    rows = m.where(F.col("thread_id").isNotNull())
    top = (rows.groupBy("thread_id")
               .agg(F.count(F.lit(1)).alias("message_count"), F.min("date_ts").alias("_lo"), F.max("date_ts").alias("_hi"))
               .orderBy(F.col("message_count").desc(), F.col("thread_id")).limit(k))
    people = (rows.join(F.broadcast(top.select("thread_id")), "thread_id", "left_semi")
                  .groupBy("thread_id").agg(F.count_distinct("from_email").alias("participants")))
    return (_with_greatest(top, rows, "thread_id", "subject").join(people, "thread_id")
            .select("thread_id", "message_count", C.epoch_text("_lo").alias("started"), C.epoch_text("_hi").alias("last_message"),
                    "participants", "subject")
            .orderBy(F.col("message_count").desc(), F.col("thread_id")))


def explode_array(m: DataFrame, column: str, alias: str = "value") -> DataFrame:
    """Lateral expansion of an array column (NULL arrays give no rows)."""
    return m.select("*", F.explode(column).alias(alias))


def attachment_types(m: DataFrame, k: int = 50) -> DataFrame:
    """Attachment counts by file extension (text after the first dot)."""
    return (explode_array(m, "attachment_names").groupBy(C.attachment_ext("value").alias("extension"))
                 .agg(F.count(F.lit(1)).alias("count"))
                 .orderBy(F.col("count").desc(), F.col("extension"))
                 .limit(k))


def by_label(m: DataFrame) -> DataFrame:
    """Message count per label."""
    return (explode_array(m, "labels", "label")
            .groupBy("label").agg(F.count(F.lit(1)).alias("message_count"))
            .orderBy(F.col("message_count").desc(), F.col("label")))


def top_recipients(m: DataFrame, k: int = 100) -> DataFrame:
    """Most-emailed recipients (sent mail)."""
    return (m.where((F.col("in_sent") == 1) & F.col("to_raw").isNotNull())
             .groupBy("to_raw")
             .agg(F.count(F.lit(1)).alias("sent_count"),
                  C.epoch_text(F.max("date_ts")).alias("last_sent"))
             .orderBy(F.col("sent_count").desc(), F.col("to_raw"))
             .limit(k))


def inbox_age_buckets(m: DataFrame, as_of_epoch: int) -> DataFrame:
    """Inbox debt by age bucket relative to an explicit ``as_of``."""
    return (m.where(F.col("in_inbox") == 1)
             .groupBy(C.age_bucket("date_ts", as_of_epoch).alias("age_bucket"))
             .agg(F.count(F.lit(1)).alias("messages"), F.sum("is_unread").cast("long").alias("unread"))
             .transform(lambda d: sort_small(d, "age_bucket")))


def unread_by_sender(m: DataFrame, k: int = 200, key=KEY) -> DataFrame:
    """Unread messages per sender (senders with at least one unread)."""
    rows = _received(m).where(F.col("from_email").isNotNull())
    top = (rows.groupBy("from_email")
               .agg(F.count(F.lit(1)).alias("total_received"), F.sum("is_unread").cast("long").alias("unread"),
                    F.max("date_ts").alias("_last"))
               .where(F.col("unread") > 0).orderBy(F.col("unread").desc(), F.col("from_email")).limit(k))
    return (_with_newest(top, rows, "from_email", "from_name", key, "from_name")
            .select("from_email", "from_name", "total_received", "unread",
                    C.fixed_text(F.col("unread") * 100, "total_received", 0, "%").alias("unread_pct"),
                    C.epoch_text("_last").alias("last_message"))
            .orderBy(F.col("unread").desc(), F.col("from_email")))


def sender_domain_volume(m: DataFrame, k: int = 100) -> DataFrame:
    """Volume by sender domain."""
    return (m.where(F.col("from_email").contains("@"))
             .groupBy(C.email_domain("from_email").alias("domain"))
             .agg(F.count_distinct("from_email").alias("distinct_addresses"),
                  F.count(F.lit(1)).alias("message_count"),
                  F.sum("is_unread").cast("long").alias("unread"),
                  C.epoch_text(F.max("date_ts")).alias("last_message"))
             .orderBy(F.col("message_count").desc(), F.col("domain"))
             .limit(k))


def replied_threads(m: DataFrame) -> DataFrame:
    """Distinct non-NULL thread ids that contain a sent message."""
    return m.where((F.col("in_sent") == 1) & F.col("thread_id").isNotNull()).select("thread_id").distinct()


def threads_without_reply(m: DataFrame, candidates: DataFrame | None = None, null_aware: bool = False) -> DataFrame:
    """Candidate rows whose thread_id is not a replied thread.

    Default: NULL-safe anti join (a NULL thread in the sent set never blocks
    anything).  ``null_aware=True`` keeps SQL ``NOT IN`` semantics exactly
    (Q1): any NULL thread id among sent messages empties the result.  That is
    expressed as an ordinary shuffle anti join plus a scalar-subquery filter,
    so it never falls back to a broadcast nested-loop join.
    """
    cand = (candidates if candidates is not None else m).where(F.col("thread_id").isNotNull())
    out = cand.join(replied_threads(m), "thread_id", "left_anti")
    if null_aware:
        nulls = (m.where((F.col("in_sent") == 1) & F.col("thread_id").isNull())
                  .agg(F.count(F.lit(1)).alias("n")))
        out = out.where(nulls.scalar() == 0)
    return out


def one_way_threads(m: DataFrame, k: int = 200, null_aware: bool = False, key=KEY) -> DataFrame:
    """Threads never replied to.

    One aggregate per thread over a single scan: received messages are
    counted and summarised while sent ones only flag the thread; threads with
    any sent message are dropped.  Equal to "received rows whose thread is not
    in the sent-thread set, grouped", without the second scan and anti join.
    ``null_aware=True`` keeps ``NOT IN`` semantics (Q1): a sent message with a
    NULL thread id empties the result.
    """
    recv = ~flag("in_sent")
    rows = m.where(F.col("thread_id").isNotNull())
    g = (rows.groupBy("thread_id")
             .agg(F.sum(F.when(F.col("in_sent") == 1, 1).otherwise(0)).alias("_sent"),
                  count_if(recv).alias("received_count"),
                  F.max(F.when(recv, F.col("date_ts"))).alias("_last"))
             .where((F.col("_sent") == 0) & (F.col("received_count") > 0)))
    if null_aware:
        nulls = (m.where((F.col("in_sent") == 1) & F.col("thread_id").isNull())
                  .agg(F.count(F.lit(1)).alias("n")))
        g = g.where(nulls.scalar() == 0)
    top = g.orderBy(F.col("received_count").desc(), F.col("thread_id")).limit(k)
    received = rows.where(recv)
    named = _with_newest(_with_greatest(top, received, "thread_id", "subject"), received, "thread_id", "from_email", key, "primary_sender")
    return (named.select("thread_id", "received_count", "subject", "primary_sender", C.epoch_text("_last").alias("last_received"))
                 .orderBy(F.col("received_count").desc(), F.col("thread_id")))


def monthly_unread_rate(m: DataFrame) -> DataFrame:
    """Unread rate per month of received mail."""
    agg = (_received(m.where(F.col("year_month").isNotNull()))
           .groupBy("year_month")
           .agg(F.count(F.lit(1)).alias("received"), F.sum("is_unread").cast("long").alias("unread")))
    return (agg.select("year_month", "received", "unread",
                       C.fixed_text(F.col("unread") * 100, "received", 1, "%").alias("unread_rate"))
               .transform(lambda d: sort_small(d, F.col("year_month").desc())))


def import_summary(ledger: DataFrame) -> DataFrame:
    """Import ledger status, newest import first."""
    return (ledger.select(
        "mbox_path",
        C.fixed_text("mbox_size_bytes", F.lit(1073741824), 2, " GB").alias("mbox_size"),
        "messages_imported",
        F.when(F.col("mbox_size_bytes") > 0,
               C.fixed_text(F.col("last_offset") * 100, "mbox_size_bytes", 1, "%")).alias("pct_done"),
        "started_at", "updated_at",
        F.coalesce(F.col("completed_at"), F.lit("(in progress)")).alias("completed_at"),
        "id").orderBy(F.col("id").desc()).drop("id"))


def messages_without_date(m: DataFrame, k: int = 200) -> DataFrame:
    """Messages whose Date header did not parse, in file order."""
    date_str = F.col("date_str") if "date_str" in m.columns else F.lit(None).cast("string").alias("date_str")
    return (m.where(F.col("date_ts").isNull())
             .select("message_id", "from_email", "subject", date_str, *KEY)
             .orderBy(*KEY).limit(k))


def _newest(df: DataFrame, key, asc: bool = False) -> DataFrame:
    if asc:  # NULL dates first, as in SQLite
        return df.orderBy(F.col("date_ts").asc_nulls_first(), *names(key))
    return df.orderBy(F.col("date_ts").desc_nulls_last(), *names(key))


def unread_inbox(m: DataFrame, k: int = 500, key=KEY) -> DataFrame:
    """Unread inbox messages, newest first."""
    rows = m.where((F.col("in_inbox") == 1) & (F.col("is_unread") == 1))
    return (_newest(rows, key).limit(k)
            .select(C.epoch_text("date_ts").alias("date"), "from_email", "from_name", "subject",
                    F.to_json("labels").alias("labels"), "message_id"))


def starred(m: DataFrame, k: int = 500, key=KEY) -> DataFrame:
    """Starred messages, newest first."""
    rows = m.where(F.col("is_starred") == 1)
    return (_newest(rows, key).limit(k)
            .select(C.epoch_text("date_ts").alias("date"), "from_email", "subject",
                    F.to_json("labels").alias("labels"), "message_id"))


def oldest_unread(m: DataFrame, k: int = 200, key=KEY) -> DataFrame:
    """Unread messages, oldest first (undated first)."""
    rows = m.where(F.col("is_unread") == 1)
    return (_newest(rows, key, asc=True).limit(k)
            .select(C.epoch_text("date_ts").alias("date"), "from_email", "subject",
                    F.to_json("labels").alias("labels"), "message_id"))


def largest_messages(m: DataFrame, k: int = 100, key=KEY) -> DataFrame:
    """T4: largest messages by size."""
    return (m.orderBy(F.col("body_size_bytes").desc_nulls_last(), *names(key)).limit(k)
             .select(C.epoch_text("date_ts").alias("date"), "from_email", "subject",
                     C.fixed_text("body_size_bytes", F.lit(1048576), 1, " MB").alias("size"),
                     "body_size_bytes", "has_attachments",
                     F.to_json("attachment_names").alias("attachment_names"), "message_id"))


def with_attachments(m: DataFrame, k: int = 500, key=KEY) -> DataFrame:
    """T5: messages with attachments, newest first."""
    rows = m.where(F.col("has_attachments") == 1)
    return (_newest(rows, key).limit(k)
            .select(C.epoch_text("date_ts").alias("date"), "from_email", "subject",
                    F.to_json("attachment_names").alias("attachment_names"),
                    C.fixed_text("body_size_bytes", F.lit(1048576), 1, " MB").alias("size"),
                    "message_id"))


def browse(m: DataFrame) -> DataFrame:
    """B1: default table browse: hidden technical columns dropped, newest first.

    Arrays are rendered as JSON text, as the table stores them.
    """
    out = m.drop(*[c for c in HIDDEN_COLUMNS if c in m.columns])
    for c, t in out.dtypes:
        if t.startswith("array") or t.startswith("map"):
            out = out.withColumn(c, F.to_json(c))
    return out.orderBy(F.col("date_ts").desc_nulls_last(), *[F.col(c) for c in ("message_id",) if c in out.columns])


def facets(df: DataFrame, cols: list[str] | None = None, k: int = 30) -> DataFrame:
    """Facet counts for several columns in ONE scan.

    The facet columns are unpivoted with ``stack`` so a single aggregation
    (one shuffle on (facet, value)) counts every facet; a window keeps the top
    ``k`` values per facet.  The window partitions by facet only after the
    aggregation, over at most (#facets x #distinct values) rows.
    """
    cols = cols or [c for c in FACET_COLUMNS if c in df.columns]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (facet, value)"))
    counts = long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window
    w = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return (counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
                  .transform(lambda d: sort_small(d, "facet", F.col("count").desc())))


def scoring_input(m: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Classifier input projection: messages with an id, newest first."""
    cols = cols or [c for c in SCORING_COLUMNS if c in m.columns]
    return (m.where(F.col("message_id").isNotNull())
             .orderBy(F.col("date_ts").desc_nulls_last(), F.col("message_id"))
             .select(*cols))
