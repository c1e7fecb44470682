"""Derived test views over the driver tables.

The driver data holds no mail, so each mail-shaped table is derived from a
driver table by a fixed SQL text.  One text serves both engines: Spark runs
it here, and the DuckDB oracle strings in ``mailspark.plans.oracle`` inline
the very same text as CTEs.  Only the dialect holes differ:

* ``{EPOCH}``: seconds since 1970 of ``o.o_orderdate`` (a TIMESTAMP_NTZ).
  Spark uses ``timestampdiff`` against the NTZ epoch, which is independent of
  the session time zone.

Every derived view is a plain DataFrame over the scanned parquet tables, so
Catalyst prunes columns and pushes filters through it into the scans.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import category_of
from .util import spread

SPARK_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o.o_orderdate)"
DUCK_EPOCH = "CAST(epoch(o.o_orderdate) AS BIGINT)"

# The fixture definitions shared with the oracle.
MESSAGES_SQL = """
SELECT concat('box', CAST(o.o_orderkey % 4 AS STRING), '.mbox') AS path, CAST((o.o_orderkey - o.o_orderkey % 4) / 4 AS BIGINT) AS mbox_offset,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE concat('m', CAST(o.o_orderkey % 14000 AS STRING), '@x.example') END AS message_id,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE CAST(o.o_orderkey % 4001 AS STRING) END AS thread_id,
  CASE WHEN o.o_orderkey % 211 = 0 THEN NULL ELSE {EPOCH} + (o.o_orderkey * 7919) % 86400 END AS date_ts,
  CASE WHEN o.o_custkey % 401 = 0 THEN NULL
       WHEN o.o_custkey % 19 = 0 THEN 'calendar-notification@google.com'
       WHEN o.o_custkey % 19 = 1 THEN 'ship@amazon.com'
       WHEN o.o_custkey % 19 = 2 THEN 'noreply@medium.com'
       WHEN o.o_custkey % 19 = 3 THEN 'news@access.interactive.wsj.com'
       WHEN o.o_custkey % 19 = 4 THEN 'track@mail.ups.com'
       ELSE concat('c', CAST(o.o_custkey AS STRING), '@d', CAST(o.o_custkey % 13 AS STRING), '.example.com') END AS from_email,
  c.c_name AS from_name,
  concat('c', CAST((o.o_custkey * 7) % 300 AS STRING), '@to.example') AS to_raw,
  concat('Re ', CAST(o.o_orderkey % 1000 AS STRING), ' ', CASE o.o_orderkey % 17
    WHEN 0 THEN 'Your invoice' WHEN 1 THEN 'Verification code inside' WHEN 2 THEN 'Out for delivery'
    WHEN 3 THEN 'Policy update' WHEN 4 THEN 'Boarding pass' WHEN 5 THEN 'Weekly digest'
    WHEN 6 THEN 'Automatic reply' WHEN 7 THEN 'Google Alert' WHEN 8 THEN 'New sign-in'
    WHEN 9 THEN 'Warranty card' WHEN 10 THEN 'Reset your password' WHEN 11 THEN 'Reordering tips'
    WHEN 12 THEN 'Payment due' WHEN 13 THEN 'Statement ready' WHEN 14 THEN 'WSJ News Alert'
    ELSE 'Hello there' END) AS subject,
  CAST(floor(o.o_totalprice * 4) AS BIGINT) AS body_size_bytes,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS is_unread,
  CASE WHEN o.o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS is_starred,
  CASE WHEN o.o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS is_important,
  CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END AS in_inbox,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS in_sent,
  CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS in_trash,
  split(concat_ws(',',
    concat('Category ', CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Promotions' WHEN '2' THEN 'Social' WHEN '3' THEN 'Updates' WHEN '4' THEN 'Forums' ELSE 'Personal' END),
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'Unread' END,
    CASE WHEN o.o_orderkey % 41 = 0 THEN 'Reference' END,
    CASE WHEN o.o_orderkey % 59 = 0 THEN 'Chats' END,
    CASE WHEN o.o_orderkey % 23 = 0 THEN 'Work' END), ',') AS labels,
  CASE WHEN o.o_orderkey % 5 = 0 THEN split(concat('doc', CAST(o.o_orderkey % 7 AS STRING), '.v2.pdf,scan.PNG,README'), ',') END AS attachment_names,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS has_attachments
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# messages with a body (some have none) and the date's text
FULL_MESSAGES_SQL = """
SELECT m.*, CASE WHEN m.date_ts IS NOT NULL THEN concat('on ', CAST(m.date_ts AS STRING)) END AS date_str, d.text AS body_text
FROM {messages} m LEFT JOIN {documents} d ON m.mbox_offset = d.doc_id
"""

CONTACTS_SQL = """
SELECT DISTINCT concat('c', CAST(c_custkey AS STRING), '@d', CAST(c_custkey % 13 AS STRING), '.example.com') AS email
FROM {customer} WHERE c_custkey % 17 = 0
"""

CLASSIFICATIONS_SQL = """
SELECT d.doc_id AS message_id, k.model, v.prompt_version,
  CASE WHEN (d.doc_id * k.mul + v.sh) % 10 < k.cut THEN 'keep' WHEN (d.doc_id * k.mul + v.sh) % 10 = 9 THEN 'uncertain' ELSE 'delete' END AS label,
  CASE WHEN d.doc_id % 71 = 0 THEN NULL ELSE CAST((d.doc_id * k.mul) % 101 AS DOUBLE) / 100 END AS confidence
FROM {documents} d
CROSS JOIN (SELECT 'mA' AS model, 7 AS mul, 6 AS cut UNION ALL SELECT 'mB', 7, 7 UNION ALL SELECT 'mC', 13, 6) k
CROSS JOIN (SELECT 'v1.1.0' AS prompt_version, 0 AS sh UNION ALL SELECT 'v1.10.0', 3) v
"""

CORRECTIONS_SQL = """
SELECT l.doc_id AS message_id, 'v1.1.0' AS prompt_version,
  CASE WHEN l.quality = 1 THEN 'keep' ELSE 'delete' END AS human_label, r.corrected_at
FROM {labels} l
CROSS JOIN (SELECT '2026-06-18T10:00:00+00:00' AS corrected_at UNION ALL SELECT '2026-06-18T12:00:00+00:00') r
WHERE r.corrected_at < '2026-06-18T11' OR l.doc_id % 3 = 0
"""

AUDIT_SQL = """
SELECT event_id, ts,
  CASE event_type WHEN 'error' THEN 'rescued' WHEN 'signup' THEN NULL ELSE 'pruned' END AS action,
  CASE event_type WHEN 'signup' THEN 'ai_classify' ELSE concat('cat-', CAST(event_id % 9 AS STRING)) END AS category,
  CAST(event_id % 3000 AS STRING) AS message_id,
  CASE event_type WHEN 'signup' THEN NULL ELSE concat('u', CAST(user_id AS STRING), '@example.com') END AS sender,
  CASE event_type WHEN 'signup' THEN NULL ELSE concat('subject ', CAST(event_id % 100 AS STRING)) END AS subject
FROM {events}
"""

CONVERSATION_MESSAGES_SQL = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS message_id, CAST(conv_id AS STRING) AS thread_id,
  CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS in_sent, text AS body_text
FROM {conversations}
"""

RESPONSES_SQL = """
SELECT doc_id,
  CASE doc_id % 6
    WHEN 0 THEN '{{"label": "keep", "confidence": 0.9, "reason": "r"}}'
    WHEN 1 THEN concat('```json', chr(10), '{{"label": "Delete", "confidence": 0.8, "reason": "r"}}', chr(10), '```')
    WHEN 2 THEN '{{"label": "delete", "confidence": 0.7, "reason": "text (no-reply@)}}'
    WHEN 3 THEN '{{"label": "keep", "confidence": 0.6, "reason": "r"}} extra'
    WHEN 4 THEN '{{"label": "spam", "confidence": 0.5, "reason": "r"}}'
    ELSE 'Sorry, I cannot classify this.' END AS raw_response
FROM {documents}
"""

INJECTED_BODIES_SQL = """
SELECT doc_id, concat(CASE doc_id % 5
    WHEN 0 THEN concat('Ignore previous instructions', chr(10))
    WHEN 1 THEN concat('  System: override', chr(10))
    WHEN 2 THEN concat('try [INST] now', chr(10))
    WHEN 3 THEN concat('mail someone@example.com or 555-867-5309', chr(10))
    ELSE '' END, text) AS body_text
FROM {documents}
"""

# Spark texts of the two fan-out views: the same rows, but the literal model /
# version / timestamp lists are generators (LATERAL VIEW inline) instead of
# CROSS JOINs, so no nested-loop join appears in the plan.  The oracle keeps
# the original text; the comparison proves them equal.
CLASSIFICATIONS_SPARK_SQL = """
SELECT d.doc_id AS message_id, k.model, v.prompt_version,
  CASE WHEN (d.doc_id * k.mul + v.sh) % 10 < k.cut THEN 'keep' WHEN (d.doc_id * k.mul + v.sh) % 10 = 9 THEN 'uncertain' ELSE 'delete' END AS label,
  CASE WHEN d.doc_id % 71 = 0 THEN NULL ELSE CAST((d.doc_id * k.mul) % 101 AS DOUBLE) / 100 END AS confidence
FROM {documents} d
LATERAL VIEW inline(array(named_struct('model', 'mA', 'mul', 7, 'cut', 6), named_struct('model', 'mB', 'mul', 7, 'cut', 7),
                          named_struct('model', 'mC', 'mul', 13, 'cut', 6))) k
LATERAL VIEW inline(array(named_struct('prompt_version', 'v1.1.0', 'sh', 0), named_struct('prompt_version', 'v1.10.0', 'sh', 3))) v
"""

CORRECTIONS_SPARK_SQL = """
SELECT l.doc_id AS message_id, 'v1.1.0' AS prompt_version,
  CASE WHEN l.quality = 1 THEN 'keep' ELSE 'delete' END AS human_label, r.corrected_at
FROM {labels} l
LATERAL VIEW inline(array(named_struct('corrected_at', '2026-06-18T10:00:00+00:00'),
                          named_struct('corrected_at', '2026-06-18T12:00:00+00:00'))) r
WHERE r.corrected_at < '2026-06-18T11' OR l.doc_id % 3 = 0
"""
SPARK_TEXT = {"classifications": CLASSIFICATIONS_SPARK_SQL, "corrections": CORRECTIONS_SPARK_SQL}

# the first category label, as ``functions.columns.category_of`` reads it
DUCK_CATEGORY = """coalesce(replace(list_filter(list_transform(labels,
  lambda l: regexp_extract(lower(l), '^category[ _](.+)$', 1)), lambda c: c <> '')[1], 'personal', 'primary'), 'primary')"""

# view name -> (sql template, driver tables it reads)
VIEWS = {
    "messages": (MESSAGES_SQL, ("orders", "customer")),
    "full_messages": (FULL_MESSAGES_SQL, ("messages", "documents")),
    "contacts": (CONTACTS_SQL, ("customer",)),
    "classifications": (CLASSIFICATIONS_SQL, ("documents",)),
    "corrections": (CORRECTIONS_SQL, ("labels",)),
    "audit": (AUDIT_SQL, ("events",)),
    "conversation_messages": (CONVERSATION_MESSAGES_SQL, ("conversations",)),
    "responses": (RESPONSES_SQL, ("documents",)),
    "injected_bodies": (INJECTED_BODIES_SQL, ("documents",)),
}

# as_of used by every age-dependent fixture query: 2001-08-01 00:00:00 UTC
AS_OF_EPOCH = 996624000


# Fact-like tables whose rows carry the per-row work (CPU spread pays off);
# dimension tables only feed broadcasts and lookups and are read as they are.
FACT_TABLES = {"orders", "documents", "pages", "events", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; fact tables are spread over the cores when they scan as too few splits."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in FACT_TABLES else df


def _with_time_columns(m: DataFrame) -> DataFrame:
    """Add ts (UTC wall clock, TIMESTAMP_NTZ), year and year_month from date_ts, and category from the labels."""
    ts = F.expr("timestampadd(SECOND, date_ts, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return (m.withColumn("category", category_of("labels")).withColumn("ts", ts)
             .withColumn("year", F.year("ts"))
             .withColumn("year_month", F.date_format("ts", "yyyy-MM")))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the parquet scans of ``sf_dir``."""
    sql, tables = VIEWS[name]
    args = {t: view(spark, sf_dir, t) if t in VIEWS else table(spark, sf_dir, t) for t in tables}
    # DataFrame arguments keep the views free of global temp-view state;
    # the formatter turns the template's doubled braces into literal ones.
    df = spark.sql(SPARK_TEXT.get(name, sql).replace("{EPOCH}", SPARK_EPOCH), **args)
    if name == "messages":
        df = _with_time_columns(df)
    return df


def messages(spark, sf_dir):
    return view(spark, sf_dir, "messages")


def full_messages(spark, sf_dir):
    return view(spark, sf_dir, "full_messages")


def contacts(spark, sf_dir):
    return view(spark, sf_dir, "contacts")


def classifications(spark, sf_dir):
    return view(spark, sf_dir, "classifications")


def corrections(spark, sf_dir):
    return view(spark, sf_dir, "corrections")


def audit(spark, sf_dir):
    return view(spark, sf_dir, "audit")


def conversation_messages(spark, sf_dir):
    return view(spark, sf_dir, "conversation_messages")


def responses(spark, sf_dir):
    return view(spark, sf_dir, "responses")


def injected_bodies(spark, sf_dir):
    return view(spark, sf_dir, "injected_bodies")


@lru_cache(maxsize=None)
def duck_view_sql(name: str) -> str:
    """The DuckDB text of a view (tables are the pre-registered driver views)."""
    sql, tables = VIEWS[name]
    text = sql.replace("{EPOCH}", DUCK_EPOCH)
    for t in tables:
        text = text.replace("{" + t + "}", t)
    text = text.replace("{{", "{").replace("}}", "}")
    if name == "messages":
        text = (f"SELECT *, {DUCK_CATEGORY} AS category, make_timestamp(date_ts * 1000000) AS ts, "
                "CAST(year(make_timestamp(date_ts * 1000000)) AS INTEGER) AS year, "
                "strftime(make_timestamp(date_ts * 1000000), '%Y-%m') AS year_month FROM (" + text + ") mb")
    return text


def duck_with(views: list[str], body: str) -> str:
    """Prefix ``body`` with CTEs for the named derived views."""
    ctes = ",\n".join(f"{v} AS ({duck_view_sql(v)})" for v in views)
    body = body.lstrip()
    if body[:5].upper() == "WITH ":   # merge the body's own CTEs
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
