"""Scalar column functions (F8-F19): all native Spark expressions.

Every function returns a ``Column`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import col

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ts_of(epoch) -> Column:
    """UTC wall-clock TIMESTAMP_NTZ of epoch seconds (independent of session TZ)."""
    return F.timestamp_add("SECOND", col(epoch), F.expr(EPOCH_NTZ))


def epoch_of(ts) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ (UTC wall clock)."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), col(ts))


def epoch_text(epoch) -> Column:
    """text of ``datetime(x, 'unixepoch')``: 'yyyy-MM-dd HH:mm:ss' in UTC."""
    return F.date_format(ts_of(epoch), "yyyy-MM-dd HH:mm:ss")


def email_domain(email) -> Column:
    """F8: lower-cased text after the first '@'."""
    e = col(email)
    return F.lower(F.substring(e, F.instr(e, "@") + 1, F.length(e)))


def attachment_ext(name) -> Column:
    """text after the FIRST dot, lower-cased; '(no extension)' without a dot."""
    v = col(name)
    pos = F.instr(v, ".")
    return F.lower(F.when(pos > 0, F.substring(v, pos + 1, F.length(v))).otherwise(F.lit("(no extension)")))


# The label of the primary category, and the name of a message without one.
_PERSONAL, PRIMARY = "personal", "primary"


def category_of(labels="labels") -> Column:
    """Mail category (lower case) from the label array: 'Category X' or 'CATEGORY_X', the first; 'primary' without one."""
    found = F.filter(F.transform(F.coalesce(col(labels), F.array().cast("array<string>")),
                                 lambda x: F.regexp_extract(F.lower(x), "^category[ _](.+)$", 1)), lambda c: c != "")
    first = F.try_element_at(found, F.lit(1))
    return F.when(first.isNull() | (first == _PERSONAL), PRIMARY).otherwise(first)


# Age-bucket labels and their day limits.
AGE_BUCKETS = [
    (7, "1 – this week"),
    (30, "2 – this month"),
    (180, "3 – 1–6 months"),
    (365, "4 – 6–12 months"),
]
AGE_BUCKET_OLDEST = "5 – over a year"


def age_bucket(epoch, as_of_epoch: int) -> Column:
    """inbox age bucket of a message date against an explicit ``as_of``."""
    e = col(epoch)
    out = None
    for days, label in AGE_BUCKETS:
        cond = e >= F.lit(as_of_epoch - days * 86400)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(AGE_BUCKET_OLDEST)


def fixed_text(num, den, decimals: int, suffix: str = "") -> Column:
    """``printf('%.<d>f', num/den)`` for non-negative integer num, den > 0.

    Rounding is half-up on the exact rational value, computed in integer
    arithmetic, so it is identical in every engine and never loses digits
    (no double rounding of large byte sums).
    """
    n, d = col(num).cast("long"), col(den).cast("long")
    scale = 10 ** decimals
    scaled = int_div(n * (2 * scale) + d, d * 2)
    if decimals == 0:
        return F.concat(scaled.cast("string"), F.lit(suffix))
    whole = int_div(scaled, F.lit(scale))
    frac = F.lpad(F.pmod(scaled, F.lit(scale)).cast("string"), decimals, "0")
    return F.concat(whole.cast("string"), F.lit("."), frac, F.lit(suffix))


def int_div(a: Column, b: Column) -> Column:
    """Exact integral division (floor) for non-negative long operands."""
    exact = (a - F.pmod(a, b)).cast("decimal(38,0)")
    return (exact / b.cast("decimal(38,0)")).cast("long")


def confidence_bucket(conf) -> Column:
    """``round(cast(cast(conf*10 as int) as real)/10, 1)``: truncation toward zero."""
    return F.round((col(conf) * 10).cast("int").cast("double") / 10.0, 1)


def version_key(v) -> Column:
    """'v1.10.0' -> [1, 10, 0]; Spark arrays compare element-wise."""
    parts = F.split(F.regexp_replace(col(v), "^v", ""), "[.]")
    return F.transform(parts, lambda p: p.try_cast("int"))


def sender_display(email, name) -> Column:
    """'Name <email>' when a name is present, else email, else '(unknown)'."""
    e, n = col(email), col(name)
    return (F.when(F.coalesce(n, F.lit("")) != "", F.concat(n, F.lit(" <"), F.coalesce(e, F.lit("")), F.lit(">")))
             .when(F.coalesce(e, F.lit("")) != "", e)
             .otherwise(F.lit("(unknown)")))


# Vote -> action label.
ACTION_LABELS = {"keep": "AI/Keep", "delete": "AI/Delete", "uncertain": "AI/Uncertain"}


def action_label(vote) -> Column:
    """vote -> mailbox label name; anything else -> AI/Uncertain."""
    v = col(vote)
    out = F.when(v == "keep", ACTION_LABELS["keep"]).when(v == "delete", ACTION_LABELS["delete"])
    return out.otherwise(ACTION_LABELS["uncertain"])


def verdict_name(n_distinct, max_label) -> Column:
    """ensemble verdict of one (message, version) group."""
    nd, ml = col(n_distinct), col(max_label)
    return (F.when((nd == 1) & (ml == "keep"), "unanimous keep")
             .when((nd == 1) & (ml == "delete"), "unanimous delete")
             .when((nd == 1) & (ml == "uncertain"), "all uncertain")
             .otherwise("disagreement"))


# Day-of-week labels, Sunday = 0.
DAY_LABELS = ["0 – Sun", "1 – Mon", "2 – Tue", "3 – Wed", "4 – Thu", "5 – Fri", "6 – Sat"]


def day_of_week_label(ts) -> Column:
    """strftime('%w') label; Spark dayofweek is 1 = Sunday."""
    return F.element_at(F.array(*[F.lit(x) for x in DAY_LABELS]), F.dayofweek(col(ts)))
