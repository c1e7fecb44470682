"""Audit-log reports.

The audit log is append-only JSONL: ts, action, category, message_id, from
(``sender`` here), subject.  Actions are normalised first: the example rows
say trash/rescue while the code writes pruned/rescued (Q7).  Each report is
one aggregation; R12 joins the first pruned and the first rescued row of a
message, each ranked by (ts, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Action synonyms (Q7).
PRUNED = ("pruned", "trash")
RESCUED = ("rescued", "rescue")


def is_pruned(action="action") -> Column:
    return F.coalesce(F.col(action).isin(*PRUNED), F.lit(False))


def is_rescued(action="action") -> Column:
    return F.coalesce(F.col(action).isin(*RESCUED), F.lit(False))


def _since(a: DataFrame, since) -> DataFrame:
    return a if since is None else a.where(F.col("ts") >= F.lit(since))


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def audit_totals(a: DataFrame, since=None) -> DataFrame:
    """One row: pruned, rescued (optionally only rows with ts >= since)."""
    return _since(a, since).agg(_n(is_pruned()).alias("pruned"), _n(is_rescued()).alias("rescued"))


def audit_by_category(a: DataFrame, since=None) -> DataFrame:
    """Pruned / rescued per category, most pruned first."""
    return (_since(a, since).groupBy("category")
            .agg(_n(is_pruned()).alias("pruned"), _n(is_rescued()).alias("rescued"))
            .orderBy(F.col("pruned").desc(), F.col("category").asc_nulls_first()))


def audit_conflict_senders(a: DataFrame, since=None, sender: str = "sender") -> DataFrame:
    """Senders both pruned and rescued at least once."""
    g = (_since(a, since).where(F.col(sender).isNotNull() & (F.col(sender) != ""))
         .groupBy(sender).agg(_n(is_pruned()).alias("pruned"), _n(is_rescued()).alias("rescued")))
    return g.where((F.col("pruned") > 0) & (F.col("rescued") > 0)).orderBy(F.col("rescued").desc(), sender)


def audit_near_misses(a: DataFrame, since=None, strict_order: bool = False, sender: str = "sender",
                      line: str = "event_id") -> DataFrame:
    """Messages pruned and rescued: first pruned row vs first rescued row.

    ``strict_order=True`` also requires the rescue to come after the prune
    (the reference does not check the order).
    """
    a = _since(a, since).where(F.col("message_id").isNotNull())
    w = Window.partitionBy("message_id").orderBy("ts", line)

    def first(cond, side):
        return (a.where(cond).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                 .select("message_id", F.struct("ts", "category", F.col(sender).alias("sender"), "subject").alias(side)))
    g = first(is_pruned(), "p").join(first(is_rescued(), "r"), "message_id")
    if strict_order:
        g = g.where(F.col("r.ts") > F.col("p.ts"))
    return g.select("message_id", F.col("p.category").alias("pruned_as"), F.col("r.category").alias("rescued_as"),
                    F.col("p.sender").alias("sender"), F.col("p.subject").alias("subject"))


def append_audit(df: DataFrame, action: str, path: str) -> None:
    """K7: append audit rows (ts as UTC 'yyyy-MM-ddTHH:mm:ssZ') as JSON lines."""
    out = df.select(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
                    F.lit(action).alias("action"), "category", "message_id",
                    F.col("sender").alias("from"), "subject")
    out.write.mode("append").json(path)
