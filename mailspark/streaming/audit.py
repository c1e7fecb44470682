"""Streaming audit counts (St4): per-category pruned / rescued over a JSONL file stream.

A running aggregate in ``update`` mode: the state is one row per category
(bounded by the number of rules).  Each batch's changed rows are merged into a
small versioned table, whose latest version equals the batch report R10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import is_pruned, is_rescued
from ..sources.lists import AUDIT_SCHEMA, exists


def audit_counts_stream(spark: SparkSession, audit_dir: str) -> DataFrame:
    a = spark.readStream.schema(AUDIT_SCHEMA).json(audit_dir)
    return (a.groupBy("category")
             .agg(F.sum(F.when(is_pruned(), 1).otherwise(0)).cast("long").alias("pruned"),
                  F.sum(F.when(is_rescued(), 1).otherwise(0)).cast("long").alias("rescued")))


def _counts_at(spark: SparkSession, table: str, before: int | None = None) -> tuple[DataFrame, int]:
    """The counts of the latest complete version (below ``before``), and its number; -1 and no rows where there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    own = [int(n[8:]) for n in names if n.startswith("version=") and exists(spark, f"{table}/{n}/_SUCCESS")]
    own = [v for v in own if before is None or v < before]
    if not own:
        return spark.createDataFrame([], _COUNTS), -1
    return spark.read.schema(_COUNTS).parquet(f"{table}/version={max(own)}"), max(own)


_COUNTS = "category string, pruned long, rescued long"


def read_audit_counts(spark: SparkSession, table: str) -> DataFrame:
    """R10 as the stream has it: the latest version of the counts table."""
    return _counts_at(spark, table)[0].orderBy(F.col("pruned").desc(), F.col("category").asc_nulls_first())


def merge_counts(table: str):
    """Put the categories that a batch has changed over those of the version before it, as the batch's own version.

    A batch that is done again writes the same version again.  A version has a
    row a category, and all but the last two are deleted.
    """
    def run(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed = changed.persist()                          # read twice, with state behind it
        old, at = _counts_at(spark, table, batch_id)
        kept = old.join(changed.select("category"), old["category"].eqNullSafe(changed["category"]), "left_anti")
        kept.unionByName(changed).coalesce(1).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        changed.unpersist()
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("version=") and int(name[8:]) < at:
                fs.delete(s.getPath(), True)
    return run


def start_audit_counts(spark: SparkSession, audit_dir: str, table: str, checkpoint: str, trigger_once: bool = False):
    """Keep the counts in a table, merged by batch (St4); returns the StreamingQuery."""
    w = (audit_counts_stream(spark, audit_dir).writeStream.outputMode("update")
         .foreachBatch(merge_counts(table)).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if trigger_once else w).start()
