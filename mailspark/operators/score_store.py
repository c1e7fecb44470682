"""Scores stored in buckets of (message_id, prompt_version), for upserts and votes without a shuffle of what is stored (K3).

A version of the store is a folder of Parquet files, a bucket a file, seen as
a bucketed table of the session.  Everything that asks per message (votes,
disagreements, outliers) groups by the bucket columns, so Spark aggregates
each bucket where it is; an upsert shuffles the new scores to the buckets of
the old, joins them there and writes the next version the same way.  A
version is complete with its success mark; a stopped upsert leaves the one
before it in place, and readers take the last complete one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import KEY, _first

VOTE = ["message_id", "model", "prompt_version"]


class ScoreStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def _write(self, df: DataFrame, version: int, dealt: bool = False) -> None:
        """dealt: the rows are in partitions of the buckets already."""
        place = f"{self.path}/v{version}"
        self._fs.delete(self._path(place), True)             # what a stopped upsert has left
        name = f"scores_{uuid.uuid4().hex}"
        df = df if dealt else df.repartition(self.buckets, *KEY)               # a task a bucket
        df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", place).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")                 # the files stay: its place is its own

    def create(self, scores: DataFrame) -> "ScoreStore":
        self._write(_latest(scores), 0)
        return self

    def read(self) -> DataFrame:
        """The stored scores, one row a (message, model, version), as a bucketed scan."""
        place = f"{self.path}/v{self.versions()[-1]}"
        columns = ", ".join(f"`{c}` {t}" for c, t in self.spark.read.parquet(place).dtypes)
        name = f"scores_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(KEY)}) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{place}'")
        return self.spark.table(name)

    def merged(self, new: DataFrame) -> DataFrame:
        """The stored scores with ``new`` over them: the latest of each (message, model, version), as K3 has it."""
        old = self.read()
        rest = [c for c in old.columns if c not in (*VOTE, "classified_at")]
        order = ["classified_at", *rest]
        own = _latest(new.select(*old.columns)).repartition(self.buckets, *KEY)
        o, n = old.alias("o"), own.alias("n")
        # joined by the bucket columns; the model, of which a message has few, is compared on the joined rows
        both = o.join(n, (F.col("o.message_id") == F.col("n.message_id")) & (F.col("o.prompt_version") == F.col("n.prompt_version"))
                      & F.arrays_overlap(F.array("o.model"), F.array("n.model")), "full_outer")

        def row(side):
            return F.when(F.col(f"{side}.message_id").isNotNull(), F.struct(*[F.col(f"{side}.{c}").alias(c) for c in order]))
        best = F.greatest(row("o"), row("n"))
        return both.select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in VOTE], best.alias("_b")).select(
            *[c if c in VOTE else F.col(f"_b.{c}").alias(c) for c in old.columns])

    def upsert(self, new: DataFrame) -> int:
        """Store the next version; returns its number."""
        version = self.versions()[-1] + 1
        self._write(self.merged(new), version, dealt=True)
        return version


def _latest(scores: DataFrame) -> DataFrame:
    """The latest row of each (message, model, version); rows without a message or version have no place in the store."""
    scores = scores.where("message_id IS NOT NULL AND prompt_version IS NOT NULL AND model IS NOT NULL")
    rest = [F.col(c).desc_nulls_last() for c in scores.columns if c not in (*VOTE, "classified_at")]
    return _first(scores, VOTE, [F.col("classified_at").desc_nulls_last(), *rest])
