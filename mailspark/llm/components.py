"""Connected components of a link table, by alternating star contraction.

Each round links every vertex to the smallest id around it (large star, then
small star).  Only minima are aggregated, so a vertex with many links is
combined on the map side and never gathered; each round is written to the
shared folder, so the plan stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    # every link now points from a larger id u to a smaller one v
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(links: DataFrame, a: str, b: str, name: str = "links") -> DataFrame:
    """(id, component) of every vertex that has a link; the component is its smallest id.

    Links to oneself and null ends are ignored.
    """
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    e = staged(e, f"{name}-edges")
    while True:
        # a forest of stars: each u has one v, and no v is itself a u
        many = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u", "left_semi")
        if many.unionByName(inner).isEmpty():
            break
        e = staged(_small_star(_large_star(e)), f"{name}-star")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
