"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def flag(c) -> Column:
    """A 0/1 INTEGER flag treated as boolean, NULL as 0."""
    return F.coalesce(col(c), F.lit(0)) == 1


def count_if(cond: Column) -> Column:
    """Conditional count as BIGINT (sum of a 0/1 case)."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


#: Key of the messages table: an offset is unique only inside its file.
KEY = ("path", "mbox_offset")


def names(key) -> list[str]:
    """A key given as one column name or several, as a list."""
    return [key] if isinstance(key, str) else list(key)


def newest_key(date="date_ts", key=KEY) -> Column:
    """Deterministic total order for bare columns: newest date, then message key.

    NULL dates rank below every real date; the key is unique, so ties never
    make ``max_by`` pick an arbitrary row.
    """
    return F.struct(F.coalesce(col(date), F.lit(-(2 ** 63)).cast("long")).alias("d"), *[col(k) for k in names(key)])


def spread(df, min_partitions: int | None = None):
    """Round-robin an under-partitioned input over the cluster's cores.

    A table stored as one small file / row group scans as a single task, so
    all row-level CPU work (regexes over long texts, rule predicates) would
    run on one core.  Only when the scan yields fewer partitions than the
    default parallelism is a (small) round-robin shuffle added; a large
    table already has many splits and is returned untouched.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: leave the plan as is
        return df
    return df.repartition(target) if n < target else df


def sort_small(df, *cols):
    """Final ORDER BY for results whose size is bounded by a fixed domain.

    Months, hours, weekdays, age buckets, labels, (model, version) pairs, rule
    categories: such results have at most a few thousand rows at any data
    size.  A global ``orderBy`` would run a sampling job to range-partition
    them; one shuffle to a single partition and a local sort gives the same
    order without it.  The aggregation feeding it stays fully parallel.
    Never use this for outputs that grow with the data.
    """
    return df.repartition(1).sortWithinPartitions(*cols)


_SHIPPED: set = set()


def ship_package(spark=None) -> None:
    """Make ``mailspark`` importable in the executors' Python workers.

    Code that runs inside Python workers (data source readers, Arrow / pandas
    functions) references this package.  Once per application the package
    sources are zipped into the session's shared checkpoint folder and added
    with ``addPyFile`` (the same mechanism as ``--py-files``).  A no-op when
    there is no active classic session.
    """
    import hashlib
    import io
    import os
    import zipfile

    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: ship with the client's artifacts instead
        return
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    data = buf.getvalue()
    from .session import checkpoint_dir
    path = checkpoint_dir(spark, f"pyfiles/mailspark-{hashlib.sha1(data).hexdigest()[:16]}.zip")
    from pyarrow import fs
    filesystem, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    filesystem.create_dir(os.path.dirname(p), recursive=True)
    with filesystem.open_output_stream(p) as out:
        out.write(data)
    sc.addPyFile(path)
    _SHIPPED.add(key)
