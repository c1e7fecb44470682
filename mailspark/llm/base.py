"""What the operators share: session preparation, staged tables, Arrow text slices."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..util import ship_package

#: Rows and bytes of one Arrow batch.  Texts can be long, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that a kernel works on at once (one longer text is a slice of its own); with a line end
#: a row they stay below 2^20, the least size of the hash tables.
SLICE_BYTES = 1_000_000
#: Rows that a kernel works on at once.
SLICE_ROWS = 4096


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers and keep Arrow batches short."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the session's shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the job.
    """
    spark = df.sparkSession
    path = checkpoint_dir(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter that ``near`` sends to the tasks (8 MB).
FILTER_BITS = 1 << 26


def near(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``ids`` (one column): a Bloom filter of fixed size.

    Put before a join that would shuffle long texts of which few match.  It
    lets every match pass; with very many ids it lets all else pass too, and
    the join alone decides.
    """
    spark = df.sparkSession
    h = F.xxhash64(F.col(ids.columns[0]))
    places = F.array(F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(FILTER_BITS)))
    words = (ids.select(F.explode(places).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
             .collect())                                     # FILTER_BITS / 64 short rows at most
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    if words:
        table[np.array([w["word"] for w in words])] = np.array([w["bits"] for w in words], np.int64)
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def holds(p: pa.Array, q: pa.Array) -> pa.Array:
        t = sent.value
        x, y = (v.to_numpy(zero_copy_only=False) for v in (p, q))
        return pa.array((t[x >> 6] >> (x & 63) & 1 & t[y >> 6] >> (y & 63)).astype(bool))
    own = F.xxhash64(F.col(column))
    return df.filter(holds(F.pmod(own, F.lit(FILTER_BITS)), F.pmod(F.shiftright(own, 32), F.lit(FILTER_BITS))))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Yield (start, stop, texts) runs of rows whose texts hold about ``limit`` bytes; null texts become empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.string())
    arr = pc.fill_null(arr, "")
    n = len(arr)
    if not n:
        return
    total = np.cumsum(pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, base + limit, side="right"))
        stop = min(max(stop, start + 1), start + rows, n)
        yield start, stop, arr.slice(start, stop - start)
        start = stop


def kept_rows(df: DataFrame, column: str, judge) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, each by its own text: no join, so null and repeated ids are rows like any other.

    judge: called once a task, gives a function from an Arrow array of texts (null: empty) to a bool a text.
    """
    prepare(df.sparkSession)

    def run(batches):
        keep = judge()
        for batch in batches:
            for a, b, texts in text_slices(batch, column):
                yield batch.slice(a, b - a).filter(pa.array(keep(texts), pa.bool_()))
    return df.mapInArrow(run, df.schema)


def merged(batches, limit: int):
    """Arrow batches joined until they hold about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ended(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each with one line end put behind it, and where each text starts (one more than texts)."""
    big = pa.types.is_large_string(texts.type)
    kind = pa.large_string() if big else pa.string()
    arr = pc.binary_join_element_wise(texts, pa.scalar("", kind), pa.scalar("\n", kind))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if big else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return d, o - o[0]


def ids(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in and out)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
