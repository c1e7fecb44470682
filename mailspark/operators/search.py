"""Full-text search (K10 index build, Q1s match).

The index is a plain DataFrame of postings ``(field, token, <key>, tf)``:
text is lower-cased, stripped of the marks of Latin letters and split on runs
of non letter/number characters (as the reference's default tokenizer does).  ``build_index``
lets the rows of a key meet in one task, which counts their tokens; no token is a hot group.

``StoredIndex`` keeps a row a field, token and block of some hundred thousand
postings, which holds their keys and counts as bytes.  For it the texts are
not shuffled: a task packs the postings of the rows it has, and its blocks go
compressed, by bucket of tokens, through the one shuffle.  A key whose rows
were in several blocks has its counts summed when they are read.  The rows lie
in additions: a folder an addition, in it a folder a bucket of tokens, sorted by token inside
each file.  A lookup reads its tokens' buckets only, and of them the row groups
that hold them; more mail adds blocks and leaves the others as they are, and
additions of one level are merged when there are enough of them.

A search is implicit AND over the query tokens, in any indexed field:
postings of the query tokens -> count distinct tokens per key -> keys that
have them all.  The query tokens become a literal IN-list on the postings
scan, so a stored index is read only where those tokens live.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..util import names, ship_package
from . import posting_bytes

TOKEN_SPLIT = "[^\\p{L}\\p{N}]+"
# Indexed message fields.
INDEX_FIELDS = ["subject", "from_email", "from_name", "body_text"]


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and the letters without it (from the character database)."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xDF, 0x250)] + \
            [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x1E00, 0x1F00)]
    own = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and a == a.lower() and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in own), "".join(b for _, b in own)


MARKED, PLAIN = _plain_letters()
#: Combining marks, where a text writes them apart from their letter.
MARKS = "[\\u0300-\\u036F]+"


def fold(c):
    """Lower case without the marks of Latin letters."""
    return F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), MARKS, "")


def tokens(c):
    """Array of folded tokens of a text column."""
    return F.filter(F.split(fold(c), TOKEN_SPLIT, -1), lambda t: t != "")


#: Runs of letters and numbers: \p{L} and \p{N} are what Python's \w takes beside the underscore.
WORD = re.compile(r"[^\W_]+")


#: What ``fold`` does to a lower-cased token.
FOLDED = str.maketrans(MARKED, PLAIN)
_MARKS = re.compile("[\u0300-\u036f]+")
#: Tokens that are packed at once.
PACKED = 1 << 20
#: Folders of an addition.
BUCKETS = 64
#: A bucket's rows of a block: what ``StoredIndex`` keeps.
ROWS = pa.schema([("field", pa.string()), ("token", pa.string()), ("postings", pa.binary())])


class _Numbers(dict):
    """Number of each token's folded form, counted up as they come."""

    def __init__(self):
        super().__init__()
        self.folded: dict[str, int] = {}

    def __missing__(self, raw: str) -> int:
        token = raw if raw.isascii() else raw.translate(FOLDED)
        n = self[raw] = self.folded.setdefault(token, len(self.folded))
        return n


class _Postings:
    """The postings of some keys: token numbers with the field in them, places of the keys, counts."""

    def __init__(self, fields: list[str], schema: pa.Schema):
        self.fields, self.schema = fields, schema
        self._start()

    def _start(self):
        self.numbers, self.keys, self.summed_before = _Numbers(), [], None
        self.tokens, self.sizes, self.of = array("q"), array("q"), array("q")

    def add(self, texts: list[bytes | None]) -> None:
        """The texts of a row of the last key."""
        for f, raw in enumerate(texts):
            if raw:
                text = raw.decode("utf-8", "replace").lower()
                found = WORD.findall(text if text.isascii() else _MARKS.sub("", text))
                self.tokens.extend(map(self.numbers.__getitem__, found))
                self.sizes.append(len(found))
                self.of.append((len(self.keys) - 1) * len(self.fields) + f)

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, key, count) in order of code and key, each code and key once."""
        n = max(len(self.keys), 1)
        key, field = np.divmod(np.repeat(np.array(self.of), np.array(self.sizes)).astype(np.int64), len(self.fields))
        one, tf = (np.array(self.tokens, np.int64) * len(self.fields) + field) * n + key, None
        if self.summed_before:
            code, key, tf = self.summed_before
            one, tf = np.r_[code * n + key, one], np.r_[tf, np.ones(len(one), np.int64)]
            order = np.argsort(one, kind="stable")
            one, tf = one[order], tf[order]
        else:
            one.sort()
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][:len(one)])
        tf = np.diff(np.r_[first, len(one)]) if tf is None else np.add.reduceat(tf, first)
        return *np.divmod(one[first], n), tf

    def shorten(self) -> int:
        """Sum the counts held, as one key's rows may be many; how many are left."""
        self.summed_before = self.summed()
        self.tokens, self.sizes, self.of = array("q"), array("q"), array("q")
        return len(self.summed_before[0])

    def _own(self) -> list[pa.Array]:
        """The key's columns."""
        return [pa.array([k[i] for k in self.keys], t) for i, t in enumerate(_key_types(self.schema))]

    def packed(self) -> pa.RecordBatch:
        """A row a field and token, with lists of its keys and counts; empty again."""
        code, key, tf = self.summed()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][:len(code)])
        offsets, place = pa.array(np.r_[first, len(code)], pa.int32()), pa.array(key)
        columns = [*self._terms(code[first]), *(pa.ListArray.from_arrays(offsets, c.take(place)) for c in self._own()),
                   pa.ListArray.from_arrays(offsets, pa.array(tf))]
        self._start()
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)

    def blocks(self) -> pa.RecordBatch:
        """A row a bucket with its rows; empty again."""
        code, key, tf = self.summed()
        out = _blocks(self._terms, code, key, tf, self._own())
        self._start()
        return out

    def _terms(self, code: np.ndarray) -> tuple[pa.Array, pa.Array]:
        number, field = np.divmod(code, len(self.fields))
        return pa.array(self.fields, pa.string()).take(pa.array(field)), pa.array(list(self.numbers.folded), pa.string()).take(pa.array(number))


def _key_types(schema: pa.Schema) -> list[pa.DataType]:
    return [f.type.value_type for f in list(schema)[2:-1]]


def _blocks(terms, code: np.ndarray, key: np.ndarray, tf: np.ndarray, own: list[pa.Array]) -> pa.RecordBatch:
    """Postings in order of code as (bucket, rows of the bucket in order of token)."""
    # lists in order of the key's values: runs and small steps
    order = pc.sort_indices(pa.table(own, names=[str(i) for i in range(len(own))]), sort_keys=[(str(i), "ascending") for i in range(len(own))])
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    n = max(len(order), 1)
    one = code * n + rank[key]
    by = np.argsort(one, kind="stable")
    code, tf, place = code[by], tf[by], order.take(pa.array(rank[key][by]))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][:len(code)])
    field, token = terms(code[first])
    rows = pa.RecordBatch.from_arrays([field, token, posting_bytes.written(first, tf, [c.take(place) for c in own])], schema=ROWS)
    bucket = np.fromiter((zlib.crc32(t) % BUCKETS for t in token.cast(pa.binary()).to_pylist()), np.int32, len(first))
    by = pc.sort_indices(pa.table([pa.array(bucket), token], names=["b", "t"]), sort_keys=[("b", "ascending"), ("t", "ascending")])
    rows, bucket = rows.take(by), bucket[by.to_numpy()]
    cuts = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    held = [b for b in range(BUCKETS) if cuts[b] < cuts[b + 1]]
    squeezed = [_squeezed(rows.slice(cuts[b], cuts[b + 1] - cuts[b])) for b in held]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(squeezed, pa.binary())], names=["bucket", "block"])


def _squeezed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _packer(fields: list[str], n_key: int, schema: pa.Schema, blocks: bool = False):
    """Rows (key, texts) to packed postings; a key's rows that follow each other are counted together."""
    def run(batches):
        held, most = _Postings(fields, schema), PACKED
        last, count = None, 0

        def packed():
            return held.blocks() if blocks else held.packed()
        for batch in (s for b in batches for s in _slices(b, 500)):
            own = list(zip(*(batch.column(i).to_pylist() for i in range(n_key))))
            texts = zip(*(batch.column(n_key + i).cast(pa.binary()).to_pylist() for i in range(len(fields))))
            for key, row in zip(own, texts):
                if key != last or not held.keys:
                    if count >= most:
                        yield from _slices(packed())
                        count, most = 0, PACKED
                    held.keys.append(key)
                    last = key
                before = len(held.tokens)
                held.add(row)
                count += len(held.tokens) - before
                if count >= 2 * most:
                    count = held.shorten()
                    most = max(PACKED, count)
        yield from _slices(packed())
    return run


def _repacker(schema: pa.Schema):
    """Postings (field, token, key, tf) to blocks."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACKED:
                yield _repacked(held, schema)
                held, rows = [], 0
        if rows:
            yield _repacked(held, schema)
    return run


def _repacked(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    (field, token, *own), tf = ([c.combine_chunks() for c in x] for x in (t.columns[:-1], t.columns[-1:]))
    f, k = field.cast(pa.string()).dictionary_encode(), token.cast(pa.string()).dictionary_encode()
    code = f.indices.to_numpy().astype(np.int64) * max(len(k.dictionary), 1) + k.indices.to_numpy()
    order = np.argsort(code, kind="stable")

    def terms(c):
        a, b = np.divmod(c, max(len(k.dictionary), 1))
        return f.dictionary.take(pa.array(a)), k.dictionary.take(pa.array(b))
    return _blocks(terms, code[order], order, tf[0].to_numpy()[order], [c.cast(t) for c, t in zip(own, _key_types(schema))])


def _rows_of(batches):
    """(bucket, block) to the block's rows."""
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            for rows in pa.ipc.open_stream(block.as_buffer()):
                for part in _slices(rows):
                    yield part.append_column("bucket", pa.array(np.full(part.num_rows, bucket, np.int32)))


def _postings_of(schema: pa.Schema):
    """Stored rows to postings (field, token, key, tf)."""
    types = _key_types(schema)

    def run(batches):
        for batch in batches:
            for field, token, raw in zip(*(c.to_pylist() for c in batch.columns)):
                tf, own = posting_bytes.read(raw, types)
                columns = [pa.repeat(pa.scalar(x, pa.string()), len(tf)) for x in (field, token)] + own + [pa.array(tf)]
                yield from _slices(pa.RecordBatch.from_arrays(columns, names=schema.names))
    return run


def _slices(batch: pa.RecordBatch, rows: int = 10000):
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _lists(key: list[T.StructField]) -> T.StructType:
    """Packed postings: a row a field and token."""
    return T.StructType([T.StructField("field", T.StringType()), T.StructField("token", T.StringType()),
                         *[T.StructField(k.name, T.ArrayType(k.dataType)) for k in key], T.StructField("tf", T.ArrayType(T.LongType()))])


def _block_type(key: list[T.StructField]) -> T.StructType:
    """Postings as they are shuffled; the column tells the key."""
    return T.StructType([T.StructField("bucket", T.IntegerType()),
                         T.StructField("block", T.BinaryType(), metadata={"key": _key_json(key)})])


def _key_json(key: list[T.StructField]) -> str:
    return T.StructType([T.StructField(k.name, k.dataType) for k in key]).json()


def _key_of(field: T.StructField) -> list[T.StructField]:
    import json
    return T.StructType.fromJson(json.loads(field.metadata["key"])).fields


def build_index(df: DataFrame, key, fields: list[str] | None = None, packed: bool | str = False) -> DataFrame:
    """Postings (field, token, key, tf) over the given text fields (one pass).

    packed: the key's columns and tf as lists; a field and token may have several rows.
    packed="blocks": the same postings as ``StoredIndex`` takes them at once, packed where the rows are.
    """
    ship_package(df.sparkSession)
    key, fields = names(key), [f for f in (fields or INDEX_FIELDS) if f in df.columns]
    own = df.select(*key, *[F.col(f).cast("string").alias(f"_text{i}") for i, f in enumerate(fields)])
    types = [own.schema[k] for k in key]
    lists = _lists(types)
    if packed == "blocks":
        return own.mapInArrow(_packer(fields, len(key), to_arrow_schema(lists), True), _block_type(types))
    out = own.repartition(*key).sortWithinPartitions(*key).mapInArrow(_packer(fields, len(key), to_arrow_schema(lists)), lists)
    return out if packed else _unpacked(out)


def _unpacked(postings: DataFrame) -> DataFrame:
    lists = postings.columns[2:]
    one = postings.select("field", "token", F.explode(F.arrays_zip(*lists)).alias("_p"))
    return one.select("field", "token", *[F.col("_p")[c].alias(c) for c in lists])


class StoredIndex:
    """Postings on storage: ``<level>-<name>/bucket=<n>/`` folders, each addition listed once it is complete."""

    MERGE = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def additions(self) -> list[str]:
        """Complete additions (a stopped one has no success mark and is not read)."""
        p = self._p("")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []
        names = [n for n in names if n[0].isdigit() and self._fs.exists(self._p(f"{n}/_SUCCESS"))]
        merged = {old for n in names if not n.startswith("0-") for old in self._merged(n)}
        return [n for n in names if n not in merged]

    def _merged(self, name: str) -> list[str]:
        """The additions that a merge has put together."""
        p = self._p(f"{name}/_MERGED")
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    @staticmethod
    def bucket(token) -> Column:
        return F.pmod(F.crc32(token), F.lit(BUCKETS)).cast("int")

    def _rows(self, postings: DataFrame) -> DataFrame:
        """Rows to store of postings in any of the forms that ``build_index`` gives, tasks of about the same size."""
        if postings.columns != ["bucket", "block"]:
            if isinstance(postings.schema["tf"].dataType, T.ArrayType):
                postings = _unpacked(postings)
            ship_package(self.spark)
            own = [f for f in postings.schema if f.name not in ("field", "token", "tf")]
            flat = postings.select("field", "token", *[f.name for f in own], F.col("tf").cast("long"))
            postings = flat.mapInArrow(_repacker(to_arrow_schema(_lists(own))), _block_type(own))
        stored = T.StructType([T.StructField("field", T.StringType()), T.StructField("token", T.StringType()),
                               T.StructField("postings", T.BinaryType()), T.StructField("bucket", T.IntegerType())])
        rows = postings.hint("rebalance", "bucket").mapInArrow(_rows_of, stored)
        return rows.withColumn("postings", F.col("postings").alias("postings", metadata=postings.schema["block"].metadata))

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket")
         .option("compression", "zstd").parquet(f"{self.path}/{name}"))

    def add(self, postings: DataFrame, name: str | None = None) -> None:
        """Add the postings of new mail; an addition of the same name is written again."""
        self._write(self._rows(postings), f"0-{name or uuid.uuid4().hex}")
        self.merge()

    def merge(self) -> None:
        level = 0
        while any(int(n.split("-")[0]) >= level for n in self.additions()):
            own = [n for n in self.additions() if n.startswith(f"{level}-")]
            if len(own) >= self.MERGE:
                new = f"{level + 1}-{uuid.uuid4().hex}"
                self._write(self._read(own).hint("rebalance", "bucket"), f".{new}")
                out = self._fs.create(self._p(f".{new}/_MERGED"), True)
                out.write(bytearray(" ".join(own).encode("utf-8")))
                out.close()
                # by this name it stands for the others in one step; they can go then or later
                self._fs.rename(self._p(f".{new}"), self._p(new))
                for n in own:
                    self._fs.delete(self._p(n), True)
            level += 1

    def _read(self, names: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{n}") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def parts(self, toks: list[str]) -> DataFrame:
        """Postings of some tokens, a key's counts in one or more rows: their buckets of each addition, pruned by name."""
        ship_package(self.spark)
        own = self._read(self.additions())
        lists = _lists(_key_of(own.schema["postings"]))
        flat = T.StructType([T.StructField(f.name, f.dataType.elementType if i > 1 else f.dataType) for i, f in enumerate(lists)])
        found = own.where(F.col("token").isin(toks) & F.col("bucket").isin([self.bucket(F.lit(t)) for t in toks]))
        return found.select("field", "token", "postings").mapInArrow(_postings_of(to_arrow_schema(lists)), flat)

    def postings(self, toks: list[str]) -> DataFrame:
        """Postings of some tokens."""
        parts = self.parts(toks)
        return parts.groupBy(*parts.columns[:-1]).agg(F.sum("tf").alias("tf"))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query string, cut as the index cuts its texts."""
    text = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not "\u0300" <= c <= "\u036f")
    out = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFC", text))
    return sorted(set(out.split()))


def search_keys(index: DataFrame | StoredIndex, query: str, key, fields: list[str] | None = None) -> DataFrame:
    """Q1s: keys whose indexed text contains every query token (any field unless ``fields``).

    The query string is a literal the caller holds, so the postings scan gets
    a literal ``token IN (...)`` that reaches the Parquet reader and its
    row-group statistics (a stored index is sorted by token inside each file).
    """
    toks = query_tokens(query)
    if not toks:
        index = index.postings([""]) if isinstance(index, StoredIndex) else index
        return index.where(F.lit(False)).select(*names(key))
    post = index.parts(toks) if isinstance(index, StoredIndex) else index.where(F.col("token").isin(toks))
    if fields:
        post = post.where(F.col("field").isin(*fields))
    hits = post.groupBy(*names(key)).agg(F.count_distinct("token").alias("_n"))
    return hits.where(F.col("_n") == len(toks)).select(*names(key))


def search(df: DataFrame, index: DataFrame | StoredIndex, query: str, key, fields: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` matching the query (semi-join on the key)."""
    return df.join(search_keys(index, query, key, fields), names(key), "left_semi")
