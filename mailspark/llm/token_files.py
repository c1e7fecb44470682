"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A data set is a folder of shards.  A shard is three files: ``*.bin``, the ids of
its documents one after another as little-endian unsigned integers (two bytes
if the vocabulary has at most 65,536 ids, four otherwise), and ``*.idx``,
one more 64-bit little-endian offset than documents, counted in ids from the
shard's start; and ``*.doc``, the documents' doc_ids as an Arrow file.  Shards follow each other in ascending doc_id order; the number
of ids before each shard is the prefix sum over the shards before it.

Documents are dealt into ranges of doc_id; each task writes its shard under a
name of its own, and only the names that successful tasks report form the data
set.  A lost executor or a second attempt leaves files that nothing refers to.

Encoding goes through the tokenizers library.  Its normaliser and splitter
never look across white space, so each distinct word is encoded once per
worker (a bounded cache), and a text's ids are those of its words in a row.  A
word is also cut behind an ASCII letter that an ASCII sign other than a letter
follows: the splitter always begins anew there.  Texts with a "<|", which may
begin a special token, are cut at white space alone.

Cases: null and empty texts have the end id alone; rows that repeat a doc_id
stand next to each other, in the order of their texts' hashes; null ids come
first; an empty table gives an empty data set; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_dir
from .base import ids as column_ids
from .base import prepare, text_slices
from .words import Words, strings

#: The id appended to each document.
END_ID = 1
#: Words that a worker keeps encoded: of the current generation, and as many of the one before.
CACHE = 350_000
#: About so many documents make a shard.
SHARD_ROWS = 20_000

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True


def _with(places: np.ndarray, more: np.ndarray, n: int) -> np.ndarray:
    """Both sets of places below n + 1, in order."""
    mark = np.zeros(n + 1, bool)
    mark[places] = mark[more] = True
    return np.flatnonzero(mark)


class WordEncoder:
    """encode(texts) -> (ids of all texts in a row, ids of each text), without end ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = Words(texts, ~_GAP, lower=False)
        starts, ends, d = w.starts, w.ends, w.data
        if not np.any((d[:-1] == 0x3C) & (d[1:] == 0x7C)):
            cut = np.flatnonzero(_LETTER[d[:-1]] & _SIGN[d[1:]]) + 1
            starts, ends = _with(starts, cut, len(d)), _with(ends, cut, len(d))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = strings(d, starts, ends).dictionary_encode()
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), "\n")[0].as_py().split("\n")
        known = self.known
        new = [x for x in words if x not in known]
        if new:
            if len(known) + len(new) > CACHE:                # the older generation goes, its words in use come along
                self.older, self.known = known, {}
                known, new = self.known, words
            for x in new:
                if x in self.older:
                    known[x] = self.older[x]
            self.learn([x for x in new if x not in known])
        entries = [known[x] for x in words]
        size = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
        flat = np.frombuffer(b"".join(entries), np.uint32)
        place = np.cumsum(size) - size
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        upto = np.cumsum(n)
        out = flat[np.repeat(place[word] - (upto - n), n) + np.arange(int(upto[-1]))]
        first = np.searchsorted(starts, w.offsets)
        total = np.concatenate(([0], upto))
        return out, total[first[1:]] - total[first[:-1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _with_ends(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each text's ids followed by the end id."""
    return np.insert(flat, np.cumsum(n), END_ID)


def write(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write a data set; returns its shards in order: name, docs, ids, base (ids before it), bytes of an id."""
    spark = prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = narrow.select("id").count()
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-n // SHARD_ROWS))
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    id_type = to_arrow_type(narrow.schema["id"].dataType)

    def run(batches):
        enc = encoder(path)
        kind = np.dtype("<u2") if enc.size <= 1 << 16 else np.dtype("<u4")
        name = uuid.uuid4().hex
        own, at = _open(folder)
        part, count, offsets = 0, 0, [np.zeros(1, "<i8")]
        with (own.open_output_stream(f"{at}/{name}.bin") as f, own.open_output_stream(f"{at}/{name}.doc") as g,
              pa.ipc.new_file(g, pa.schema([("id", id_type)])) as docs_file):
            for batch in batches:
                part = column_ids(batch, "part")[0].as_py() if len(batch) else part
                docs_file.write_batch(pa.RecordBatch.from_arrays([column_ids(batch, "id")], ["id"]))
                for _, _, texts in text_slices(batch, "text"):
                    flat, size = enc.encode(texts)
                    f.write(_with_ends(flat, size).astype(kind).tobytes())
                    offsets.append((count + np.cumsum(size + 1)).astype("<i8"))
                    count = int(offsets[-1][-1])
        offsets = np.concatenate(offsets)
        with own.open_output_stream(f"{at}/{name}.idx") as f:
            f.write(offsets.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(offsets) - 1], "ids": [count],
                                          "width": [kind.itemsize]}, pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()),
                                                                                ("ids", pa.int64()), ("width", pa.int32())]))

    made = (narrow.repartitionByRange(shards, "id").sortWithinPartitions("id", F.xxhash64("text"))
            .withColumn("part", F.spark_partition_id())
            .mapInArrow(run, "part int, name string, docs long, ids long, width int")
            .filter("docs > 0").collect())                  # one short row a shard
    base, out = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        out.append({"part": r["part"], "name": r["name"], "docs": r["docs"], "ids": r["ids"], "width": r["width"], "base": base})
        base += r["ids"]
    return out


class Shard:
    """A shard, memory-mapped: offsets, ids and doc_ids.  One that does not lie on a mounted disk is fetched to a scratch file first."""

    def __init__(self, folder: str, name: str, width: int):
        fs, root = _open(folder)
        self.scratch = []
        paths = []
        for end in ("idx", "bin", "doc"):
            p = f"{root}/{name}.{end}"
            if not isinstance(fs, pafs.LocalFileSystem):
                fd, local = tempfile.mkstemp()
                with fs.open_input_stream(p) as f, os.fdopen(fd, "wb") as out:
                    while chunk := f.read(1 << 22):
                        out.write(chunk)
                self.scratch.append(local)
                p = local
            paths.append(p)
        self.offsets = np.memmap(paths[0], "<i8", "r")
        self.ids = np.memmap(paths[1], f"<u{width}", "r")
        with pa.memory_map(paths[2]) as f:
            self.docs = pa.ipc.open_file(f).read_all().column("id")

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]

    def close(self) -> None:
        del self.offsets, self.ids, self.docs
        for p in self.scratch:
            os.unlink(p)


def read(spark, folder: str, shards: list[dict], id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a data set, from its files."""
    prepare(spark)
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                shard = Shard(folder, s["name"], s["width"])
                for a in range(0, s["docs"], 4096):
                    b = min(a + 4096, s["docs"])
                    o = np.asarray(shard.offsets[a:b + 1])
                    crc = [zlib.crc32(shard[i].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [shard.docs.slice(a, b - a).combine_chunks(), pa.array(o[:-1] + s["base"], pa.int64()),
                         pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()
    rows = [(s["name"], s["docs"], s["width"], s["base"]) for s in shards]
    table = spark.createDataFrame(rows, "name string, docs long, width int, base long")
    return table.repartition(max(1, len(rows))).mapInArrow(run, schema)


def report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a data set into the session's shared folder and read it back."""
    spark = docs.sparkSession
    folder = checkpoint_dir(spark, f"llm/tokens-{uuid.uuid4().hex}")
    shards = write(docs, path, folder, id_col, text_col)
    return read(spark, folder, shards, dict(docs.dtypes)[id_col])
