"""mbox as a Spark Python Data Source (S1, St1).

``spark.read.format("mbox").option("path", p).load()`` yields one row per
raw message: (path, mbox_offset, mbox_size, raw).  A file is cut into byte
ranges (``splitSize``, default 128 MB); each range emits the messages that
START inside it: it looks back one byte to know whether it begins at a line
start, skips to the first envelope line (``^From \\S``) and reads past its
end to finish its last message.  Bytes before the first envelope of a file
form a message of their own (offset 0), as in a sequential read.  The rows
are identical for any split size.  With ``option("parse", "true")`` the reader
parses each message as it reads it (schema ``parse.PARSED``), so raw bytes
never cross from the Python worker into the JVM and back.

Files are opened with ``pyarrow.fs`` so local, HDFS and object-store paths
work the same on executors.  The streaming reader uses the byte position
per file as its offset: a micro-batch covers the complete messages appended
since the last committed position.  A message is complete once the next
envelope line exists; a file's last message is, once the file has kept its
size from one trigger to the next.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, InputPartition)
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .parse import PARSED, parse_row

ENVELOPE = re.compile(rb"^From \S")
SCHEMA = StructType([
    StructField("path", StringType(), False),
    StructField("mbox_offset", LongType(), False),
    StructField("mbox_size", LongType(), False),
    StructField("raw", BinaryType(), False),
])
DEFAULT_SPLIT = 128 << 20
BLOCK = 4 << 20


def _fs(path: str):
    from pyarrow import fs
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of every regular file under ``path`` (a file or a directory), sorted."""
    from pyarrow import fs
    filesystem, p = _fs(path)
    info = filesystem.get_file_info(p)
    prefix = path[: len(path) - len(p)] if "://" in path else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    sel = fs.FileSelector(p, recursive=True)
    out = [(prefix + i.path, i.size) for i in filesystem.get_file_info(sel)
           if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted(out)


class _Lines:
    """Line iterator with absolute byte positions over a random-access file."""

    def __init__(self, f, pos: int):
        self.f, self.pos = f, pos
        f.seek(pos)
        self.buf, self.i = b"", 0

    def skip_line(self, end: int) -> None:
        """Pass the rest of a line without keeping it; stops early once the position reaches ``end``."""
        while self.pos < end:
            if self.i >= len(self.buf):
                self.buf, self.i = self.f.read(BLOCK), 0
                if not self.buf:
                    return
            j = self.buf.find(b"\n", self.i)
            stop = len(self.buf) if j < 0 else j + 1
            self.pos += stop - self.i
            self.i = stop
            if j >= 0:
                return

    def readline(self) -> bytes:
        parts = []
        while True:
            j = self.buf.find(b"\n", self.i)
            if j >= 0:
                parts.append(self.buf[self.i:j + 1])
                self.i = j + 1
                break
            parts.append(self.buf[self.i:])
            self.buf, self.i = self.f.read(BLOCK), 0
            if not self.buf:
                break
        line = b"".join(parts)
        self.pos += len(line)
        return line


def read_range(path: str, start: int, end: int) -> Iterator[tuple]:
    """Messages of ``path`` whose first byte lies in [start, end) (the last one read to its end)."""
    filesystem, p = _fs(path)
    with filesystem.open_input_file(p) as f:
        if start > 0:
            f.seek(start - 1)
            at_line_start = f.read(1) == b"\n"
        else:
            at_line_start = True
        rd = _Lines(f, start)
        if not at_line_start:
            rd.skip_line(end)                               # pass the line we landed in
        msg_start = 0 if start == 0 else None               # bytes before a first envelope
        buf: list[bytes] = []
        while True:
            line_pos = rd.pos
            if msg_start is None and line_pos >= end:       # no message begins in this range
                return
            line = rd.readline()
            if not line:
                break
            is_env = ENVELOPE.match(line) is not None
            if msg_start is None:                           # looking for the first envelope
                if not is_env:
                    continue
                msg_start = line_pos
            elif is_env and buf:
                yield (path, msg_start, line_pos - msg_start, b"".join(buf))
                if line_pos >= end:
                    return
                msg_start, buf = line_pos, []
            buf.append(line)
        if buf:
            yield (path, msg_start, sum(len(x) for x in buf), b"".join(buf))


class MboxPartition(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(json.dumps([path, start, end]))
        self.path, self.start, self.end = path, start, end


def split_ranges(files: list[tuple[str, int]], split: int) -> list[MboxPartition]:
    parts = []
    for path, size in files:
        if size == 0:
            continue
        for s in range(0, size, split):
            parts.append(MboxPartition(path, s, min(s + split, size)))
    return parts


def _parsed_rows(rows, max_bytes: int):
    """Parse inside the reader: raw bytes never leave the Python worker."""
    names = [f.name for f in PARSED.fields]
    for path, off, size, raw in rows:
        r = parse_row(path, off, size, raw, max_bytes)
        yield tuple(r[n] for n in names)


class MboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("mbox: option 'path' is required")
        self.split = int(options.get("splitSize", DEFAULT_SPLIT))
        self.parse = str(options.get("parse", "false")).lower() == "true"
        self.max_bytes = int(options.get("maxBodyKb", 500)) * 1024
        # JSON list of [path, start, end]: read these byte ranges only (messages that begin in them)
        self.ranges = json.loads(options.get("ranges", "null"))

    def partitions(self):
        if self.ranges is not None:
            parts = [MboxPartition(p, a, min(a + self.split, e)) for p, s, e in self.ranges for a in range(s, e, self.split)]
        else:
            parts = split_ranges(list_files(self.path), self.split)
        return parts or [MboxPartition(self.path, 0, 0)]

    def read(self, partition: MboxPartition):
        if partition.end <= partition.start:
            return iter(())
        rows = read_range(partition.path, partition.start, partition.end)
        return _parsed_rows(rows, self.max_bytes) if self.parse else rows


def _complete_end(path: str, size: int) -> int:
    """Byte position of the last envelope line of ``path``: everything before it is complete."""
    filesystem, p = _fs(path)
    with filesystem.open_input_file(p) as f:
        step, hi = 1 << 20, size
        while hi > 0:
            lo = max(0, hi - step)
            f.seek(lo)
            chunk = f.read(hi - lo + 64)
            idx = [m.start() for m in re.finditer(rb"(?m)^From \S", chunk) if lo + m.start() < hi]
            for i in reversed(idx):
                pos = lo + i
                if pos == 0:
                    return 0
                f.seek(pos - 1)
                if f.read(1) == b"\n":
                    return pos
            hi = lo
    return 0


class MboxStreamReader(DataSourceStreamReader):
    """Offsets are ``{path: byte position}``; a batch reads complete messages in between."""

    def __init__(self, options: dict):
        self.path = options.get("path")
        self.split = int(options.get("splitSize", DEFAULT_SPLIT))
        # 'true': files are written whole (no partial tail), so EOF ends the last message at once;
        # otherwise it does when a file has not changed since the trigger before
        self.eof_complete = str(options.get("eofComplete", "false")).lower() == "true"
        self.parse = str(options.get("parse", "false")).lower() == "true"
        self.max_bytes = int(options.get("maxBodyKb", 500)) * 1024

        self.seen: dict[str, tuple[int, int]] = {}           # path: size at the last trigger, complete up to there

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for p, size in list_files(self.path):
            if self.eof_complete or self.seen.get(p, (-1, 0))[0] == size:
                out[p] = size
            else:
                out[p] = max(_complete_end(p, size), self.seen.get(p, (0, 0))[1])
            self.seen[p] = (size, out[p])
        return out

    def partitions(self, start: dict, end: dict):
        parts = []
        for p, e in sorted(end.items()):
            s = int(start.get(p, 0))
            for a in range(s, int(e), self.split):
                parts.append(MboxPartition(p, a, min(a + self.split, int(e))))
        return parts

    def read(self, partition: MboxPartition):
        if partition.end <= partition.start:
            return iter(())
        # messages starting before the batch end also end by it (the next envelope)
        rows = read_range(partition.path, partition.start, partition.end)
        return _parsed_rows(rows, self.max_bytes) if self.parse else rows

    def commit(self, end: dict) -> None:
        pass


class MboxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self):
        if str(self.options.get("parse", "false")).lower() == "true":
            return PARSED
        return SCHEMA

    def reader(self, schema):
        return MboxReader(self.options)

    def streamReader(self, schema):
        return MboxStreamReader(self.options)


def register(spark) -> None:
    """Make ``format("mbox")`` known.

    The source travels by value: the process that asks a stream for its
    offsets runs beside the driver and sees neither the caller's Python path
    nor the files shipped to executors.
    """
    import sys

    from pyspark import cloudpickle

    from . import parse
    from ..util import ship_package
    ship_package(spark)
    for module in (sys.modules[__name__], parse):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(MboxDataSource)


def read_mbox(spark, path: str, split_size: int = DEFAULT_SPLIT, parse: bool = False):
    """Raw messages, or with ``parse=True`` parsed rows (schema ``parse.PARSED``) straight from the reader."""
    register(spark)
    return (spark.read.format("mbox").option("path", path).option("splitSize", str(split_size))
            .option("parse", str(parse).lower()).load())
