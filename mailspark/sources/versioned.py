"""A message table in versions, changed by rewriting only the files that hold changed rows.

Layout: ``data/<uuid>/`` folders of Parquet files and ``versions/<n>``, one
small text file a version that lists its data files (relative names, a line
each) under a header line.  A change reads the keys of the table once to learn
which files hold them (``_metadata.file_path``), writes those files anew into
a folder of its own and adds a version that names the new files in place of
the old.  The version file is written under another name and renamed, and a
number is only taken once, so a reader sees the old version or the new one,
and a run that stops half way leaves the old one as it was.

The driver holds the file names of one version, as Spark's own file index
does; rows never pass through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import KEY, names


class VersionConflict(RuntimeError):
    """Another run has added the version that this one was about to add."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        p = self._path(path)
        self._fs = p.getFileSystem(self._conf)
        self.path = self._fs.makeQualified(p).toString().rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _listed(self, folder: str) -> list[str]:
        p = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    # ------------------------------------------------------------- versions
    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._listed("versions") if n.isdigit())

    def _head(self, version: int) -> dict:
        io = self._jvm.java.io
        lines = io.BufferedReader(io.InputStreamReader(self._fs.open(self._path(f"{self.path}/versions/{version}")), "UTF-8"))
        try:
            return json.loads(lines.readLine())
        finally:
            lines.close()

    def _manifest(self, version: int) -> tuple[dict, list[str]]:
        stream = self._fs.open(self._path(f"{self.path}/versions/{version}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        head, *files = text.splitlines()
        return json.loads(head), files

    def _add(self, version: int, head: dict, files: list[str]) -> None:
        there = self._path(f"{self.path}/versions/{version}")
        own = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        try:
            out.write(bytearray("\n".join([json.dumps(head), *files]).encode("utf-8")))
        finally:
            out.close()
        if self._fs.exists(there) or not self._fs.rename(own, there):
            self._fs.delete(own, False)
            raise VersionConflict(f"version {version} of {self.path} is there already")

    def files(self, version: int | None = None) -> list[str]:
        """Data files of a version (the latest by default), relative to the table."""
        return self._manifest(self.versions()[-1] if version is None else version)[1]

    def runs(self) -> dict[str, int]:
        """The version that each named run has added."""
        out = {}
        for v in self.versions():
            run = self._head(v).get("run")
            if run is not None:
                out[run] = v
        return out

    # ----------------------------------------------------------- rows
    def read(self, version: int | None = None) -> DataFrame:
        head, files = self._manifest(self.versions()[-1] if version is None else version)
        if not files:
            return self.spark.createDataFrame([], head["schema"])
        return self.spark.read.schema(head["schema"]).parquet(*[f"{self.path}/{f}" for f in files])

    def _write(self, df: DataFrame) -> list[str]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return [f"{folder}/{n}" for n in self._listed(folder) if n.endswith(".parquet")]

    def create(self, df: DataFrame) -> "VersionedTable":
        """Version 0, in ranges of date so that files cover short times."""
        if self.versions():
            raise VersionConflict(f"{self.path} is there already")
        own = df.repartitionByRange("date_ts").sortWithinPartitions("date_ts") if "date_ts" in df.columns else df
        self._add(0, {"schema": _ddl(df)}, self._write(own))
        return self

    def located(self, keys: DataFrame, key=KEY, version: int | None = None) -> DataFrame:
        """``keys`` with the name of the file that holds each (``_file``; null where the version lacks the key)."""
        at = self.read(version).select(*names(key), F.col("_metadata.file_path").alias("_file"))
        return keys.join(at, names(key), "left")

    def rewrite(self, files: list[str], change: Callable[[DataFrame], DataFrame], run: str | None = None) -> int:
        """Add a version in which ``change`` has been applied to the rows of ``files`` (names as ``located`` gives them).

        run: a name; a run that has added its version adds no other.  Returns the version.
        """
        if run is not None and run in (done := self.runs()):
            return done[run]
        version = self.versions()[-1]
        head, all_files = self._manifest(version)
        touched = {self._relative(f) for f in files}
        unknown = touched - set(all_files)
        if unknown:
            raise VersionConflict(f"version {version} of {self.path} has no file {min(unknown)}")
        new: list[str] = []
        if touched:
            old = self.spark.read.schema(head["schema"]).parquet(*[f"{self.path}/{f}" for f in sorted(touched)])
            out = change(old)
            # about as many files as before
            new = self._write(out.repartitionByRange(len(touched), "date_ts").sortWithinPartitions("date_ts") if "date_ts" in out.columns else out)
        self._add(version + 1, {"schema": head["schema"], "run": run}, [f for f in all_files if f not in touched] + new)
        return version + 1

    def _relative(self, file: str) -> str:
        own = self._path(self._jvm.java.net.URI(file).getPath()).toString()
        root = self._path(self.path).toUri().getPath()
        if not own.startswith(root + "/"):
            raise ValueError(f"{file} is no file of {self.path}")
        return own[len(root) + 1:]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
