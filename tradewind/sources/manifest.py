"""A small file that names the tables of a folder, replaced as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published first."""


class Manifest:
    """Numbered JSON files below ``root/_manifest``; the highest number holds.

    A new file is written under another name and then renamed, so readers see
    the old entries or the new ones and never a part. Works on every file
    system that Spark's own readers open. Where a rename replaces its target
    (a local disk), two writers at the same moment are told apart by a check only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> tuple[int, dict]:
        """(number, entries); zero and none before the first one is published."""
        folder, fs = self._path()
        if not fs.exists(folder):
            return 0, {}
        numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName()[:-5].isdigit()]
        if not numbers:
            return 0, {}
        path, _ = self._path(f"{max(numbers):012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def publish(self, entries: Mapping, after: int) -> int:
        """Make ``entries`` the current ones if number ``after`` still is; returns the new number."""
        waiting, fs = self._path(f"waiting-{uuid.uuid4().hex}")
        final, _ = self._path(f"{after + 1:012d}.json")
        out = fs.create(waiting, False)
        out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(waiting, final):
            fs.delete(waiting, False)
            raise Conflict(f"{self.root} has moved on from {after}")
        return after + 1
