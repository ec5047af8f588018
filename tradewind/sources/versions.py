"""Keyed tables in hash buckets: a merge rewrites the buckets it touches and publishes them at once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.vessels import latest
from tradewind.sources.manifest import Conflict, Manifest


class VersionedTable:
    """One row per key, the one that comes last by ``order``, in files that are never changed.

    The manifest names a folder for each bucket. A merge reads the buckets that
    its keys fall into, writes them anew beside the old ones and publishes the
    new names in one step: readers see all of a merge or nothing of it, and a
    merge that failed half way has changed nothing. Since the order decides, and not the
    time of arrival, merges give the same table in any sequence.
    """

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], order: Sequence[str], schema: StructType, buckets: int = 64):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), list(key), list(order)
        self.schema, self.buckets, self.manifest = schema, buckets, Manifest(spark, root)

    def _entries(self) -> tuple[int, dict]:
        number, entries = self.manifest.read()
        return number, entries or {"buckets": {}, "batches": {}, "snapshots": {}}

    def _files(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(folders))

    def read(self, snapshot: str | None = None) -> DataFrame:
        """The table as published last, or as it was at a named snapshot."""
        entries = self._entries()[1]
        return self._files(list((entries["buckets"] if snapshot is None else entries["snapshots"][snapshot]).values()))

    def merge(self, rows: DataFrame, batch: tuple[str, int] | None = None, tries: int = 5) -> None:
        """Fold rows in. ``batch`` (stream, number) is applied once, however often it comes; others that publish meanwhile are met by a new try."""
        place = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        newest = latest(rows.select(*self.schema.fieldNames()), self.key, self.order)
        for _ in range(tries):
            number, entries = self._entries()
            if batch and entries["batches"].get(batch[0], -1) >= batch[1]:
                return
            touched = sorted(r[0] for r in newest.select(place.alias("b")).distinct().collect())  # as many as buckets at most
            if touched:
                held = self._files([entries["buckets"][str(b)] for b in touched if str(b) in entries["buckets"]])
                folder = f"{self.root}/data-{uuid.uuid4().hex}"
                merged = latest(held.unionByName(newest), self.key, self.order).withColumn("_bucket", place)
                merged.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
                entries["buckets"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
            if batch:
                entries["batches"][batch[0]] = batch[1]
            try:
                self.manifest.publish(entries, number)
                return
            except Conflict:
                continue
        raise Conflict(f"{self.root}: {tries} merges in a row met another writer")

    def snapshot(self, name: str) -> None:
        """Keep the present files under a name; nothing is copied."""
        number, entries = self._entries()
        entries["snapshots"][name] = dict(entries["buckets"])
        self.manifest.publish(entries, number)

    def restore(self, name: str) -> None:
        """Make a snapshot the present table; later snapshots stay."""
        number, entries = self._entries()
        entries["buckets"] = dict(entries["snapshots"][name])
        self.manifest.publish(entries, number)
