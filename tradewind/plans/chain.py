"""A chain of stages whose results are written once and read by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tradewind.session import shared_folder
from tradewind.sources.manifest import Manifest


class Chain:
    """Named tables of one run in the shared folder.

    ``table(name, build)`` writes what ``build`` returns the first time and
    reads it from then on: every later stage meets the same rows, whatever the
    models or executors behind them do. A chain opened again on the folder of a
    broken run goes on after its last published stage; files of a stage that
    did not end are never read, as no manifest names them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
        self.manifest = Manifest(spark, self.folder)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        entries = self.manifest.read()[1]
        if name not in entries:
            df = build()
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            number, entries = self.manifest.read()  # building may have published earlier stages
            entries[name] = {"path": path, "schema": df.schema.json()}
            self.manifest.publish(entries, number)
        return self.spark.read.schema(_schema(entries[name]["schema"])).parquet(entries[name]["path"])

    def stages(self) -> list[str]:
        return sorted(self.manifest.read()[1])


def _schema(text: str) -> StructType:
    import json

    return StructType.fromJson(json.loads(text))
