"""Words, scratch tables, files in tasks and connected components shared by the operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import checkpointed, shared_folder

#: Bytes that end a word of letters and digits: ASCII other than 0-9 and a-z; A-Z become a-z. Bytes from 0x80 belong to words.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Bytes of a batch of rows between Spark and its Python workers; a longer row is a batch of its own.
BATCH_BYTES = 1 << 22
#: Of a worker process: the models of one operator.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps for an operator from task to task.

    Workers serve stage after stage. The models of one operator go when
    another's are asked for: memory holds the largest of them, not their sum.
    """
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
    return _kept[operator]


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return encoded(text).translate(_ALNUM).split()


def space_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8; A-Z lower-cased if asked."""
    raw = encoded(text)
    return (raw.lower() if lower else raw).split()


def workers_import(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package; clusters ship it with ``--py-files``.

    Rows go to the workers in batches of BATCH_BYTES instead of 10,000 rows:
    an executor's memory outside the heap then doesn't grow with the texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; a run never meets files of another."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and no executor holds it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(file system, path on it) for a path of the shared folder, inside a task."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 64) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    Returns (node, root): every node that has an edge to another node, and the
    smallest node it can reach. Every step is an aggregate and an inner join
    against that aggregate written out first, so Spark may split the partition
    of a hub by itself. Loops and nulls are left out.
    """
    a, b = F.col(left), F.col(right)
    now = checkpointed(edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    for _ in range(most_rounds):
        if _starred(now):
            break
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = checkpointed(both.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("x")))
        large = checkpointed(both.filter("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("x").alias("lo")))
        least = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("x")))
        small = large.join(least, "hi").filter("lo != x").select(F.col("lo").alias("hi"), F.col("x").alias("lo"))
        now = checkpointed(small.union(least.select("hi", F.col("x").alias("lo"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return checkpointed(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct()))


def _starred(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it is one itself: the edges then are stars."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()
