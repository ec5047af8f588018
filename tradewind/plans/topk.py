"""First k rows per key, cut on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """``row_number() <= k`` per key.

    Spark plans the filter as a group limit below the exchange, so each task
    sends at most ``k`` rows of a key however many it holds.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def listed(df: DataFrame, keys: Sequence[str], rank: str, value: str, out: str) -> DataFrame:
    """Collect an already limited set of ranked rows into an ordered array."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(value))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(out))
