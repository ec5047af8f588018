"""Table reads and writes: filtered queries, appends, upserts, deletes, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.vessels import latest

# Comparison by name; an unknown name compares for equality.
COMPARISONS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def predicate(filters: Mapping[str, object] | None) -> Column:
    """AND of all conditions; a value is compared for equality, a mapping by its operators."""
    parts = []
    for name, wanted in (filters or {}).items():
        tests = wanted if isinstance(wanted, Mapping) else {"$eq": wanted}
        parts += [COMPARISONS.get(op, COMPARISONS["$eq"])(F.col(name), value) for op, value in tests.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def query_table(
    df: DataFrame, filters: Mapping[str, object] | None = None, projection: Sequence[str] | None = None,
    sort: Sequence[tuple[str, int]] | None = None, limit: int | None = None, offset: int | None = None,
) -> DataFrame:
    """Filter, sort (1 ascending, else descending), page and project; 0 or None means no limit or offset."""
    out = df.where(predicate(filters))
    if sort:
        out = out.orderBy(*[F.col(c).asc() if d == 1 else F.col(c).desc() for c, d in sort])
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    return out.select(*projection) if projection else out


def query_text(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **views: DataFrame) -> DataFrame:
    """Parameterised SQL over named frames."""
    return spark.sql(sql, args=dict(args or {}), **views) if views else spark.sql(sql, args=dict(args or {}))


def stamped(df: DataFrame, now: str) -> DataFrame:
    """created_at and updated_at, set only where absent."""
    at = F.lit(now).cast("timestamp_ntz")
    return df.withColumns({
        c: F.coalesce(F.col(c), at) if c in df.columns else at for c in ("created_at", "updated_at")})


def append(df: DataFrame, path: str, now: str, partition_by: Sequence[str] = ()) -> None:
    writer = stamped(df, now).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(base: DataFrame, updates: DataFrame, order: Sequence[str], key: str | None = None) -> DataFrame:
    """New rows win over old ones of the same key; the last update of a key wins among updates.

    The key is ``symbol`` where there is one, else ``id``. Each update key
    keeps one row before the join, so many updates of one key cost nothing there.
    """
    key = key or ("symbol" if "symbol" in base.columns else "id")
    newest = latest(updates, [key], order).select(*base.columns)
    return base.join(newest, key, "left_anti").select(*base.columns).unionByName(newest)


def delete_where(df: DataFrame, filters: Mapping[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and a one-row frame with the number deleted; an unknown comparison deletes nothing."""
    gone = F.coalesce(predicate(filters), F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("deleted"))


def replace_table(df: DataFrame, root: str) -> str:
    """Write a full new version beside the old one and return its path.

    The old version stays readable until callers switch to the new path.
    """
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def retain(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` days."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def history(df: DataFrame, symbols: Sequence, as_of: str, days: int = 90, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """All wanted symbols of the last ``days`` days in one scan, ascending."""
    end = F.lit(as_of).cast("timestamp_ntz")
    rows = df.where(F.col(symbol).isin(list(symbols)) & F.col(ts).between(end - F.make_dt_interval(F.lit(days)), end))
    return rows.orderBy(symbol, ts)


def stale(ts: str, as_of: str, minutes: int, inclusive: bool = False) -> Column:
    """Older than the given age."""
    age = F.lit(as_of).cast("timestamp_ntz") - F.col(ts)
    bound = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return age >= bound if inclusive else age > bound


def snapshot(tables: Mapping[str, DataFrame], root: str, now: str) -> DataFrame:
    """Parquet copy per table plus a manifest with row counts."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        rows.append((name, spark.read.parquet(f"{root}/{name}").count(), now))
    manifest = spark.createDataFrame(rows, "table_name string, row_count bigint, taken_at string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/_tables")
    return manifest


def restore(spark: SparkSession, root: str, targets: Mapping[str, str], overwrite: bool = False) -> None:
    """Write snapshot tables back, replacing or appending."""
    for name, path in targets.items():
        spark.read.parquet(f"{root}/{name}").write.mode("overwrite" if overwrite else "append").parquet(path)


def write_run(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Sink of one collection run, partitioned by day."""
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_delimited(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows) of delimited files.

    A row with a field that does not parse is in the second frame as text, with
    the names of its bad columns in ``bad_columns``, whichever columns are
    read: fields are read as text and cast here, because the reader's own check
    looks only at the columns a query asks for.
    """
    fields = StructType.fromDDL(schema).fields
    raw = spark.read.csv(path, schema=", ".join(f"`{f.name}` string" for f in fields), header=header)
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = F.array_compact(F.array(*[F.when(typed[n].isNull() & F.col(n).isNotNull(), F.lit(n)) for n in typed]))
    return (
        raw.where(F.size(bad) == 0).select(*[c.alias(n) for n, c in typed.items()]),
        raw.withColumn("bad_columns", bad).where(F.size("bad_columns") > 0))


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Table bucketed and sorted on its join keys, for joins without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
