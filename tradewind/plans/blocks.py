"""Window layouts that stay parallel when one key holds most of the rows.

``Window.partitionBy(key)`` puts a whole key into one task. That is the right
plan while every key is small, and it is what these helpers produce then. Once
the largest key passes ``hot_rows`` they switch to a split layout:

* *chunks*: the rows are cut into ranges of the keys and all order columns, so
  row positions come from small per-chunk counts;
* *blocks*: rows of one key are regrouped by position into blocks, each with a
  halo of neighbours, so any frame of bounded reach is computed block by block;
* *carries*: running totals add per-chunk totals to in-chunk totals.

The cut rows are written to the shared checkpoint folder, so a task that is run
again after the loss of an executor sees the same layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tradewind.session import checkpointed

HOT_ROWS = 2_000_000


def is_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> bool:
    """Does any key hold more than ``hot_rows`` rows? One counting pass."""
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if not keys:
        return df.count() > limit
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return (row["n"] or 0) > limit


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys, adding only ``values``."""
    joined = df.alias("l").join(small.alias("r"), _same(keys, "l", "r"), "left")
    return joined.select("l.*", *[F.col(f"r.{v}") for v in values])


def with_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None, out: str = "_chunk", rows: int | None = None
) -> DataFrame:
    """Cut the rows into ranges of (keys, order) of about half ``hot_rows`` rows each.

    Any order type will do, text too, and rows that tie in the first order
    column are cut by the others. Only rows that tie in all of them stay
    together. A key that fits into a range lies in one or two of them. ``rows``
    is their number, if it is known.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    parts = max(2, math.ceil(2 * (df.count() if rows is None else rows) / max(1, limit)))
    return checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn(out, F.spark_partition_id()))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_pos", hot_rows: int | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """0-based position of each row inside its key."""
    keys, hot = list(keys), is_hot(df, keys, hot_rows) if hot is None else hot
    if not hot:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    cut = with_chunks(df, keys, order, hot_rows)
    group = [*keys, "_chunk"]
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*group).count().withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0)))
    local = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return (
        attach(local, offsets, group, ["_off"])
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
        .drop("_off", "_rn", "_chunk")
    )


def _halo(df: DataFrame, back: int, ahead: int, rows: int) -> DataFrame:
    """Copy rows near block edges into the neighbouring blocks."""
    own, place = F.floor(F.col("_pos") / rows), F.col("_pos") % rows
    targets = F.array_compact(F.array(
        own,
        F.when(place >= rows - back, own + 1),
        F.when((place < ahead) & (own > 0), own - 1),
    ))
    return df.withColumn("_own", own).withColumn("_blk", F.explode(targets))


def blocks_of(df: DataFrame, back: int, rows: int) -> DataFrame:
    """Rows with a position ``_pos`` and the block ``_blk`` they belong to, the last ``back`` ones of a block in the next one too."""
    if rows < back:
        raise ValueError("a block must be at least as long as the reach into it")
    return _halo(df, back, 0, rows).drop("_own")


def over_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *stages: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0, ahead: int = 0, hot_rows: int | None = None, block_rows: int | None = None,
    hot: bool | None = None, at: str | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows behind and ``ahead`` rows on.

    Each stage maps a window spec to new columns and may use the columns of the
    stages before it; ``back`` and ``ahead`` cover the reach of all of them.
    ``block_rows`` forces the block layout (for formulas that need short blocks).
    ``at`` names a column that already holds the positions of :func:`with_position`.
    """
    keys = list(keys)
    hot = is_hot(df, keys, hot_rows) if hot is None else hot
    if not hot and block_rows is None:
        spec = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        for stage in stages:
            df = df.withColumns(stage(spec))
        return df
    size = block_rows or max(HOT_ROWS if hot_rows is None else hot_rows, back + ahead + 1)
    if size < max(back, ahead):
        raise ValueError("a block must be at least as long as the reach of its frames")
    known = df.withColumn("_pos", F.col(at)) if at else with_position(df, keys, order, hot_rows=hot_rows, hot=hot)
    placed = _halo(known, back, ahead, size)
    spec = Window.partitionBy(*keys, "_blk").orderBy("_pos")
    for stage in stages:
        placed = placed.withColumns(stage(spec))
    return placed.where("_blk = _own").drop("_blk", "_own", "_pos")


def over_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], fields: Sequence[StructField],
    add: Callable[[dict, np.ndarray], list[pa.Array]], back: int, hot_rows: int | None = None, hot: bool | None = None,
) -> DataFrame:
    """Add ``fields`` that ``add`` computes from arrays of ``columns``, for frames that reach ``back`` rows behind.

    Spark brings the rows of a key, or of a block of a hot one, together in
    order; ``add`` sees them batch by batch. It gets (values, known) of each
    column, ``back`` rows from before the batch included, and for each row of
    the batch how many rows of its own key lie before it: what is further back
    belongs to other keys.
    """
    keys, order = list(keys), list(order)
    hot = is_hot(df, keys, hot_rows) if hot is None else hot
    placed, group = df, keys
    if hot:
        size = max(HOT_ROWS if hot_rows is None else hot_rows, back + 1)
        placed, group, order = _halo(with_position(df, keys, order, hot_rows=hot_rows, hot=True), back, 0, size), [*keys, "_blk"], ["_pos"]
    behind = (F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)) - 1).cast("bigint")
    rows = placed.withColumn("_behind", behind).sortWithinPartitions(*group, "_behind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {}
        for batch in batches:
            seen = {}
            for c in columns:
                known, values = batch.column(c).is_valid().to_numpy(zero_copy_only=False), batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                before = last.get(c, (np.zeros(back, values.dtype), np.zeros(back, bool)))
                seen[c] = np.concatenate([before[0], values]), np.concatenate([before[1], known])
                last[c] = tuple(x[len(x) - back :] for x in seen[c])
            added = add(seen, batch.column("_behind").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[f.name for f in fields]])

    done = rows.mapInArrow(run, StructType([*rows.schema.fields, *fields])).drop("_behind")
    return done.where("_blk = _own").drop("_blk", "_own", "_pos") if hot else done


def over_time(
    df: DataFrame, keys: Sequence[str], micros: str, build: Callable[[WindowSpec], dict[str, Column]], seconds: int,
    hot_rows: int | None = None,
) -> DataFrame:
    """Window columns whose range frames reach ``seconds`` back along a microsecond column.

    A hot key is cut into time blocks as long as the reach; a row is copied
    into the next block, where it can still be seen.
    """
    keys = list(keys)
    if not is_hot(df, keys, hot_rows):
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(micros)))
    own = F.floor(F.col(micros) / (seconds * 1_000_000))
    spread = df.withColumn("_own", own).withColumn("_blk", F.explode(F.array(own, own + 1)))
    spec = Window.partitionBy(*keys, "_blk").orderBy(micros)
    return spread.withColumns(build(spec)).where("_blk = _own").drop("_blk", "_own")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, tuple[str, Column]],
    hot_rows: int | None = None, backward: bool = False, hot: bool | None = None,
) -> DataFrame:
    """Unbounded running ``sum``, ``max`` or ``last`` (last known value) per key.

    ``backward`` runs from the end of the key (so ``last`` is a backward fill).
    """
    keys = list(keys)
    spec = [F.col(c).desc() for c in order] if backward else [F.col(c) for c in order]
    pick = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}

    def through(partition, by):
        w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*by)
        return w.rowsBetween(Window.unboundedPreceding, 0)

    rows = None
    if hot is None and not keys:
        rows = df.count()
        hot = rows > (HOT_ROWS if hot_rows is None else hot_rows)
    if not (is_hot(df, keys, hot_rows) if hot is None else hot):
        w = through(keys, spec)
        return df.withColumns({out: pick[how](col).over(w) for out, (how, col) in totals.items()})

    cut = with_chunks(df, keys, order, hot_rows, rows=rows)
    group = [*keys, "_chunk"]
    marked = cut.withColumns({f"_in_{out}": col for out, (_, col) in totals.items()})
    place = F.struct(*[F.col(c) for c in order])
    edge = F.min_by if backward else F.max_by

    def chunk_total(out, how):
        c = F.col(f"_in_{out}")
        if how == "last":
            return edge(c, F.when(c.isNotNull(), place))
        return pick[how](c)

    chunks = marked.groupBy(*group).agg(*[chunk_total(o, h).alias(f"_t_{o}") for o, (h, _) in totals.items()])
    by = F.col("_chunk").desc() if backward else F.col("_chunk")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.withColumns({f"_c_{o}": pick[h](F.col(f"_t_{o}")).over(before) for o, (h, _) in totals.items()})
    w = through(group, spec)
    local = marked.withColumns({f"_l_{o}": pick[h](F.col(f"_in_{o}")).over(w) for o, (h, _) in totals.items()})
    joined = attach(local, carry, group, [f"_c_{o}" for o in totals])

    def merged(out, how):
        own, prior = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if how == "sum":
            return F.when(own.isNull(), prior).otherwise(own + F.coalesce(prior, F.lit(0)))
        return F.greatest(own, prior) if how == "max" else F.coalesce(own, prior)

    done = joined.withColumns({o: merged(o, h) for o, (h, _) in totals.items()})
    scrap = [f"{p}{o}" for o in totals for p in ("_in_", "_l_", "_c_")]
    return done.drop("_chunk", *scrap)


def group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Per-key aggregates attached to every row through partial aggregation."""
    keys = list(keys)
    if not keys:
        row = df.agg(*[c.alias(o) for o, c in stats.items()]).first()
        return df.withColumns({o: F.lit(row[o]) for o in stats})
    return attach(df, df.groupBy(*keys).agg(*[c.alias(o) for o, c in stats.items()]), keys, list(stats))
