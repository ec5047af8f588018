"""Cleaning: typing, missing values, outliers, validation and the whole chain."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tradewind.functions.quantiles import exact_quantiles, modes
from tradewind.functions.rowwise import numeric_columns, text_columns
from tradewind.operators.isolation import series_outliers
from tradewind.operators.nearest import SPACES, gap_code, nearest_donors, spaces_of
from tradewind.operators.quality import outlier_flag, profile_row
from tradewind.plans.blocks import is_hot, running, with_position
from tradewind.plans.topk import top_k
from tradewind.session import checkpointed


def coerce_types(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.8) -> DataFrame:
    """Text columns become numbers, else times, when more than 80 % of all rows parse.

    A number is an optional sign, digits with an optional point and an optional
    exponent; suffixes as in ``12d`` and ``NaN`` are text.
    """
    texts = list(columns) if columns is not None else text_columns(df)
    if not texts:
        return df
    tests = []
    for c in texts:
        tests += [F.avg(_number(c).isNotNull().cast("double")).alias(f"{c}|n"),
                  F.avg(F.col(c).try_cast("timestamp_ntz").isNotNull().cast("double")).alias(f"{c}|t")]
    row = df.agg(*tests).first()
    out = {}
    for c in texts:
        if (row[f"{c}|n"] or 0) > share:
            out[c] = _number(c)
        elif (row[f"{c}|t"] or 0) > share:
            out[c] = F.col(c).try_cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def _number(c: str) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.col(c).try_cast("double"))


def apply_validators(df: DataFrame, validators: Mapping[str, Callable]) -> DataFrame:
    """Per-column validators: a Column -> Column function, or a pandas series function.

    A pandas validator runs as a scalar Arrow function. If it fails on any part
    of a column, the whole column is left as it is, whatever the batches were:
    one pass asks, a second one applies it.
    """
    for name, validator in validators.items():
        if name not in df.columns:
            continue
        if getattr(validator, "on_pandas", False):
            checked = _on_batches(validator, df.schema[name].dataType)(F.col(name))
            if df.agg(F.bool_and(checked["ok"]).alias("ok")).first()["ok"]:
                df = df.withColumn(name, checked["value"])
        else:
            df = df.withColumn(name, validator(F.col(name)))
    return df


def _on_batches(validator: Callable, kind):
    def run(values: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": validator(values), "ok": True})
        except Exception:
            return pd.DataFrame({"value": values, "ok": False})

    return F.pandas_udf(run, StructType([StructField("value", kind), StructField("ok", BooleanType())]))


def on_pandas(function):
    """Mark a validator that takes and returns a pandas series."""
    function.on_pandas = True
    return function


def drop_empty(df: DataFrame) -> DataFrame:
    """All-null rows, then all-null columns."""
    rows = df.dropna(how="all")
    counts = rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if counts[c]])


def drop_sparse(df: DataFrame, limit: float = 0.5, target: str | None = None) -> DataFrame:
    """Columns missing in more than half of the rows, the target excepted."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if c == target or (row[c] or 0.0) <= limit])


def impute_numeric(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Mean, median or most frequent value (smallest on ties)."""
    if not columns:
        return df
    if how == "mean":
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    elif how == "median":
        row = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    elif how == "most_frequent":
        row = modes(df, columns)
    else:
        raise ValueError(f"unknown imputation {how}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c]).cast("double")) for c in columns})


def impute_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent text, 'Unknown' where a column has none."""
    top = modes(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(top[c] if top[c] is not None else "Unknown")) for c in columns})


def impute_nearest(df: DataFrame, columns: Sequence[str], key: str, k: int = 5, tile_rows: int = 2_000) -> DataFrame:
    """Mean of the k nearest donors, distance over the coordinates both rows have; exact, ties to the smaller key.

    Rows with gaps visit only the cells of about ``tile_rows`` donors that one
    of their nearest may lie in, so the work grows with the rows and not with
    rows times donors. Where the kinds of gaps are too many for a tree each
    (many columns), every row visits all donors, tile by tile.
    """
    columns = list(columns)
    d = len(columns)
    base = df.select(F.col(key).cast("bigint").alias("_id"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    base = base.withColumn("_code", gap_code([f"_x{i}" for i in range(d)]))
    codes = {r["_code"]: r["count"] for r in base.groupBy("_code").count().limit(SPACES + 1).collect()}
    spaces = spaces_of(list(codes)) if len(codes) <= SPACES else None
    if spaces is not None and not spaces:
        return df.withColumns({c: F.col(c).cast("double") for c in columns})
    few = spaces is not None and len(spaces) <= SPACES
    found = nearest_donors(base, d, k, tile_rows, codes) if few else _nearest_by_tiles(base.drop("_code"), d, k, max(tile_rows, 20_000))
    best = top_k(found, ["_id", "_col"], [F.col("_dist"), F.col("_donor")], k)
    fills = best.groupBy("_id").agg(*[F.avg(F.when(F.col("_col") == i, F.col("_value"))).alias(f"_f{i}") for i in range(d)])
    joined = df.join(fills, F.col(key) == fills["_id"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_f{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def _nearest_by_tiles(base: DataFrame, d: int, k: int, tile_rows: int) -> DataFrame:
    """The k nearest donors of each tile, for any kinds of gaps: rows with gaps times donors, spread over tasks."""
    gap_list = F.array_compact(F.array(*[F.when(F.col(f"_x{i}").isNull(), F.lit(i)) for i in range(d)]))
    sizes = base.agg(F.count("*").alias("n"), F.count_if(F.size(gap_list) > 0).alias("g")).first()
    tiles, parts = (max(1, math.ceil(sizes[x] / tile_rows)) for x in ("n", "g"))
    by_hash = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n).cast("bigint"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    visits = base.where(F.size(gap_list) > 0).withColumn("_part", by_hash(parts)).withColumn("_tile", every(tiles))
    donors = base.withColumn("_tile", by_hash(tiles)).withColumn("_part", every(parts))
    names = [f"_x{i}" for i in range(d)]

    def nearest(pair_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        there, ids = right[names].to_numpy(dtype=float), right["_id"].to_numpy()
        for start in range(0, len(left), 128):
            part = left.iloc[start : start + 128]
            here = part[names].to_numpy(dtype=float)
            square, shared = np.zeros((len(part), len(right))), np.zeros((len(part), len(right)))
            for i in range(d):
                gap = here[:, i, None] - there[None, :, i]
                both = ~np.isnan(gap)
                square += np.where(both, gap * gap, 0.0)
                shared += both
            dist = np.where(shared > 0, square / np.maximum(shared, 1) * d, np.inf)
            for i in range(d):
                donor = np.flatnonzero(~np.isnan(there[:, i]))
                for row in np.flatnonzero(np.isnan(here[:, i])):
                    reach = dist[row, donor]
                    edge = np.partition(reach, k - 1)[k - 1] if len(reach) > k else np.inf
                    near = np.flatnonzero((reach <= edge) & np.isfinite(reach))
                    near = near[np.lexsort((ids[donor[near]], reach[near]))][:k]
                    out += [(part["_id"].iloc[row], i, reach[j], ids[donor[j]], there[donor[j], i]) for j in near]
        return pd.DataFrame(out, columns=["_id", "_col", "_dist", "_donor", "_value"])

    return visits.groupBy("_tile", "_part").cogroup(donors.groupBy("_tile", "_part")).applyInPandas(
        nearest, "_id bigint, _col int, _dist double, _donor bigint, _value double")


def zscore_flags(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> dict[str, Column]:
    stats = profile_row(df.select(*columns))
    return {c: outlier_flag(c, stats, limit) for c in columns}


def modified_z_flags(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> dict[str, Column]:
    """0.6745 |x - median| / MAD > 3; a zero MAD flags nothing."""
    medians = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    spread = df.select(*[F.abs(F.col(c) - F.lit(medians[c])).alias(c) for c in columns])
    mads = {c: q[0] for c, q in exact_quantiles(spread, columns, [0.5]).items()}
    return {
        c: F.coalesce(F.abs(F.lit(0.6745) * (F.col(c) - medians[c]) / mads[c]) > limit, F.lit(False)) if mads[c] else F.lit(False)
        for c in columns
    }


def iqr_flags(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return _fences(exact_quantiles(df, columns, [0.25, 0.75]))


def _fences(quartiles: Mapping[str, Sequence[float | None]], reach: float = 1.5) -> dict[str, Column]:
    out = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is None:
            out[c] = F.lit(False)
            continue
        step = reach * (q3 - q1)
        out[c] = F.coalesce((F.col(c) < q1 - step) | (F.col(c) > q3 + step), F.lit(False))
    return out


OUTLIERS: dict[str, Callable[[DataFrame, Sequence[str]], dict[str, Column]]] = {
    "zscore": zscore_flags, "modified_zscore": modified_z_flags, "iqr": iqr_flags}


def cap_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """A column with any outlier is clipped to its own 5 % / 95 % quantiles.

    Fences and clipping edges come from one quantile pass.
    """
    if not columns:
        return df
    if method == "iqr":
        found = exact_quantiles(df, columns, [0.25, 0.75, low, high])
        flags, edges = _fences({c: q[:2] for c, q in found.items()}), {c: q[2:] for c, q in found.items()}
    else:
        flags, edges = OUTLIERS[method](df, columns), None
    hit = df.agg(*[F.bool_or(flag).alias(c) for c, flag in flags.items()]).first()
    touched = [c for c in columns if hit[c]]
    return _clip(df, {c: edges[c] for c in touched}) if edges else clip_quantiles(df, touched, low, high)


def clip_quantiles(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    """Clip to two quantiles, NULL kept (also the winsorizing step)."""
    return _clip(df, exact_quantiles(df, columns, [low, high])) if columns else df


def _clip(df: DataFrame, edges: Mapping[str, Sequence[float | None]]) -> DataFrame:
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.lit(b), F.greatest(F.lit(a), F.col(c).cast("double"))))
        for c, (a, b) in edges.items() if a is not None
    })


def series_anomalies(df: DataFrame, column: str, keys=("series_id",), order=("ts", "id"), limit: float = 3.0) -> DataFrame:
    """Anomalous rows of each series by both methods, and how many the series has by that method.

    ``statistical``: |z| > 3 in series of at least 10 values;
    ``isolation_forest``: the series' own forest, in series of more than 10.
    NULL and NaN values have no part in either, series of infinite range none at all.
    """
    keys, order = list(keys), list(order)
    known = df.where(~F.isnan(column))
    stats = known.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"), F.count(column).alias("_n"))
    joined = known.join(stats, keys)
    spread = (F.col("_s") > 0) & (F.col("_s") < math.inf)  # NaN is above all numbers here
    flagged = joined.where((F.col("_n") >= 10) & spread & (F.abs(F.col(column) - F.col("_m")) / F.col("_s") > limit))
    columns = [*keys, "method", *order, column, "anomalies"]
    counted = flagged.join(flagged.groupBy(*keys).agg(F.count("*").alias("anomalies")), keys).withColumn("method", F.lit("statistical"))
    forest = series_outliers(df, column, keys, order).withColumn(column, F.col(column).cast(df.schema[column].dataType))
    return counted.select(*columns).unionByName(forest.withColumn("method", F.lit("isolation_forest")).select(*columns))


def interpolate(df: DataFrame, column: str, out: str, keys=("series_id",), order=("ts", "id"), **kw) -> DataFrame:
    """Linear by position between known neighbours; a trailing gap holds the last value."""
    kw = {**kw, "hot": is_hot(df, list(keys), kw.get("hot_rows")) if kw.get("hot") is None else kw["hot"]}
    placed = with_position(df, keys, order, out="_at", **kw)
    here = F.when(F.col(column).isNotNull(), F.struct(F.col("_at").alias("p"), F.col(column).cast("double").alias("v")))
    ahead = running(placed, keys, ["_at"], {"_prev": ("last", here)}, **kw)
    both = running(ahead, keys, ["_at"], {"_next": ("last", here)}, backward=True, **kw)
    p, n, at = F.col("_prev"), F.col("_next"), F.col("_at")
    line = p.v + (n.v - p.v) * (at - p.p) / (n.p - p.p)
    value = F.coalesce(F.col(column).cast("double"), F.when(p.isNotNull() & n.isNotNull(), line), p.v)
    return both.withColumn(out, value).drop("_prev", "_next", "_at")


def validate_rules(df: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One row per violated rule; ``rules`` are (column, rule, passes)."""
    errors = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"))) for c, r, ok in rules]))
    return df.select(F.col(key), F.explode(errors).alias("_e")).select(key, "_e.column", "_e.rule")


def rule_minimum(c: str, low: float) -> tuple[str, str, Column]:
    return c, "minimum", F.col(c).isNull() | (F.col(c) >= low)


def rule_required(c: str) -> tuple[str, str, Column]:
    return c, "required", F.col(c).isNotNull()


def rule_length(c: str, n: int) -> tuple[str, str, Column]:
    return c, "min_length", F.col(c).isNull() | (F.length(c) >= n)


def rule_date(c: str, fmt: str = "yyyy-MM-dd") -> tuple[str, str, Column]:
    return c, "date_format", F.col(c).isNull() | F.try_to_timestamp(F.col(c), F.lit(fmt)).isNotNull()


def clean(
    df: DataFrame, numeric: str = "median", outliers: str = "iqr", target: str | None = None,
    validators: Mapping[str, Callable] | None = None, history: list | None = None,
) -> DataFrame:
    """The whole chain: empty, duplicate, sparse, missing, outlying, mistyped, invalid.

    The duplicate-free rows are written to the shared folder because every later
    step first needs statistics over them.
    """
    known: dict[int, tuple[DataFrame, int]] = {}  # the frames are kept, so that no other takes an id

    def size(rows: DataFrame) -> int:
        if id(rows) not in known:
            known[id(rows)] = rows, rows.count()
        return known[id(rows)][1]

    def note(step: str, before: DataFrame, after: DataFrame) -> DataFrame:
        if history is not None:
            history.append(processing_step(step, before, after, (size(before), size(after))))
        return after

    out = note("empty", df, drop_empty(df))
    out = note("duplicates", out, checkpointed(out.dropDuplicates()))
    out = note("sparse", out, drop_sparse(out, target=target))
    numbers = [c for c in numeric_columns(out) if c != target]
    texts = [c for c in text_columns(out) if c != target]
    out = note("missing", out, impute_categories(impute_numeric(out, numbers, numeric), texts))
    out = note("outliers", out, cap_outliers(out, numbers, outliers))
    out = note("types", out, coerce_types(out))
    return note("validators", out, apply_validators(out, validators or {}))


def processing_step(step: str, before: DataFrame, after: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """Lineage row of one step: sizes before and after, and their differences; ``rows`` are their counts, if known."""
    n_in, n_out = rows or (before.count(), after.count())
    return before.sparkSession.createDataFrame(
        [(step, n_in, len(before.columns), n_out, len(after.columns), n_out - n_in, len(after.columns) - len(before.columns))],
        "step string, rows_in bigint, columns_in int, rows_out bigint, columns_out int, row_change bigint, column_change int")
