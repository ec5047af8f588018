"""Scaling, encoding and feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions import calendar
from tradewind.functions.quantiles import exact_quantiles
from tradewind.functions.rowwise import (
    auto_pairs, columns_present, leading_interactions, numeric_columns, pair_interactions, polynomials, row_statistics)
from tradewind.operators import series
from tradewind.plans.blocks import is_hot, over_blocks
from tradewind.plans.chain import Chain
from tradewind.session import checkpointed


#: Columns of stored rows that one pass aggregates: many more make code that the JVM will not compile.
AT_ONCE = 12


def _aggregated(df: DataFrame, aggs: dict[str, list[Column]], at_once: int | None) -> dict:
    """The named aggregates of every column, in one pass, or over stored rows in passes that read ``at_once`` columns each."""
    names, row = list(aggs), {}
    step = at_once or max(1, len(names))
    for i in range(0, len(names), step):
        row |= df.agg(*[a for c in names[i : i + step] for a in aggs[c]]).first().asDict()
    return row


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard", at_once: int | None = None) -> DataFrame:
    """One row per column with centre and scale; scales that are zero but for rounding become 1. For ``at_once`` see :func:`_aggregated`."""
    columns = columns_present(df, columns)
    if method == "robust":
        fitted = [(c, q[1], q[2] - q[0]) for c, q in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items()]
    else:
        aggs = {}
        for c in columns:
            x = F.col(c).cast("double")
            pair = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
            aggs[c] = [pair[0].alias(f"{c}|c"), pair[1].alias(f"{c}|s")]
        if method not in ("standard", "minmax"):
            raise ValueError(f"unknown scaler {method}")
        row = _aggregated(df, aggs, at_once)
        fitted = [(c, row[f"{c}|c"], row[f"{c}|s"]) for c in columns]
    # a constant column's deviation may be the rounding of its mean
    rows = [(c, centre, scale if scale and abs(scale) > 1e-12 * abs(centre) else 1.0) for c, centre, scale in fitted]
    return df.sparkSession.createDataFrame(rows, "column string, centre double, scale double")


def transform_scaled(df: DataFrame, scaler: DataFrame, suffix: str = "") -> DataFrame:
    """Apply a fitted scaler: a projection with literals, no join."""
    rows = scaler.collect()  # one row per scaled column
    return df.withColumns({
        f"{r['column']}{suffix}": (F.col(r["column"]) - F.lit(r["centre"])) / F.lit(r["scale"])
        for r in rows if r["column"] in df.columns
    })


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    return transform_scaled(df, fit_scaler(df, columns, method))


def one_hot(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Indicator per level in sorted order, first level dropped, NULL all zero."""
    levels = _levels(df, column, most)
    if levels is None:
        raise ValueError(f"{column} has more than {most} levels")
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels[1:]}
    return df.withColumns(flags).drop(column) if flags else df.drop(column)


def _levels(df: DataFrame, column: str, most: int) -> list | None:
    """Sorted levels, or None when there are more than ``most``."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def ordinal_dimension(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values with their index in sorted order.

    The dimension is range-partitioned and numbered partition by partition; it
    is checkpointed first, because the sampled ranges must not change
    between the counting and the numbering pass.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    ranged = checkpointed(values.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").count().withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0)))
    numbered = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    return numbered.join(offsets, "_p").select(column, (F.col("_off") + F.col("_rn") - 1).alias(out))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    out = f"{column}_encoded"
    return df.join(ordinal_dimension(df, column, out), column, "left").drop(column)


def encode(df: DataFrame, columns: Sequence[str], most: int = 10) -> DataFrame:
    """One-hot up to ten levels, sorted index beyond."""
    for c in columns:
        df = one_hot(df, c, most) if _levels(df, c, most) is not None else label_encode(df, c)
    return df


def _ranking(df: DataFrame, scored: list[tuple[str, float | None]], k: int) -> DataFrame:
    best = sorted(((c, s) for c, s in scored if s is not None), key=lambda p: (-p[1], p[0]))[:k]
    return df.sparkSession.createDataFrame(
        [(i + 1, c, float(s)) for i, (c, s) in enumerate(best)], "rank int, feature string, score double")


def _correlation(x: Column, y: Column) -> Column:
    """Correlation over the rows that have both; NULL where one side is constant but for rounding."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.var_pop(a) > 1e-24 * F.pow(F.avg(a), F.lit(2.0))) & (F.var_pop(b) > 1e-24 * F.pow(F.avg(b), F.lit(2.0)))
    # roots of the same variances, so that no second pair of aggregates is kept
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))))


def select_by_correlation(df: DataFrame, target: str, features: Sequence[str], k: int = 20) -> DataFrame:
    """Top k by |correlation|, rows without target left out."""
    rows = df.where(F.col(target).isNotNull())
    row = rows.agg(*[_correlation(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in features]).first()
    return _ranking(df, [(c, None if row[c] is None else abs(row[c])) for c in features], k)


def select_by_f_test(df: DataFrame, target: str, features: Sequence[str], k: int = 20, fill: float | None = None, at_once: int | None = None) -> DataFrame:
    """Top k by F = r2 / (1 - r2) * (n - 2). For ``at_once`` see :func:`_aggregated`."""
    rows = df.where(F.col(target).isNotNull())
    if fill is not None:
        rows = rows.fillna(fill, list(features))
    aggs = {}
    for c in features:
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        aggs[c] = [_correlation(x, y).alias(f"{c}|r"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"{c}|n")]
    row = _aggregated(rows, aggs, at_once)

    def score(c):
        r = row[f"{c}|r"]
        if r is None or r * r >= 1:
            return None
        return r * r / (1 - r * r) * (row[f"{c}|n"] - 2)

    return _ranking(df, [(c, score(c)) for c in features], k)


def mutual_information(df: DataFrame, target: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information over equal-frequency bins, one contingency count per feature.

    Bin edges are exact quantiles; the counts are tiny (bins x bins) whatever
    the number of rows. This binned form stands for the nearest-neighbour estimator.
    """
    wanted = [*features, target]
    edges = exact_quantiles(df, wanted, [i / bins for i in range(1, bins)])

    def bin_of(c):
        return sum((F.when(F.col(c) > e, 1).otherwise(0) for e in sorted(set(edges[c]))), F.lit(0))

    binned = df.where(F.col(target).isNotNull()).select(*[F.when(F.col(c).isNotNull(), bin_of(c)).alias(c) for c in wanted])
    long = binned.select(F.col(target).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features]))).where("x is not null")
    joint = long.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    by = Window.partitionBy("feature")
    total, nx, ny = F.sum("n").over(by), F.sum("n").over(Window.partitionBy("feature", "x")), F.sum("n").over(
        Window.partitionBy("feature", "y"))
    parts = joint.select("feature", (F.col("n") / total * F.log(F.col("n") * total / (nx * ny))).alias("part"))
    return parts.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum("part")).alias("score"))


def select_features(df: DataFrame, target: str, features: Sequence[str], method: str = "correlation", k: int = 20) -> DataFrame:
    """Ranking by the named method, by correlation when that selects nothing."""
    if method == "f_test":
        ranked = select_by_f_test(df, target, features, k)
    elif method == "mutual_info":
        ranked = _ranking(df, [(r["feature"], r["score"]) for r in mutual_information(df, target, features).collect()], k)
    elif method == "correlation":
        return select_by_correlation(df, target, features, k)
    else:
        raise ValueError(f"unknown method {method}")
    return ranked if ranked.take(1) else select_by_correlation(df, target, features, k)


def _with_windows(df: DataFrame, columns, lags, windows, functions, only_full, averages, bands, volatility, spans, changes, keys, order, ranked=()) -> DataFrame:
    """All window features of a series key, and of ``ranked`` columns z-score and percentile rank.

    Statistics of whole series, relative changes, exponential means and lags
    come first, while the rows are narrow, as each of them sorts or copies
    rows; all moving frames come last, from one pass. Where no key is hot, the
    rows are shuffled once, by the key.
    """
    keys, out = list(keys), df
    hot = is_hot(df, keys)
    for c in ranked:
        out = series.percentile_ranks(series.z_scores(out, c, keys, hot=hot), c, keys, hot=hot)
    for c, (periods, name) in changes.items():
        out = series.padded_change(out, c, periods, name, keys, order, hot=hot)
    out = series.emas(out, {c: {} for c in bands}, spans, keys, order, hot=hot)
    moves, _ = series.rsi_stages(list(bands))

    def lagged(w):
        found = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags}
        return found | ({f"{c}_change": F.col(c) - F.lag(c, 1).over(w) for c in columns} if volatility else {}) | moves(w)

    out = over_blocks(out, keys, order, lagged, back=max(*lags, 1), hot=hot)
    frames = {f"{c}_{f}_{k}": (c, f, k, only_full) for c in columns for k in windows for f in functions}
    frames |= {f"{c}_volatility_{k}d": (c, "std", k, False) for c in columns for k in volatility}
    for c in bands:
        frames |= {f"{c}_sma_{k}": (c, "mean", k, True) for k in averages}
        frames |= {f"_mean_{c}": (c, "mean", 20, True), f"_dev_{c}": (c, "std", 20, True)}
        frames |= {f"_{x}s_{c}": (f"_{x}_{c}", "mean", 14, True) for x in ("gain", "loss")}
    out = series.frame_statistics(out, frames, keys, order, hot=hot)
    made = {}
    for c, names in bands.items():
        made |= series.bands_of(F.col(c), F.col(f"_mean_{c}"), F.col(f"_dev_{c}"), names) | {f"{c}_rsi": series.rsi_of(F.col(f"_gains_{c}"), F.col(f"_losss_{c}"))}
    return out.withColumns(made).drop(*[f"_{x}_{c}" for c in bands for x in ("gain", "loss", "gains", "losss", "mean", "dev")])


def engineer(df: DataFrame, ts: str | None, columns: Sequence[str], categories: Sequence[str] = (), keys=series.KEYS, order=series.ORDER,
             chain: Chain | None = None) -> DataFrame:
    """The full driver: lags, rolling statistics, interactions, polynomials, row statistics, encoding, calendar, technical indicators.

    Lags of 1, 7 and 30 rows; mean, deviation, least and greatest of full
    frames of 7, 14 and 30; of every column the means of 5, 10 and 20 rows,
    exponential means of as many, changes over 1, 5 and 10 rows, bands and
    relative strength. Without ``ts`` there are no lags, frames and calendar
    parts, nor indicators, which need an order. Window columns of the series
    key come from one pass; what follows reads them as stored.
    """
    chain, out = chain or Chain(df.sparkSession), df
    if ts:
        bands = {c: (f"{c}_bb_upper", f"{c}_bb_lower", f"{c}_bb_width") for c in columns}
        changes = {c: ((1, 5, 10), f"{c}_roc") for c in columns}
        out = chain.table("windows", lambda: _with_windows(
            df, columns, (1, 7, 30), (7, 14, 30), ("mean", "std", "min", "max"), True, (5, 10, 20), bands, (), (5, 10, 20), changes, keys, order))
    out = out.withColumns({**leading_interactions(columns), **polynomials(columns), **row_statistics(columns)})
    return encode(out.withColumns(calendar.prefixed_features(ts)) if ts else out, columns_present(out, categories))


def engineer_basic(df: DataFrame, ts: str, columns: Sequence[str], target: str | None = None, k: int | None = None, method: str | None = "standard",
                   keys=series.KEYS, order=series.ORDER, chain: Chain | None = None) -> DataFrame:
    """The second driver: calendar, lags, rolling and group statistics, indicators, interactions, then scaling and selection.

    Lags of 1, 3, 7 and 14 rows; mean, deviation, least, greatest and median of
    the last 7, 14, 30 and 60; z-score, percentile rank, change, relative
    change and volatility of each column; means of 5, 10, 20 and 50 rows,
    exponential means of as many, relative strength and bands of the first
    column with ``price`` in its name; interactions of each column with the next two.
    Window and group columns are stored once; the others, scaling too, are
    functions of a stored row and are derived where they are read. Scaling
    leaves keys, order columns and target as they are. With ``target`` and ``k`` the target and its k best
    features by F, missing values as 0, are returned.
    """
    chain, keys, order = chain or Chain(df.sparkSession), list(keys), list(order)
    price = [c for c in columns if "price" in c.lower()][:1]
    windowed = chain.table("windows", lambda: _with_windows(
        df, columns, (1, 3, 7, 14), (7, 14, 30, 60), ("mean", "std", "min", "max", "median"), False, (5, 10, 20, 50), {c: series.BANDS for c in price}, (7, 14, 30),
        (5, 10, 20, 50), {c: ((1,), f"{c}_pct_change") for c in columns}, keys, order, ranked=columns))

    pairs: dict = {}
    for a, b in auto_pairs(list(columns)):
        pairs |= pair_interactions(a, b)
    out = windowed.withColumns({**calendar.calendar_parts(ts), **calendar.cyclic_parts(ts), **calendar.calendar_flags(ts)} | pairs)
    kept = {*keys, *order, target}
    wanted = [c for c in numeric_columns(out) if c not in kept]
    if method:
        out = transform_scaled(out, fit_scaler(out, wanted, method, AT_ONCE))
    if target and k:
        best = [r["feature"] for r in select_by_f_test(out.fillna(0.0, [target]), target, wanted, k, fill=0.0, at_once=AT_ONCE // 3).orderBy("rank").collect()]
        out = out.select(target, *best)
    return out


def numeric_features(df: DataFrame, target: str) -> list[str]:
    return [c for c in numeric_columns(df) if c != target]
