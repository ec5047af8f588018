"""Time-series features per series key.

Every function takes the series keys and a total order of rows. Frames with a
bounded reach go through :func:`over_blocks`, running ones through
:func:`running`, so a series of any length is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField

from tradewind.plans.blocks import attach, group_stats, is_hot, over_arrays, over_blocks, running, with_position
from tradewind.plans.topk import top_k

KEYS, ORDER = ("series_id",), ("ts", "id")


def _frame(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def full(aggregate: Column, value: Column, w: WindowSpec, k: int) -> Column:
    """The aggregate once the frame holds ``k`` values, else NULL."""
    return F.when(F.count(value).over(_frame(w, k)) == k, aggregate.over(_frame(w, k)))


def _with_hot(df: DataFrame, keys: Sequence[str], kw: dict) -> dict:
    """Measure once per operator whether a key is hot and pass the answer to its steps."""
    return kw if kw.get("hot") is not None else {**kw, "hot": is_hot(df, list(keys), kw.get("hot_rows"))}


def lag_features(df: DataFrame, columns: Sequence[str], lags=(1, 3, 7, 14), keys=KEYS, order=ORDER, **kw) -> DataFrame:
    return over_blocks(
        df, keys, order, lambda w: {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags},
        back=max(lags), **kw)


# Aggregations that can be chosen by name in configuration.
ROLLING: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "sum": F.sum,
    "count": F.count,
    "var": F.var_samp,
}


def rolling_features(
    df: DataFrame, columns: Sequence[str], windows=(7, 14, 30, 60), functions=("mean", "std", "min", "max", "median"),
    only_full: bool = False, keys=KEYS, order=ORDER, **kw,
) -> DataFrame:
    """Rolling statistics by name, either from the first row on or only over full frames."""
    return frame_statistics(df, {f"{c}_{f}_{k}": (c, f, k, only_full) for c in columns for k in windows for f in functions}, keys, order, **kw)


#: Statistics and column types that :func:`frame_statistics` takes as arrays.
ON_ARRAYS = ("mean", "std", "min", "max", "median")
PLAIN = (DoubleType(), LongType(), IntegerType())


def frame_statistics(df: DataFrame, wanted: Mapping[str, tuple[str, str, int, bool]], keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Statistics of the last k rows, as a map of names to (column, statistic of ``ROLLING``, k, only over full frames).

    Window functions visit each frame anew for each row, and a median builds a
    map of its frame; so frames of plain numbers are taken as arrays, batch by
    batch. Other statistics and types use window functions.
    """
    plain = {o: x for o, x in wanted.items() if x[1] in ON_ARRAYS and df.schema[x[0]].dataType in PLAIN}
    rest = {o: x for o, x in wanted.items() if o not in plain}
    kw = _with_hot(df, keys, kw)
    if rest:
        def build(w):
            return {o: full(ROLLING[f](F.col(c)), F.col(c), w, k) if only_full else ROLLING[f](F.col(c)).over(_frame(w, k))
                    for o, (c, f, k, only_full) in rest.items()}

        df = over_blocks(df, keys, order, build, back=max(k for _, _, k, _ in rest.values()) - 1, **kw)
    if plain:
        columns = sorted({c for c, *_ in plain.values()})
        kinds = {o: df.schema[c].dataType if f in ("min", "max") else DoubleType() for o, (c, f, _, _) in plain.items()}
        fields, types = [StructField(o, t) for o, t in kinds.items()], {o: _ARROW[type(t)] for o, t in kinds.items()}
        df = over_arrays(df, keys, order, columns, fields, lambda seen, behind: _frames(seen, behind, plain, types), max(k for _, _, k, _ in plain.values()) - 1, **kw)
    return df.select(*[c for c in df.columns if c not in wanted], *wanted)


_ARROW = {DoubleType: pa.float64(), LongType: pa.int64(), IntegerType: pa.int32()}


def _frames(seen: Mapping[str, tuple[np.ndarray, np.ndarray]], behind: np.ndarray, wanted, types) -> list[pa.Array]:
    """The wanted statistics of a batch; all of one column and frame share its values."""
    found = {}
    for c, k in sorted({(c, k) for c, _, k, _ in wanted.values()}):
        values, known = (np.lib.stride_tricks.sliding_window_view(x, k)[-len(behind) :] for x in seen[c])
        held = known & (np.arange(k - 1, -1, -1) <= behind[:, None])
        n = held.sum(axis=1)
        for f in {f for x, f, y, _ in wanted.values() if (x, y) == (c, k)}:
            found[c, f, k] = (*_statistic(f, values, held, n), n == k)
    out = []
    for o, (c, f, k, only_full) in wanted.items():
        value, ok, whole = found[c, f, k]
        out.append(pa.array(value, types[o], mask=~(ok & whole if only_full else ok), from_pandas=False))
    return out


def _statistic(name: str, values: np.ndarray, held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, known) per frame, a row of ``values`` each. NaN is a value and the greatest one, as in Spark."""
    with np.errstate(all="ignore"):
        if name in ("min", "max"):
            if values.dtype.kind == "i":
                edge = np.iinfo(values.dtype)
                return (np.where(held, values, edge.max).min(axis=1) if name == "min" else np.where(held, values, edge.min).max(axis=1)), n > 0
            return (np.fmin.reduce(np.where(held, values, np.nan), axis=1) if name == "min" else np.where(held, values, -np.inf).max(axis=1)), n > 0
        values = values.astype(float, copy=False)
        if name == "median":
            ranked = np.sort(np.where(held, values, np.nan), axis=1)  # NaN comes last
            low, high = (np.take_along_axis(ranked, np.maximum(at, 0)[:, None], axis=1)[:, 0] for at in ((n - 1) // 2, np.minimum(n // 2, ranked.shape[1] - 1)))
            return np.where(low == high, low, low * 0.5 + high * 0.5), n > 0
        mean = np.where(held, values, 0.0).sum(axis=1) / n
        if name == "mean":
            return mean, n > 0
        away = np.where(held, values - mean[:, None], 0.0)
        return np.sqrt((away * away).sum(axis=1) / (n - 1)), n > 1


def padded_change(df: DataFrame, column: str, periods=(1,), prefix: str | None = None, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Relative change after carrying the last known value forward."""
    kw = _with_hot(df, keys, kw)
    filled = running(df, keys, order, {"_fill": ("last", F.col(column))}, **kw)
    name = prefix or f"{column}_pct_change"

    def build(w):
        return {
            (name if len(periods) == 1 else f"{name}_{k}"):
                F.try_divide(F.col("_fill"), F.lag("_fill", k).over(w)) - 1
            for k in periods
        }

    return over_blocks(filled, keys, order, build, back=max(periods), **kw).drop("_fill")


def z_scores(df: DataFrame, column: str, keys=KEYS, hot: bool | None = None) -> DataFrame:
    """(x - mean) / (sample std + 1e-8) per group, through partial aggregates.

    Callers that window the same groups anyway and know that none is hot pass
    ``hot=False``: the rows stay where they are, and no join is needed.
    """
    stats = {"_m": F.avg(column), "_s": F.stddev_samp(column)}
    z = (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)
    if hot is False:
        group = Window.partitionBy(*keys)
        return df.withColumns({o: c.over(group) for o, c in stats.items()}).withColumn(f"{column}_zscore", z).drop(*stats)
    return group_stats(df, keys, stats).withColumn(f"{column}_zscore", z).drop("_m", "_s")


def percentile_ranks(df: DataFrame, column: str, keys=KEYS, hot_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Average-tie percentile rank per group."""
    out, keys = f"{column}_percentile", list(keys)
    if not (is_hot(df, keys, hot_rows) if hot is None else hot):
        group = Window.partitionBy(*keys)
        ties = F.count("*").over(Window.partitionBy(*keys, column))
        rank = F.rank().over(group.orderBy(F.col(column).asc_nulls_last()))
        return df.withColumn(
            out, F.when(F.col(column).isNotNull(), (rank + (ties - 1) / 2.0) / F.count(column).over(group)))
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_ties"))
    ranked = running(counts, keys, [column], {"_upto": ("sum", F.col("_ties"))}, hot_rows=hot_rows)
    ranked = group_stats(ranked, keys, {"_n": F.sum("_ties")}).withColumn(
        out, (F.col("_upto") - (F.col("_ties") - 1) / 2.0) / F.col("_n"))
    return attach(df, ranked, [*keys, column], [out]).withColumn(out, F.when(F.col(column).isNotNull(), F.col(out)))


def change_features(df: DataFrame, column: str, windows=(7, 14, 30), keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """First difference and rolling deviation from the first row on."""
    def build(w):
        c = F.col(column)
        return {
            f"{column}_change": c - F.lag(c, 1).over(w),
            **{f"{column}_volatility_{k}d": F.stddev_samp(c).over(_frame(w, k)) for k in windows},
        }

    return over_blocks(df, keys, order, build, back=max(max(windows) - 1, 1), **kw)


def moving_averages(df: DataFrame, column: str, windows=(5, 10, 20, 50), keys=KEYS, order=ORDER, **kw) -> DataFrame:
    c = F.col(column)
    return over_blocks(
        df, keys, order, lambda w: {f"{column}_sma_{k}": full(F.avg(c), c, w, k) for k in windows},
        back=max(windows) - 1, **kw)


def ema(df: DataFrame, column: str, spans=(5, 10, 20, 50), names: dict[int, str] | None = None, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Exponential means with adjusted weights, linear in the number of rows.

    With q = 1 - a the mean is sum(x_i q^-i) / sum(q^-i) over the rows so far:
    two running sums. Blocks keep q^-i inside the range of a double, and a halo
    of K rows with q^K < 1e-16 makes each block exact by itself.
    """
    return emas(df, {column: names or {}}, spans, keys, order, **kw)


def emas(df: DataFrame, columns: Mapping[str, dict[int, str]], spans=(5, 10, 20, 50), keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """The same for several columns, whose blocks share one layout; each maps spans to names, if they are to have others."""
    kw = _with_hot(df, keys, kw)
    out = with_position(df, keys, order, out="_at", **kw)
    for group, reach, rows in _span_groups(spans):
        out = _ema_pass(out, columns, group, reach, rows, keys, **kw)
    return out.drop("_at")


def _span_groups(spans: Sequence[int]):
    """Spans that fit one block layout together, with its halo and block length."""
    def layout(group):
        decay = [1 - 2 / (s + 1) for s in group]
        reach = max(math.ceil(36.8 / (1 - q)) for q in decay)
        return reach, min(int(500 / -math.log(q)) for q in decay) - reach

    group: list[int] = []
    for s in sorted(spans):
        reach, rows = layout([*group, s])
        if group and rows < reach:
            yield (tuple(group), *layout(group))
            group = []
        group.append(s)
    yield (tuple(group), *layout(group))


def _ema_pass(df, columns, spans, reach, rows, keys, **kw) -> DataFrame:
    decay = {s: 1 - 2 / (s + 1) for s in spans}

    def weights(w):
        at = F.row_number().over(w).cast("double")
        return {f"_w{s}": F.exp(at * -math.log(q)) for s, q in decay.items()}

    def means(w):
        upto, out = w.rowsBetween(Window.unboundedPreceding, 0), {}
        for column, names in columns.items():
            x = F.col(column).cast("double")
            for s in spans:
                mean = F.sum(x * F.col(f"_w{s}")).over(upto) / F.sum(F.when(x.isNotNull(), F.col(f"_w{s}"))).over(upto)
                out[names.get(s, f"{column}_ema_{s}")] = mean
        return out

    stages = over_blocks(df, keys, ["_at"], weights, means, back=reach, block_rows=rows, at="_at", **kw)
    return stages.drop(*[f"_w{s}" for s in spans])


def rsi_stages(columns: Sequence[str], k: int = 14) -> tuple[Callable[[WindowSpec], dict[str, Column]], Callable[[WindowSpec], dict[str, Column]]]:
    """Window columns of the relative strength: gains and losses of each column, then the index. They reach k rows back."""
    def moves(w):
        out = {}
        for c in columns:
            d = F.col(c) - F.lag(c, 1).over(w)
            out |= {f"_gain_{c}": F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)), f"_loss_{c}": F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0))}
        return out

    def build(w):
        return {f"{c}_rsi": rsi_of(*[full(F.avg(x), F.col(x), w, k) for x in (f"_gain_{c}", f"_loss_{c}")]) for c in columns}

    return moves, build


def rsi_of(gain: Column, loss: Column) -> Column:
    """The index from the mean gain and the mean loss."""
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(
        F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + F.try_divide(gain, loss)))


def rsi(df: DataFrame, column: str, k: int = 14, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Relative strength from simple means of gains and losses; the first difference counts as 0."""
    moves, build = rsi_stages([column], k)
    return over_blocks(df, keys, order, moves, build, back=k, **_with_hot(df, keys, kw)).drop(f"_gain_{column}", f"_loss_{column}")


def bollinger_columns(column: str, w: WindowSpec, names: Sequence[str], k: int = 20) -> dict[str, Column]:
    """Upper and lower band, their distance, and with a fourth name the value's place between them."""
    c = F.col(column)
    return bands_of(c, full(F.avg(c), c, w, k), full(F.stddev_samp(c), c, w, k), names)


def bands_of(c: Column, mean: Column, dev: Column, names: Sequence[str]) -> dict[str, Column]:
    """The same from mean and deviation."""
    upper, lower = mean + dev * 2, mean - dev * 2
    return dict(zip(names, (upper, lower, upper - lower, F.try_divide(c - lower, upper - lower))))


BANDS = ("bollinger_upper", "bollinger_lower", "bollinger_width", "bollinger_position")


def bollinger(df: DataFrame, column: str, k: int = 20, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    return over_blocks(df, keys, order, lambda w: bollinger_columns(column, w, BANDS, k), back=k - 1, **kw)


def macd(df: DataFrame, column: str, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """EMA 12 - EMA 26, its EMA 9 and the difference."""
    kw = _with_hot(df, keys, kw)
    fast_slow = ema(df, column, (12, 26), {12: "_e12", 26: "_e26"}, keys, order, **kw)
    line = fast_slow.withColumn("macd", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")
    signal = ema(line, "macd", (9,), {9: "macd_signal"}, keys, order, **kw)
    return signal.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def volume_features(df: DataFrame, price: str, volume: str, k: int = 20, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Volume mean, ratio to it and on-balance volume."""
    kw = _with_hot(df, keys, kw)

    def build(w):
        v = F.col(volume)
        mean = full(F.avg(v), v, w, k)
        return {
            "volume_sma_20": mean, "volume_ratio": F.try_divide(v, mean),
            "_flow": v * F.signum(F.col(price) - F.lag(price, 1).over(w)),
        }

    moved = over_blocks(df, keys, order, build, back=k - 1, **kw)
    return running(moved, keys, order, {"obv": ("sum", F.col("_flow"))}, **kw).drop("_flow")


def fill(df: DataFrame, column: str, out: str, backward: bool = False, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Forward or backward fill."""
    return running(df, keys, order, {out: ("last", F.col(column))}, backward=backward, **kw)


def differences(df: DataFrame, column: str, order_n: int, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    return over_blocks(
        df, keys, order, lambda w: {f"{column}_diff_{order_n}": F.col(column) - F.lag(column, order_n).over(w)},
        back=order_n, **kw)


def lead_labels(df: DataFrame, column: str, k: int, out: str = "target", keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """The value ``k`` rows on, 0 where there is none."""
    return over_blocks(
        df, keys, order, lambda w: {out: F.coalesce(F.lead(column, k).over(w), F.lit(0.0))}, ahead=k, **kw)


def change_volatility(df: DataFrame, column: str, k: int = 7, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Rolling deviation of the relative changes over ``k`` full rows."""
    kw = _with_hot(df, keys, kw)
    changed = padded_change(df, column, (1,), "rate_change", keys, order, **kw)
    c = F.col("rate_change")
    return over_blocks(
        changed, keys, order, lambda w: {"volatility": full(F.stddev_samp(c), c, w, k)}, back=k - 1, **kw)


def series_volatility(df: DataFrame, column: str, k: int = 30, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Deviation of returns, root of squared returns, mean rolling deviation (0 when n <= k)."""
    kw = _with_hot(df, keys, kw)
    changed = padded_change(df, column, (1,), "_r", keys, order, **kw).where(F.col("_r").isNotNull())
    r = F.col("_r")
    rolled = over_blocks(changed, keys, order, lambda w: {"_roll": full(F.stddev_samp(r), r, w, k)}, back=k - 1, **kw)
    return rolled.groupBy(*keys).agg(
        F.stddev_samp(r).alias("std_volatility"), F.sqrt(F.sum(r * r)).alias("realized_volatility"),
        F.when(F.count(r) > k, F.avg("_roll")).otherwise(0.0).alias("rolling_volatility"))


def decompose(df: DataFrame, column: str, period: int = 12, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """Additive trend, seasonal and residual parts for series of at least two periods.

    The trend is a centred mean (half weights at both ends of an even period),
    the seasonal part the centred phase means of what is left.
    """
    keys = list(keys)
    half, even = period // 2, period % 2 == 0
    kw = _with_hot(df, keys, kw)
    placed = with_position(df, keys, order, out="_at", **kw)
    placed = group_stats(placed, keys, {"_n": F.count("*")}).where(F.col("_n") >= 2 * period)

    def trend(w):
        x = F.col(column)
        inner = w.rowsBetween(-half + 1, half - 1) if even else w.rowsBetween(-half, half)
        total = F.sum(x).over(inner)
        if even:
            total = total + (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2
        ok = (F.col("_at") >= half) & (F.col("_at") < F.col("_n") - half)
        return {"trend": F.when(ok, total / period)}

    lined = over_blocks(placed, keys, ["_at"], trend, back=half, ahead=half, at="_at", **kw)
    phased = lined.withColumn("_phase", F.col("_at") % period)
    means = phased.groupBy(*keys, "_phase").agg(F.avg(F.col(column) - F.col("trend")).alias("_pm"))
    centre = means.groupBy(*keys).agg(F.avg("_pm").alias("_c"))
    means = attach(means, centre, keys, ["_c"]).withColumn("seasonal", F.col("_pm") - F.col("_c"))
    out = attach(phased, means, [*keys, "_phase"], ["seasonal"])
    return out.withColumn("residual", F.col(column) - F.col("trend") - F.col("seasonal")).drop("_phase", "_at", "_n")


def unbiased_skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def unbiased_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    scale = F.greatest((n - 2) * (n - 3), F.lit(1.0))
    return F.when(n >= 4, (n - 1) / scale * ((n + 1) * F.kurtosis(c) + 6))


def series_summary(df: DataFrame, column: str, keys=KEYS, ts: str = "ts") -> DataFrame:
    """Shape of each series after averaging rows with the same time."""
    x = F.col("_x")
    return df.groupBy(*keys, ts).agg(F.avg(column).alias("_x")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
        unbiased_skew(x).alias("skew"), unbiased_kurtosis(x).alias("kurtosis"))


def inferred_frequency(df: DataFrame, keys=KEYS, ts: str = "ts", **kw) -> DataFrame:
    """Most frequent gap between distinct times, and the gap itself when all are equal."""
    times = df.select(*keys, ts).distinct()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = over_blocks(
        times, keys, [ts], lambda w: {"gap": micros - F.lag(micros, 1).over(w)}, back=1, **kw).where("gap is not null")
    counts = gaps.groupBy(*keys, "gap").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(
        F.max_by("gap", F.struct("n", -F.col("gap"))).alias("modal_gap"), F.count("*").alias("distinct_gaps"))
    return best.withColumn("regular_gap", F.when(F.col("distinct_gaps") == 1, F.col("modal_gap")))


def momentum(df: DataFrame, column: str, keys=KEYS, order=ORDER) -> DataFrame:
    """Change of the last two against the first two values (n >= 4), last against first (2-3), else 0."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    head = top_k(df, keys, [F.col(c) for c in order], 2, rank="_r").groupBy(*keys).agg(
        F.avg(column).alias("_h2"), F.max(F.when(F.col("_r") == 1, F.col(column))).alias("_h1"))
    tail = top_k(df, keys, [F.col(c).desc() for c in order], 2, rank="_r").groupBy(*keys).agg(
        F.avg(column).alias("_t2"), F.max(F.when(F.col("_r") == 1, F.col(column))).alias("_t1"))
    n = F.col("_n")
    value = (
        F.when((n >= 4) & (F.col("_h2") > 0), (F.col("_t2") - F.col("_h2")) / F.col("_h2"))
        .when((n >= 2) & (n < 4) & (F.col("_h1") > 0), (F.col("_t1") - F.col("_h1")) / F.col("_h1"))
        .otherwise(0.0)
    )
    return size.join(head, keys).join(tail, keys).select(*keys, n.alias("n"), value.alias("momentum"))
