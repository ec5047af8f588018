"""Unit-root and stationarity tests for many series at once.

Both tests need only sums of lagged products. A series is cut into blocks of
rows, each with the rows before it that its lags reach into; a block gives its
sums as rows (key, i, sum), which add up like any others. So a single very long
series is spread like any other, and the plan is the same whatever the lags.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.series import KEYS, ORDER
from tradewind.plans.blocks import attach, blocks_of, is_hot, running, with_position

#: Rows of a block at least; more where a block's sums would outnumber a sixteenth of its rows.
BLOCK_ROWS = 4096

# MacKinnon's response surface for one series with a constant.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
# Published critical values of the level-stationarity test.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def _centred(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    known = df.where(F.col(column).isNotNull()).select(*keys, *order, F.col(column).cast("double").alias("_x"))
    stats = known.groupBy(*keys).agg(F.avg("_x").alias("_m"), F.count("*").alias("_n"))
    joined = attach(known, stats, keys, ["_m", "_n"]).withColumn("_e", F.col("_x") - F.col("_m"))
    return with_position(joined, keys, order, **kw)


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def _block_sums(base: DataFrame, keys: Sequence[str], reach: int, rows: int, sums) -> DataFrame:
    """(keys, _i, _v): what ``sums`` gives for each block, added up per key and index.

    ``sums(x, first, start, lag)`` sees the values of a block behind those it
    reaches into, the place of its own first value among them, that value's
    position in the series, and the series' lag.
    """
    names = list(keys)

    def of_block(group: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        at = np.argsort(part.column("_pos").to_numpy(), kind="stable")
        pos, x = part.column("_pos").to_numpy()[at], part.column("_e").to_numpy()[at]
        first = int(np.searchsorted(pos, group[-1].as_py() * rows))
        index, value = sums(x, first, int(pos[first]), int(part.column("_lag")[0].as_py())) if first < len(pos) else (np.empty(0, np.int64), np.empty(0))
        out = {k: pa.repeat(g, len(index)) for k, g in zip(names, group)}
        return pa.table(out | {"_i": pa.array(index, pa.int64()), "_v": pa.array(value, pa.float64())})

    placed = blocks_of(base.select(*names, "_pos", "_e", "_lag"), reach, rows)
    found = placed.groupBy(*names, "_blk").applyInArrow(of_block, f"{_fields(base, names)}_i bigint, _v double")
    return found.groupBy(*names, "_i").agg(F.sum("_v").alias("_v"))


def _normal_sums(x: np.ndarray, first: int, start: int, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of the products of (1, level, lag differences, difference); the series' first values at -1, -2, ...

    Rows count from position lag + 1 on, where all differences exist.
    """
    d, skip = np.diff(x), max(0, lag + 1 - start)
    own = np.arange(first + skip, len(x))  # places of the rows' values; a row's difference is d[place - 1]
    full = np.zeros((lag + 3, lag + 3))
    for part in np.array_split(own, max(1, len(own) // 8192)):
        if len(part):
            past = np.lib.stride_tricks.sliding_window_view(d, lag + 1)[part - 1 - lag]  # oldest first, the row's own difference last
            terms = np.column_stack([np.ones(len(part)), x[part - 1], past[:, -2::-1], past[:, -1]])
            full += terms.T @ terms
    value = full[np.triu_indices(lag + 3)]
    index = np.arange(len(value))
    if start == 0:
        head = x[:lag + 2]
        index, value = np.concatenate([index, -1 - np.arange(len(head))]), np.concatenate([value, head])
    return index, value


def _sums_of(one: pa.ListScalar) -> dict[int, float]:
    """The sums of one series as plain values; a batch holds thousands of series, as plain values many times its size."""
    index, value = one.values.flatten()
    return dict(zip(index.to_pylist(), value.to_pylist()))


def _solved(pieces: dict[int, float], lag: int, n: int, choose: bool) -> tuple[int, float]:
    """(lag, t value of the level): the lag of least AIC on common rows if one is to be chosen, then the fit on all its rows."""
    size = lag + 3
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = [pieces[i] for i in range(size * (size + 1) // 2)]
    full = full + np.triu(full, 1).T
    head = np.array([pieces[-1 - i] for i in range(min(lag + 2, n))])

    def fit(g, p):
        x, y = g[: p + 2, : p + 2], g[: p + 2, -1]
        inverse = np.linalg.pinv(x)
        beta = inverse @ y
        return beta, inverse, max(g[-1, -1] - beta @ y, 1e-300)

    best = lag
    if choose:
        rows = n - 1 - lag
        best = int(np.argmin([rows * math.log(fit(full, p)[2] / rows) + 2 * (p + 2) for p in range(lag + 1)]))
    keep = [*range(best + 2), size - 1]
    g, d = full[np.ix_(keep, keep)], np.diff(head)
    for t in range(best + 1, lag + 1):  # rows that the longest lag had left out lie among the first values
        row = np.array([1.0, head[t - 1], *d[t - 1 - best:t - 1][::-1], d[t - 1]])
        g = g + np.outer(row, row)
    beta, inverse, ssr = fit(g, best)
    free = n - 1 - best - (best + 2)
    return best, float(beta[1] / math.sqrt(ssr / free * inverse[1, 1])) if free > 0 else float("nan")


def unit_root_p(statistic: Column) -> Column:
    """Approximate p-value of the unit-root statistic as an expression (normal tail by its series)."""
    def poly(c):
        return sum((F.pow(statistic, F.lit(float(i))) * a for i, a in enumerate(c)), F.lit(0.0))

    z = F.when(statistic <= TAU_STAR, poly(SMALL_P)).otherwise(poly(LARGE_P))
    return F.when(statistic > TAU_MAX, 1.0).when(statistic < TAU_MIN, 0.0).otherwise(normal_cdf(z))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    erf = 1 - sum((F.pow(t, F.lit(float(i + 1))) * c for i, c in enumerate(a)), F.lit(0.0)) * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def unit_root(df: DataFrame, column: str, keys=KEYS, order=ORDER, max_lag: int | None = None, choose: bool = True, **kw) -> DataFrame:
    """Augmented Dickey-Fuller test with constant; stationary when p < 0.05.

    The lag is the one of least AIC up to ``max_lag`` (by the length of the
    series if none is given), or ``max_lag`` itself without ``choose``. Series
    too short for any lag have no row.
    """
    keys, order = list(keys), list(order)
    kw = {**kw, "hot": is_hot(df, keys, kw.get("hot_rows"))}
    base = _centred(df, column, keys, order, **kw)
    rule = F.least(F.floor(F.col("_n") / 2) - 2, F.ceil(12 * F.pow(F.col("_n") / 100.0, F.lit(0.25))))
    base = base.withColumn("_lag", rule.cast("int") if max_lag is None else F.least(rule, F.lit(max_lag)).cast("int")).where("_lag >= 0")
    if not choose:
        base = base.where(F.col("_lag") == max_lag)
    depth = base.agg(F.max("_lag")).first()[0] or 0
    rows = max(kw.get("hot_rows") or BLOCK_ROWS, 8 * (depth + 3) ** 2)
    sums = _block_sums(base, keys, depth + 1, rows, _normal_sums)
    facts = base.where("_pos = 0").select(*keys, "_n", "_lag")
    # a few hundred sums per series, however long it is
    pieces = attach(sums.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_v")).alias("_g")), facts, keys, ["_n", "_lag"])

    def solve(batches):
        for batch in batches:
            g, n, lag = (batch.column(batch.schema.get_field_index(c)) for c in ("_g", "_n", "_lag"))
            answers = [_solved(_sums_of(one), p.as_py(), size.as_py(), choose) for one, size, p in zip(g, n, lag)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array([a for a, _ in answers], pa.int32()), pa.array([t for _, t in answers], pa.float64())], [*keys, "used_lag", "statistic"])

    out = pieces.mapInArrow(solve, f"{_fields(df, keys)}used_lag int, statistic double")
    return out.withColumn("p_value", unit_root_p(F.col("statistic"))).withColumn("stationary", F.col("p_value") < 0.05)


def _lag_sums(x: np.ndarray, first: int, start: int, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each own value times the one i places before it, for i up to the lag."""
    lags = np.arange(min(lag, start + len(x) - first - 1) + 1)
    return lags, np.array([x[max(first, i):] @ x[max(first, i) - i:len(x) - i] for i in lags])


def level_stationarity(df: DataFrame, column: str, keys=KEYS, order=ORDER, **kw) -> DataFrame:
    """KPSS test around a level, data-dependent lag; stationary when p > 0.05."""
    keys, order = list(keys), list(order)
    kw = {**kw, "hot": is_hot(df, keys, kw.get("hot_rows"))}
    base = running(_centred(df, column, keys, order, **kw), keys, ["_pos"], {"_s": ("sum", F.col("_e"))}, **kw)
    facts = base.groupBy(*keys).agg(F.first("_n").alias("_n"), F.sum(F.col("_s") * F.col("_s")).alias("_eta"))
    n = F.col("_n").cast("double")

    def products(lagged: DataFrame) -> DataFrame:
        depth = int(lagged.agg(F.max("_lag")).first()[0] or 0)
        return attach(_block_sums(lagged, keys, depth, max(kw.get("hot_rows") or BLOCK_ROWS, depth + 1, 16 * depth), _lag_sums), facts, keys, ["_n", "_eta"])

    i, p = F.col("_i"), F.col("_v")
    pilot = products(base.withColumn("_lag", F.floor(F.pow(n, F.lit(2 / 9)) + 1e-9).cast("int"))).groupBy(*keys, "_n").agg(
        F.sum(F.when(i == 0, p).otherwise(2 * p) / n).alias("_s0"), F.sum(i * 2 * p / n).alias("_s1"))
    auto = F.floor(1.1447 * F.pow(F.pow(F.try_divide("_s1", "_s0"), F.lit(2.0)), F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3)))
    lags = pilot.select(*keys, F.least(F.coalesce(auto, F.lit(0)), F.col("_n") - 1).cast("int").alias("_lag"))
    full = attach(products(attach(base.drop("_lag"), lags, keys, ["_lag"])), lags, keys, ["_lag"])
    weighted = F.sum(F.when(i == 0, p).otherwise(2 * p * (1 - i / (F.col("_lag") + 1.0))))
    out = full.groupBy(*keys, F.col("_lag").alias("lags"), "_n", "_eta").agg(weighted.alias("_w")).select(
        *keys, "lags", F.try_divide(F.col("_eta") / (n * n), F.col("_w") / n).alias("statistic"))
    return out.withColumn("p_value", level_p(F.col("statistic"))).withColumn("stationary", F.col("p_value") > 0.05)


def level_p(statistic: Column) -> Column:
    """Linear interpolation between the published critical values, held at both ends."""
    (c0, p0), *rest = KPSS_CRITICAL
    p = F.when(statistic <= c0, p0)
    for (a, pa), (b, pb) in zip(KPSS_CRITICAL, rest):
        p = p.when(statistic <= b, pa + (statistic - a) / (b - a) * (pb - pa))
    return F.when(statistic.isNotNull(), p.otherwise(KPSS_CRITICAL[-1][1]))
