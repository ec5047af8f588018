"""Isolation forest: trees grown in parallel on small samples, rows scored in batches."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.quantiles import exact_quantiles
from tradewind.plans.blocks import attach
from tradewind.plans.topk import top_k
from tradewind.session import checkpointed

TREES, SAMPLE = 100, 256
#: Rows of one series that one task scores; rows of short series that one task takes, and the most such tasks.
CHUNK, SHARE, MOST = 50_000, 5_000, 4_096


@lru_cache(4096)
def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _samples(df: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int, size: int, seed: int) -> DataFrame:
    """``size`` rows per tree, drawn from all rows by seeded hashes; a row is copied only for trees that may take it."""
    rows = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)))
    n = max(1, rows.count())

    def uniform(tree, *parts):
        return (F.pmod(F.xxhash64(F.lit(seed + 1), tree, *parts), F.lit(1 << 40)) / float(1 << 40)).cast("double")

    # twice the wanted number on average: fewer than ``size`` are drawn once in 10^28 trees
    share = min(1.0, 2.0 * size / n)
    keys = [f"_k{i}" for i in range(len(key))]
    spread = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], *[F.col(k).alias(a) for k, a in zip(key, keys)])
    hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda h: uniform(h, *[F.col(k) for k in keys]) < share)
    spread = spread.withColumn("tree", F.explode(hits)).withColumn("_u", uniform(F.col("tree"), *[F.col(k) for k in keys]))
    return top_k(spread, ["tree"], [F.col("_u"), *map(F.col, keys)], size)


def grow(df: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int = TREES, size: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Nodes of all trees: a task grows one tree from at most ``size`` rows."""
    columns = list(columns)
    limit = math.ceil(math.log2(max(size, 2)))
    # path length of an unsplit leaf by row count, as plain values so that tasks need no import of this package
    average = [_average_path(n) for n in range(size + 1)]

    def build(tree_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values("_u")[columns].to_numpy()
        rng = np.random.default_rng(seed + int(tree_key[0]))
        nodes, stack = [], [(0, np.arange(len(data)), 0)]
        while stack:
            node, rows, depth = stack.pop()
            low, high = data[rows].min(axis=0), data[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                nodes.append((node, -1, 0.0, depth + average[len(rows)]))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append((node, f, cut, 0.0))
            left = data[rows, f] < cut
            stack += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "path"])
        return out.assign(tree=int(tree_key[0]))

    return _samples(df, columns, key, trees, size, seed).groupBy("tree").applyInPandas(
        build, "node int, feature int, cut double, path double, tree int")


def scored(df: DataFrame, columns: Sequence[str], nodes: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Anomaly score 2^(-mean path / c(size)) per row, NULL where a column is NULL."""
    forest: dict[int, list] = {}
    for r in nodes.collect():  # at most trees x 2 x size small rows
        forest.setdefault(r["tree"], []).append((r["node"], r["feature"], r["cut"], r["path"]))
    width = 2 ** (math.ceil(math.log2(max(size, 2))) + 1)
    tables = []
    for rows in forest.values():
        feature, cut, path = np.full(width, -1), np.zeros(width), np.zeros(width)
        for node, f, c, p in rows:
            feature[node], cut[node], path[node] = f, c, p
        tables.append((feature, cut, path))
    shared = df.sparkSession.sparkContext.broadcast(tables)
    scale = _average_path(size)

    def score(points: pd.DataFrame) -> pd.Series:
        data = points.to_numpy(dtype=float)
        total, row = np.zeros(len(data)), np.arange(len(data))
        for feature, cut, path in shared.value:
            at = np.zeros(len(data), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                left = data[row, np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(left, 2 * at + 1, 2 * at + 2), at)
            total += path[at]
        out = 2.0 ** (-(total / max(len(shared.value), 1)) / scale)
        out[np.isnan(data).any(axis=1)] = np.nan
        return pd.Series(out)

    point = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    return df.withColumn("anomaly_score", F.nanvl(F.pandas_udf(score, "double")(point), F.lit(None).cast("double")))


def isolation_outliers(df: DataFrame, columns: Sequence[str], key: Sequence[str], contamination: float = 0.1, **kw) -> DataFrame:
    """Flag rows whose score lies above the (1 - contamination) quantile."""
    out = checkpointed(scored(df, columns, grow(df, columns, key, **kw), kw.get("size", SAMPLE)))
    edge = exact_quantiles(out, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    return out.withColumn("outlier", F.coalesce(F.col("anomaly_score") > F.lit(edge), F.lit(False)))


def step_tree(values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, path lengths between them) of one tree over sorted values: with one feature a tree cuts the line into pieces."""
    cuts, paths, _ = _pieces(values.tolist(), rng, limit)
    return np.array(cuts), np.array(paths)


def _pieces(values: list[float], rng: np.random.Generator, limit: int) -> tuple[list[float], list[float], list[int]]:
    """(cuts, path lengths between them, values between them) in ascending order: depth first, left before right."""
    if math.isinf(values[-1] - values[0]):
        raise OverflowError("no cut lies between infinite values")
    cuts, paths, held, waiting, draw = [], [], [], [], rng.random
    a, b, depth = 0, len(values), 0
    while True:
        if depth >= limit or b - a <= 1 or values[a] == values[b - 1]:
            paths.append(depth + _average_path(b - a))
            held.append(b - a)
            if not waiting:
                return cuts, paths, held
            cut, a, b, depth = waiting.pop()
            cuts.append(cut)
            continue
        low = values[a]
        cut = low + (values[b - 1] - low) * draw()
        at = bisect_left(values, cut, a, b)
        depth += 1
        waiting.append((cut, at, b, depth))
        b = at


def _grown(pool: np.ndarray, trees: int, size: int, seed: int, n: int):
    """The pieces of each tree over a sample of its own, drawn from ``n`` rows of which the pool holds the first in random order.

    Places in a random order are alike, so the k-th different place that the
    trees draw may stand for the k-th row of the pool: no tree can draw more
    than trees x size rows hold, however many the series has.
    """
    rng, limit, whole = np.random.default_rng(seed), math.ceil(math.log2(max(size, 2))), np.sort(pool).tolist()
    met: dict[int, int] = {}
    for _ in range(trees):
        at = rng.choice(n, size, replace=False)
        if n > len(pool):
            at = [met.setdefault(i, len(met)) for i in at.tolist()]
        yield _pieces(whole if size == len(pool) else np.sort(pool[at]).tolist(), rng, limit)


def _scores(total: np.ndarray, trees: int, size: int) -> np.ndarray:
    scale = _average_path(size)
    return 2.0 ** (-(total / trees) / scale) if scale else np.full(len(total), 0.5)


def step_forest(pool: np.ndarray, trees: int, sample: int, seed: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, scores between them) of a whole forest: the mean of its trees is a step function too. ``n``: rows it draws from, if not the pool alone."""
    size = min(sample, len(pool))
    grown = [(np.array(cuts), np.array(paths)) for cuts, paths, _ in _grown(pool, trees, size, seed, n or len(pool))]
    cuts = np.unique(np.concatenate([c for c, _ in grown]))
    total = np.zeros(len(cuts) + 1)
    for own, paths in grown:
        total += paths[np.concatenate([[0], np.searchsorted(own, cuts, side="right")])]
    return cuts, _scores(total, trees, size)


def forest_scores(x: np.ndarray, pool: np.ndarray, trees: int, sample: int, seed: int, n: int | None = None) -> np.ndarray:
    """What :func:`step_forest` of the pool gives for each value, without joining the steps of its trees."""
    size, total, n = min(sample, len(pool)), np.zeros(len(x)), n or len(pool)
    if size == len(x):  # every tree has seen all values: a piece's path length is that of the values in it
        paths, held = [], []
        for _, own, counts in _grown(pool, trees, size, seed, n):
            paths += own
            held += counts
        for row in np.repeat(paths, held).reshape(trees, size):
            total += row
        out = np.empty(len(x))
        out[np.argsort(x, kind="stable")] = _scores(total, trees, size)
        return out
    for cuts, paths, _ in _grown(pool, trees, size, seed, n):
        total += np.array(paths)[np.searchsorted(cuts, x, side="right")]
    return _scores(total, trees, size)


def _quantile(values: np.ndarray, share: float) -> float:
    """As Spark's ``percentile``."""
    x, at = np.sort(values), (len(values) - 1) * share
    a, b = math.floor(at), math.ceil(at)
    return float(x[a]) if x[a] == x[b] else (b - at) * float(x[a]) + (at - a) * float(x[b])


def series_outliers(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], least: int = 10, contamination: float = 0.1,
                    trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Rows of each series of more than ``least`` values that its own forest sets apart, with their score and how many they are.

    Each series has a forest of its own, grown by one task. Each tree draws from
    all rows of the series, whose random order is that of a seeded hash of
    ``order``. A series of at most CHUNK rows is grown and scored in one place,
    so that no forest leaves its task. A longer one keeps its forest as one step
    function, its rows are scored in chunks. A row stands out if its score lies
    above the exact (1 - ``contamination``) quantile of its series. NULL and NaN
    values, NULL keys, shorter series and those of infinite range have no part.
    """
    keys, order = list(keys), list(order)
    rows = df.select(*keys, *order, F.col(column).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max("_x") - F.min("_x")).alias("_range")).where(F.col("_n") > least)
    hashed = rows.withColumn("_u", F.xxhash64(F.lit(seed), *order))
    kinds = dict(df.dtypes)
    fields = "".join(f"`{c}` {kinds[c]}, " for c in [*keys, *order])
    found = "_x double, _score double, _hits bigint"

    def one(group: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        n, pool = len(part), part
        if not least < n <= CHUNK or not math.isfinite(np.ptp(part.column("_x").to_numpy())):
            return part.slice(0, 0).drop_columns(["_u"]).append_column("_score", pa.array([], pa.float64())).append_column("_hits", pa.array([], pa.int64()))
        if n > trees * sample:
            pool = part.take(pc.sort_indices(part, sort_keys=[(c, "ascending") for c in ("_u", *order, "_x")], null_placement="at_start")[: trees * sample])
        values = pool.column("_x").to_numpy()[np.lexsort((pool.column("_x").to_numpy(), pool.column("_u").to_numpy()))]
        scores = forest_scores(part.column("_x").to_numpy(), values, trees, sample, _seed_of(seed, group), n)
        hits = np.flatnonzero(scores > _quantile(scores, 1 - contamination))
        return part.take(hits).drop_columns(["_u"]).append_column("_score", pa.array(scores[hits])).append_column("_hits", pa.array(np.full(len(hits), len(hits))))

    # values of one size class alone stay in this plan, so that no group of a long series is gathered
    long = sizes.where(F.col("_n") > CHUNK)
    held = sizes.agg(F.count_if(F.col("_n") > CHUNK).alias("long"), F.sum(F.when(F.col("_n") <= CHUNK, F.col("_n"))).alias("rows")).first()
    some, parts = held["long"] > 0, min(MOST, math.ceil((held["rows"] or 1) / SHARE))
    short = attach(hashed, long.withColumn("_long", F.lit(True)), keys, ["_long"]).where("_long is null").drop("_long") if some else hashed
    # small rows, long work: Spark would put them into a few tasks by their bytes
    out = short.repartition(parts, *keys).groupBy(*keys).applyInArrow(one, f"{fields}{found}")
    if some:
        out = out.unionByName(_long_outliers(hashed, long.where(F.col("_range") < math.inf), keys, order, fields, contamination, trees, sample, seed))
    return out.select(*keys, *order, F.col("_x").alias(column), F.col("_score").alias("score"), F.col("_hits").alias("anomalies"))


def _seed_of(seed: int, group: tuple[pa.Scalar, ...]) -> int:
    return seed + zlib.crc32(repr([g.as_py() for g in group]).encode())


def _long_outliers(hashed: DataFrame, sizes: DataFrame, keys: list[str], order: list[str], fields: str, contamination: float, trees: int, sample: int, seed: int) -> DataFrame:
    """The same for the series in ``sizes``: the scores of a series are as few as its steps, so their counts are small whatever its length."""
    sizes = sizes.withColumn("_chunks", F.ceil(F.col("_n") / CHUNK))
    held = checkpointed(attach(hashed, sizes, keys, ["_chunks", "_n"]).where("_chunks is not null"))
    pool = top_k(held, keys, [F.col("_u"), *map(F.col, order), F.col("_x")], trees * sample)
    kinds = dict(hashed.dtypes)

    def grow_one(group: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        at = np.lexsort((part.column("_x").to_numpy(), part.column("_u").to_numpy()))
        cuts, scores = step_forest(part.column("_x").to_numpy()[at], trees, sample, _seed_of(seed, group), part.column("_n")[0].as_py())
        return pa.table({k: pa.repeat(g, 1) for k, g in zip(keys, group)} | {n: pa.array([x.tolist()], pa.list_(pa.float64())) for n, x in (("_cuts", cuts), ("_scores", scores))})

    forests = pool.groupBy(*keys).applyInArrow(grow_one, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "_cuts array<double>, _scores array<double>")
    forests = attach(forests, sizes, keys, ["_chunks"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))).drop("_chunks")
    chunked = held.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed + 1), *order), F.col("_chunks"))).select(*keys, *order, "_x", "_chunk")

    def score(part: pa.Table, forest: pa.Table) -> pa.Table:
        if not len(part):
            return part.append_column("_score", pa.array([], pa.float64())).drop_columns(["_chunk"])
        cuts, scores = (np.array(forest.column(c)[0].as_py(), float) for c in ("_cuts", "_scores"))
        found = scores[np.searchsorted(cuts, part.column("_x").to_numpy(), side="right")]
        return part.append_column("_score", pa.array(found)).drop_columns(["_chunk"])

    scored = checkpointed(chunked.groupBy(*keys, "_chunk").cogroup(forests.groupBy(*keys, "_chunk")).applyInArrow(score, f"{fields}_x double, _score double"))
    edges = scored.groupBy(*keys).agg(F.percentile("_score", F.lit(1 - contamination)).alias("_edge"))
    # equal scores are equal numbers here: the step function has one for each piece
    above = attach(scored, edges, keys, ["_edge"]).where("_score > _edge").drop("_edge")
    return attach(above, above.groupBy(*keys).agg(F.count("*").alias("_hits")), keys, ["_hits"])
