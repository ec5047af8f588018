"""Exact nearest donors: rows meet by cells of the space of the values that both have."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.plans.topk import top_k

#: Sampled points of a cell, points that a space gives to the sample at least, and spaces that one call may have.
PER_CELL, LEAST, SPACES = 16, 2_000, 64
KNOWN = "f+-"


def gap_code(columns: Sequence[str]) -> Column:
    """A letter per column: f for a finite value, + and - for infinite ones, a for NaN, n for NULL."""
    def letter(c: Column) -> Column:
        infinite = F.lit(float("inf"))
        return F.when(c.isNull(), "n").when(F.isnan(c), "a").when(c == infinite, "+").when(c == -infinite, "-").otherwise("f")

    return F.concat(*[letter(F.col(c)) for c in columns])


def spaces_of(codes: Sequence[str]) -> dict[tuple[str, tuple[int, ...], int], list[str]]:
    """(donor's code, shared columns, wanted column) -> codes of the rows that look there.

    A pair with an infinite gap has no distance; equal infinities are not shared.
    """
    out: dict[tuple[str, tuple[int, ...], int], list[str]] = {}
    for wants in (c for c in codes if "n" in c):
        for gives in codes:
            if any(a in KNOWN and b in KNOWN and a != b for a, b in zip(wants, gives)):
                continue
            shared = tuple(i for i, (a, b) in enumerate(zip(wants, gives)) if a == b == "f")
            for i in range(len(wants)):
                if shared and wants[i] == "n" and gives[i] in KNOWN:
                    out.setdefault((gives, shared, i), []).append(wants)
    return out


def grow_cells(points: np.ndarray, donor: np.ndarray, k: int, most: int) -> dict[str, np.ndarray]:
    """A tree that cuts the space until a cell has at most ``most`` of the points, or equal ones.

    Each cell keeps some donors of its own or of the smallest part around it
    that has ``k``: the k-th of them bounds how far a row must look.
    """
    dims = points.shape[1]
    axis, cut, left, low, high, near = [], [], [], [], [], []

    def add(a, b):
        for to, x in ((axis, -1), (cut, 0.0), (left, -1), (low, a), (high, b), (near, None)):
            to.append(x)
        return len(axis) - 1

    width = max(most, 2 * k)
    stack = [(add(np.full(dims, -np.inf), np.full(dims, np.inf)), np.arange(len(points)), np.flatnonzero(donor)[:width])]
    while stack:
        node, own, around = stack.pop()
        given = own[donor[own]]
        around = given[:width] if len(given) >= k else around
        wide = np.ptp(points[own], axis=0) if len(own) > most else np.zeros(dims)
        if not wide.max(initial=0.0) > 0:
            near[node] = around
            continue
        c = int(wide.argmax())
        x = np.sort(points[own, c])
        at = x[len(x) // 2]
        at = at if at > x[0] else x[np.searchsorted(x, x[0], side="right")]
        axis[node], cut[node] = c, at
        below, above = high[node].copy(), low[node].copy()
        below[c] = above[c] = at
        left[node] = add(low[node], below)
        add(above, high[node])
        less = points[own, c] < at
        stack += [(left[node], own[less], around), (left[node] + 1, own[~less], around)]
    listed = np.full((len(axis), width), len(points), np.int32)  # the place after the last point stands for none
    for i, n in enumerate(near):
        if n is not None:
            listed[i, :len(n)] = n
    return {"axis": np.array(axis), "cut": np.array(cut), "left": np.array(left), "low": np.array(low), "high": np.array(high), "near": listed,
            "points": np.vstack([points, np.full(dims, np.nan)])}


def home(tree: Mapping[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    at, row = np.zeros(len(x), int), np.arange(len(x))
    while (inner := tree["axis"][at] >= 0).any():
        right = x[row, np.maximum(tree["axis"][at], 0)] >= tree["cut"][at]
        at = np.where(inner, tree["left"][at] + right, at)
    return at


def distances(gaps: Sequence[np.ndarray], shared: int) -> np.ndarray:
    """Mean square over the shared columns times all columns; the same sums in the same order for points and for cells."""
    square = np.zeros_like(gaps[0])
    for gap in gaps:
        square += gap * gap
    return square / shared * len(gaps)


def reached(tree: Mapping[str, np.ndarray], x: np.ndarray, shared: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, bound): all cells in which one of a row's k nearest may lie."""
    dims = range(x.shape[1])
    near = tree["points"][tree["near"][home(tree, x)]]
    sample = distances([x[:, None, c] - near[:, :, c] for c in dims], shared)
    sample = np.where(np.isnan(sample), np.inf, sample)
    bound = np.partition(sample, k - 1, axis=1)[:, k - 1] if sample.shape[1] >= k else np.full(len(x), np.inf)
    row, at, rows, cells = np.arange(len(x)), np.zeros(len(x), int), [], []
    while len(row):
        low, high = tree["low"][at], tree["high"][at]
        least = distances([np.maximum(np.maximum(low[:, c] - x[row, c], x[row, c] - high[:, c]), 0.0) for c in dims], shared)
        keep = least <= bound[row]
        row, at = row[keep], at[keep]
        leaf = tree["axis"][at] < 0
        rows.append(row[leaf])
        cells.append(at[leaf])
        row, at = np.repeat(row[~leaf], 2), np.repeat(tree["left"][at[~leaf]], 2)
        at[1::2] += 1
    row, at = np.concatenate(rows), np.concatenate(cells)
    return row, at, bound[row]


def nearest_of(x: np.ndarray, bound: np.ndarray, there: np.ndarray, ids: np.ndarray, shared: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, donor's place, distance) of the k nearest within the bound, ties to the smaller id."""
    dist = distances([x[:, None, c] - there[None, :, c] for c in range(x.shape[1])], shared)
    edge = bound if dist.shape[1] <= k else np.minimum(bound, np.partition(dist, k - 1, axis=1)[:, k - 1])
    row, at = np.nonzero((dist <= edge[:, None]) & np.isfinite(dist))
    reach = dist[row, at]
    order = np.lexsort((ids[at], reach, row))
    row, at, reach = row[order], at[order], reach[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], at[first], reach[first]


def nearest_donors(base: DataFrame, d: int, k: int, cell_rows: int, codes: Mapping[str, int]) -> DataFrame:
    """(_id, _col, _dist, _donor, _value): for each row with gaps and column, its k nearest donors of each space and perhaps more.

    ``base`` has ``_id``, ``_x0``.. and ``_code``. Donors and rows with gaps meet in
    a space for each pair of kinds of gaps that share values, where columns not
    shared are 0. A sample fits a tree of cells for each space, which decides
    only where rows meet: every donor is in its cell, and a row visits each
    cell that is no farther than its k-th nearest sampled donor. Of donors at
    one point only the k smallest ids can be among the nearest; rows at one
    point look together. So neither many copies nor many rows make a cell large.
    """
    spaces = list(spaces_of(list(codes)).items())
    names = [f"_x{i}" for i in range(d)]

    def at(shared):
        return [F.col(x) if i in shared else F.lit(0.0).alias(x) for i, x in enumerate(names)]

    def dealt(rows: DataFrame, parts: list[Column]) -> DataFrame:
        return rows.select("_id", F.inline(F.array_compact(F.array(*parts))))

    code = F.col("_code")
    asked = dealt(base, [F.when(code.isin(wants), F.struct(F.lit(n).alias("_space"), F.lit(i).alias("_col"), *at(shared))) for n, ((_, shared, i), wants) in enumerate(spaces)])
    given = dealt(
        base.withColumn("_id", F.coalesce("_id", F.lit((1 << 63) - 1))),
        [F.when(code == gives, F.struct(F.lit(n).alias("_space"), *at(shared), F.col(names[i]).alias("_value"))) for n, ((gives, shared, i), _) in enumerate(spaces)])
    trees = base.sparkSession.sparkContext.broadcast(_trees(base, names, k, cell_rows, codes, spaces))

    def by_space(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, dict]]:
        space = batch.column("_space").to_numpy()
        x = np.column_stack([batch.column(c).to_numpy() for c in names])
        for n in np.unique(space):
            rows = np.flatnonzero(space == n)
            yield rows, x[rows], len(spaces[n][0][1]), trees.value[n]

    def placed(batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for rows, x, _, tree in by_space(batch):
                cell[rows] = home(tree, x)
            yield batch.append_column("_cell", pa.array(cell))

    def visiting(batches):
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, len(whole), 2048)):
                for rows, x, shared, tree in by_space(batch):
                    row, cell, bound = reached(tree, x, shared, k)
                    out = batch.take(pa.array(rows[row]))
                    yield out.append_column("_cell", pa.array(cell, pa.int32())).append_column("_bound", pa.array(bound))

    def meet(group: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        n, none = group[0].as_py(), np.zeros(0, int)
        shared = len(spaces[n][0][1])
        x, there = (np.column_stack([t.column(c).to_numpy() for c in names]) for t in (left, right))
        bound, ids = left.column("_bound").to_numpy(), right.column("_id").to_numpy()
        step = max(1, 1_000_000 // max(1, len(there)))
        found = [(start + row, to, dist) for start in range(0, len(x) if len(there) else 0, step)
                 for row, to, dist in [nearest_of(x[start:start + step], bound[start:start + step], there, ids, shared, k)]]
        row, to, dist = (np.concatenate(c) for c in zip(*found)) if found else (none, none, np.zeros(0))
        return pa.table({"_space": pa.array(np.full(len(row), n, np.int32))} | {c: x[row, i] for i, c in enumerate(names)}
                        | {"_dist": dist, "_donor": pa.array(ids[to], pa.int64()), "_value": right.column("_value").to_numpy()[to]})

    point = "_space int, " + "".join(f"{x} double, " for x in names)
    donors = top_k(given, ["_space", *names], [F.col("_id")], k).mapInArrow(placed, f"_id bigint, {point}_value double, _cell int")
    points = asked.select("_space", *names).distinct().mapInArrow(visiting, f"{point}_cell int, _bound double")
    met = points.groupBy("_space", "_cell").cogroup(donors.groupBy("_space", "_cell")).applyInArrow(meet, f"{point}_dist double, _donor bigint, _value double")
    return asked.join(met, ["_space", *names]).select("_id", "_col", "_dist", "_donor", "_value")


def _trees(base: DataFrame, names: Sequence[str], k: int, cell_rows: int, codes: Mapping[str, int], spaces: list) -> list[dict[str, np.ndarray]]:
    """One tree of cells for each space from a seeded sample: PER_CELL points for each cell, LEAST or all of a rare kind of gaps."""
    share = {c: min(1.0, max(PER_CELL / cell_rows, LEAST / n)) for c, n in codes.items()}
    u = F.pmod(F.xxhash64(F.lit(7), "_id", *names), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.coalesce(*[F.when(F.col("_code") == c, F.lit(s)) for c, s in share.items()])
    sample = base.where(u < wanted).select("_code", *names).toPandas()
    held = {c: part[list(names)].to_numpy(float) for c, part in sample.groupby("_code")}
    none = np.zeros((0, len(names)))
    out = []
    for (gives, shared, _), wants in spaces:
        parts = [held.get(c, none) for c in (gives, *wants)]
        points = np.concatenate(parts)
        points[:, [i for i in range(len(names)) if i not in shared]] = 0.0
        out.append(grow_cells(points, np.arange(len(points)) < len(parts[0]), k, PER_CELL))
    return out
