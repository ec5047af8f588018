"""Exact quantiles and modes that never gather a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one bracket that may meet in one task.
SMALL = 200_000
#: Least and most cuts that one step puts into a bracket.
CUTS = (16, 512)


@dataclass
class _Bracket:
    """All values of a column in [low, high]: ``base`` lie below, ``n`` inside, and the wanted ranks among them."""

    column: int
    low: float
    high: float
    base: int
    n: int
    ranks: list[int]
    cuts: list[float] = field(default_factory=list)


def _shares(wide: Sequence[_Bracket], small: int) -> list[float]:
    most = max(b.n for b in wide)
    cuts = min(CUTS[1], max(CUTS[0], 4 * math.ceil(most / small)))
    return [i / cuts for i in range(1, cuts)]


def _edges(brackets: Sequence[_Bracket], width: int) -> list[tuple]:
    """Per column: the brackets' numbers, lows and highs, ascending; brackets of a column do not overlap."""
    out = []
    for c in range(width):
        own = sorted((b.low, i) for i, b in enumerate(brackets) if b.column == c)
        out.append(([i for _, i in own], [low for low, _ in own], [brackets[i].high for _, i in own]))
    return out


def _inside(values: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """(bracket, x): the values that lie in a bracket."""
    edges = _edges(brackets, len(values.columns))

    def tag(batches: Iterator):
        for batch in batches:
            tags, found = [], []
            for (numbers, lows, highs), column in zip(edges, batch.columns):
                if numbers:
                    x = column.to_numpy(zero_copy_only=False)
                    x = x[~np.isnan(x)]
                    at = np.searchsorted(lows, x, side="right") - 1
                    held = (at >= 0) & (x <= np.array(highs)[at])
                    tags.append(np.array(numbers, np.int32)[at[held]])
                    found.append(x[held])
            if tags:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tags)), pa.array(np.concatenate(found))], ["bracket", "x"])

    return values.mapInArrow(tag, "bracket int, x double")


def _sketched(values: DataFrame, wide: Sequence[_Bracket], small: int) -> None:
    """One mergeable sketch per bracket gives all its cuts."""
    shares = F.array(*[F.lit(s) for s in _shares(wide, small)])
    if all(b.low == -math.inf and b.high == math.inf for b in wide):
        row = values.agg(*[F.percentile_approx(values.columns[b.column], shares).alias(f"c{i}") for i, b in enumerate(wide)]).first()
        cuts = {i: row[f"c{i}"] for i in range(len(wide))}
    else:
        cuts = {r["bracket"]: r["cuts"] for r in _inside(values, wide).groupBy("bracket").agg(F.percentile_approx("x", shares).alias("cuts")).collect()}
    for i, b in enumerate(wide):
        b.cuts = sorted(set(cuts[i]))


def _counted(values: DataFrame, wide: Sequence[_Bracket]) -> dict[int, list[tuple]]:
    """(part, n, least, greatest) of every part of every bracket: part 2j + 1 is the j-th cut itself, part 2j lies below it.

    A task counts all its batches in small arrays, so what is shuffled is a row
    for each task and part.
    """
    edges, cuts = _edges(wide, len(values.columns)), [b.cuts for b in wide]

    def count(batches: Iterator):
        n = [np.zeros(2 * len(c) + 1, np.int64) for c in cuts]
        least, most = [np.full(len(x), np.inf) for x in n], [np.full(len(x), -np.inf) for x in n]
        for batch in batches:
            for (numbers, lows, highs), column in zip(edges, batch.columns):
                if not numbers:
                    continue
                x = column.to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                at = np.searchsorted(lows, x, side="right") - 1
                for k, b in enumerate(numbers):
                    own = x[(at == k) & (x <= highs[k])]
                    part = np.searchsorted(cuts[b], own, side="left") + np.searchsorted(cuts[b], own, side="right")
                    n[b] += np.bincount(part, minlength=len(n[b]))
                    np.minimum.at(least[b], part, own)
                    np.maximum.at(most[b], part, own)
        rows = [(b, p, int(n[b][p]), float(least[b][p]), float(most[b][p])) for b in range(len(cuts)) for p in np.flatnonzero(n[b])]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], ["bracket", "part", "n", "least", "most"])

    parts = values.mapInArrow(count, "bracket int, part int, n bigint, least double, most double").groupBy("bracket", "part").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    out: dict[int, list[tuple]] = {}
    for r in parts.collect():  # as many rows as cuts
        out.setdefault(r["bracket"], []).append((r["part"], r["n"], r["least"], r["most"]))
    return {b: sorted(rows) for b, rows in out.items()}


def _narrowed(wide: Sequence[_Bracket], counted: dict[int, list[tuple]]) -> list[_Bracket]:
    """The parts that hold a wanted rank."""
    out = []
    for i, b in enumerate(wide):
        base = b.base
        for _, n, least, most in counted[i]:
            ranks = [k for k in b.ranks if base <= k < base + n]
            if ranks:
                out.append(_Bracket(b.column, least, most, base, n, ranks))
            base += n
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column; NULL and NaN are skipped.

    All columns and probabilities advance together. A bracket of more than
    ``small`` values is cut by one sketch into parts, a pass counts the parts,
    and those that hold a wanted rank become the brackets of the next step. A
    cut is a part of its own, so a value that fills a bracket ends the search
    instead of repeating it. What is left is ranked bracket by bracket, each of
    at most ``small`` values. A column of a billion values takes two steps,
    one of ``small`` values none. Plans do not grow with the number of probabilities.
    """
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(x) for c, x in names.items()])
    row = values.agg(*[F.count(x).alias(x) for x in names.values()]).first()
    counts = [row[x] for x in names.values()]
    wanted = [sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else [] for n in counts]
    brackets = [_Bracket(c, -math.inf, math.inf, 0, counts[c], ranks) for c, ranks in enumerate(wanted) if ranks]
    while wide := [b for b in brackets if b.n > small and b.low != b.high]:
        _sketched(values, wide, small)
        brackets = [b for b in brackets if b.n <= small or b.low == b.high] + _narrowed(wide, _counted(values, wide))
    found = {(b.column, k): b.low for b in brackets if b.low == b.high for k in b.ranks}
    rest = [b for b in brackets if b.low != b.high]
    if rest:
        found |= _ranked(values, rest)
    out: dict[str, list[float | None]] = {}
    for c, (name, n) in enumerate(zip(columns, counts)):
        out[name] = []
        for p in probs:
            if not n:
                out[name].append(None)
                continue
            at = p * (n - 1)
            a, b = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[name].append(a if a == b else a + (at - math.floor(at)) * (b - a))
    return out


def _ranked(values: DataFrame, brackets: Sequence[_Bracket]) -> dict[tuple[int, int], float]:
    """The values of the wanted ranks, each bracket sorted by one task."""
    wanted = [[k - b.base for k in b.ranks] for b in brackets]

    def pick(keys: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        number = keys[0].as_py()
        x, at = np.sort(rows.column("x").to_numpy()), wanted[number]
        return pa.table({"bracket": pa.array([number] * len(at), pa.int32()), "rank": pa.array(at, pa.int64()), "x": x[at]})

    rows = _inside(values, brackets).groupBy("bracket").applyInArrow(pick, "bracket int, rank bigint, x double").collect()
    return {(brackets[r["bracket"]].column, brackets[r["bracket"]].base + r["rank"]): r["x"] for r in rows}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties, NULLs skipped; one grouped pass for all columns."""
    if not columns:
        return {}
    sets = [[F.col(c)] for c in columns]
    counted = df.select(*columns).groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_set"), F.count("*").alias("_n"))
    # bit i from the left is 0 in the set of column i
    full = 2 ** len(columns) - 1
    best = [F.min(F.when((F.col("_set") == full - 2 ** (len(columns) - 1 - i)) & F.col(c).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))).alias(f"m{i}")
            for i, c in enumerate(columns)]
    row = counted.agg(*best).first()
    return {c: row[f"m{i}"]["v"] if row[f"m{i}"] is not None else None for i, c in enumerate(columns)}
