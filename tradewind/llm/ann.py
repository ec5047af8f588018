"""Nearest neighbours by inner product over an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.common import partitions, stored, workers_import

#: Bounds of what the index is fitted on: vectors for the codebooks, and of these as queries to set the candidates.
SAMPLE_VECTORS, SAMPLE_QUERIES = 16_384, 256
CENTROIDS = 64
BLOCK = 8192


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, each once: an id, and finite components of which one isn't zero.

    Vectors of another length than the most common one (the shorter on equal
    counts) have no inner product with the others and take no part either.
    """
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (widths["n"] if widths else 0)).distinct()


def _codebook(half: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids by Lloyd's rounds; empty ones keep their place."""
    draw = np.random.default_rng(seed)
    centers = half[draw.choice(len(half), min(k, len(half)), replace=False)].copy()
    for _ in range(12):
        near = _nearest(half, centers)
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, half)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _nearest(half: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (half @ centers.T - 0.5 * (centers * centers).sum(axis=1)).argmax(axis=1)


class Index:
    """Codebooks of the two halves, rows per cell, and how many rows a query gathers."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.cut = first, second, first.shape[1]
        self.sizes = np.zeros((len(first), len(second)), np.int64)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(v[:, :self.cut], self.first), _nearest(v[:, self.cut:], self.second)

    def traverse(self, q: np.ndarray, most: int) -> dict[int, list[int]]:
        """Cells by summed distance (the negative inner product of both halves), until they hold ``most`` rows.

        Both half distances are sorted; a heap yields the pairs in order of
        their sum: a pair enters it once its left and upper neighbours are out.
        """
        near, far = -(self.first @ q[:self.cut]), -(self.second @ q[self.cut:])
        rows, columns = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        a, b = near[rows].tolist(), far[columns].tolist()
        rows, columns, sizes = rows.tolist(), columns.tolist(), self.sizes.tolist()
        heap, reached, got, out = [(a[0] + b[0], 0, 0)], [0] * len(a), 0, {}
        while heap and got < most:
            _, x, y = heapq.heappop(heap)
            n = sizes[rows[x]][columns[y]]
            if n:
                out.setdefault(rows[x], []).append(columns[y])
                got += n
            reached[x] = y + 1
            if y + 1 < len(b) and (x == 0 or reached[x - 1] > y + 1):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if x + 1 < len(a) and reached[x + 1] == y:
                heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
        return out


def fitted(rows: DataFrame, k: int, recall: float, centroids: int = CENTROIDS) -> tuple[Index, float]:
    """Index and the share of all rows a query gathers, from at most SAMPLE_VECTORS rows (least hash of the id).

    The share is what SAMPLE_QUERIES sampled rows need to find ``recall`` of
    their k nearest in the sample, compared by brute force.
    """
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS).select("v").toLocalIterator()]
    v = np.array(sample, np.float64)
    if not len(v):
        return Index(np.zeros((1, 0)), np.zeros((1, 0))), 1.0
    cut = v.shape[1] // 2
    index = Index(_codebook(v[:, :cut], centroids, 1), _codebook(v[:, cut:], centroids, 2))
    i, j = index.cells(v)
    np.add.at(index.sizes, (i, j), 1)
    need: list[float] = []
    for at, q in enumerate(v[:SAMPLE_QUERIES]):
        score = v @ q
        score[at] = -np.inf
        nearest = np.argsort(-score, kind="stable")[:k]
        nearest = nearest[nearest != at]
        sums = (index.first @ q[:cut])[:, None] + (index.second @ q[cut:])[None, :]
        order = np.argsort(-sums, axis=None)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        gathered = np.cumsum(index.sizes.ravel()[order])
        need += gathered[rank[i[nearest] * len(index.second) + j[nearest]]].tolist()
    return index, float(np.quantile(need, recall, method="higher")) / len(v) if need else 1.0


def nearest(vectors: DataFrame, every: int, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = 0.96,
            share: float | None = None) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``, by largest inner product in doubles.

    Every usable row is indexed. Rows with equal vectors are one entry that
    carries the k + 1 smallest of their ids, all that can be among k nearest
    once ties go to the smaller id. Cells that share their first centroid lie
    together, in blocks of about BLOCK entries; a query goes there with the
    second centroids it visits. Scores are those of the original vectors. No
    usable rows: no result; fewer candidates than k: all of them. Repeated rows
    count once.
    """
    spark = vectors.sparkSession
    workers_import(spark)
    rows = stored(usable(vectors, vec_id, embedding), "vectors")
    index, measured = fitted(rows, k, recall)
    share = share or measured
    least = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def place(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                i, j = index.cells(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["v", "ids", "i", "j"])

    placed = stored(entries.mapInArrow(place, "v array<double>, ids array<long>, i int, j int"), "entries")
    index.sizes[:] = 0
    for r in placed.groupBy("i", "j").count().toLocalIterator():  # as many rows as pairs of centroids at most
        index.sizes[r["i"], r["j"]] = r["count"]
    total = int(index.sizes.sum())
    most = max(k + 1, int(np.ceil(share * total)))
    blocks = np.maximum(1, -(-index.sizes.sum(axis=1) // BLOCK))
    width = len(index.second)

    def ask(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for query, q in zip(ids, _matrix(batch.column(1))):
                for i, visited in index.traverse(q, most).items():
                    mask = np.zeros(width, np.uint8)
                    mask[visited] = 1
                    out += [(i, b, 1, [query], q, mask.tobytes()) for b in range(blocks[i])]
                if len(out) > 5000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    def deal(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            v, ids, i, j = (c.to_pylist() for c in batch.columns)
            out = [(a, hash(tuple(x)) % int(blocks[a]), 0, own, x, bytes([b])) for x, own, a, b in zip(v, ids, i, j)]
            if out:
                yield packed(out)

    def packed(out):
        import pyarrow as pa

        types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["i", "block", "role", "ids", "v", "cells"])

    schema = "i int, block long, role int, ids array<long>, v array<double>, cells binary"

    def rerank(batches: Iterator):
        import pyarrow as pa

        now, held, cell, owners, base = None, [], [], [], None
        for batch in batches:
            i, block, role, ids, cells = (batch.column(n).to_pylist() for n in (0, 1, 2, 3, 5))
            v = _matrix(batch.column(4))
            at = 0
            while at < len(i):
                key, kind, end = (i[at], block[at]), role[at], at
                while end < len(i) and (i[end], block[end]) == key and role[end] == kind and end - at < 512:
                    end += 1
                if key != now:
                    now, held, cell, owners, base = key, [], [], [], None
                if kind == 0:
                    held.append(v[at:end].copy())
                    cell += [c[0] for c in cells[at:end]]
                    owners += ids[at:end]
                elif held:
                    if base is None:
                        base, where = np.concatenate(held), np.array(cell)
                    out = _best(v[at:end], [x[0] for x in ids[at:end]], cells[at:end], base, where, owners, k)
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])
                at = end

    queries = rows.filter(F.col("vec_id") % every == 0)
    work = placed.mapInArrow(deal, schema).union(queries.mapInArrow(ask, schema))
    found = (
        work.repartition(max(partitions(spark), 1), "i", "block").sortWithinPartitions("i", "block", "role")
        .mapInArrow(rerank, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(q: np.ndarray, ids: list[int], visited: list[bytes], base: np.ndarray, cell: np.ndarray, owners: list[list[int]], k: int) -> list[tuple]:
    """(query, vec_id, score) of the k nearest entries in visited cells, ties to the smaller id."""
    masks = np.frombuffer(b"".join(visited), np.uint8).reshape(len(q), -1)
    scores = np.where(masks[:, cell] > 0, q @ base.T, -np.inf)
    take = min(k + 1, scores.shape[1])
    out = []
    edge = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take] if take else None
    for row, query in enumerate(ids):
        # entries that tie with the last one within rounding come along
        near = np.flatnonzero((scores[row] >= edge[row] - 1e-9 * (1 + abs(edge[row]))) & (scores[row] > -np.inf)) if np.isfinite(edge[row]) else np.flatnonzero(scores[row] > -np.inf)
        exact = (base[near] * q[row]).sum(axis=1)
        ranked = sorted((-s, own) for s, n in zip(exact.tolist(), near.tolist()) for own in owners[n] if own != query)
        out += [(query, own, -s) for s, own in ranked[:k]]
    return out
