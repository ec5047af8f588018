"""Hard negatives by coordinate pruning: buckets of similar length with a sorted list for each coordinate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.common import stored, workers_import

#: Rows of a slice, which one task holds with its lists; anchors that meet a slice in one task; rows of a bucket.
SLICE, ANCHORS, BUCKET = 8192, 4096, 1024
#: A bucket ends where lengths fall below this share of its longest; focus coordinates of an anchor.
SIMILAR, FOCUS = 0.9, 5
#: Up to here whole numbers and their sums are exact in doubles.
EXACT = 2.0 ** 53


class Bucket:
    """Rows of similar length, and for every coordinate the rows sorted by their value in the unit vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.v, self.longest = ids, labels, v, float(lengths.max())
        self.top = float(np.abs(v).max()) if v.size else 0.0
        self.unit = v / np.where(lengths > 0, lengths, 1)[:, None]
        order = np.argsort(self.unit, axis=0)
        self.lists, self.values = order.T.copy(), np.take_along_axis(self.unit, order, axis=0).T.copy()

    def candidates(self, q: np.ndarray, length: float, least: float, look: np.ndarray) -> np.ndarray | None:
        """Rows that can reach the score ``least`` with the anchor; None stands for all of them.

        A score needs an angle of at most g = arccos(least / lengths) between
        both vectors. The angle of each to a coordinate's axis differs by no
        more, which leaves a range of values on every focus coordinate. The
        shortest range is read from its list, the others are looked up.
        """
        if least <= 0 or not np.isfinite(length * self.longest):
            return None
        if least > length * self.longest * (1 + 1e-9):
            return np.empty(0, np.int64)
        apart = np.arccos(min(1.0, least / (length * self.longest) * (1 - 1e-9)))
        own = np.arccos(np.clip(q[look] / length, -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + apart)) - 1e-9, np.cos(np.maximum(0, own - apart)) + 1e-9
        # the largest coordinate has the narrowest range of angles: if its list is read nearly whole, so are the others
        a, b = np.searchsorted(self.values[look[0]], (low[0], high[0]))
        if 4 * (b - a) > 3 * len(self.ids):
            return None
        ranges = [np.searchsorted(self.values[f], (x, y)) for f, x, y in zip(look, low, high)]
        at = min(range(len(look)), key=lambda i: ranges[i][1] - ranges[i][0])
        rows = self.lists[look[at], ranges[at][0]:ranges[at][1]]
        near = self.unit[rows[:, None], look]
        return rows[((near >= low) & (near <= high)).all(axis=1)]

    def verified(self, rows: np.ndarray | None, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, labels) of the candidates: whole inner products, in Python's numbers where doubles could round."""
        v, ids, labels = (self.v, self.ids, self.labels) if rows is None else (self.v[rows], self.ids[rows], self.labels[rows])
        if self.top * float(np.abs(q).sum()) < EXACT:
            return v @ q, ids, labels
        most, whole = 2 ** 63 - 1, [int(x) for x in q]
        return np.array([max(-most, min(most, sum(int(a) * b for a, b in zip(row, whole)))) for row in v], object), ids, labels


def buckets(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list[Bucket]:
    """Buckets of falling length."""
    lengths = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, labels, v, lengths = ids[order], labels[order], v[order], lengths[order]
    out, start = [], 0
    while start < len(ids):
        end = min(start + BUCKET, int(np.searchsorted(-lengths, -lengths[start] * SIMILAR, side="right")))
        out.append(Bucket(ids[start:end], labels[start:end], v[start:end], lengths[start:end]))
        start = end
    return out


def _first(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k highest with those known so far, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[near], ids[near]
    return sorted(best + [(int(s), int(i)) for s, i in zip(scores, ids)], key=lambda x: (-x[0], x[1]))[:k]


def same_label(own: list[Bucket], anchor: int, label: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best rows of the anchor's label but itself, and how many rows were verified; the kth best so far is the next bucket's limit."""
    best: list[tuple[int, int]] = []
    length, look, count = float(np.sqrt(q @ q)), np.argsort(-np.abs(q))[:FOCUS], 0
    for b in own:
        scores, ids, labels = b.verified(b.candidates(q, length, float(best[-1][0]) if len(best) == k else 0.0, look), q)
        count += len(ids)
        keep = (labels == label) & (ids != anchor)
        best = _first(best, scores[keep], ids[keep], k)
    return best, count


def other_labels(own: list[Bucket], label: int, q: np.ndarray, bands: list[tuple[int, int]], k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each band of scores the k best rows of other labels within, and how many rows were verified.

    Every band's limit rises from its lower end to its kth best so far; a
    bucket is asked for rows that can reach the lowest of these limits.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in bands]
    length, look, count = float(np.sqrt(q @ q)), np.argsort(-np.abs(q))[:FOCUS], 0
    for b in own:
        limits = [max(low, x[-1][0]) if len(x) == k else low for (low, _), x in zip(bands, best)]
        scores, ids, labels = b.verified(b.candidates(q, length, float(min(limits)), look), q)
        count += len(ids)
        near = np.flatnonzero((scores >= min(limits)) & (labels != label))
        scores, ids = scores[near], ids[near]
        for n, (_, high) in enumerate(bands):
            within = np.flatnonzero((scores >= limits[n]) & (scores <= high))
            if len(within):
                best[n] = _first(best[n], scores[within], ids[within], k)
    return best, count


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each id once, v the floors of ``scale`` times the components.

    Rows with a null id, label or vector, or a null or non-finite component take
    no part, nor do vectors of another length than the most common one (the
    shorter on equal counts), which have no product with the others. Of
    rows with the same id the one with the least label and vector counts.
    """
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (widths["n"] if widths else 0)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    # floor() of a column is a long; doubles keep what is larger, and whole doubles above 2^53 are their own floor
    floor = lambda x: F.when(F.abs(x * scale) < 2.0 ** 52, F.floor(x * scale).cast("double")).otherwise(F.greatest(F.least(x * scale, F.lit(1e300)), F.lit(-1e300)))
    return rows.select("vec_id", F.col("r.label").alias("label"), F.transform("r.v", floor).alias("v"))


def hard_negatives(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row whose id ``every`` divides.

    Scores are whole inner products of floored vectors, higher first, ties to
    the smaller id. Positives are an anchor's first rows of its own label,
    negatives of a positive its first rows of other labels that score between
    ``low`` and ``high`` hundredths of the positive. ``usable`` says which rows take part.

    Rows are cut into slices of a label and similar length. Anchors go, in
    groups, to slices of their label, and then, with the bands of their
    positives, to slices that hold another label and are long enough for the
    lowest band. In a slice, buckets of falling length are pruned by length and
    by the focus coordinates (``Bucket.candidates``); what is left is verified
    exactly, and only the best of a slice leave it. A label with most rows is
    many slices. Fewer rows than asked for: all of them; no rows or no anchor: no
    result. A score beyond a long is reported as the largest or smallest long.
    """
    spark = vectors.sparkSession
    workers_import(spark)
    rows = usable(vectors, vec_id, embedding, label, scale)
    rows = stored(rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "negative-rows")
    total = rows.count()
    sliced = stored(_numbered(rows.repartitionByRange(max(1, -(-total // SLICE)), "label", F.desc("length"), "vec_id")), "negative-slices")
    anchors = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "v", "length")
    groups = max(1, -(-anchors.count() // ANCHORS))
    anchors = anchors.withColumn("team", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    # a row for each slice and label in it: as many as slices and labels together
    held = stored(sliced.groupBy("slice", "label").agg(F.max("length").alias("longest")), "negative-held")

    near = anchors.join(held.select("slice", "label"), "label").select("slice", "team", F.col("vec_id").alias("anchor"), "label", "v", F.lit(None).cast("array<bigint>").alias("lows"), F.lit(None).cast("array<bigint>").alias("highs"))
    found = _visited(sliced, near, groups, positives, negatives).select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    pairs = stored(found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= positives), "negative-positives")

    # bands are told apart by their place among the anchor's positives
    # no whole number is between low and high hundredths of a score below zero; products beyond a long are in decimals
    wide = F.col("positive_score").cast("decimal(38,0)")
    bands = pairs.select("anchor", "at", F.ceil(wide * low / 100).cast("long").alias("least"), F.floor(wide * high / 100).cast("long").alias("most")).filter("least <= most")
    asked = bands.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "least", "most"))).alias("bands"), F.min("least").alias("lowest"))
    asked = asked.join(anchors.withColumnRenamed("vec_id", "anchor"), "anchor").select(
        "anchor", "label", "v", "length", "team", "lowest", F.col("bands.at").alias("ats"), F.col("bands.least").alias("lows"), F.col("bands.most").alias("highs"))
    asked = stored(asked, "negative-bands")
    # slices with another label: all but those of one label, the anchor's; long enough: |anchor| * |longest| reaches the lowest band
    spans = held.groupBy("slice").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max("longest").alias("longest"))
    last = held.agg(F.max("slice")).first()[0] or 0
    far = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(spans, "slice").filter(
        "length * longest * (1 + 1e-9) >= lowest and (first != label or last != label)").select("slice", "team", "anchor", "label", "v", "lows", "highs")
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "other")
    got = _visited(sliced, far, groups, positives, negatives).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    got = got.join(asked.select("anchor", "ats"), "anchor").select(
        "anchor", F.element_at("ats", F.col("band") + 1).alias("at"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return got.join(pairs, ["anchor", "at"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _numbered(rows: DataFrame) -> DataFrame:
    """The number of its partition beside each row."""
    return rows.withColumn("slice", F.spark_partition_id())


def _visited(sliced: DataFrame, visits: DataFrame, groups: int, positives: int, negatives: int) -> DataFrame:
    """(anchor, band, other, score): what each slice has to offer to the anchors that visit it.

    A slice is copied once for each group of anchors; slice and group meet in
    one task, the slice first. Visits with bands look for other labels, those
    without for the anchor's own.
    """
    team = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))) if groups > 1 else F.lit(0)
    none = F.lit(None).cast("array<bigint>")
    rows = sliced.select("slice", team.alias("team"), F.lit(0).alias("role"), F.col("vec_id").alias("id"), "label", "v", none.alias("lows"), none.alias("highs"))
    asked = visits.select("slice", "team", F.lit(1).alias("role"), F.col("anchor").alias("id"), "label", "v", "lows", "highs")

    def meet(batches: Iterator):
        import pyarrow as pa

        out: list[tuple] = []

        def answers():
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "band", "other", "score"])

        now, held, own = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1))))
            roles, ids, labels = (batch.column(i).to_numpy() for i in (2, 3, 4))
            flat = batch.column(5).flatten().to_numpy()
            v = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)
            lows, highs = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            for at, key in enumerate(keys):
                if key != now:
                    now, held, own = key, [], None
                if roles[at] == 0:
                    held.append((ids[at], labels[at], v[at].copy()))
                    continue
                if own is None:
                    own = buckets(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held])) if held else []
                    held = []
                anchor, q = int(ids[at]), v[at]
                if lows[at] is None:
                    out += [(anchor, 0, i, s) for s, i in same_label(own, anchor, labels[at], q, positives)[0]]
                else:
                    for n, best in enumerate(other_labels(own, labels[at], q, list(zip(lows[at], highs[at])), negatives)[0]):
                        out += [(anchor, n, i, s) for s, i in best]
                if len(out) > 10_000:
                    yield answers()
                    out = []
        if out:
            yield answers()

    together = rows.union(asked).repartition("slice", "team").sortWithinPartitions("slice", "team", "role")
    return together.mapInArrow(meet, "anchor long, band int, other long, score long")
