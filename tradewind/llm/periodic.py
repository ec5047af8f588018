"""Periodic runs of words: recursive frequency splitting, then a scan of lags over what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import workers_import

#: Words that a worker looks at together; a longer document stands alone.
BATCH_WORDS = 200_000

SPANS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def surviving(ids: np.ndarray, starts: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int]]:
    """[start, end) stretches of the word numbers that can hold a run, none across a document's start.

    A run of period q has ``times * q`` words or more and ``least`` at least, so
    each of its words stands ``times`` times in it, and ``least`` times if q = 1,
    the only period that fits below ``2 * times`` words. A word that is rarer
    within its segment splits it; the parts are counted again until none splits.
    """
    width = int(ids.max()) + 1 if len(ids) else 1
    at = np.arange(len(ids), dtype=np.int64)
    segment = np.zeros(len(ids), np.int64)
    segment[starts[(starts > 0) & (starts < len(ids))]] = 1
    segment = np.cumsum(segment)
    stable: list[tuple[int, int]] = []
    while len(at):
        sizes = np.bincount(segment)
        _, which, counts = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        common = counts[which] >= np.where(sizes[segment] >= 2 * times, times, max(times, least))
        whole = np.bincount(segment, weights=~common) == 0
        heads = np.flatnonzero(np.diff(segment, prepend=-1))
        stable += [(int(at[h]), int(at[h] + sizes[segment[h]])) for h in heads[whole[segment[heads]]]]
        stay = common & ~whole[segment]
        at, segment = at[stay], segment[stay]
        if len(at):
            segment = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(segment) != 0)]))
            long = np.bincount(segment)[segment] >= least
            at = at[long]
            segment = np.unique(segment[long], return_inverse=True)[1]
    return sorted(stable)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Equal elements from the start on, looked at in growing steps."""
    done, step, most = 0, 32, min(len(a), len(b))
    while done < most:
        differs = np.flatnonzero(a[done:min(done + step, most)] != b[done:min(done + step, most)])
        if len(differs):
            return done + int(differs[0])
        done, step = min(done + step, most), step * 4
    return most


def scanned(ids: np.ndarray, segments: list[tuple[int, int]], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run within the segments, by start and period.

    Lags go up by doubling: those from B to 2B - 1 are scanned together. A run
    of such a lag has 4B words or more, so two neighbouring places of the grid
    0, B, 2B... lie in it, and the B words at each are repeated a lag later.
    Hashes of B words find these pairs of places, in as many comparisons as
    there are words; every find is extended both ways on the words themselves,
    so a collision costs a look and nothing else. A stretch whose smallest period is
    shorter is the run of that period and not reported twice.
    """
    if times < 4:
        raise ValueError("runs of less than four periods do not fill two places of the grid")
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    cover = np.full(len(ids), -1, np.int64)  # a run of the smallest period so far at each place
    block, left = 1, segments
    hashes, places = None, None
    while left := [s for s in left if s[1] - s[0] >= times * block]:
        if block == 1:
            # segments one after the other, a number of its own behind each
            places = np.concatenate([np.arange(a, b + 1) for a, b in left])
            ends = np.cumsum([b - a + 1 for a, b in left]) - 1
            x = ids[np.minimum(places, len(ids) - 1)].astype(np.uint64)
            x[ends] = np.arange(len(left), dtype=np.uint64) + np.uint64(int(ids.max()) + 1)
            hashes = x * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        if len(hashes) > block:
            grid = np.arange(0, len(hashes) - block, block)
            behind = np.concatenate([hashes, np.arange(2 * block, dtype=np.uint64)])
            same = np.lib.stride_tricks.sliding_window_view(behind[block:], block)[::block][:len(grid)] == hashes[grid][:, None]
            heads = same.copy()
            heads[:-1] &= same[1:]
            heads[-1] = False
            heads[1:] &= ~same[:-1]
            lags, rows = np.nonzero(heads.T)
            for lag, row in zip((lags + block).tolist(), rows.tolist()):
                g = int(places[row * block])
                k = cover[g]
                if k >= 0 and lag % found[k][2] == 0 and g + lag + block <= found[k][0] + found[k][1]:
                    continue
                a, b = _bounds(segments, g)
                if g + lag >= b:
                    continue
                ahead = _shared(ids[g:b], ids[g + lag:b])
                back = _shared(ids[a:g][::-1], ids[a:g + lag][::-1])
                start, length = g - back, back + lag + ahead
                if length >= max(least, times * lag) and (start, length) not in seen:
                    seen.add((start, length))
                    inside = cover[start:start + length]
                    inside[inside < 0] = len(found)
                    found.append((start, length, lag))
        # hashes of twice the words
        joined = hashes[:-block] * np.uint64(0x100000001B3) + (hashes[block:] ^ (hashes[block:] >> np.uint64(31)))
        hashes, places = joined * np.uint64(0xFF51AFD7ED558CCD), places[:-block]
        hashes ^= hashes >> np.uint64(33)
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _bounds(segments: list[tuple[int, int]], place: int) -> tuple[int, int]:
    from bisect import bisect_right

    return segments[bisect_right(segments, (place, len(segments) and segments[-1][1] + 1)) - 1]


def runs_of(documents: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs of each document's words."""
    number: dict[bytes, int] = {}
    starts = np.cumsum([0, *map(len, documents)])
    ids = np.fromiter((number.setdefault(w, len(number)) for words in documents for w in words), np.int64, int(starts[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    segments = surviving(ids, starts[:-1], least, times)
    for start, length, period in scanned(ids, segments, least, times) if segments else ():
        owner = int(np.searchsorted(starts, start, side="right")) - 1
        out[owner].append((start - int(starts[owner]), length, period))
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of every document, and its words without the repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A run is a stretch of words with
    smallest period q and ``max(least, times * q)`` words or more (times: four at
    least) that neither neighbour extends. ``runs`` holds start, length and
    period, by start and then period; ``collapsed`` the words outside of any
    run's part after its first q words, joined by one space. Whole texts are
    read, each by one task; nothing is shuffled. A null or empty text has no
    words, no runs and an empty ``collapsed``. Repeated rows and ids are rows of
    their own, null ids stay, other columns are not read. Runs may overlap or
    lie in each other; all are reported. No rows: no result.
    """
    workers_import(docs.sparkSession)

    def scan(batches: Iterator):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def answer(keys: list, texts: list[list[bytes]]):
            runs = runs_of(texts, least, times)
            left = []
            for words, own in zip(texts, runs):
                if own:
                    keep = np.ones(len(words), bool)
                    for start, length, period in own:
                        keep[start + period:start + length] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                left.append(b" ".join(words))
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.string()), pa.array(map(len, texts), pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], kind),
                pa.array(left, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

        keys, texts, held = [], [], 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = raw.as_buffer().to_pybytes().split() if raw.is_valid else []
                if held and held + len(words) > BATCH_WORDS:
                    yield answer(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(words)
                held += len(words)
        if keys:
            yield answer(keys, texts)

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(scan, f"id string, n_words bigint, runs {SPANS}, collapsed string")
    return found.select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties go to the smallest start, then period. Null without runs."""
    def better(a: Column, b: Column) -> Column:
        by = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(by > 0, b).otherwise(a)  # runs come by start and period

    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), runs[0], better))


def repeated_tail(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal id divisible by ten, the words from a on repeat those of their first p.

    g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8) of n words,
    which are then joined by one space. Null ids and texts without words stay as they are.
    """
    h, words = F.crc32(F.col(doc_id).cast("string").cast("binary")), F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.expr("""array_join(concat(
        slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a))), ' ')""")
    return rows.select("doc_id", F.when(F.col("g").isNotNull() & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))
