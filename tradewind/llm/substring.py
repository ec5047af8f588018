"""Substring dedup: winnowed anchors seed matches, windows around them extend these word by word."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tradewind.llm.common import encoded, partitions, space_words, workers_import
from tradewind.llm.minhash import mixed, word_hashes

WINDOW, GRAM = 35, 16  # every run of 35 words selects a gram of 16 among its 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i (mod 2^64) for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 2 * n)
        out = []
        for base in (_P, pow(_P, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def run_hashes(h: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, the hash of every run of so many words, wherever it stands."""
    n = len(h)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down[:n], out=sums[1:])
    return [mixed((sums[w:] - sums[:n + 1 - w]) * up[:n + 1 - w]) if n >= w else h[:0] for w in widths]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least gram of each run of ``width`` grams, which grams are the least of a run that holds them)."""
    least = sliding(grams, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    return least, sliding(padded, width, np.maximum) == grams


def _once(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries occur once here, the distinct codes that occur more often)."""
    distinct, inverse, n = np.unique(codes, return_inverse=True, return_counts=True)
    return n[inverse] == 1, distinct[n > 1]


_PLACES = "code long, key long, at long, kind int"
_OPEN, _KNOWN, _SEEN_TWICE = 0, 1, 2


def _repeated(places: DataFrame) -> DataFrame:
    """(key, at) of places whose code occurs at another place.

    A batch settles by itself the codes it holds twice: their places come as
    known, spread over all tasks, and one row says that the code occurs
    elsewhere. So a code meets itself at most once per batch, however many
    copies there are.
    """
    more = F.sum(F.when(F.col("kind") == _SEEN_TWICE, 2).otherwise(1)).over(Window.partitionBy("code", "known"))
    return (
        places.withColumn("known", F.col("kind") == _KNOWN).withColumn("n", more)
        .filter((F.col("kind") == _KNOWN) | ((F.col("kind") == _OPEN) & (F.col("n") > 1))).select("key", "at"))


def _places(codes: np.ndarray, keys: np.ndarray, at: np.ndarray):
    """Record batches of _PLACES for the places of one batch of documents."""
    import pyarrow as pa

    once, twice = _once(codes)
    known = ~once
    parts = (
        (codes[once], keys[once], at[once], _OPEN),
        (mixed(keys[known].view(np.uint64) + at[known].view(np.uint64)), keys[known], at[known], _KNOWN),
        (twice, np.zeros(len(twice), np.int64), np.zeros(len(twice), np.int64), _SEEN_TWICE))
    for code, key, place, kind in parts:
        for a in range(0, len(code), 100_000):
            b = min(len(code), a + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[a:b].view(np.int64)), pa.array(key[a:b]), pa.array(place[a:b]), pa.array(np.full(b - a, kind, np.int32))],
                ["code", "key", "at", "kind"])


def _gathered(found: Iterator[tuple[np.ndarray, int, int, np.ndarray]], most: int = 1_500_000):
    """Places of many documents at a time: (codes, key, check, starts) each, about ``most`` places in memory."""
    held, n = [], 0

    def out():
        codes = np.concatenate([c for c, _, _, _ in held])
        keys = np.concatenate([np.full(len(c), k, np.int64) for c, k, _, _ in held])
        at = np.concatenate([s.astype(np.int64) + (check << 32) for _, _, check, s in held])
        return _places(codes, keys, at)

    for one in found:
        if len(one[0]):
            held.append(one)
            n += len(one[0])
            if n >= most:
                yield from out()
                held, n = [], 0
    if held:
        yield from out()


def repeated_words(docs: DataFrame, text: str, doc_id: str, change, schema, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Apply ``change`` to batches of all documents with the words that windows elsewhere repeat.

    ``change(batch, removed)`` gets an Arrow batch of the columns of ``docs``
    and per row (words, mask of the words to remove), and returns a batch of
    ``schema``. A window is ``window`` consecutive words of a document; a word
    is to be removed if a window over it also starts anywhere else, in the same
    document too. Rows with null texts, without words or with fewer words than
    a window have no window. Rows that repeat are documents of their own.

    Stage one selects anchors (the least gram of every window) and keeps those
    that occur twice; every repeated window holds one at the same place. Stage
    two extends the seeds both ways: windows that have a seed as their anchor
    are counted by 64-bit hash, and covered words are the union of those found
    elsewhere, hence of all maximal repeats of a window or more.
    """
    spark = docs.sparkSession
    workers_import(spark)
    width = window - gram + 1
    at_text = docs.columns.index(text)
    columns = len(docs.columns)
    keyed = docs.withColumns({
        "__key": F.xxhash64(F.col(doc_id), F.col(text)),
        "__check": F.pmod(F.xxhash64(F.col(text), F.col(doc_id)), F.lit(1 << 31)).cast("long")})

    def seeds(batches: Iterator):
        def found():
            for batch in batches:
                for value, key, check in zip(*(c.to_pylist() for c in batch.columns)):
                    words = space_words(value, lower=False)
                    if len(words) >= window:
                        (grams,) = run_hashes(word_hashes(words), gram)
                        at = np.flatnonzero(anchors(grams, width)[1])
                        yield grams[at], key, check, at

        yield from _gathered(found())

    def windows(batches: Iterator):
        def found():
            for batch in batches:
                values, keys, checks = (batch.column(i).to_pylist() for i in (at_text, columns, columns + 1))
                for value, key, check, places in zip(values, keys, checks, batch.column(columns + 2).to_pylist()):
                    at = np.array(places, np.int64)
                    at = at[at >> 32 == check] & 0xFFFFFFFF
                    words = space_words(value, lower=False)
                    if len(words) < window:
                        continue
                    grams, full = run_hashes(word_hashes(words), gram, window)
                    at = at[at < len(grams)]
                    seeded = np.full(len(grams), 2**64 - 1, np.uint64)
                    seeded[at] = grams[at]
                    starts = np.flatnonzero(sliding(seeded, width, np.minimum) == sliding(grams, width, np.minimum))
                    yield full[starts], key, check, starts

        yield from _gathered(found())

    def finish(batches: Iterator):
        for batch in batches:
            values, checks = batch.column(at_text).to_pylist(), batch.column(columns + 1).to_pylist()
            removed = []
            for value, check, places in zip(values, checks, batch.column(columns + 2).to_pylist()):
                words = space_words(value, lower=False)
                mask = np.zeros(len(words), bool)
                if places:
                    at = np.array(places, np.int64)
                    at = at[at >> 32 == check] & 0xFFFFFFFF
                    turns = np.zeros(len(words) + 1, np.int64)
                    np.add.at(turns, at, 1)
                    np.add.at(turns, at + window, -1)
                    mask = np.cumsum(turns[:-1]) > 0
                removed.append((words, mask))
            import pyarrow as pa

            yield change(pa.RecordBatch.from_arrays(batch.columns[:columns], names=batch.schema.names[:columns]), removed)

    listed = lambda places: places.groupBy(F.col("key").alias("__key")).agg(F.collect_set("at").alias("__at"))
    n = partitions(spark)
    seeded = listed(_repeated(keyed.select(F.col(text), "__key", "__check").mapInArrow(seeds, _PLACES)))
    # both joins deal the documents out in the same way, so Spark writes that shuffle once
    dealt = keyed.repartition(n, "__key")
    wide = dealt.join(seeded, "__key").select(*dealt.columns, "__at")
    covered = listed(_repeated(wide.mapInArrow(windows, _PLACES)))
    return dealt.join(covered, "__key", "left").select(*dealt.columns, "__at").mapInArrow(finish, schema)


def _cut(value: str, mask: np.ndarray) -> str:
    """The text without the words of the mask; what is kept keeps its own white space."""
    raw, out, done = encoded(value), [], 0
    for place, gone in zip(_WORD.finditer(raw), mask.tolist()):
        if not gone:
            out.append(raw[done:place.end()])
        done = place.end()
    return b"".join([*out, raw[done:]]).strip().decode("utf-8", "surrogatepass")


def substring_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: words, removed words and the SHA-256 of the kept words joined by single spaces."""

    def change(batch, removed):
        import pyarrow as pa

        kept = [hashlib.sha256(b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone] if mask.any() else words)).hexdigest() for words, mask in removed]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w, _ in removed], pa.int64()), pa.array([int(m.sum()) for _, m in removed], pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return repeated_words(slim, "text", "doc_id", change, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", window)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut from their texts; texts without one are left as they are.

    A removed word takes the white space before it along. All columns and rows
    stay.
    """
    at = docs.columns.index(text)

    def change(batch, removed):
        import pyarrow as pa

        values = batch.column(at).to_pylist()
        for i, (words, mask) in enumerate(removed):
            if mask.any():
                values[i] = _cut(values[i], mask)
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return repeated_words(docs, text, doc_id, change, T.StructType(docs.schema.fields), window)
