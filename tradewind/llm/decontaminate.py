"""Benchmark decontamination by longest matches in a suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.automaton import SuffixAutomaton
from tradewind.llm.common import alnum_words, filesystem, kept, scratch, workers_import

_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # of the text as it is, A-Z included

#: Matchers a worker holds, and bytes of documents read against one shard after the other where there are more.
HELD, GATHER_BYTES = 4, 48 << 20


class Matcher:
    """Automaton of one shard of items with what a window needs: marked states and the items behind them."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.code: dict[bytes, int] = {}
        code = self.code
        self.automaton = SuffixAutomaton()
        coded = [(item, [code.setdefault(w, len(code)) for w in words]) for item, words in pieces if words]
        for _, words in coded:
            self.automaton.add(words)
        self.shortest = min((min(len(w), window) for _, w in coded), default=window)
        self.of_window: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        self.up: list[int] | None = None
        self.window_state: dict[int, int] = {}
        for item, words in coded:
            state = matched = 0
            for word in words:
                state, matched = self.automaton.step(state, matched, word)
                if matched >= window:
                    self.of_window.setdefault(self._windowed(state), set()).add(item)
            if len(words) < window:
                self.short.setdefault(state, set()).add(item)

    def _windowed(self, state: int) -> int:
        """The class of the last ``window`` words, reached over suffix links."""
        found = self.window_state.get(state)
        if found is None:
            found = state
            while self.automaton.length[self.automaton.link[found]] >= self.window:
                found = self.automaton.link[found]
            self.window_state[state] = found
        return found

    def hits(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Add (start, end) of every window occurrence among the words, and the items they belong to."""
        get = self.code.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], codes >= 0, [False]))
        turns = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = turns[::2], turns[1::2]
        # a word that no item has ends every match, so only runs of item words that can hold a window are read
        long = ends - starts >= self.shortest
        step, automaton = self.automaton.step, self.automaton
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for i, word in enumerate(codes[a:b].tolist(), a):
                state, matched = step(state, matched, word)
                if matched >= self.window:
                    spans.append((i + 1 - self.window, i + 1))
                    items |= self.of_window[self._windowed(state)]
                if self.short:
                    at = state if matched >= automaton.length[state] else automaton.link[state]
                    while at > 0:
                        if at in self.short:
                            spans.append((i + 1 - automaton.length[at], i + 1))
                            items |= self.short[at]
                        at = automaton.link[at]


def sharded_items(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13, shard_words: int = 200_000) -> tuple[str, int]:
    """Write the items' words to the shared folder in shards of about ``shard_words`` words.

    Returns (folder, number of shards). Items longer than a tenth of a shard are
    cut into pieces that overlap by window - 1 words, so no window is lost and
    no automaton grows with the benchmark.
    """
    spark = items.sparkSession
    workers_import(spark)
    piece, folder = max(window, shard_words // 10), scratch(spark, "items")

    def cut(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                words = alnum_words(row["text"])
                for at in range(0, max(1, len(words) - window + 1), piece):
                    part = words[at:at + piece + window - 1]
                    if part:
                        out.append((str(row["item_id"]), at, len(part), b" ".join(part)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["item", "at", "n", "words"])

    cut_items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, "item string, at long, n long, words binary")
    shards = -(-(cut_items.agg(F.sum("n")).first()[0] or 0) // shard_words)
    if shards:
        where = F.pmod(F.xxhash64("item", "at"), F.lit(shards)).cast("int")
        cut_items.select(where.alias("shard"), "item", "words").repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    return folder, shards


def _matcher(folder: str, shard: int, window: int) -> Matcher | None:
    """The matcher of a shard; a worker keeps the last HELD it has built."""
    loaded, key = kept("matchers"), f"{folder}/{shard}/{window}"
    if key not in loaded:
        from pyarrow import fs as pafs
        from pyarrow import parquet

        fs, base = filesystem(folder)
        path = f"{base}/shard={shard}"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:  # no item fell into this shard
            return None
        rows = [
            r for info in fs.get_file_info(pafs.FileSelector(path)) if info.path.endswith(".parquet")
            for r in parquet.ParquetFile(fs.open_input_file(info.path)).read().to_pylist()]
        while len(loaded) >= HELD:
            loaded.pop(next(iter(loaded)))
        loaded[key] = Matcher(sorted((r["item"], r["words"].split()) for r in rows), window)
    return loaded[key]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _gathered(batches: Iterator, shards: int) -> Iterator[list]:
    """Batches to read against one shard after the other: each alone if a worker holds all shards, else GATHER_BYTES at a time."""
    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.nbytes
        if shards <= HELD or held >= GATHER_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def _found(columns: list, folder: str, shards: int, window: int) -> list[list[tuple[int, list[tuple[int, int]], list[str]]]]:
    """(words, joined spans, items) of each text of each column; a shard is taken up once for all of them."""
    found = [[(set(), [], [0]) for _ in column] for column in columns]
    for shard in range(max(1, shards)):
        matcher = _matcher(folder, shard, window) if shards else None
        for column, rows in zip(columns, found):
            for value, (items, spans, n) in zip(column, rows):
                if matcher is not None or shard == 0:
                    words = alnum_words(value.as_py())
                    n[0] = len(words)
                    if matcher is not None:
                        matcher.hits(words, spans, items)
    return [[(n[0], joined(spans), sorted(items)) for items, spans, n in rows] for rows in found]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 13, share: int = 20) -> DataFrame:
    """Per document: words, words hit, matched items, spans of hit words and the verdict.

    A window is ``window`` consecutive item words, or a whole shorter item. A
    document is contaminated if it has hits on at least one word in ``share``.
    Null and empty texts have no words; null item ids count as ``None``; rows
    are never merged, so repeated documents repeat. Items: one distinct id each.
    """
    workers_import(docs.sparkSession)
    folder, shards = sharded_items(items, item_id, item_text, window)

    def scan(batches: Iterator):
        import pyarrow as pa

        for group in _gathered(batches, shards):
            for batch, rows in zip(group, _found([b.column(1) for b in group], folder, shards, window)):
                out: list[tuple] = []
                for key, (n, spans, found) in zip(batch.column(0).to_pylist(), rows):
                    hit = sum(b - a for a, b in spans)
                    out.append((
                        key, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and share * hit >= n,
                        max((b - a for a, b in spans), default=0), [{"start": a, "end": b} for a, b in spans]))
                if out:
                    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    types = (batch.column(0).type, *[pa.int64()] * 3, pa.string(), pa.bool_(), pa.int64(), span)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)],
                        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_span", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_span long, "
        "spans array<struct<start: long, end: long>>")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """The documents without contamination, columns as they came.

    Documents over the coverage limit (one hit word in ``share``) go. In the
    others every matched span is cut from the text; texts without a match, null
    and empty ones are left alone. Repeated rows are judged each; an empty table
    gives an empty one, and without items every document stays.
    """
    workers_import(docs.sparkSession)
    folder, shards = sharded_items(items, item_id, item_text, window)
    at = docs.columns.index(text)

    def clean(batches: Iterator):
        import pyarrow as pa

        for group in _gathered(batches, shards):
            for batch, rows in zip(group, _found([b.column(at) for b in group], folder, shards, window)):
                texts, keep = batch.column(at).to_pylist(), []
                for i, (n, spans, _) in enumerate(rows):
                    hit = sum(b - a for a, b in spans)
                    keep.append(not (hit > 0 and share * hit >= n))
                    if spans and keep[-1]:
                        texts[i] = without(texts[i], spans)
                columns = [c if i != at else pa.array(texts, batch.schema.field(at).type) for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def without(value: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(value)]
    out, done = [], 0
    for a, b in spans:
        out.append(value[done:places[a][0]])
        done = places[b - 1][1]
    return "".join([*out, value[done:]])
