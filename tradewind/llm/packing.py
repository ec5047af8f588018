"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import encoded, kept, stored, workers_import

_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: Of a lower-cased text: runs of letters, ASCII or not, single digits, runs of marks.
_RUNS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\s]+")
_MARKS = ".,;:!?|()\"-"


class ChunkIds(dict):
    """Token ids (little-endian unsigned 32-bit) of white-space separated chunks, each made once.

    The tokenizer drops white space, lower-cases and never joins letters,
    digits and marks, so a text's ids are those of its runs of letters and
    marks and its digits in turn (``runs``). A text where a run isn't certain,
    as of bytes outside ASCII that aren't all letters, an apostrophe or a
    special token, goes by its chunks instead. Words of letters alone are
    encoded many at once; the ids of one end where its last token carries the
    word end. At most ``most`` runs and as many chunks stay in memory.
    """

    def __init__(self, path: str, most: int = 450_000):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Ids of runs; None of those that may join with their neighbours.
        self.runs: dict[bytes, bytes | None] = {}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def parts(self, chunk: bytes) -> list[bytes]:
        """Parts that the tokenizer would cut the chunk into; the chunk alone if that isn't certain."""
        if chunk.isascii():
            if b"'" in chunk or b"<|" in chunk:
                return [chunk]
            return _PARTS.findall(chunk.lower())
        text = chunk.decode("utf-8", "replace")
        core = text.strip(_MARKS)
        if core == text or not core.lower().isalpha():
            return [chunk]
        at = text.index(core)
        return [p.encode() for p in (text[:at], core, text[at + len(core):]) if p]

    def one(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def words(self, words: list[bytes], into: dict) -> None:
        """Encode words of letters alone, many at once."""
        for at in range(0, len(words), 4096):
            block = words[at:at + 4096]
            ids = np.array(self.tokenizer.encode(b" ".join(block).decode("utf-8"), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(block):
                raw = ids.tobytes()
                edges = [0, *(4 * stops).tolist()]
                into.update((w, raw[a:b]) for w, a, b in zip(block, edges, edges[1:]))
            else:
                into.update((w, self.one(w)) for w in block)

    def learn(self, chunks: set[bytes]) -> None:
        """Take up all chunks that are new."""
        new = chunks.difference(self)
        if len(self) + 2 * len(new) > self.most:
            self.clear()
            new = chunks
        cut = {c: self.parts(c) for c in new}
        self.words([p for p in {p for parts in cut.values() for p in parts}.difference(self) if _letters(p)], self)
        for chunk, parts in cut.items():
            if len(parts) == 1 and parts[0] in self:
                self[chunk] = self[parts[0]]
            else:
                for p in parts:
                    if p not in self:
                        self[p] = self.one(p)
                self[chunk] = b"".join(self[p] for p in parts)

    def learn_runs(self, runs: set[bytes]) -> None:
        """Take up all runs that are new."""
        new = runs.difference(self.runs)
        if len(self.runs) + len(new) > self.most:
            self.runs.clear()
            new = runs
        # of bytes alone isalpha() is of ASCII letters
        self.words([r for r in new if r.isalpha() or not r.isascii() and _letters(r)], self.runs)
        for r in new.difference(self.runs):
            self.runs[r] = self.one(r) if r.isascii() else None

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        cut = [None if b"'" in t or b"<|" in t else _RUNS.findall(t.lower()) for t in texts]
        self.learn_runs(set().union(*(c for c in cut if c)))
        ids: list[bytes | None] = []
        for runs in cut:
            try:
                ids.append(None if runs is None else b"".join(map(self.runs.__getitem__, runs)))
            except TypeError:  # a run without certain ids
                ids.append(None)
        rest = [k for k, known in enumerate(ids) if known is None]
        chunks = [texts[k].split() for k in rest]
        self.learn(set().union(*chunks))
        for k, c in zip(rest, chunks):
            ids[k] = b"".join(map(self.__getitem__, c))
        return ids


def _letters(raw: bytes) -> bool:
    """Whether it is UTF-8 of letters that stay letters when lower-cased."""
    return raw.decode("utf-8", "replace").lower().isalpha()


def ids_of(path: str) -> ChunkIds:
    held = kept("chunk ids")
    if path not in held:
        held[path] = ChunkIds(path)
    return held[path]


class Bins:
    """A fixed number of open bins, found by free space in a bitset; the fullest closes when all are taken."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.bits = capacity, most, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        held = self.by_free[free]
        one = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return one

    def add(self, length: int, item) -> list[list]:
        """Put the item into the fullest bin that takes it, or a new one; returns bins that close by it."""
        closed = []
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            one = self._take(free)
        else:
            if self.open >= self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, one = self.capacity, []
        one.append(item)
        free -= length
        if free:
            self.by_free.setdefault(free, []).append(one)
            self.bits |= 1 << free
            self.open += 1
        else:
            closed.append(one)
        return closed

    def rest(self) -> Iterator[list]:
        for held in self.by_free.values():
            yield from held


def _pack(rows: Iterator[tuple], capacity: int, bins: int, last_round: bool, first_id: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc, sequence_id, offset, open) of pieces packed in the order they come."""
    holder, ids = Bins(capacity, bins), iter(range(first_id, first_id + (1 << 36)))

    def placed(one: list, still_open: bool):
        sequence, offset = next(ids), 0
        for item in one:
            yield *item, sequence, offset, still_open
            offset += item[3]

    for item in rows:
        for one in holder.add(item[3], item):
            yield from placed(one, False)
    for one in holder.rest():
        yield from placed(one, not last_round)


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, bins: int = 256,
           gather: int = 32) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` tokens and pack them into sequences.

    A document is its ids and ``end_id``; a null or empty text is the end id
    alone. Each task packs what it tokenizes, with ``bins`` bins open. What
    lies in bins that were still open at its end is packed again by a
    ``gather``-th of the tasks, round after round, until one task's worth is
    left. Best fit with bounded space may need 1.7 times the fewest sequences
    that an offline packing takes; ``bins`` of the last round may be short for
    want of pieces. Rows with equal or null ids are documents of their own.
    """
    spark = docs.sparkSession
    workers_import(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[tuple], doc_type):
        import pyarrow as pa

        types = [doc_type, pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def in_batches(rows: Iterator[tuple], doc_type: list):
        out = []
        for row in rows:
            out.append(row)
            if len(out) >= 10_000:
                yield batch_of(out, doc_type[0])
                out = []
        if out:
            yield batch_of(out, doc_type[0])

    def first(batches: Iterator):
        doc_type, chunk_ids, end = [], ids_of(tokenizer), end_id.to_bytes(4, "little")

        def pieces():
            for batch in batches:
                doc_type[:] = [batch.column(0).type]
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    texts = chunk_ids.of([encoded(t) for t in part.column(1).to_pylist()])
                    for key, ids in zip(part.column(0).to_pylist(), texts):
                        ids += end
                        for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                            piece = ids[a:a + 4 * capacity]
                            yield key, k, a // 4, len(piece) // 4, zlib.crc32(piece)

        yield from in_batches(_pack(pieces(), capacity, bins, False, TaskContext.get().partitionId() << 36), doc_type)

    def again(last: bool, number: int):
        def pack(batches: Iterator):
            doc_type = []

            def pieces():
                for batch in batches:
                    doc_type[:] = [batch.column(0).type]
                    yield from zip(*(c.to_pylist() for c in batch.columns))

            where = (number << 56) + (TaskContext.get().partitionId() << 36)
            yield from in_batches(_pack(pieces(), capacity, bins, last, where), doc_type)

        return pack

    placed = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, schema), "packed")
    done = [placed.filter("not open")]
    left = placed.filter("open")
    # longest first: the short pieces then fill what the long ones leave
    tasks, number = max(1, -(-_sequences(left) // (gather * bins))), 1
    while True:
        last = tasks == 1
        placed = stored(
            left.select(*names[:5]).repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
            .mapInArrow(again(last, number), schema), "packed")
        if last:
            done.append(placed)
            break
        done.append(placed.filter("not open"))
        left, tasks, number = placed.filter("open"), -(-tasks // gather), number + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("open")


def _sequences(rows: DataFrame) -> int:
    return rows.select("sequence_id").distinct().count()
