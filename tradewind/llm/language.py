"""Language ID by cross-parsing: how few phrases of a language's labelled text make up a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.automaton import SuffixAutomaton
from tradewind.llm.common import encoded, kept, workers_import

#: Bound of the labelled sample: rows per language, bytes of each row and of all languages together.
SAMPLE_ROWS, ROW_BYTES, TOTAL_BYTES = 64, 1024, 160_000
#: Bytes parsed as one stretch; the last phrase of a stretch ends there.
STRETCH = 1024

#: Bytes that part words: ASCII other than letters, as one space; A-Z become a-z, other bytes stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters_of(text: str | None) -> bytes:
    """The text in lower case (ASCII) with every run of other ASCII characters as one space."""
    return b" ".join(encoded(text).translate(_LETTERS).split())


@dataclass(frozen=True)
class Samples:
    """Labelled text per language, at most TOTAL_BYTES in all."""

    languages: tuple[str, ...]
    texts: tuple[tuple[bytes, ...], ...]

    def mark(self) -> int:
        return zlib.crc32(repr((self.languages, self.texts)).encode())


def held_out(doc_id, parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text falls into the part that is not learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == part


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Samples:
    """A bounded sample of labelled rows, never of held-out ones: per language the rows with the least hash of the id.

    Rows with equal texts count once. Of each chosen row a stretch of at most
    ROW_BYTES bytes is taken from its middle; with many languages the stretches
    shrink, so the driver holds TOTAL_BYTES in all.
    """
    first = Window.partitionBy("lang").orderBy("h", "text_hash")
    size = F.octet_length("text")
    rows = (
        docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
        .select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
        .withColumn("stretch", F.substring("text", F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - ROW_BYTES // 2), ROW_BYTES))
        .drop("text").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= 4 * sample_rows)
        .dropDuplicates(["lang", "text_hash"]).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample_rows)
        .select("lang", "n", "stretch"))
    found: dict[str, list[bytes]] = {}
    for row in rows.orderBy("lang", "n").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["stretch"])
    share = TOTAL_BYTES // max(1, len(found))
    texts = []
    for stretches in found.values():
        kept, left = [], share
        for s in stretches:
            raw = letters_of(s)[:max(0, left)]
            left -= len(raw)
            if raw:
                kept.append(b" " + raw + b" ")
        texts.append(tuple(kept))
    return Samples(tuple(found), tuple(texts))


class PhraseTable:
    """The automata of all languages as one dense table of moves over the bytes they use."""

    def __init__(self, samples: Samples):
        self.languages = samples.languages
        used = sorted({b for texts in samples.texts for t in texts for b in t})
        self.symbol = np.zeros(256, np.int32)  # 0: a byte of no language
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        roots, tables, root = [], [], 0
        for texts in samples.texts:  # one automaton at a time is in memory
            tables.append(self._moves(texts, root))
            roots.append(root)
            root += len(tables[-1])
        self.roots = np.array(roots, np.int64)
        self.moves = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def _moves(self, texts: tuple[bytes, ...], root: int) -> np.ndarray:
        """The moves of one language's automaton, whose states count from ``root``.

        A missing move ends the phrase; it is stored as -1 - (where the byte
        leads from the root).
        """
        machine = SuffixAutomaton()
        for t in texts:
            machine.add(t)
        alone = root + len(machine.next)  # a phrase of one byte that the language lacks
        from_root = np.full(self.width, alone, np.int32)
        for b, target in machine.next[0].items():
            from_root[self.symbol[b]] = root + target
        table = np.empty((len(machine.next) + 1, self.width), np.int32)
        table[:] = -from_root - 1
        table[0] = from_root
        for s, moves in enumerate(machine.next):
            for b, target in moves.items():
                table[s, self.symbol[b]] = root + target
        return table

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns).

        A phrase is the longest match from where the last one ended; a byte
        that the language lacks is a phrase of its own. All stretches of all
        texts advance together, a byte at a time.
        """
        stretches = [(i, t[a:a + STRETCH]) for i, t in enumerate(texts) for a in range(0, len(t), STRETCH)]
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if not stretches or not len(self.languages):
            return counts
        stretches.sort(key=lambda s: -len(s[1]))
        owner = np.array([i for i, _ in stretches])
        length = np.array([len(s) for _, s in stretches])
        rows = np.zeros((len(stretches), int(length[0])), np.uint8)
        flat = np.frombuffer(b"".join(s for _, s in stretches), np.uint8)
        rows[np.arange(rows.shape[1])[None, :] < length[:, None]] = flat
        columns = self.symbol[rows.T]
        live = np.searchsorted(-length, -np.arange(rows.shape[1]), side="left")  # stretches longer than k
        width = np.int32(self.width)
        for j, root in enumerate(self.roots.tolist()):
            state = np.full(len(stretches), root, np.int32)
            ended = np.zeros(len(stretches), np.int32)
            for k in range(rows.shape[1]):
                n = live[k]
                target = self.moves[state[:n] * width + columns[k, :n]]
                new = target < 0
                ended[:n] += new
                state[:n] = np.where(new, -1 - target, target)
            counts[:, j] = np.bincount(owner, ended + 1, len(texts)).astype(np.int64)
        return counts


def _table(samples: Samples) -> PhraseTable:
    tables, key = kept("phrase tables"), samples.mark()
    if key not in tables:
        tables.clear()
        tables[key] = PhraseTable(samples)
    return tables[key]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def judged(texts: list[str | None], samples: Samples) -> tuple[list[str], list[float], list[float]]:
    """(language, score, bytes per phrase) of texts.

    The language with the fewest phrases wins; equal counts go to the smaller
    name. The score is the winner's lead: 1 - fewest / second fewest, 1 with
    a single language. Texts that are null or hold no letter are ``und`` at 0.
    """
    table = _table(samples)
    known = [_has_letter(t) for t in texts]
    raws = [letters_of(t) if k else b"" for t, k in zip(texts, known)]
    # texts of some million bytes advance at a time, so that memory is bounded
    counts, at = np.zeros((len(texts), len(table.languages)), np.int64), 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= 4_000_000):
            size += len(raws[end])
            end += 1
        counts[at:end] = table.phrases(raws[at:end])
        at = end
    order = sorted(range(len(table.languages)), key=lambda j: table.languages[j])
    langs, scores, lengths = [], [], []
    for i, raw in enumerate(raws):
        if not known[i] or not order:
            langs.append("und")
            scores.append(0.0)
            lengths.append(0.0)
            continue
        best = min(order, key=lambda j: counts[i, j])
        second = min((int(counts[i, j]) for j in order if j != best), default=0)
        langs.append(table.languages[best])
        scores.append(1.0 - int(counts[i, best]) / second if second else 1.0)
        lengths.append(len(raw) / max(1, int(counts[i, best])))
    return langs, scores, lengths


def predicted(docs: DataFrame, samples: Samples, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language, score and mean phrase length of every whole text; rows that repeat repeat."""
    workers_import(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def predict(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            langs, scores, lengths = judged(batch.column(2).to_pylist(), samples)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "phrase_bytes"])

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, phrase_bytes double")


def in_known_language(docs: DataFrame, samples: Samples, text: str = "text", least_phrase: float = 2.0, least_letters: int = 20) -> DataFrame:
    """The documents in one of the learned languages, columns as they came.

    Rejected are texts without a letter (null and empty ones too) and texts
    that even the best language takes apart into phrases of fewer than
    ``least_phrase`` bytes on average, as random characters or another script.
    Texts of fewer than ``least_letters`` letters say too little for that and
    stay: a text of one letter has one phrase of one byte in any language.
    Repeated rows and null ids are rows like others; an empty table stays empty.
    """
    workers_import(docs.sparkSession)
    at = docs.columns.index(text)

    def keep(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, _, lengths = judged(texts, samples)
            yield batch.filter(pa.array([
                lang != "und" and (n >= least_phrase or sum(c.isalpha() for c in t) < least_letters) for t, lang, n in zip(texts, langs, lengths)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
