"""Language-model scores: word unigrams as base, and the marginal probability over all subword segmentations."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import space_words, stored, workers_import

SPACE = "▁"
#: Words kept at hand in every task; all others are looked up by a join.
HEAD_WORDS = 100_000
_lattices: dict[str, "Lattice"] = {}


class Lattice:
    """Pieces of an existing vocabulary; every text is a sequence of pieces and one end.

    Words start with a space mark. A character that is no piece of its own is
    also covered by the vocabulary's byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end = size
        self.ids: dict[str, int] = {}  # -1: the start of a piece, no piece itself
        self.bytes = [-1] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in piece[1:]:
                self.ids[piece] = i
        for piece in list(self.ids):
            for k in range(1, len(piece)):
                self.ids.setdefault(piece[:k], -1)
        self.possible = np.zeros(size + 1, bool)
        self.possible[[i for i in (*self.ids.values(), *self.bytes) if i >= 0]] = True

    def spelled(self, char: str, logs: list[float]) -> float:
        return sum(logs[self.bytes[b]] for b in char.encode("utf-8", "surrogatepass"))


def lattice_of(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def forward(lattice: Lattice, word: str, logs: list[float], edges: list | None = None) -> list[float]:
    """Log of the sum over all segmentations of every prefix of the word, left to right.

    ``edges`` gets (from, to, piece or -1 for bytes, log weight) in order.
    """
    n, find, exp, log1p, never = len(word), lattice.ids.get, math.exp, math.log1p, -math.inf
    alpha = [never] * (n + 1)
    alpha[0] = 0.0
    for i in range(n):
        a = alpha[i]
        for j in range(i + 1, n + 1):
            piece = find(word[i:j], -2)
            if piece >= 0:
                w = logs[piece]
            elif j == i + 1:
                w = lattice.spelled(word[i], logs)
            elif piece == -1:
                continue
            else:
                break
            if edges is not None:
                edges.append((i, j, piece if piece >= 0 else -1, w))
            v, b = a + w, alpha[j]
            alpha[j] = v if b == never else v + log1p(exp(b - v)) if b < v else b + log1p(exp(v - b))
            if piece == -2:
                break
    return alpha


def expected(lattice: Lattice, word: str, logs: list[float], times: float, total: list[float]) -> None:
    """Add the expected uses of every piece over all segmentations of the word."""
    edges: list[tuple[int, int, int, float]] = []
    alpha = forward(lattice, word, logs, edges)
    exp, log1p, never = math.exp, math.log1p, -math.inf
    beta = [never] * len(alpha)
    beta[-1] = 0.0
    whole = alpha[-1]
    for i, j, piece, w in reversed(edges):
        v, b = w + beta[j], beta[i]
        beta[i] = v if b == never else v + log1p(exp(b - v)) if b < v else b + log1p(exp(v - b))
        share = times * exp(alpha[i] + v - whole)
        if piece >= 0:
            total[piece] += share
        else:
            for c in word[i].encode("utf-8", "surrogatepass"):
                total[lattice.bytes[c]] += share


def held_out(doc_id, parts: int = 10):
    """Whether crc32 of the id as text is a multiple of ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == 0


def word_counts(docs: DataFrame, doc_id: str, text: str, most: int = 400_000) -> DataFrame:
    """(word, train) of every distinct word: its places in documents to learn from. Tasks count before they shuffle."""

    def count(batches: Iterator):
        import pyarrow as pa

        train, other = Counter(), set()

        def out():
            other.difference_update(train)
            for words, n in ((list(train), list(train.values())), (list(other), [0] * len(other))):
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "train"])

        for batch in batches:
            for value, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = space_words(value)
                (other if held else train).update(words)
                if len(train) + len(other) > most:
                    yield from out()
                    train, other = Counter(), set()
        yield from out()

    pairs = docs.select(F.col(text).alias("text"), held_out(doc_id).alias("held")).mapInArrow(count, "word binary, train long")
    return pairs.groupBy("word").agg(F.sum("train").alias("train"))


def fitted(words: DataFrame, path: str, n_docs: int, rounds: int = 1, prior: float = 0.01) -> list[float]:
    """Log weights of all pieces and the end, learned from all training words.

    The vocabulary's own scores are the ranks of its merges. They order the
    merges that segment each word, and the uses of every piece in these
    segmentations are the first weights; ``rounds`` of expectation-maximisation
    over all segmentations follow. Each is one pass over the distinct words;
    tasks send uses per piece, so what is gathered is bounded by the
    vocabulary. ``prior`` uses are added to every piece: none is impossible.
    """
    lattice = lattice_of(path)

    def uses_of(logs: list[float] | None):
        def count(batches: Iterator):
            import pyarrow as pa

            own = lattice_of(path)
            total = [0.0] * (own.end + 1)
            for batch in batches:
                texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
                if logs is None:
                    for pieces, times in zip(own.model.encode(texts), batch.column(1).to_pylist()):
                        for piece in pieces:
                            total[piece] += times
                else:
                    for text, times in zip(texts, batch.column(1).to_pylist()):
                        expected(own, SPACE + text, logs, times, total)
            uses = np.array(total)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(uses[used])], ["piece", "uses"])

        return count

    train, logs = words.filter("train > 0").select("word", "train"), None
    for _ in range(rounds + 1):
        uses = np.zeros(lattice.end + 1)
        for row in train.mapInArrow(uses_of(logs), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[row["piece"]] = row["uses"]
        uses = np.where(lattice.possible, uses + prior, 0.0)
        uses[lattice.end] = n_docs + prior
        logs = np.log(np.maximum(uses / uses.sum(), 1e-300)).tolist()
    return logs


def scored(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """Base and lattice score of every document, log10.

    Words are runs without white space, A-Z lower-cased; each text ends with an
    end token. A null text is empty: its end alone. The lattice score sums over
    all segmentations of every word into pieces; a text's probability is the
    product over its words and the end. Rows with equal id and text are scored
    once and come out as often as they came in.

    The probability of each distinct word is computed once. The HEAD_WORDS most
    frequent words travel to the tasks, the others (none of them frequent) are
    joined per document.
    """
    spark = docs.sparkSession
    workers_import(spark)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    words = stored(word_counts(slim, "doc_id", "text"), "words")
    n_train = slim.filter(~held_out("doc_id")).count()
    known = words.filter("train > 0").agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = known["n"] + n_train, known["v"] + (1 if n_train else 0)
    logs = fitted(words, vocabulary, n_train, rounds)
    floor = math.log10(total + 0.1 * (distinct + 1))
    end_base = math.log10(n_train + 0.1) - floor
    lattice_end = logs[-1] / math.log(10)

    def marginal(batches: Iterator):
        import pyarrow as pa

        lattice = lattice_of(vocabulary)
        for batch in batches:
            found = [
                forward(lattice, SPACE + w.decode("utf-8", "replace"), logs)[-1] / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["word", "train", "log_p"])

    table = stored(words.mapInArrow(marginal, "word binary, train long, log_p double"), "word-scores")
    head = {
        bytes(r["word"]): (r["train"], r["log_p"])
        for r in table.orderBy(F.desc("train"), "word").limit(HEAD_WORDS).toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)

    def split(batches: Iterator):
        """A row per document with what the head words give, and a row per other distinct word of it."""
        import pyarrow as pa

        at_hand, cache = shared.value, {}
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)))
            out: list[tuple] = []
            for doc, key, value in keys:
                found = space_words(value)
                n_known = 1 if n_train else 0
                base = score = 0.0
                rest = []
                for word, times in Counter(found).items():
                    have = at_hand.get(word)
                    if have is None:
                        rest.append((doc, key, None, None, times, None, None, word))
                    else:
                        c, p = have
                        n_known += times * (c > 0)
                        base += times * (math.log10(c + 0.1) - floor)
                        score += times * p
                out.append((doc, key, len(found) + 1, n_known, 1, base + end_base, score + lattice_end, None))
                out += rest
                if len(out) > 50_000:
                    yield packed(out, batch)
                    out = []
            if out:
                yield packed(out, batch)

    def packed(out, batch):
        import pyarrow as pa

        types = (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "key", "n_tokens", "n_known", "times", "base", "score", "word"])

    parts = slim.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(
        split, f"doc_id {kind}, key long, n_tokens long, n_known long, times long, base double, score double, word binary")
    # rows of documents join with nothing; they get keys of their own, else they would meet in one task
    tail = parts.select(
        "*", F.coalesce(F.xxhash64("word"), F.xxhash64("key", F.lit("document"))).alias("place")).join(
        table.select(F.col("word").alias("w"), "train", "log_p", F.xxhash64("word").alias("place")), "place", "left").filter(
        F.col("word").isNull() | (F.col("word") == F.col("w")))
    one = F.col("word").isNotNull()
    scores = tail.groupBy("doc_id", "key").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(~one, 1)).alias("copies"),
        F.sum(F.when(one, F.when(F.col("train") > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(one, F.col("times") * (F.log10(F.col("train") + 0.1) - floor)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(one, F.col("times") * F.col("log_p")).otherwise(F.col("score"))).alias("score"))
    n = F.col("copies")
    return scores.select(
        "doc_id", held_out("doc_id").alias("held_out"), (F.col("n_tokens") / n).cast("long").alias("n_tokens"), (F.col("n_known") / n).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / n).alias("base_score"), (F.col("score") / n).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy")).drop("copy")
