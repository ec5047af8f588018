"""License scans: an exact containment join of text blocks with license templates, beside phrase search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import alnum_words, workers_import

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Sentences of common licenses and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)

#: Bound of the templates' words, which travel to every task.
MOST_TEMPLATE_WORDS = 1_000_000


class TemplateJoin:
    """Templates as token sets in one global order, rarest first, with an index over their prefixes.

    A block contains a template to the share if it has ``need`` of its tokens,
    need = ceil(share * size), or all of them if the template has fewer than
    ``whole_below``: a share of a short one may lack the very word that tells it
    from another license. It then holds one of the template's
    size - need + 1 rarest tokens (prefix filter), has ``need`` known tokens
    (length filter), and what follows a first common token on either side must
    still allow ``need`` in all (positional filter).
    """

    def __init__(self, templates, order: dict[bytes, int], share: float, whole_below: int = 10):
        self.sets, self.need, self.labels = [], [], []
        self.order = order
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, (text, label) in enumerate(templates):
            tokens = sorted(set(alnum_words(text)), key=order.__getitem__)
            need = len(tokens) if len(tokens) < whole_below else max(1, math.ceil(share * len(tokens) - 1e-9))
            self.sets.append(frozenset(tokens))
            self.need.append(need)
            self.labels.append(label)
            for p, token in enumerate(tokens[:len(tokens) - need + 1]):
                self.prefix.setdefault(token, []).append((t, p))

    def matches(self, block: list[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of every template the block contains to the share."""
        tokens = sorted({w for w in block if w in self.order}, key=self.order.__getitem__)
        seen: set[int] = set()
        for q, token in enumerate(tokens):
            for t, p in self.prefix.get(token, ()):
                if t in seen or len(tokens) < self.need[t]:
                    continue
                if 1 + min(len(self.sets[t]) - p - 1, len(tokens) - q - 1) < self.need[t]:
                    continue
                seen.add(t)
                shared = len(self.sets[t].intersection(tokens))
                if shared >= self.need[t]:
                    yield t, shared / len(self.sets[t])


def token_order(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Rank of every template token by the number of documents that hold it, rarest first, ties by the token.

    All documents are counted; a task sends a count per template token, so what
    is gathered is bounded by the templates.
    """

    def count(batches: Iterator):
        import pyarrow as pa

        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(alnum_words(value)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["token"]): r["n"] for r in rows}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, share: float = 0.8,
                 whole_below: int = 10) -> DataFrame:
    """Phrase places and license labels of every whole text.

    Blocks are runs of twice the longest template's words, one starting at
    every half of that, so each run as long as a template lies in a block.
    ``matches`` lists (first word of the block, label, containment) of every
    block and template that meet. The score is 1 with a phrase, else the best
    containment, else 0. Templates of fewer than ``whole_below`` tokens must be
    contained whole. Ties do not arise: all templates that meet are listed, and
    columns other than id and text are not read. Null and empty texts have no words, no places and no
    labels (empty strings); rows that repeat repeat.
    """
    spark = docs.sparkSession
    workers_import(spark)
    sized = [alnum_words(t) for t, _ in templates]
    if sum(map(len, sized)) > MOST_TEMPLATE_WORDS:
        raise ValueError("the templates are meant to be a bounded list")
    half = max(map(len, sized), default=1)
    order = token_order(docs, text, {w for words in sized for w in words})
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator):
        import pyarrow as pa

        join = TemplateJoin(templates, order, share, whole_below)
        starts: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases:
            words = alnum_words(phrase)
            starts.setdefault(words[0], []).append((words, label))
        telling = set(join.prefix) | set(starts)
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(value)
                places, base, blocks = [], set(), set()
                present = telling.intersection(words)
                if present:
                    for i, word in enumerate(words):
                        if word in present:
                            for phrase, label in starts.get(word, ()):
                                if words[i:i + len(phrase)] == phrase:
                                    places.append(i)
                                    base.add(label)
                            if word in join.prefix:
                                blocks.update((max(0, i // half - 1), i // half))
                found = [
                    (b * half, join.labels[t], held) for b in sorted(blocks) for t, held in join.matches(words[b * half:(b + 2) * half])]
                labels = base.union(label for _, label, _ in found)
                score = 1.0 if base else max((held for _, _, held in found), default=0.0)
                out.append((
                    key, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                    score, [{"start": a, "label": label, "containment": held} for a, label, held in found]))
            if out:
                match = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
                types = (batch.column(0).type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), match)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<start: long, label: string, containment: double>>")
