"""Operators on documents against plain versions, over nulls, empty, long and repeated rows and clashing columns."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from tradewind.llm import decontaminate, language, licenses, lm, minhash, packing, substring  # noqa: E402
from tradewind.llm.automaton import SuffixAutomaton  # noqa: E402
from tradewind.llm.queries import piece_vocabulary, word_tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def test_automaton_holds_exactly_the_substrings():
    machine = SuffixAutomaton()
    texts = ["abcbc", "bcbca", "aaab", "abcbc"]
    for t in texts:
        machine.add(t)
    inside = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    read = "abcbcaaabzbcbcbcaab"
    state = matched = 0
    for i, c in enumerate(read):
        state, matched = machine.step(state, matched, c)
        assert matched == max((k for k in range(i + 2) if read[i + 1 - k:i + 1] in inside), default=0)


@pytest.mark.parametrize("shard_words", [200_000, 130])
def test_contamination(spark, docs, monkeypatch, shard_words):
    items = spark.createDataFrame(cases.items(), "item_id long, text string")
    plain = decontaminate.sharded_items
    monkeypatch.setattr(decontaminate, "sharded_items", lambda i, a, b, w: plain(i, a, b, w, shard_words))
    windows = defaultdict(set)
    for item, text in cases.items():
        w = cases.alnum(text)
        for k in range(max(0, len(w) - 12) or bool(w)):
            windows[tuple(w[k:k + 13])].add(str(item))
    want = []
    for row in cases.documents():
        w, hit, found = cases.alnum(row[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        ids = sorted(found)
        want.append((row[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(docs, items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert cases.answers(got, *columns) == sorted(want, key=repr)
    assert sum(w[5] for w in want) >= 2 and any(w[2] and not w[5] for w in want)


def test_decontaminated_texts(spark, docs, none):
    items = spark.createDataFrame(cases.items(), "item_id long, text string")
    left = decontaminate.decontaminated(docs, items)
    assert left.schema == docs.schema
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in left.collect()}
    assert 312 not in after and 313 in after
    assert len(cases.alnum(after[313])) == len(cases.alnum(before[313])) - 25
    assert after[1] == before[1] and after[300] is None and after[301] == ""
    assert decontaminate.decontaminated(none, items).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()


def test_near_duplicates(docs, none):
    rows = cases.documents()
    sets = []
    for row in rows:
        w = cases.spaced(row[1])
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = defaultdict(list)
    for i, row in enumerate(rows):
        lowest[find(i)] += [row[0]] * (row[0] is not None)
    want = []
    for i, row in enumerate(rows):
        component = min(lowest[find(i)], default=None) if sets[i] else row[0]
        want.append((row[0], len(sets[i]), component, component is None or row[0] == component))
    assert cases.answers(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    kept = minhash.deduplicated(docs)
    assert kept.schema == docs.schema
    wordless = sum(not s for s in sets)
    assert kept.count() == wordless + len({find(i) for i in range(len(rows)) if sets[i]})
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_a_shard_is_built_once_for_many_documents(spark, monkeypatch):
    import pyarrow as pa

    items = spark.createDataFrame([(i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(60)], "item_id long, text string")
    folder, shards = decontaminate.sharded_items(items, shard_words=200)
    assert shards > decontaminate.HELD
    built, plain = [], decontaminate.Matcher
    monkeypatch.setattr(decontaminate, "Matcher", lambda *a: built.append(1) or plain(*a))
    texts = [None, "", *(" ".join(f"v{i}x{k}" for k in range(5, 25)) for i in range(60))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    groups = list(decontaminate._gathered(iter([batch.slice(a, 7) for a in range(0, len(texts), 7)]), shards))
    assert len(groups) == 1
    rows = [r for part in decontaminate._found([b.column(0) for b in groups[0]], folder, shards, 13) for r in part]
    assert len(built) <= shards
    assert rows == [(0, [], []), (0, [], [])] + [(20, [(0, 20)], [str(i)]) for i in range(60)]


def test_spanning_links_join_what_all_pairs_join():
    draw = np.random.default_rng(7)
    for _ in range(30):
        base = draw.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.where(draw.random(60) < 0.12, draw.integers(0, 2**63, 60, dtype=np.uint64), base)) for _ in range(25)]
        sets.append(base[:3])
        roots = draw.integers(0, 12, len(sets))
        sides = draw.random(len(sets)) < 0.5
        for left, right in ((np.flatnonzero(sides), np.flatnonzero(~sides)), (np.arange(len(sets)),) * 2):
            def joined(pairs):
                label = roots.copy()
                for i, j in pairs:
                    label[label == label[i]] = label[j]
                return len(set(label.tolist()))

            linked = [(i, j) for i in left for j in right if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))]
            got = minhash.spanning_links(sets, roots, left, right, 75, 100)
            assert set(got) <= set(linked) and joined(got) == joined(linked)
            assert len(got) == len(set(roots.tolist())) - joined(linked)


@pytest.mark.parametrize("block", [262_144, 300])
def test_unresolved_buckets_are_compared(spark, monkeypatch, block):
    """Three texts in a row: the outer ones link only through the middle one, whatever the buckets' first nodes are."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[k:k + 200]) for k in range(0, 200, 12)]
    rows = [(i, t, "en", "s", 0, None, None, None) for i, t in enumerate(chain)]
    got = minhash.near_duplicates(cases.frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_substrings(docs, none):
    places = Counter()
    texts = [cases.spaced(r[1], False) for r in cases.documents()]
    for w in texts:
        places.update(tuple(w[k:k + 35]) for k in range(len(w) - 34))
    want = []
    for row, w in zip(cases.documents(), texts):
        gone = {p for k in range(len(w) - 34) if places[tuple(w[k:k + 35])] > 1 for p in range(k, k + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((row[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert cases.answers(substring.substring_report(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    cut = substring.without_repeats(docs)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    assert sorted((hashlib.sha256(" ".join(cases.spaced(r.text, False)).encode()).hexdigest() for r in cut.collect())) == sorted(w[3] for w in want)
    assert substring.substring_report(none).count() == 0


def test_language(spark, docs, none):
    samples = language.learned(docs)
    assert samples.languages == ("de", "en")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language.predicted(docs, samples).collect()}
    truth = {r[0]: r[2] for r in cases.documents() if r[0] is not None and r[0] < 60}
    assert all((i, lang) in {(g[0], g[1]) for g in got} for i, lang in truth.items())
    assert all(g[2] == (zlib.crc32(str(g[0]).encode()) % 4 == 2) for g in got if g[0] is not None)
    assert {g[1] for g in got if g[0] in (300, 301, 302, 305)} == {"und"}
    # learning never sees held-out rows or labels of others
    changed = docs.withColumn("lang", language.F.when(language.held_out("doc_id"), "xx").otherwise(language.F.col("lang")))
    assert language.learned(changed) == samples
    assert language.predicted(none, language.learned(none)).count() == 0
    assert {r.lang_pred for r in language.predicted(docs, language.learned(none)).collect()} == {"und"}
    kept = language.in_known_language(docs, samples)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.schema == docs.schema and {300, 301, 302, 305}.isdisjoint(ids) and {303, 306} <= ids
    odd = cases.frame(docs.sparkSession, [(i, t, "en", "s", 0, None, None, None) for i, t in enumerate(["A.", "Ok", "q7x9 zk3v8 w1j5 xq2z9 kv4w7 jz8q1 vx6k3 " * 5, None])])
    assert {r.doc_id for r in language.in_known_language(odd, samples).collect()} == {0, 1}


def test_phrases_are_greedy_longest_matches():
    samples = language.Samples(("a", "b"), ((b" abab cab ", b" bb "), (b" xyz ab ",)))
    table = language.PhraseTable(samples)
    for text in (b"abab", b"cabxyzab", b"q", b"", b"abqqab bb", b"zabcab " * 400):
        for j, texts in enumerate(samples.texts):
            n = 0
            for at in range(0, len(text), language.STRETCH):
                part = text[at:at + language.STRETCH]
                while part:
                    k = max([m for m in range(1, len(part) + 1) if any(part[:m] in t for t in texts)], default=1)
                    part, n = part[k:], n + 1
            assert table.phrases([text])[0, j] == n, (text, j)


def test_lm(docs, none):
    rows = cases.documents()
    train, held = Counter(), []
    n_end = 0
    for row in rows:
        if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 10:
            train.update(cases.spaced(row[1]))
            n_end += 1
    total, distinct = sum(train.values()) + n_end, len(train) + 1
    want = []
    for row in rows:
        w = cases.spaced(row[1])
        base = sum(math.log10((train[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w) + math.log10((n_end + 0.1) / (total + 0.1 * (distinct + 1)))
        want.append((row[0], len(w) + 1, sum(train[x] > 0 for x in w) + 1, total, round(base, 6)))
    lm_head = lm.HEAD_WORDS
    try:
        lm.HEAD_WORDS = 20  # most words then take the joined way
        few = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.scored(docs, piece_vocabulary()).collect()}
    finally:
        lm.HEAD_WORDS = lm_head
    got = lm.scored(docs, piece_vocabulary()).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert few == {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in got}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.scored(none, piece_vocabulary()).count() == 0


def test_forward_sums_all_segmentations():
    lattice = lm.lattice_of(piece_vocabulary())
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(lattice.end + 1))).tolist()

    def every(word):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, len(word) + 1):
            piece = lattice.ids.get(word[:k], -2)
            if piece >= 0:
                out += math.exp(logs[piece]) * every(word[k:])
            elif k == 1:
                out += math.exp(lattice.spelled(word[0], logs)) * every(word[1:])
        return out

    for word in ("▁the", "▁that", "▁x☃y", "▁été", "▁"):
        assert math.isclose(lm.forward(lattice, word, logs)[-1], math.log(every(word)), rel_tol=1e-9)
        total = [0.0] * (lattice.end + 1)
        lm.expected(lattice, word, logs, 2.0, total)
        assert sum(total) > 0 and max(total) <= 2.0 * len(word) + 1e-9


def test_licenses(docs, none):
    order = None
    got = {}
    for r in licenses.license_scan(docs).collect():
        got.setdefault(r.doc_id, r)
    vocabulary = {w for t, _ in licenses.TEMPLATES for w in cases.alnum(t)}
    half = max(len(cases.alnum(t)) for t, _ in licenses.TEMPLATES)
    for row in cases.documents():
        if row[0] in (None, 309):
            continue
        w, r = cases.alnum(row[1]), got[row[0]]
        places, base = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            places += found
            base |= {label} if found else set()
        labels = set(base)
        for a in range(0, max(1, len(w)), half):
            block = set(w[a:a + 2 * half]) & vocabulary
            for t, label in licenses.TEMPLATES:
                tokens = set(cases.alnum(t))
                if len(tokens & block) >= (len(tokens) if len(tokens) < 10 else math.ceil(0.8 * len(tokens) - 1e-9)):
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(labels)), row[0]
    assert got[311].labels.startswith("apache,") and order is None
    assert licenses.license_scan(none).count() == 0


def test_short_templates_need_their_telling_word(spark):
    """A GPL notice is no LGPL one, CC BY and CC BY-NC lines are no CC BY-SA ones, an Apache line is no MIT one."""
    texts = ["under the GNU General Public License v3", "under the GNU Lesser General Public License", "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0",
             "Licensed under CC BY-SA 4.0.", "Released under the Apache License", "Released under the MIT License"]
    docs = cases.frame(spark, [(i, t, "en", "s", 0, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()}
    assert got == {0: "gpl", 1: "lgpl", 2: "cc-by", 3: "cc-by,cc-by-nc", 4: "cc-by,cc-by-sa", 5: "apache", 6: "mit"}


def test_chunk_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer())
    ids = packing.ids_of(word_tokenizer())
    texts = [r[1] or "" for r in cases.documents()] + ["it's don't 'S <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> J̌ 12x3 ΑΣ, ,É, \x1c ½²"]
    for t in texts:
        chunks = t.encode().split()
        ids.learn(set(chunks))
        assert b"".join(ids[c] for c in chunks) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_those_of_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    plain, ids = Tokenizer.from_file(word_tokenizer()), packing.ChunkIds(word_tokenizer(), most=60)
    draw = random.Random(5)
    pieces = ["word", "Straße", "É", "ÉCOLE", "e\u0301", "\u0301", "İ", "İstanbul", "…", "“", "”", "—", "²", "½", "7", "2024", "don't", "'s", "<|", "|>", "<|endoftext|>", ".",
              ",", "...", "$$$", "-", "_", "\u00a0", "\u2028", "\x1c", "\x85", "\t", "\n", " ", " ", " ", "中文", "한국", "\u1112\u1161", "ß", "ﬁ", "🙂", "\x00", "ǅ", "ª", "x²y"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    for at in range(0, len(texts), 40):
        block = texts[at:at + 40]
        for t, raw in zip(block, ids.of([t.encode() for t in block])):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer())
    want = []
    for row in cases.documents():
        ids = [*plain.encode(row[1] or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a:a + 512]
            want.append((row[0], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.packed(docs, word_tokenizer(), capacity=512, bins=8).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    # best fit with a bounded number of bins may need 1.7 times the fewest, and a bin more for each one open at the end
    fewest = math.ceil(sum(w[3] for w in want) / 512)
    assert fewest <= len(sequences) <= 1.7 * fewest + 8
    assert packing.packed(none, word_tokenizer()).count() == 0


def plain_best_fit(lengths, capacity, most):
    """(closed, open) lists: each length goes into the fullest open list that takes it; the fullest closes for a new one."""
    held, closed = [], []
    for length in lengths:
        fits = [b for b in held if sum(b) + length <= capacity]
        if fits:
            max(fits, key=sum).append(length)
        else:
            if len(held) == most:
                fullest = max(held, key=sum)
                closed.append(fullest)
                held = [b for b in held if b is not fullest]
            held.append([length])
        closed += [b for b in held if sum(b) == capacity]
        held = [b for b in held if sum(b) < capacity]
    return closed, held


def test_one_task_packs_as_plain_best_fit(docs):
    """The same pieces in the same order; what lies in open lists at the end is packed again, longest first."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer())
    one = docs.coalesce(1)
    lengths = []
    for row in one.collect():
        n = len(plain.encode(row.text or "", add_special_tokens=False).ids) + 1
        lengths += [512] * (n // 512) + [n % 512] * (n % 512 > 0)
    closed, held = plain_best_fit(lengths, 512, 8)
    again, rest = plain_best_fit(sorted((x for b in held for x in b), reverse=True), 512, 8)
    sequences = defaultdict(int)
    for r in packing.packed(one, word_tokenizer(), capacity=512, bins=8).collect():
        sequences[r.sequence_id] += r.length
    assert sorted(sequences.values()) == sorted(map(sum, closed + again + rest))


def test_bins_close_the_fullest_first():
    bins = packing.Bins(10, 2)
    assert bins.add(4, "a") == [] and bins.add(7, "b") == []
    assert bins.add(3, "c") == [["b", "c"]]  # the fullest that fits, now full
    assert bins.add(9, "d") == []
    assert bins.add(8, "e") == [["d"]]
    assert bins.add(6, "f") == [["a", "f"]]
    assert list(bins.rest()) == [["e"]]
