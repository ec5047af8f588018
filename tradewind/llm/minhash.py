"""MinHash near-duplicates: banded universal minima, signature and set verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import BATCH_BYTES, components, kept, partitions, space_words, stored, workers_import

BANDS, ROWS = 32, 4  # a pair at a similarity of 0.75 meets in no band with probability (1 - 0.75^4)^32 = 5e-6
SHINGLE = 5
PAIRED = "a long, b long"
#: Nodes whose ids may be broadcast to find their texts; beyond, the texts are joined by a shuffle.
BROADCAST_NODES = 500_000
BLOCK = 128
#: Shingles of a block of a bucket on average (2 MB of hashes).
BLOCK_SHINGLES = 262_144

_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_draw = np.random.default_rng(20240229)
_A = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, made once; at most ``most`` words stay in memory."""

    def __init__(self, most: int = 100_000):
        import xxhash

        super().__init__()
        self.digest, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.digest(word)
        return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    held = kept("word hashes")
    if not held:
        held["all"] = WordHashes()
    return np.fromiter(map(held["all"].__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; of fewer words, the one of them all."""
    h = word_hashes(space_words(text))
    n = len(h)
    if n == 0:
        return h
    width = min(SHINGLE, n)
    acc = h[:n - width + 1].copy()
    for j in range(1, width):
        acc = acc * _P + h[j:n - width + 1 + j]
    if n < SHINGLE:
        acc += np.uint64(n)
    return np.unique(mixed(acc))


def signature(values: np.ndarray) -> np.ndarray:
    """High halves of the minima of the universal hashes a * x + b (mod 2^64)."""
    least = np.full(len(_A), 2**64 - 1, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(least, (_A[:, None] * values[None, at:at + 512] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, digest, sig) per row of (doc_id, text, text_hash)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            n, digests, sigs = [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py())
                n.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sigs.append(signature(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "text_hash", "n", "digest", "sig"])

    return docs.mapInArrow(sketch, f"doc_id {kind}, text_hash long, n long, digest binary, sig binary")


def _full_sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(center, part, role, digest, values) for (node, center, part, role): the full set of every wanted node, made from its text."""
    side = stored(
        wanted.join(nodes.select("node", F.col("doc_id").alias("own"), "text_hash", "digest"), "node").select("text_hash", "own", "digest", "center", "part", "role"), "wanted")
    # a list below a stated size goes to the texts, else both meet by a shuffle
    if side.count() <= BROADCAST_NODES:
        side = F.broadcast(side)
    found = texts.join(side, "text_hash").filter(F.col("doc_id").eqNullSafe(F.col("own"))).select("text", "digest", "center", "part", "role")

    def packed(out):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["center", "part", "role", "digest", "values"])

    def sets(batches: Iterator):
        for batch in batches:
            out, held = [], 0
            for text, digest, center, part, role in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                raw = shingle_set(text.as_py()).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == digest:
                    out.append((center, part, role, digest, raw))
                    held += len(raw)
                if held >= BATCH_BYTES:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

    return found.mapInArrow(sets, "center long, part long, role int, digest binary, values binary")


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Sets are made from the texts of the nodes in the pairs. A set goes to the
    task of each node ``a`` it is compared with; there the pairs of one a
    follow its own set. An a with many partners is dealt to several tasks.
    """
    spark = pairs.sparkSession
    pairs = stored(pairs, "pairs")
    fan = pairs.groupBy("a").agg(F.count("*").alias("n"))
    tasks = stored(
        pairs.join(fan, "a").select(
            F.col("b").alias("node"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).alias("part"), F.lit(1).alias("role"))
        .union(fan.select(F.col("a").alias("node"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)), F.lit(0))),
        "comparisons")

    def compare(batches: Iterator):
        import pyarrow as pa

        now, base = None, None
        for batch in batches:
            a, b = [], []
            for center, part, role, digest, raw in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(raw, np.uint64)
                if role == 0:
                    now, base = (center, part), values
                elif now == (center, part):
                    at = np.searchsorted(base, values)
                    at[at == len(base)] = 0
                    shared = int(np.count_nonzero(base[at] == values))
                    if den * shared >= num * (len(base) + len(values) - shared):
                        a.append(center)
                        b.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["a", "digest"])

    linked = (
        _full_sets(tasks, nodes, texts)
        .repartition(partitions(spark), "center", "part").sortWithinPartitions("center", "part", "role").mapInArrow(compare, "a long, digest binary"))
    return stored(linked.join(nodes.select(F.col("node").alias("b"), "digest"), "digest").select("a", "b").distinct(), "links")


def spanning_links(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Places (i, j) of linked sets, i in ``left`` and j in ``right``, of which each joins two components not joined so far.

    Every pair of sets in different components is compared exactly; a pair
    whose components an earlier link joined is not, as it adds nothing.
    """
    label = np.unique(roots, return_inverse=True)[1]
    size = np.array([len(v) for v in sets])
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    columns = np.split(columns, np.cumsum(size)[:-1])
    mark = np.zeros(int(max(c.max() for c in columns)) + 1, np.int32)
    all_right = np.concatenate([columns[j] for j in right])
    links = []
    for i in left:
        near = (label[right] != label[i]) & (den * np.minimum(size[right], size[i]) >= num * np.maximum(size[right], size[i]))
        some = right[near]
        if not len(some):
            continue
        # few candidates: their columns alone; else those of the whole side, laid out once
        those, gathered = (some, np.concatenate([columns[j] for j in some])) if 4 * len(some) < len(right) else (right, all_right)
        mark[columns[i]] = 1
        shared = np.add.reduceat(mark[gathered], np.concatenate(([0], np.cumsum(size[those])[:-1])))
        mark[columns[i]] = 0
        for j in those[den * shared >= num * (size[i] + size[those] - shared)]:
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _joining(members: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links (a, b) between different components that share a bucket; None if no bucket holds two components.

    Members of such a bucket are dealt to blocks of BLOCK_SHINGLES shingles on
    average; a task holds two blocks and compares their full sets. A set goes
    to each block of its buckets once, and a task gives at most one row per
    set it holds. Buckets with the same members are compared once.
    """
    spark = members.sparkSession
    rooted = members.drop("size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    unresolved = stored(
        rooted.groupBy("key").agg(
            F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("size"), F.sum("n").alias("shingles"),
            F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
        .filter("r < s").dropDuplicates(["size", "shingles", "h1", "h2"])
        .select("key", F.least("size", F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")), "unresolved")
    if unresolved.isEmpty():
        return None
    dealt = stored(
        rooted.join(unresolved, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root"), "blocks")
    wanted = dealt.select("node").distinct().select("node", F.col("node").alias("center"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("role"))
    full = _full_sets(wanted, nodes, texts).select(F.col("center").alias("node"), "values").dropDuplicates(["node"])

    def compare(batches: Iterator):
        import pyarrow as pa

        group, held = None, []

        def links():
            own, node, root = (np.array(c) for c in list(zip(*held))[:3])
            if group is None or len(held) < 2 or (root == root[0]).all():
                return
            left, right = np.flatnonzero(own == group[1]), np.flatnonzero(own == group[2])
            if len(left) and len(right):
                pairs = spanning_links([np.frombuffer(h[3], np.uint64) for h in held], root, left, right, num, den)
                if pairs:
                    a, b = node[[i for i, _ in pairs]], node[[j for _, j in pairs]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for key, x, y, own, node, root, values in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, x, y) != group:
                    if held:
                        yield from links()
                    group, held = (key, x, y), []
                held.append((own, node, root, values))
        if held:
            yield from links()

    found = (
        dealt.join(full, "node").select("key", "x", "y", "own", "node", "root", "values")
        .repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(compare, PAIRED))
    return stored(found.distinct(), "joining")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """Every row's set size, the smallest id of its component and whether it is kept.

    Documents link if den * shared >= num * union on their shingle sets. Rows
    with equal sets form one node. Null texts and texts without words have an
    empty set, link with nothing and are kept; a null id takes part through
    its text, its component is named by the ids that are there, and without
    any it is null and the row is kept.

    Bands propose pairs: first every node with the center of a bucket that it
    meets most often, then, in buckets that still hold two components, all
    pairs between different components, block by block. Both are decided on
    full sets (64-bit shingle hashes).
    """
    rows, classes, roots = _grouped(docs, doc_id, text, num, den)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    answer = stored(named.select("digest", "root").join(lowest, "root").select("digest", "component_id"), "answers")
    full = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    # rows without words get keys of their own, else they would meet in one task
    key = F.coalesce(F.hex("digest"), F.concat(F.lit("none:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (
        full.withColumn("digest", key).join(answer.withColumn("digest", F.hex("digest")), "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """The documents of which one per component stays, columns as they came.

    The row with the smallest id stays (a null id only if all are null); of
    rows with equal ids in a component one stays. Rows without words all stay.
    """
    rows, classes, roots = _grouped(docs, doc_id, text, num, den)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # of every component the least row with an id, else the least without
    rank = F.struct(F.col("lowest").isNull().alias("none"), F.col("lowest").alias("id"), F.col("first_hash").alias("text_hash"))
    stays = stored(named.groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.id").alias("__id"), F.col("r.text_hash").alias("__hash")), "stays")
    same = rows.filter("n > 0").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n")).filter("n > 1")
    same = stored(same.join(stays, (same["__hash"] == stays["__hash"]) & same["__id"].eqNullSafe(stays["__id"]), "left_semi").drop("n"), "same-rows")
    has_word = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = docs.filter(has_word).withColumn("__hash", F.xxhash64(F.col(text)))

    def picked(these: DataFrame, how: str) -> DataFrame:
        # a list below a stated size goes to the documents, else both meet by a shuffle
        keys = these.toDF("__id", "__hash2")
        keys = F.broadcast(keys) if these.count() <= BROADCAST_NODES else keys
        return full.join(keys, (F.col("__hash") == F.col("__hash2")) & F.col(doc_id).eqNullSafe(F.col("__id")), how)

    repeated = same.count() > 0
    single = stays.join(same, (same["__hash"] == stays["__hash"]) & same["__id"].eqNullSafe(stays["__id"]), "left_anti") if repeated else stays
    out = picked(single, "left_semi").select(docs.columns).unionByName(docs.filter(~has_word))
    if repeated:  # rows that repeat as a whole: one of each
        out = out.unionByName(picked(same, "left_semi").dropDuplicates([doc_id, "__hash"]).select(docs.columns))
    return out


def _grouped(docs: DataFrame, doc_id: str, text: str, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch of every row, classes of equal sets, root of every class that links with another)."""
    spark = docs.sparkSession
    workers_import(spark)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    rows = stored(_sketched(ids), "sketches")
    classes = stored(
        rows.filter("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("chosen"), F.min("doc_id").alias("lowest"),
            F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("first_hash"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = stored(
        rows.join(classes, "digest").filter(F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash")))
        .select("node", "doc_id", "text_hash", "digest", "n", "sig").dropDuplicates(["node"]), "nodes")
    band = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * band + 1, band)) for k in range(BANDS)])
    members = nodes.select("node", "n", F.explode(keys).alias("key"))
    buckets = stored(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = stored(members.join(buckets, "key"), "members")
    # a bucket's center is the member that meets the most others in all its buckets: an original rather than one of its copies
    meets = stored(members.groupBy("node").agg(F.sum("size").alias("meets")), "meets")
    central = stored(
        members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("c")).select("key", F.col("c.meets").alias("most"), F.col("c.node").alias("a")), "centers")
    met = (
        members.join(central, "key").filter("node != a").groupBy("a", F.col("node").alias("b"), "most").agg(F.count("*").alias("times")))
    sized = nodes.select("node", "n")
    best = met.groupBy("b").agg(F.max(F.struct("times", "most", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    first = (
        best.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b")
        .filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb")).select("a", "b"))
    links = _confirmed(first, nodes, ids, num, den)
    roots = components(links, "a", "b")

    more = _joining(members, roots, nodes, ids, num, den)
    if more is not None and not more.isEmpty():
        roots = components(links.union(more), "a", "b")

    return rows, classes, roots
