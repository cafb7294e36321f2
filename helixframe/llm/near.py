"""N-gram Jaccard join: a MinHash LSH forest proposes pairs, exact set sizes decide them.

A signature is TREES labels of DEPTH minimum hashes. In each tree the labels
form a prefix trie; texts under one node at depth d share d minimum hashes.
The join begins with whole labels and shortens the prefix, one hash at a time,
until two texts at the threshold itself meet with the target's chance. A
shorter prefix is looked at only where it brings nodes together. What is found
on the way ends nothing: whether a pair is met depends on its two texts alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, holding, map_texts, release, shielded, slices, unshielded
from .hashing import Words, mix, shingles

WIDTH = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999
TREES, DEPTH = 16, 6
#: Members of a trie node that meet in one task are about twice this, and their shingles too; larger nodes are dealt out as pairs of chunks.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Rows of pairs compared at once, and bytes of bit sets in a task.
SLAB, BIT_BYTES = 32, 16 << 20

_random = np.random.default_rng(20_231)
_TIMES = _random.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each text, and a 64-bit hash of each set; words are compared in lower case."""
    value, row = shingles(Words(texts, lower=True), width)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    sets, keys = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        s = np.sort(value[a:b])
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        sets.append(s)
        keys[i] = np.uint64(mix(s + np.uint64(len(s))).sum(dtype=np.uint64)).astype(np.int64)
    return sets, keys


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES x DEPTH minimum hashes of each set, none of which is empty."""
    short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for j in range(TREES * DEPTH):
        out[:, j] = np.minimum.reduceat((short ^ _XOR[j]) * _TIMES[j], starts)
    return out


def recall_at(similarity: np.ndarray, depth: int) -> np.ndarray:
    """The chance that two texts of this similarity share a node at this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def depth_for(similarity: float, target_recall: float) -> int:
    """The longest prefix at which two texts of this very similarity meet with the target's chance; more similar ones meet more surely."""
    for depth in range(DEPTH, 0, -1):
        if recall_at(similarity, depth) >= target_recall:
            return depth
    raise ValueError(f"{TREES} trees do not reach recall {target_recall} at similarity {similarity}")


def _row_hash(row_id: Column, text: Column) -> Column:
    """Tells rows of one id, or of none, apart by their texts; equal for repeated rows."""
    return F.xxhash64(row_id, row_id.isNull(), text)


def _signed(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(_id, x, k, n, labels) of each row; x is its row hash, k its set's hash, and a text without words has n = 0."""

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets, keys = shingle_sets(rows.column("text"), width)
        n = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(n)
        labels = signatures([sets[i] for i in some.tolist()]).view(np.int32).ravel() if len(some) else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, TREES * DEPTH, 0)))).astype(np.int32)
        return pa.record_batch([rows.column(0), rows.column(1), pa.array(keys), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels))], ["_id", "x", "k", "n", "labels"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("_id"), _row_hash(F.col(id_column), F.col(text_column)).alias("x"), F.col(text_column).alias("text"))
    return map_texts(rows, ["_id", "x"], "text", make, f"_id {kind}, x long, k long, n long, labels array<int>")


def _nodes(rows: DataFrame, depth: int) -> DataFrame:
    """(k, n, labels, tree, key): the trie node of each text in each tree at this depth."""
    keys = F.array(*(F.xxhash64(F.slice("labels", t * DEPTH + 1, depth)) for t in range(TREES)))
    return rows.select("k", *(c for c in ("n", "labels") if c in rows.columns), F.posexplode(keys).alias("tree", "key"))


def _active(reps: DataFrame, depth: int) -> DataFrame:
    """The distinct k that share a node with another at this depth."""
    nodes = _nodes(reps, depth).select("k", "tree", "key")
    shared = nodes.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return nodes.join(shared, ["tree", "key"], "left_semi").select("k").distinct()


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys stand together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in names]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = batch.slice(a, b - a)
            if kept and any(kept[-1].column(n)[-1] != part.column(n)[0] for n in names):
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pa.Table.from_batches(kept)


def _prefixes(labels: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit value for each row's prefix in each tree."""
    cube, out = labels.reshape(len(labels), TREES, DEPTH).astype(np.uint64), np.zeros((len(labels), TREES), np.uint64)
    for d in range(depth):
        out = mix(out + cube[:, :, d] * np.uint64(2 * d + 1))
    return out


def _sizes_shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The size of the intersection of each pair of sets."""
    out = np.zeros(len(left), np.int64)
    if len(left) > 4 * len(sets):
        value, place = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(place) > 1
        keep = often[place]
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep], (np.cumsum(often) - 1)[place[keep]]
        words = -(-int(often.sum()) // 64)
        most = max(1, BIT_BYTES // 8 // len(sets))
        for low in range(0, words, most):  # as many values at once as the bit sets have room for
            n = min(most, words - low)
            own = (at >= low * 64) & (at < (low + n) * 64)
            bit = at[own] - low * 64
            bits = np.zeros((len(sets), n), np.uint64)
            np.bitwise_or.at(bits, (row[own], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            step = max(1, (BIT_BYTES >> 5) // n)
            for a in range(0, len(left), step):
                out[a : a + step] += np.bitwise_count(bits[left[a : a + step]] & bits[right[a : a + step]]).sum(1, dtype=np.int64)
        return out
    for x, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(b, a)
        out[x] = (b[np.minimum(at, len(b) - 1)] == a).sum()
    return out


def _linked(rows: pa.Table, depth: int, similarity: float) -> pa.RecordBatch | None:
    """Verifies the pairs of one node, or of two chunks of it.

    A pair that shares several nodes counts in the first tree only, and one
    that shares a longer prefix in any tree has been met before. Returns for
    each text with a link: k, the copies linked to it, and the first text that
    it is connected with here.
    """
    k = rows.column("k").to_numpy()
    _, once = np.unique(k, return_index=True)  # rows of one id may repeat
    if len(once) < len(k):
        rows = rows.take(pa.array(once))
        k = rows.column("k").to_numpy()
    tree, b1, b2 = (rows.column(c)[0].as_py() for c in ("tree", "b1", "b2"))
    chunk, copies = rows.column("chunk").to_numpy(), rows.column("copies").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    labels = rows.column("labels").combine_chunks()
    labels = labels.chunk(0) if isinstance(labels, pa.ChunkedArray) else labels
    labels = labels.flatten().to_numpy().view(np.uint32).reshape(len(k), TREES * DEPTH)
    prefix, longer = _prefixes(labels, depth), _prefixes(labels, depth + 1) if depth < DEPTH else None
    rows_1, rows_2 = np.flatnonzero(chunk == b1), np.flatnonzero(chunk == b2)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(rows_1), SLAB):
        i = rows_1[a : a + SLAB]
        fine = np.minimum(n[i][:, None], n[rows_2]) >= similarity * np.maximum(n[i][:, None], n[rows_2]) - 1e-9
        if b1 == b2:
            fine &= i[:, None] < rows_2
        for t in range(tree):
            fine &= prefix[i, t][:, None] != prefix[rows_2, t]
        if longer is not None:
            for t in range(TREES):
                fine &= longer[i, t][:, None] != longer[rows_2, t]
        x, y = np.nonzero(fine)
        if len(x):
            pairs.append((i[x], rows_2[y]))
    if not pairs:
        return None
    left, right = (np.concatenate(p) for p in zip(*pairs, strict=True))
    shared = _sizes_shared(sets, left, right)
    union = n[left] + n[right] - shared
    linked = shared >= similarity * union - 1e-9
    left, right = left[linked], right[linked]
    if not len(left):
        return None
    size = len(k)
    links = np.bincount(left, copies[right], size) + np.bincount(right, copies[left], size)
    root = np.arange(size)
    while True:
        old = root.copy()
        np.minimum.at(root, left, old[right])
        np.minimum.at(root, right, root[left])
        root = root[root]
        if (root == old).all():
            break
    some = np.flatnonzero(links)
    return pa.record_batch([pa.array(x) for x in (k[some], links[some].astype(np.int64), k[root[some]])], ["k", "links", "root"])


def _verify(active: DataFrame, depth: int, similarity: float) -> DataFrame:
    """Links of the pairs that meet at this depth and at no greater one.

    Nodes with the same members in several trees hold the same pairs, so one
    of them, in the first tree, is kept; nodes with one child hold no new
    pairs. Large nodes are dealt out as pairs of chunks: a text goes to as many
    tasks as its node has chunks.
    """
    nodes = _nodes(active, depth)
    if depth < DEPTH:
        nodes = nodes.withColumn("child", F.xxhash64(F.slice("labels", F.col("tree") * DEPTH + 1, depth + 1)))
    nodes = nodes.drop("labels")
    h = F.xxhash64("k")
    # Sums of 32-bit parts do not overflow.
    seals = [F.sum(f(h)).alias(c) for c, f in (("s1", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))), ("s2", lambda x: F.shiftrightunsigned(x, 32)))]
    new = F.lit(True) if depth == DEPTH else F.min("child") < F.max("child")
    held = nodes.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), new.alias("new"), *seals).where("m > 1 AND new")
    held = held.groupBy("m", "shingles", "s1", "s2").agg(F.min(F.struct("tree", "key")).alias("x"))
    held = cut(held.select("m", "shingles", "x.tree", "x.key"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.least(F.col("m"), F.ceil(F.col("shingles") / CHUNK_SHINGLES))).cast("int")
    members = nodes.select("k", "tree", "key").join(held.select("tree", "key", chunks.alias("c")), ["tree", "key"]).withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(1)), F.col("c")).cast("int"))
    dealt = members.select("tree", "key", "k", "chunk", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    dealt = dealt.withColumns({"b1": F.least("chunk", "o"), "b2": F.greatest("chunk", "o")}).drop("o")
    order = ["tree", "key", "b1", "b2"]
    rows = dealt.join(active.drop("n"), "k").repartition(*order).sortWithinPartitions(*order)

    def run(batches):
        for group in _runs(batches, order):
            if (made := _linked(group, depth, similarity)) is not None:
                yield made

    return cut(rows.mapInArrow(run, "k long, links long, root long"))


def _links(active: DataFrame, least: int, similarity: float) -> DataFrame:
    """(k, links, root) of all depths, from whole labels down to ``least`` hashes."""
    return reduce(DataFrame.unionByName, [_verify(active, depth, similarity) for depth in range(DEPTH, least - 1, -1)])


def components(edges: DataFrame) -> DataFrame:
    """(k, c): c is the least k that k is connected with, by the edges (k, root).

    Each round takes the least label around and then the label's own label;
    the rounds end when none changes. Labels stay distributed.
    """
    both = cut(edges.select("k", F.col("root").alias("o")).union(edges.select(F.col("root").alias("k"), F.col("k").alias("o"))).where("k <> o").distinct())
    labels = cut(both.groupBy("k").agg(F.min("o").alias("c")).select("k", F.least("k", "c").alias("c")))
    while True:
        around = both.join(labels.select(F.col("k").alias("o"), "c"), "o").groupBy("k").agg(F.min("c").alias("a"))
        nearer = labels.join(around, "k").select("k", F.col("c").alias("old"), F.least("c", "a").alias("c"))
        jumped = nearer.join(labels.select(F.col("k").alias("c"), F.col("c").alias("j")), "c", "left")
        step = cut(jumped.select("k", "old", F.least("c", F.coalesce("j", "c")).alias("c")))
        labels = step.select("k", "c")
        if step.where("c <> old").limit(1).count() == 0:
            return labels


def _classified(docs: DataFrame, similarity: float, width: int, target_recall: float, id_column: str, text_column: str) -> DataFrame:
    """(_id, x, n, class, class_id, n_links) of each row; a text without words is a class of its own, named by its row hash."""
    depth = depth_for(similarity, target_recall)
    signed = cut(_signed(docs, id_column, text_column, width))
    spark, own = docs.sparkSession, uuid.uuid4().hex
    with holding(own):
        reps = cut(signed.where("n > 0").groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("first_id"), F.min("x").alias("x"), F.first("labels").alias("labels")))
        chosen = _active(reps, depth).join(reps, "k").select("x", "k", "copies", "labels")
        texts = docs.select(_row_hash(F.col(id_column), F.col(text_column)).alias("x"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

        def fetched(batches):
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    part = batch.slice(a, b - a)
                    sets, keys = shingle_sets(part.column("text"), width)
                    own = np.flatnonzero(keys == part.column("k").to_numpy())
                    kept = part.take(pa.array(own))
                    yield pa.record_batch([kept.column("k"), kept.column("copies"), kept.column("labels"), pa.array([len(sets[i]) for i in own.tolist()], pa.int64()), pa.array([sets[i].tobytes() for i in own.tolist()], pa.binary())], ["k", "copies", "labels", "n", "shingles"])

        active = cut(texts.join(chosen, "x").select("k", "copies", "labels", "text").mapInArrow(fetched, "k long, copies long, labels array<int>, n long, shingles binary"))
        links = _links(active, depth, similarity)
        sums = links.groupBy("k").agg(F.sum("links").alias("links"))
        labels = components(links)
        classes = reps.select("k", "copies", "first_id").join(sums, "k", "left").join(labels, "k", "left").withColumn("c", F.coalesce("c", "k"))
        least = classes.groupBy("c").agg(F.min("first_id").alias("class_id"))
        named = classes.join(least, "c").select("k", "c", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = cut(named)
    release(spark, own)
    joined = signed.drop("labels").join(named, "k", "left")
    blank = F.col("n") == 0
    return joined.select("_id", "x", "n", F.when(blank, F.col("x")).otherwise(F.col("c")).alias("class"), F.when(blank, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(blank, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, target_recall: float = TARGET_RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id, class_id, n_links and n_shingles.

    Two texts are linked if the Jaccard similarity of their sets of ``width``
    consecutive words is ``similarity`` or more; texts with fewer words are
    one shingle. n_links counts the other documents linked with this one,
    copies among them; class_id is the least id among all documents that
    links connect. Texts with equal sets meet once, as one row with a count.
    Null, empty and blank texts have no shingle, no link, and a class of their
    own; repeated rows count as copies. An empty table gives no rows.
    """
    rows = _classified(docs, similarity, width, target_recall, id_column, text_column)
    return rows.select(F.col("_id").alias(id_column), "class_id", "n_links", F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each class, with the columns it came with: that of the least id, and of its texts that of the least hash.

    Unlike texts of one id, or of none, are classes of their own and stay; of
    rows with equal id and text one stays.
    """
    rows = _classified(docs, similarity, width, TARGET_RECALL, id_column, text_column)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "x"))
    stay = rows.groupBy((F.col("n") == 0).alias("blank"), "class").agg(first.alias("first")).select(F.col("first.x").alias("_x"))
    held = shielded(docs).withColumn("_x", _row_hash(F.col(f"`c_{id_column}`"), F.col(f"`c_{text_column}`")))
    return unshielded(held.join(stay.hint("shuffle_hash"), "_x", "left_semi").dropDuplicates(["_x"]), docs.columns)
