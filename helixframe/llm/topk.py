"""Exact top-k by inner product: ball trees of shards, searched best bound first, later ones with the k-th score so far."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, settled
from .near import _runs
from .vectors import matrix, whole_numbers

SCALE, TOP, EVERY = 256, 5, 50
#: Vectors of a shard, whose tree one task builds; queries that a task takes through it; vectors of a leaf at most.
SHARD, BLOCK, LEAF = 16_384, 4_096, 64
#: A wave of shards is so many times as large as all before it; the k-th score is shared between waves.
GROWTH = 3
#: Leaves that a query visits before its k-th score is looked at again: one, then so many times as many.
STRIDE = 4
#: A task merges its hits when there are so many.
PENDING = 1 << 21
#: Stands for a missing id in numpy: it comes after all others.
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min
#: Doubles multiply and add whole numbers exactly below this.
EXACT = 1 << 53


class Tree(NamedTuple):
    """A complete binary tree in heap order; node h has children 2h and 2h + 1, and the root is 1."""

    levels: int
    centre: np.ndarray  # whole numbers, a row for each node
    radius: np.ndarray  # squared
    members: np.ndarray  # rows of leaf 2^levels + i at starts[i] : starts[i + 1]
    starts: np.ndarray
    ids: np.ndarray


def _split(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves along the line through two rows that are far apart."""
    own = x[rows].astype(np.float64)
    far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
    other = own[((own - far) ** 2).sum(1).argmax()]
    order = np.argsort(own @ (other - far), kind="stable")
    half = len(rows) // 2
    return rows[order[:half]], rows[order[half:]]


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows of each leaf, and every node's centre and squared radius; node 0 is not used.

    A centre is a mean rounded to whole numbers, so that inner products with
    it and distances to it are exact.
    """
    levels = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))
    nodes: list[np.ndarray] = [np.zeros(0, np.int64), np.arange(len(x))]
    for h in range(1, 1 << levels):
        nodes.extend(_split(x, nodes[h]))
    centre, radius = np.zeros((len(nodes), x.shape[1]), np.int64), np.zeros(len(nodes), np.int64)
    for h, rows in enumerate(nodes):
        if len(rows):
            own = x[rows]
            centre[h] = np.rint(own.mean(0))
            radius[h] = ((own - centre[h]) ** 2).sum(1).max()
    return nodes[1 << levels :], centre, radius


def _product(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """a x b transposed in whole numbers; doubles hold them exactly if no sum can exceed EXACT."""
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, floor: np.ndarray, floor_id: np.ndarray, k: int) -> None:
        """floor and floor_id: what a hit must beat until k are known here."""
        self.k, self.floor, self.floor_id = k, floor.copy(), floor_id.copy()
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((query, score, ids))
        self.size += len(query)
        if self.size > PENDING:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        query, score, ids = (np.concatenate((a, *b)) for a, b in zip((self.query, self.score, self.id), zip(*self.new, strict=True), strict=True))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id, last = query[kept], score[kept], ids[kept], place == self.k - 1
        self.floor[query[last]], self.floor_id[query[last]] = score[last], ids[last]
        self.new, self.size = [], 0


def search(tree: Tree, q: np.ndarray, own: np.ndarray, best: Best) -> int:
    """Adds to ``best`` the members that beat what is known; returns how many products of a query and a member it took.

    A node's bound is q.centre + |q| radius, and no more than its parent's,
    rounded up. Nodes under a query's k-th score are left out with all below
    them. Leaves are visited in the order of their bounds, in growing strides,
    and a query ends when the next bound is under its k-th score.
    """
    span = int(max(np.abs(q).max(initial=0), np.abs(tree.members).max(initial=0), np.abs(tree.centre).max(initial=0)))
    most = span * span * max(1, q.shape[1])
    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    reach = np.sqrt(tree.radius.astype(np.float64))
    bound = np.full((len(q), 1), np.inf)
    for level in range(tree.levels + 1):
        nodes = slice(1 << level, 2 << level)
        above = bound if level == 0 else np.repeat(bound, 2, axis=1)
        some = np.flatnonzero((above >= best.floor[:, None]).any(0))
        bound = np.full(above.shape, -np.inf)
        ball = length[:, None] * reach[nodes][some]
        bound[:, some] = np.minimum(above[:, some], _product(q, tree.centre[nodes][some], most) + ball * (1 + 1e-9) + 1)
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    done, start, width = 0, 0, 1
    while start < order.shape[1]:
        open_ = np.flatnonzero(bound[:, start] >= best.floor)
        if not len(open_):
            break
        part = slice(start, start + width)
        row, at = np.nonzero((bound[open_, part] >= best.floor[open_][:, None]) & (bound[open_, part] > -np.inf))
        query, leaf = open_[row], order[open_, part][row, at]
        by = np.argsort(leaf, kind="stable")
        query, leaf = query[by], leaf[by]
        edges = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            low, high = tree.starts[leaf[a]], tree.starts[leaf[a] + 1]
            asking, ids = query[a:b], tree.ids[low:high]
            score = _product(q[asking], tree.members[low:high], most)
            done += score.size
            floor = best.floor[asking][:, None]
            beats = (score > floor) | ((score == floor) & (ids < best.floor_id[asking][:, None]))
            i, j = np.nonzero(beats & (ids != own[asking][:, None]))
            best.add(asking[i], score[i, j], ids[j])
        best.merge()
        start, width = start + width, width * STRIDE
    return done


def _row_hash() -> Column:
    return F.xxhash64("id", "v")


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def _nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


def trees(vectors: DataFrame, shards: int, width: int) -> DataFrame:
    """(shard, kind, place, id, v, radius): the nodes (kind 0) and members (kind 1, place is the leaf's) of each shard's tree, written.

    Shards are taken by a hash of id and vector, so each is a fair sample of
    all and gives a k-th score that holds for the others too. Rows equal in
    both meet there and count once.
    """
    dealt = vectors.withColumn("shard", F.pmod(_row_hash(), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["shard"]):
            ids, x = _ids(group.column("id")), matrix(group.column("v"), width)
            _, once = np.unique(np.column_stack((ids, x)), axis=0, return_index=True)
            ids, x = ids[once], x[once]
            leaves, centre, radius = build(x)
            row = np.concatenate(leaves)
            nodes, members = len(radius), len(row)
            place = np.concatenate((np.arange(nodes), np.repeat(np.arange(len(leaves)), [len(r) for r in leaves])))
            flat = np.concatenate((centre, x[row])).astype(np.int32)
            offsets = np.arange(0, (nodes + members) * width + 1, width, dtype=np.int32)
            made = [
                pa.array(np.full(nodes + members, group.column("shard")[0].as_py(), np.int32)),
                pa.array(np.repeat(np.array([0, 1], np.int32), [nodes, members])),
                pa.array(place.astype(np.int32)),
                _nullable(np.concatenate((np.full(nodes, NO_ID), ids[row]))),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())),
                pa.array(np.concatenate((radius, np.zeros(members, np.int64)))),
            ]
            whole = pa.record_batch(made, ["shard", "kind", "place", "id", "v", "radius"])
            for a in range(0, whole.num_rows, LEAF * LEAF):
                yield whole.slice(a, LEAF * LEAF)

    return cut(dealt.mapInArrow(run, "shard int, kind int, place int, id long, v array<int>, radius long"))


def _read_tree(rows: pa.Table, width: int) -> Tree:
    kind, place = rows.column("kind").to_numpy(), rows.column("place").to_numpy()
    x, ids, radius = matrix(rows.column("v"), width), _ids(rows.column("id")), rows.column("radius").to_numpy()
    node, member = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    node, member = node[np.argsort(place[node])], member[np.argsort(place[member], kind="stable")]
    leaves = len(node) // 2
    starts = np.searchsorted(place[member], np.arange(leaves + 1))
    return Tree(int(leaves).bit_length() - 1, x[node], radius[node], x[member], starts, ids[member])


def _wave(forest: DataFrame, queries: DataFrame, known: DataFrame | None, low: int, high: int, blocks: int, k: int, width: int) -> DataFrame:
    """Hits of the shards low to high - 1, in one task for each shard and block of queries.

    ``known`` has the k-th (score, id) of the queries that have k hits.
    """
    asked = queries if known is None else queries.join(known, ["id", "h"], "left")
    floor = [F.lit(None).cast("long").alias(c) for c in ("floor", "floor_id")] if known is None else [F.col("floor"), F.col("floor_id")]
    asking = asked.select(F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("shard"), "block", F.lit(2).alias("kind"), F.lit(0).alias("place"), "id", "v", F.lit(0).cast("long").alias("radius"), "h", *floor)
    held = forest.where(F.col("shard").between(low, high - 1)).select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "kind", "place", "id", "v", "radius", *(F.lit(None).cast("long").alias(c) for c in ("h", "floor", "floor_id")))
    order = ["shard", "block"]
    rows = asking.unionByName(held).repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, order):
            asks = group.column("kind").to_numpy() == 2
            q_rows = group.filter(pa.array(asks))
            if not q_rows.num_rows or asks.all():
                continue
            tree = _read_tree(group.filter(pa.array(~asks)), width)
            own, h = _ids(q_rows.column("id")), q_rows.column("h").to_numpy()
            best = Best(q_rows.column("floor").fill_null(LOWEST).to_numpy(), _ids(q_rows.column("floor_id")), k)
            search(tree, matrix(q_rows.column("v"), width), own, best)
            if len(best.query):
                yield pa.record_batch([pa.array(own[best.query]), pa.array(h[best.query]), _nullable(best.id), pa.array(best.score)], ["id", "h", "found", "score"])

    return rows.mapInArrow(run, "id long, h long, found long, score long")


@settled
def top_products(embeddings: DataFrame, k: int = TOP, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of the highest inner product with each query: query_id, rank, vec_id and score.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but those of the query's own id. Components are floor(256 * x),
    products are whole numbers, and ties go to the smaller id. Null vectors,
    and those that hold null or non-finite components, take no part; an empty
    vector is all zeros, and shorter ones go on with zeros. Rows equal in id
    and vector count once, as query and as candidate; unlike vectors of one id
    are rows of their own. A row without an id is no query; as a candidate it
    comes last among ties. Fewer candidates give fewer rows; an empty table
    gives none. Components of 2^20 or more raise an error.

    A shard's tree is searched by blocks of queries. Shards are dealt out in
    growing waves: what a wave finds raises the score that hits of the next
    one must beat, so a query brings few hits from each wave however many
    shards there are.
    """
    vectors = cut(whole_numbers(embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("w")), {"id": "id"}, "w", SCALE, once=True))
    asks = F.col("id") % every == 0
    rows, asked, longest = vectors.agg(F.count(F.lit(1)), F.count_if(asks), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not asked or rows < 2:
        return embeddings.sparkSession.createDataFrame([], schema)
    width, shards, blocks = max(1, longest), -(-rows // SHARD), -(-asked // BLOCK)
    forest = trees(vectors, shards, width)
    h = _row_hash()
    queries = vectors.where(asks).withColumns({"h": h, "block": F.pmod(F.xxhash64(h, F.lit(1)), F.lit(blocks)).cast("int")})
    queries = cut(queries.dropDuplicates(["id", "h"]))
    ranked = Window.partitionBy("id", "h").orderBy(F.desc("score"), F.asc_nulls_last("found"))  # k rows, and the few of one wave that beat them
    found, known, low = None, None, 0
    while low < shards:
        high = min(shards, max(1, low * (1 + GROWTH)))
        hits = _wave(forest, queries, known, low, high, blocks, k, width)
        both = hits if found is None else found.drop("rank").unionByName(hits)
        found = cut(both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        known = found.where(F.col("rank") == k).select("id", "h", F.col("score").alias("floor"), F.col("found").alias("floor_id"))
        low = high
    return found.select(F.col("id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
