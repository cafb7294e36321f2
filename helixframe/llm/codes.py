"""Vector code compression: product codes in whole numbers, nearest entries found behind segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settled
from .vectors import ROWS, matrix, whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A limit has this share of the squared lengths more than the distance it stands for, far more than the bounds' rounding.
SLACK = 1e-11
#: So many label sums go to every task; beyond, labels are joined, a hot one in SALTS parts.
SENT, SALTS = 100_000, 32

Codebooks = list[np.ndarray]  # for each part its entries x components


class Segments(NamedTuple):
    """Of rows cut into equal blocks: the blocks' sums, the norms of what is left without the blocks' means, and a block's length."""

    sums: np.ndarray
    rests: np.ndarray
    size: int


def pyramid(x: np.ndarray) -> list[Segments]:
    """The segments of one block, of its halves, and of their halves, while a block has two components; coarse to fine."""
    blocks = 1
    while x.shape[1] % (2 * blocks) == 0 and x.shape[1] // (2 * blocks) >= 2:
        blocks *= 2
    out, sums, squares = [], x.reshape(len(x), blocks, -1).sum(2), (x * x).reshape(len(x), blocks, -1).sum(2)
    while True:
        size = x.shape[1] // sums.shape[1]
        out.append(Segments(sums.astype(np.float64), np.sqrt((size * squares - sums * sums) / size), size))
        if sums.shape[1] == 1:
            return out[::-1]
        sums, squares = sums[:, ::2] + sums[:, 1::2], squares[:, ::2] + squares[:, 1::2]


def lower_bounds(x: Segments, c: Segments, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Lower bounds, but for rounding, of the squared distances of all rows and entries, or of rows i and entries j.

    In each block the difference has a part along the mean, whose length is
    known, and a part across it, which is the difference of the residual norms
    at least.
    """
    low: np.ndarray | float = 0.0
    for b in range(x.sums.shape[1]):
        sx, rx = (x.sums[:, b, None], x.rests[:, b, None]) if i is None else (x.sums[i, b], x.rests[i, b])
        sc, rc = (c.sums[:, b], c.rests[:, b]) if j is None else (c.sums[j, b], c.rests[j, b])
        mean, rest = sx - sc, rx - rc
        low = low + mean * mean / x.size + rest * rest
    return low


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry, ties to the lower index, the squared distance, and how many exact distances were needed.

    An exact distance to the entry of the least coarse bound is the first
    limit. Entries whose bound is over it are out; the others meet the bounds
    of finer blocks, and those that are left exact distances. As no bound is
    over the true distance by more than its rounding, for which the limit has
    room, the result is that of comparing all.
    """
    rows, limit, left = np.arange(len(x)), None, None
    for own, other in zip(pyramid(x), pyramid(entries), strict=True):
        if limit is None:
            low = lower_bounds(own, other)
            guess = low.argmin(1)
            limit = ((x - entries[guess]) ** 2).sum(1)[:, None] + SLACK * ((x * x).sum(1, dtype=np.float64)[:, None] + (entries * entries).sum(1, dtype=np.float64))
            left = low <= limit
        elif left.mean() > 0.25:  # whole columns are cheaper than picked pairs
            left &= lower_bounds(own, other) <= limit
        else:
            i, j = np.nonzero(left)
            left[i, j] = lower_bounds(own, other, i, j) <= limit[i, j]
    i, j = np.nonzero(left)
    found = np.full((len(x), len(entries)), np.iinfo(np.int64).max)
    difference = x[i] - entries[j]
    found[i, j] = np.einsum("ij,ij->i", difference, difference)
    best = found.argmin(1)  # the first of the least
    return best, found[rows, best], len(x) + len(i)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, matrix(part.column("v"), width)


def _improved(vectors: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks after one round: each task sums its parts by entry, Spark adds the sums, and as many numbers as the codebooks have come back."""
    size = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), size + 1), np.int64) for b in books]
        for _, x in _blocks(batches, width):
            for p, book in enumerate(books):
                own = x[:, p * size : (p + 1) * size]
                best, _, _ = nearest(own, book)
                mine = best == np.arange(len(book))[:, None]  # entries x rows; sums of ROWS components are exact in doubles
                sums[p] += (mine.astype(np.float64) @ np.column_stack((own, np.ones(len(own))))).astype(np.int64)
        flat = np.concatenate([s.ravel() for s in sums])
        some = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(some), pa.array(flat[some])], ["place", "total"])

    totals = vectors.select("v").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(sum(len(b) for b in books) * (size + 1), np.int64)
    for r in totals:
        flat[r["place"]] = r["total"]
    out, at = [], 0
    for book in books:
        own = flat[at : at + len(book) * (size + 1)].reshape(len(book), size + 1)
        at += own.size
        used = own[:, size] > 0
        new = book.copy()
        new[used] = own[used, :size] // own[used, size:]  # floor
        out.append(new)
    return out


def _coded(vectors: DataFrame, books: Codebooks, width: int, label_type: str, id_type: str) -> DataFrame:
    size = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                best, distance, _ = nearest(x[:, p * size : (p + 1) * size], book)
                code[:, p] = best
                error += distance
            yield pa.record_batch([part.column("id"), part.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long")


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks of ``vectors`` (id, v array<int>), and the width that vectors are brought to.

    They start as the parts of the vectors of the least ids; as many numbers
    as they hold pass through the driver in each round, and every vector takes
    part in each.
    """
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return [], 0
    width = max(1, -(-longest // parts)) * parts
    first = vectors.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()
    start = matrix(first.column("v"), width)
    books = [start[:, p * width // parts : (p + 1) * width // parts].copy() for p in range(parts)]
    for _ in range(rounds):
        books = _improved(vectors, books, width)
    return books, width


@settled
def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """The product code of every vector: id, code, error, label_error and codebooks_sha256.

    code has two hex digits for each part; error is the squared distance of
    the vector and its entries, label_error its sum over the rows of one
    label, nulls together. Null vectors, and those that hold null or
    non-finite components, have no row; an empty one counts as zeros, and
    shorter ones go on with zeros to the longest one's parts. Repeated rows
    stay. Of rows that share an id the one with the lesser vector comes first
    when codebooks start, and rows without an id come last. Fewer vectors than
    entries give as many entries. An empty table gives no rows. Components of
    65,536 or more raise an error, as their distances might not fit a long.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    kinds = {c: embeddings.schema[c].dataType.simpleString() for c in (id_column, label_column)}
    vectors = cut(whole_numbers(embeddings, {"id": id_column, "label": label_column}, vector_column, SCALE))
    books, width = fit(vectors, parts, entries, rounds)
    if not books:
        return vectors.select(F.col("id").alias(id_column), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(str(n) for b in books for n in b.ravel().tolist()).encode()).hexdigest()
    coded = cut(_coded(vectors, books, width, kinds[label_column], kinds[id_column]))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= SENT:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        dealt = sums.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Each round written out, as DuckDB's recursion has no aggregate."""
    assign = "SELECT id, rid, p, v, min_by(e, d) AS e, min(d)[1] AS d FROM (SELECT id, rid, parts.p, parts.v, e, [list_sum(list_transform(list_zip(parts.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, e] AS d FROM parts JOIN {0} AS b USING (p)) GROUP BY id, rid, p, v"
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"a{r} AS MATERIALIZED ({assign.format(f'b{r}')})")
        if r < ROUNDS:
            mean = f"SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r}, generate_series(1, {{size}}) AS u(i) GROUP BY p, e, i) GROUP BY p, e"
            rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{r} AS b LEFT JOIN ({mean.format(size=8)}) AS m USING (p, e))")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id AS id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, rid, p, v[8 * p + 1 : 8 * p + 8] AS v FROM kept, generate_series(0, {PARTS - 1}) AS u(p)),
b0 AS (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= {ENTRIES}),
{", ".join(rounds)},
digest AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), digest
"""


SQL = _sql()
