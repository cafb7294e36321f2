"""Best-fit packing of documents into fixed sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, running, settled
from .tokens import merger


def fullest(counts: dict[int, int], room: int, order: list[int] | None = None) -> Counter:
    """The multiset of lengths whose sum is the largest that fits ``room``.

    Subset sums are the set bits of one integer; multiples of a length enter
    as powers of two, and the steps are walked back to find the parts.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in order if order is not None else sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        k = 1
        while left > 0:
            k = min(k, left)
            grown = (reach | reach << (length * k)) & full
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += k
            total -= length * k
    return chosen


def patterns(counts: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins by minimum bin slack: (number of equal bins, [(length, uses in each)]).

    Each pattern holds the longest length left and the fullest company for it,
    and repeats while all its lengths last. A repetition ends because some
    length has fewer left than the pattern uses, and a length has at most
    room // length uses, so there are at most the sum of room / length
    patterns (under 17,000 for 2,048), however many rows there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order, made = sorted(left, reverse=True), []
    while order:
        first = order[0]
        left[first] -= 1
        chosen = fullest(left, room - first, [n for n in order if n <= room - first and left[n] > 0])
        left[first] += 1
        chosen[first] += 1
        times = min(left[n] // u for n, u in chosen.items())
        made.append((times, sorted(chosen.items(), reverse=True)))
        for n, u in chosen.items():
            left[n] -= times * u
        order = [n for n in order if left[n] > 0]
    return made


def places(counts: dict[int, int], room: int) -> dict[str, np.ndarray]:
    """Where the rows of each length go, by their number within the length.

    Entry i holds rows from ``key`` = length << 40 | first number on: the bin
    of the first, the rows a bin takes, and the place of its first row.
    """
    used, found, bins = Counter(), [], 0
    for times, parts in patterns(counts, room):
        offset = 0
        for length, uses in parts:
            found.append((length << 40 | used[length], bins, uses, offset))
            used[length] += times * uses
            offset += length * uses
        bins += times
    found.sort()
    return dict(zip(("key", "bin", "uses", "offset"), np.array(found, np.int64).reshape(-1, 4).T, strict=True))


def token_pieces(docs: DataFrame, tokenizer: str, room: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Each document's ids with ``end_id`` appended, in pieces of ``room`` of which the first may be shorter."""

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        owner, piece, start, length, crc = [], [], [], [], []
        encode, end = merger(tokenizer).of_text, np.uint32(end_id).tobytes()
        for i, text in enumerate(rows.column("text").to_pylist()):
            ids = encode(text).tobytes() + end
            n = len(ids) // 4
            at, take = 0, (n - 1) % room + 1
            k = 0
            while at < n:
                owner.append(i)
                piece.append(k)
                start.append(at)
                length.append(take)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + take)]))
                at, take, k = at + take, room, k + 1
        return pa.record_batch([rows.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [id_column, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_texts(docs, [id_column], text_column, make, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long")


@settled
def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", room: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs every document into sequences of at most ``room`` tokens.

    Rows of one length are alike to the packing, so it needs the number of
    rows of each length only: at most ``room`` counts reach the driver, where
    minimum bin slack turns them into bin patterns, and each piece finds its
    bin from its number within its length, which ranges of pieces count. Returns one row a piece: id, piece,
    start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Equal rows get places of their
    own. A null id is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(token_pieces(docs, tokenizer, room, end_id, id_column, text_column))
    # At most room rows.
    seen = Counter({r["length"]: r["count"] for r in rows.groupBy("length").count().collect()})
    sent = spark.sparkContext.broadcast(places(seen, room))

    def assign(batches):
        where = sent.value
        for b in batches:
            length, number = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "_before"))
            at = np.searchsorted(where["key"], length << 40 | number, "right") - 1
            nth = number - (where["key"][at] & ((1 << 40) - 1))
            sequence = where["bin"][at] + nth // where["uses"][at]
            offset = where["offset"][at] + nth % where["uses"][at] * length
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    numbered = running(rows, "length", ["ids_crc32", id_column, "piece"], F.lit(1)).select(*rows.columns, "_before")
    kind = docs.schema[id_column].dataType.simpleString()
    return numbered.mapInArrow(assign, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
