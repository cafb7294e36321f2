"""Vectors as whole numbers, for the operators that compare them exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are held as 32-bit numbers of less than this, so that sums of products of 64 of them fit 63 bits.
MOST = 1 << 28
#: Rows of vectors that a task turns into numpy arrays at once.
ROWS = 4096


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, pa.ListArray]:
    """The places of the vectors that can be compared, and these vectors with each x as floor(scale * x).

    Null vectors, and those that hold a null or a non-finite component, are
    left out. Components are taken as doubles.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes nan
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.asarray(column.is_valid()) & (np.bincount(row, ~np.isfinite(flat), len(sizes)) == 0)
    numbers = np.floor(flat[fine[row]] * scale)
    if len(numbers) and np.abs(numbers).max() >= MOST:
        raise ValueError(f"a component of {np.abs(numbers).max() / scale:g} is too large to be compared exactly: {MOST / scale:g} is the limit")
    offsets = np.concatenate(([0], np.cumsum(sizes[fine]))).astype(np.int32)
    return np.flatnonzero(fine), pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers.astype(np.int32)))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter vectors go on with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width).astype(np.int64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    row, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(sizes), width), np.int64)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _first_of_each(rows: pa.RecordBatch, v: pa.ListArray) -> np.ndarray:
    """Places of the rows, without those that repeat an earlier one's first column and vector."""
    ids = rows.column(0)
    if pc.count_distinct(ids, mode="all").as_py() == len(ids):
        return np.arange(len(ids))
    flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    first = {(key, flat[a:b].tobytes()): i for i, (key, a, b) in reversed(list(enumerate(zip(ids.to_pylist(), at[:-1], at[1:], strict=True))))}
    return np.sort(np.fromiter(first.values(), np.int64))


def whole_numbers(rows: DataFrame, keep: dict[str, str], vector_column: str, scale: int, once: bool = False) -> DataFrame:
    """The columns ``keep`` (name to source) and v, the vector as array<int>, of the rows whose vectors can be compared.

    With ``once``, rows that repeat the first column and the vector go where a
    task sees both, so that few of many repeated rows are shuffled later.
    """
    schema = ", ".join(f"{name} {rows.schema[source].dataType.simpleString()}" for name, source in keep.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                places, v = scaled(part.column("v"), scale)
                kept = part.take(pa.array(places))
                made = pa.record_batch([*(kept.column(c) for c in keep), v], [*keep, "v"])
                yield made.take(pa.array(_first_of_each(kept, v))) if once else made

    return rows.select(*(F.col(source).alias(name) for name, source in keep.items()), F.col(vector_column).alias("v")).mapInArrow(run, f"{schema}, v array<int>")
