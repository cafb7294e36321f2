"""Keyed tensor files as a Spark data source: a header that says where each tensor's bytes are, then the bytes.

A file is eight bytes with the header's length, the header as JSON
(``{key: {"dtype", "shape", "data_offsets"}}``), and the tensors' bytes one after
another. The source reads rows of tensors, or the headers alone:

    tensors.register(spark)
    spark.read.format("tensors").load(folder).where(F.endswith("key", F.lit("__layer6")))
    spark.read.format("tensors").option("content", "keys").load(folder)

Files are dealt out by byte ranges, so neither the number of tensors nor the
size of a file bounds the number of tasks. A task reads a file's header and,
of the tensors that begin in its range, the bytes of those that the pushed
filters on ``key`` ask for. Rows come back in bounded batches, so that a
tensor of any length passes through.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

#: The format's names of number types, and numpy's.
TYPES = {"BOOL": "?", "U8": "<u1", "I8": "<i1", "U16": "<u2", "I16": "<i2", "F16": "<f2", "BF16": "<u2", "U32": "<u4", "I32": "<i4", "F32": "<f4", "U64": "<u8", "I64": "<i8", "F64": "<f8"}
SUFFIX = ".safetensors"
ROWS = "key string, row long, values array<double>"
KEYS = "key string, dtype string, shape array<long>, bytes long"
#: Bytes of a task's range, of what it reads and returns at once, and of a file that is written.
SPLIT_BYTES, READ_BYTES, FILE_BYTES = 128 << 20, 4 << 20, 64 << 20
#: Small files that a task takes at most.
SPLIT_FILES = 1024


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which is a local one or a URI that Arrow knows."""
    if re.match(r"\w[\w+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _fetch(file: pa.NativeFile, offset: int, size: int) -> bytes:
    """Bytes of a file; all reads of this source go through here."""
    got = file.read_at(size, offset)
    if len(got) != size:
        raise ValueError(f"a tensor file ends at {offset + len(got)}; {offset + size} bytes were expected")
    return got


@dataclass
class Tensor:
    key: str
    dtype: str
    shape: list[int]
    start: int  # in the file
    size: int

    @property
    def rows(self) -> int:
        """A tensor of one dimension or none is one row."""
        return self.shape[0] if len(self.shape) > 1 else 1

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:]) if len(self.shape) > 1 else math.prod(self.shape)


def header(file: pa.NativeFile, length: int) -> list[Tensor]:
    """The tensors of a file of this length in the order of their bytes; raises where header and length contradict."""
    size = int.from_bytes(_fetch(file, 0, 8), "little") if length >= 8 else length
    if size + 8 > length:
        raise ValueError(f"a tensor file of {length} bytes can't have a header of {size}")
    out = []
    for key, x in json.loads(_fetch(file, 8, size)).items():
        if key == "__metadata__":
            continue
        first, last = x["data_offsets"]
        own = Tensor(key, x["dtype"], x["shape"], 8 + size + first, last - first)
        if own.dtype not in TYPES or own.size != math.prod(own.shape) * np.dtype(TYPES[own.dtype]).itemsize or 8 + size + last > length:
            raise ValueError(f"tensor {key} of type {own.dtype} and shape {own.shape} can't be the bytes {first} to {last}")
        out.append(own)
    return sorted(out, key=lambda t: (t.start, t.size))


def _numbers(raw: bytes, dtype: str) -> np.ndarray:
    values = np.frombuffer(raw, TYPES[dtype])
    return (values.astype(np.uint32) << 16).view(np.float32) if dtype == "BF16" else values


@dataclass
class Ranges(InputPartition):
    """(path, file's length, first byte, last byte + 1) of a task."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        super().__init__(None)
        self.parts = parts


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.keys_only = options["path"], options.get("content", "rows") == "keys"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.kinds = {f.name: f.dataType for f in schema}
        self.asked: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what is asked of the key alone; Spark evaluates the rest."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("key",):
                self.asked.append((kinds[type(f)], frozenset(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def wanted(self, key: str) -> bool:
        tests = {"is": lambda v: key == v, "in": lambda v: key in v, "starts": lambda v: key.startswith(v), "ends": lambda v: key.endswith(v), "has": lambda v: v in key}
        return all(tests[kind](v) for kind, v in self.asked)

    def partitions(self) -> list[InputPartition]:
        """Ranges of files, from their lengths alone; headers are read by the tasks."""
        system, path = _located(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and not re.search(r"/[_.]", f.path[len(path) :])]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            for start in range(0, max(1, f.size), self.split):
                end = min(f.size, start + self.split)
                if held and (size + end - start > self.split or len(held) >= SPLIT_FILES):
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((f.path, f.size, start, end))
                size += end - start
        return [*out, Ranges(held)] if held else [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.path)
        for path, length, start, end in partition.parts:
            with system.open_input_file(path) as file:
                # What has no bytes may begin where the file ends.
                own = [t for t in header(file, length) if (start <= t.start < end or (t.start == end == length and start < end)) and self.wanted(t.key)]
                yield from self._listed(own) if self.keys_only else self._rows(file, own)

    def _batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        """The columns that the schema names, in its order."""
        return pa.record_batch([columns[n] for n in self.kinds], list(self.kinds))

    def _listed(self, own: list[Tensor]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(own), 4096):
            part = own[a : a + 4096]
            yield self._batch({"key": pa.array([t.key for t in part]), "dtype": pa.array([t.dtype for t in part]), "shape": pa.array([t.shape for t in part], pa.list_(pa.int64())), "bytes": pa.array([t.size for t in part], pa.int64())})

    def _pieces(self, own: list[Tensor]) -> Iterator[tuple[Tensor, int, int]]:
        """(tensor, first row, rows): whole rows of READ_BYTES at most, one row at least."""
        for t in own:
            step = max(1, READ_BYTES // max(1, t.size // max(1, t.rows)))
            for row in range(0, t.rows, step):
                yield t, row, min(step, t.rows - row)

    def _rows(self, file: pa.NativeFile, own: list[Tensor]) -> Iterator[pa.RecordBatch]:
        """Neighbouring pieces are one read, and one batch."""
        held: list[tuple[Tensor, int, int]] = []
        at = lambda t, row: t.start + row * (t.size // max(1, t.rows))
        for t, row, n in self._pieces(own):
            if held:
                last, r, m = held[-1]
                first = at(held[0][0], held[0][1])
                if at(last, r + m) != at(t, row) or at(t, row + n) - first > READ_BYTES or last.dtype != t.dtype or len(held) >= 4096:
                    yield self._made(file, held, at)
                    held = []
            held.append((t, row, n))
        if held:
            yield self._made(file, held, at)

    def _made(self, file, held, at) -> pa.RecordBatch:
        first, last = at(held[0][0], held[0][1]), at(held[-1][0], held[-1][1] + held[-1][2])
        values = _numbers(_fetch(file, first, last - first), held[0][0].dtype)
        widths = np.repeat([t.width for t, _, _ in held], [n for _, _, n in held])
        offsets = np.concatenate(([0], np.cumsum(widths))).astype(np.int32)
        keys = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(held)), [n for _, _, n in held]).astype(np.int32), pa.array([t.key for t, _, _ in held])).cast(pa.string())
        rows = np.concatenate([np.arange(row, row + n) for _, row, n in held])
        kind = {"float": np.float32, "double": np.float64, "bigint": np.int64, "int": np.int32}[self.kinds["values"].elementType.simpleString()]
        return self._batch({"key": keys, "row": pa.array(rows, pa.int64()), "values": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))})


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, with the number of tensors, rows and bytes of each."""

    files: dict[str, dict[str, int]] = field(default_factory=dict)


class TensorWriter(DataSourceArrowWriter):
    """Tasks write to a folder of the job; a commit moves the files of the tasks that count, and says what they hold."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.dtype, self.most = options["path"], options.get("dtype", "F32"), int(options.get("fileBytes", FILE_BYTES))
        if self.dtype not in TYPES or self.dtype == "BF16":
            raise ValueError(f"tensors can't be written as {self.dtype}")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, path = _located(self.path)
        return system, path, f"{path}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        done, entries, blobs, size = Written(), {}, [], 0
        key, parts, rows, width, seen = None, [], 0, None, set()

        def close() -> None:
            nonlocal size, parts, rows, width
            if key is None:
                return
            if key in entries or key in seen:
                raise ValueError(f"the rows of tensor {key} do not stand together")
            raw = np.concatenate(parts).astype(TYPES[self.dtype]).tobytes()
            entries[key] = {"dtype": self.dtype, "shape": [rows, width], "data_offsets": [size, size + len(raw)]}
            blobs.append(raw)
            size += len(raw)
            parts, rows, width = [], 0, None

        def flush() -> None:
            nonlocal size
            if not entries:
                return
            head = json.dumps(entries, ensure_ascii=False).encode()
            head += b" " * (-len(head) % 8)
            name = f"part-{uuid.uuid4().hex}{SUFFIX}"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(len(head).to_bytes(8, "little"))
                out.write(head)
                for raw in blobs:
                    out.write(raw)
            done.files[name] = {"tensors": len(entries), "rows": sum(x["shape"][0] for x in entries.values()), "bytes": 8 + len(head) + size}
            seen.update(entries)
            entries.clear()
            blobs.clear()
            size = 0

        for batch in iterator:
            keys, values = batch.column("key"), batch.column("values")
            if keys.null_count or values.null_count or values.values.null_count:
                raise ValueError("a tensor's key and numbers can't be null")
            codes, names = keys.dictionary_encode().indices.to_numpy(), keys.dictionary_encode().dictionary
            numbers, offsets, flat = batch.column("row").to_numpy(), values.offsets.to_numpy(), values.values.to_numpy()
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                k = names[int(codes[a])].as_py()
                if k != key:
                    close()
                    if size >= self.most:
                        flush()
                    key = k
                widths = np.diff(offsets[a : b + 1])
                width = int(widths[0]) if width is None else width
                if (numbers[a:b] != np.arange(rows, rows + b - a)).any() or (widths != width).any():
                    raise ValueError(f"rows {numbers[a:b]} of {widths} numbers can't follow {rows} rows of {width} in tensor {k}")
                parts.append(flat[offsets[a] : offsets[b]])
                rows += b - a
        close()
        flush()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, path, folder = self._folder()
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File:
                    system.delete_file(old.path)
        files = {name: about for m in messages if m for name, about in m.files.items()}
        for name in files:
            system.move(f"{folder}/{name}", f"{path}/{name}")
        with system.open_output_stream(f"{path}/_manifest-{self.job}.json") as out:
            out.write(json.dumps(files).encode())
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self._folder()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return KEYS if self.options.get("content", "rows") == "keys" else ROWS

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(key, row, values): a row for each index of a tensor's first dimension, the others flattened; filters on key decide which bytes are read."""
    register(spark)
    return spark.read.format("tensors").load(path)


def tensor_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, dtype, shape, bytes) of every tensor, from the headers alone."""
    register(spark)
    return spark.read.format("tensors").option("content", "keys").load(path)


def write_tensors(df: DataFrame, path: str, dtype: str = "F32", overwrite: bool = False) -> None:
    """Writes (key, row, values) as tensors of two dimensions.

    A tensor's bytes stand together in one file, so a key's rows go to one
    task, which holds that tensor and as many others as make a file. Rows are
    numbered from 0 in each key without gaps.
    """
    register(df.sparkSession)
    rows = df.select("key", F.col("row").cast("long").alias("row"), F.col("values").cast("array<double>").alias("values")).repartition("key").sortWithinPartitions("key", "row")
    rows.write.format("tensors").option("dtype", dtype).mode("overwrite" if overwrite else "append").save(path)


def sampled_keys(keys: DataFrame, n: int) -> list[str]:
    """Every (count / n)-th key in their order, ``n`` at most: those that a check of a large file reads."""
    from ..operators.entities import numbered

    many = keys.count()
    step = max(1, many // n)
    placed = numbered(keys.select("key"), F.col("key"), "_i")
    return sorted(r["key"] for r in placed.where((F.col("_i") % step == 0) & (F.col("_i") < step * n)).select("key").collect())
