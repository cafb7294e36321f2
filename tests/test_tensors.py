"""Keyed tensor files: formats, ranges, pushed filters, writes; and verified writes of tables."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from helixframe.sources import storage, tensors


def file_of(path, entries, pad=0):
    """A tensor file made by hand from {key: (type, shape, bytes)}."""
    head, at = {"__metadata__": {"made": "by hand"}}, 0
    for key, (dtype, shape, raw) in entries.items():
        head[key] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    text = json.dumps(head).encode() + b" " * pad
    path.write_bytes(len(text).to_bytes(8, "little") + text + b"".join(raw for _, _, raw in entries.values()))


def numbers(shape, dtype="<f4", seed=0):
    return np.random.default_rng(seed).integers(0, 100, shape).astype(dtype)


@pytest.fixture
def folder(tmp_path):
    a, b = numbers((5, 3)), numbers((7, 2, 2), "<f2", 1)
    file_of(tmp_path / "one.safetensors", {"a__layer6": ("F32", [5, 3], a.tobytes()), "b__layer6": ("F16", [7, 2, 2], b.tobytes()), "bias__layer7": ("F64", [4], numbers(4, "<f8").tobytes()), "step": ("I64", [], numbers((), "<i8").tobytes())}, pad=5)
    half = (numbers((2, 2)).view(np.uint32) >> 16).astype("<u2")
    (tmp_path / "deep").mkdir()
    file_of(tmp_path / "deep/two.safetensors", {"c__layer6": ("BF16", [2, 2], half.tobytes()), "none__layer6": ("F32", [0, 3], b""), "empty__layer7": ("F32", [2, 0], b""), "flag": ("BOOL", [3], b"\1\0\1"), "ß 日本": ("U8", [1, 2], b"\7\xff")})
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary/three.safetensors").write_bytes(b"not yet whole")
    (tmp_path / "readme.txt").write_text("no tensor")
    return tmp_path


def test_rows_of_all_types_and_shapes(spark, folder):
    got = {(r["key"], r["row"]): r["values"] for r in tensors.read_tensors(spark, str(folder)).collect()}
    want = {("a__layer6", i): x for i, x in enumerate(numbers((5, 3)).tolist())}
    want |= {("b__layer6", i): x for i, x in enumerate(numbers((7, 4), "<f2", 1).tolist())}
    want |= {("bias__layer7", 0): numbers(4, "<f8").tolist(), ("step", 0): [float(numbers(()))], ("flag", 0): [1.0, 0.0, 1.0], ("ß 日本", 0): [7.0, 255.0]}
    want |= {("c__layer6", i): x for i, x in enumerate(numbers((2, 2)).tolist())}  # small whole numbers are exact in 16 bits
    want |= {("empty__layer7", 0): [], ("empty__layer7", 1): []}
    assert got == want
    keys = {r["key"]: (r["dtype"], r["shape"], r["bytes"]) for r in tensors.tensor_keys(spark, f"file:{folder}").collect()}
    assert len(keys) == 9 and keys["none__layer6"] == ("F32", [0, 3], 0) and keys["b__layer6"] == ("F16", [7, 2, 2], 56) and keys["step"] == ("I64", [], 8)
    one = spark.read.format("tensors").schema("values array<float>, key string").load(f"{folder}/one.safetensors")
    assert one.columns == ["values", "key"] and one.count() == 14


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_each_tensor_is_read_by_one_range(folder, split):
    reader = tensors.TensorReader({"path": str(folder), "splitBytes": str(split), "content": "keys"}, StructType.fromDDL(tensors.KEYS))
    parts = reader.partitions()
    keys = [k for p in parts for batch in reader.read(p) for k in batch.column("key").to_pylist()]
    assert len(keys) == len(set(keys)) == 9 and (split > 64 or len(parts) > 5)


def test_only_the_asked_bytes_are_read(folder, monkeypatch):
    read = []
    fetch = tensors._fetch
    monkeypatch.setattr(tensors, "_fetch", lambda file, offset, size: (read.append((offset, size)), fetch(file, offset, size))[1])
    reader = tensors.TensorReader({"path": f"{folder}/one.safetensors"}, StructType.fromDDL(tensors.ROWS))
    more = GreaterThan(("row",), 1)
    assert list(reader.pushFilters([EqualTo(("key",), "b__layer6"), more])) == [more]  # Spark evaluates the other one
    rows = [batch for p in reader.partitions() for batch in reader.read(p)]
    assert sum(b.num_rows for b in rows) == 7
    head = sum(size for _, size in read[:2])
    assert [x for x in read[2:]] == [(head + 60, 56)]  # of 60 + 56 + 32 + 8 bytes of tensors


def test_filters_that_are_taken(folder):
    def left(*filters):
        reader = tensors.TensorReader({"path": str(folder), "content": "keys"}, StructType.fromDDL(tensors.KEYS))
        assert list(reader.pushFilters(list(filters))) == []
        return {k for p in reader.partitions() for b in reader.read(p) for k in b.column("key").to_pylist()}

    assert left(StringEndsWith(("key",), "__layer7")) == {"bias__layer7", "empty__layer7"}
    assert left(StringEndsWith(("key",), "__layer6"), StringStartsWith(("key",), "b")) == {"b__layer6"}
    assert left(In(("key",), ("step", "flag", "absent"))) == {"step", "flag"}
    assert left(StringContains(("key",), "日")) == {"ß 日本"}


def test_spark_pushes_the_suffix(spark, folder):
    found = tensors.read_tensors(spark, str(folder)).where(F.endswith("key", F.lit("__layer7")) & (F.col("row") >= 0))
    assert {r["key"] for r in found.collect()} == {"bias__layer7", "empty__layer7"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "EndsWith" not in plan  # left to the source


@pytest.mark.parametrize("raw", [b"", b"123", (99).to_bytes(8, "little") + b"{}", b"\4\0\0\0\0\0\0\0{}  ", (80).to_bytes(8, "little") + json.dumps({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 4]}}).encode().ljust(80) + b"1234"])
def test_broken_files_are_an_error(spark, tmp_path, raw):
    (tmp_path / "x.safetensors").write_bytes(raw)
    read = tensors.read_tensors(spark, str(tmp_path))
    if raw.endswith(b"{}  "):  # no tensor, but whole
        assert read.count() == 0
    else:
        with pytest.raises(PySparkException, match="tensor"):
            read.collect()


def test_round_trip_by_keys(spark, tmp_path):
    data = [(f"seq{k}__layer{k % 3}", i, [float(k), float(i), 0.5]) for k in range(40) for i in range(k % 7 + 1)]
    df = spark.createDataFrame(data, "key string, row long, values array<double>").repartition(6)
    path = str(tmp_path / "out")
    tensors.write_tensors(df, path)
    back = tensors.read_tensors(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(data)
    manifest = json.load(open(glob.glob(f"{path}/_manifest-*.json")[0]))
    assert sum(x["rows"] for x in manifest.values()) == len(data) and sum(x["tensors"] for x in manifest.values()) == 40
    assert {n: x["bytes"] for n, x in manifest.items()} == {n: os.path.getsize(f"{path}/{n}") for n in manifest}
    assert not glob.glob(f"{path}/_job-*")
    sample = tensors.sampled_keys(tensors.tensor_keys(spark, path), 10)
    assert sample == sorted({k for k, _, _ in data})[::4]
    tensors.write_tensors(df.where("row = 0"), path, "F16", overwrite=True)
    assert tensors.read_tensors(spark, path).count() == 40


def test_many_files_and_rows_beyond_one_read(spark, tmp_path, monkeypatch):
    reader = tensors.TensorReader({"path": str(tmp_path)}, StructType.fromDDL(tensors.ROWS))
    monkeypatch.setattr(tensors, "READ_BYTES", 64)
    big = numbers((50, 9))
    file_of(tmp_path / "big.safetensors", {"wide": ("F32", [50, 9], big.tobytes()), "next": ("F32", [3, 2], numbers((3, 2)).tobytes())})
    rows = [(k, i, v) for p in reader.partitions() for b in reader.read(p) for k, i, v in zip(*(b.column(c).to_pylist() for c in ("key", "row", "values")))]
    assert rows == [("wide", i, x) for i, x in enumerate(big.tolist())] + [("next", i, x) for i, x in enumerate(numbers((3, 2)).tolist())]
    data = [(f"k{k}", i, [float(i)] * 8) for k in range(20) for i in range(4)]
    df = spark.createDataFrame(data, "key string, row long, values array<double>").coalesce(1).sortWithinPartitions("key", "row")
    path = str(tmp_path / "small")
    tensors.register(spark)
    df.write.format("tensors").option("fileBytes", "256").mode("append").save(path)
    assert len(glob.glob(f"{path}/*.safetensors")) == 10
    assert sorted(map(tuple, tensors.read_tensors(spark, path).collect())) == sorted(data)


@pytest.mark.parametrize("data", [[(None, 0, [1.0])], [("a", 0, None)], [("a", 0, [None])], [("a", 1, [1.0])], [("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], [("a", 0, [1.0]), ("a", 0, [1.0])]])
def test_rows_that_are_no_tensor_are_refused(spark, tmp_path, data):
    path = str(tmp_path / "out")
    with pytest.raises(PySparkException, match="tensor"):
        tensors.write_tensors(spark.createDataFrame(data, "key string, row long, values array<double>"), path)
    assert not glob.glob(f"{path}/*")


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    tensors.write_tensors(spark.createDataFrame([], "key string, row long, values array<double>"), path)
    assert tensors.read_tensors(spark, path).count() == 0 and tensors.tensor_keys(spark, path).count() == 0


def test_verified_write(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id as string) AS s", "map(id, id) AS m", "array(id) AS a").repartition(5)
    path = str(tmp_path / "table")
    assert storage.write_verified(df, path) == 1000
    assert storage.verify(spark, path) == 1000 and os.listdir(tmp_path) == ["table"]
    assert sorted(spark.read.parquet(path).select("id").toPandas()["id"]) == list(range(1000))
    with pytest.raises(FileExistsError):
        storage.write_verified(df, path)
    assert storage.write_verified(df.limit(0), str(tmp_path / "none")) == 0
    assert storage.write_verified(df, str(tmp_path / "told"), expected=1000) == 1000
    with pytest.raises(ValueError, match="1001"):
        storage.write_verified(df, str(tmp_path / "more"), expected=1001)
    assert not os.path.exists(tmp_path / "more")


def test_verified_write_refuses_without_room(spark, tmp_path):
    df = spark.range(10)
    left = storage.free_bytes(spark, str(tmp_path / "not/yet"))
    assert left > 0
    with pytest.raises(OSError, match="needed"):
        storage.write_verified(df, str(tmp_path / "table"), estimate=left)
    assert os.listdir(tmp_path) == []
    source = str(tmp_path / "source")
    df.write.parquet(source)
    assert storage.input_bytes(spark.read.parquet(source)) == sum(map(os.path.getsize, glob.glob(f"{source}/*.parquet")))


def test_a_lost_or_changed_file_is_found(spark, tmp_path, monkeypatch):
    df, folder = spark.range(1000).repartition(4), str(tmp_path / "staged")
    storage.stage(df, folder)
    files = sorted(glob.glob(f"{folder}/*.parquet"))
    held = open(files[0], "rb").read()
    os.remove(files[0])
    with pytest.raises(ValueError, match=os.path.basename(files[0])):
        storage.verify(spark, folder)
    open(files[0], "wb").write(open(files[1], "rb").read())  # as many rows, but others
    for crc in glob.glob(f"{folder}/.*.crc"):
        os.remove(crc)
    with pytest.raises(ValueError, match=os.path.basename(files[0])):
        storage.verify(spark, folder)
    open(files[0], "wb").write(held)
    assert storage.verify(spark, folder) == 1000

    stage = storage.stage

    def losing(df, folder, expected):
        stage(df, folder, expected)
        os.remove(sorted(glob.glob(f"{folder}/*.parquet"))[0])

    monkeypatch.setattr(storage, "stage", losing)
    with pytest.raises(ValueError, match="manifest"):
        storage.write_verified(df, str(tmp_path / "table"))
    assert os.listdir(tmp_path) == ["staged"]
