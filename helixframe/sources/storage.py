"""Folders that driver and executors share, and writes that are checked before they count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or a local one on a single machine that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/helixframe-checkpoints")
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, for what is used more than once or begins a round."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def free_bytes(spark: SparkSession, path: str) -> int:
    """What the file system of ``path`` has left, by its own account."""
    system, own = _file_system(spark, path)
    while not system.exists(own) and own.getParent() is not None:
        own = own.getParent()
    return system.getStatus(own).getRemaining()


def input_bytes(df: DataFrame) -> int:
    """The bytes of the files that ``df`` reads; 0 if it reads none."""
    total = 0
    for name in df.inputFiles():
        system, own = _file_system(df.sparkSession, name)
        total += system.getFileStatus(own).getLen()
    return total


def _seal(columns: list[Column]) -> list[Column]:
    """Rows, and a sum of their hashes, which is the same in whatever order and files they stand."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("seal")]


def _counted(back: DataFrame) -> DataFrame:
    """(file, rows, seal) of a folder as it is read."""
    columns = [F.col(f"`{f.name}`") for f in back.schema if f.dataType.typeName() != "map"]
    return back.groupBy(F.col("_metadata.file_name").alias("file")).agg(*_seal(columns))


def stage(df: DataFrame, folder: str, expected: int | None = None) -> None:
    """Writes ``df`` and a manifest of rows and hashes for each file.

    Raises if the files do not hold ``expected`` rows, or, where no number is
    given, the rows that ``df`` has when it is read once more and their hashes.
    """
    spark = df.sparkSession
    df.write.mode("error").parquet(folder)
    _counted(spark.read.schema(df.schema).parquet(folder)).write.json(f"{folder}/_manifest")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("rows", "seal")]
    held = {c: int(v) for c, v in _manifest(spark, folder).agg(*sums).first().asDict().items()}
    if expected is None:
        columns = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() != "map"]
        told = {c: int(v) for c, v in df.agg(*_seal(columns)).first().asDict().items()}
    else:
        told = {**held, "rows": expected}
    if held != told:
        raise ValueError(f"{folder} holds {held['rows']} rows that differ from the {told['rows']} that were to be written")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, rows long, seal decimal(38,0)").json(f"{folder}/_manifest")


def verify(spark: SparkSession, folder: str) -> int:
    """The number of rows of a folder that stage() wrote; raises if a file is lost, new or changed since."""
    told, found = _manifest(spark, folder), _counted(spark.read.parquet(folder))
    both = told.toDF("file", "rows", "seal").join(found.toDF("file", "rows_now", "seal_now"), "file", "full")
    wrong = both.where(~(F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("seal").eqNullSafe(F.col("seal_now"))))
    if names := [r["file"] for r in wrong.orderBy("file").limit(5).collect()]:
        raise ValueError(f"{folder} is not what its manifest says: {', '.join(names)}")
    return told.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def write_verified(df: DataFrame, path: str, estimate: int | None = None, factor: float = 1.5, expected: int | None = None) -> int:
    """Writes Parquet that readers see only after it has been checked; returns its rows.

    Refuses to begin unless the file system has ``factor`` times the estimated
    bytes left, by default those of the files that ``df`` reads. With the
    number of rows as ``expected``, ``df`` is not read a second time. The files go
    to a folder beside ``path`` with a manifest (stage), are read back and
    compared with it (verify), and are renamed then; whatever fails, ``path``
    does not appear.
    """
    spark = df.sparkSession
    need, left = factor * (input_bytes(df) if estimate is None else estimate), free_bytes(spark, path)
    if left < need:
        raise OSError(f"{path} has {left} bytes left, {need:.0f} are needed")
    system, target = _file_system(spark, path)
    if system.exists(target):
        raise FileExistsError(path)
    folder = f"{path.rstrip('/')}._staged-{uuid.uuid4().hex}"
    _, staged = _file_system(spark, folder)
    try:
        stage(df, folder, expected)
        rows = verify(spark, folder)
        if not system.rename(staged, target):
            raise OSError(f"{folder} can't be renamed to {path}")
        return rows
    finally:
        system.delete(staged, True)
