"""Helpers that the operators share: table access, durable cuts, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task turns into numpy arrays at once.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    on a single machine, as in tests, a local folder stands in for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/helixframe-checkpoints")
    return sc.getCheckpointDir()


#: Paths that cut() wrote, by the owner that is to release them.
_held: dict[str, list[str]] = {}
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Later jobs start from the files, so neither a lost executor nor a second
    use of the result computes it anew.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (owner := _owner.get()) is not None:
        _held.setdefault(owner, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def holding(owner: str) -> Iterator[None]:
    """What cut() writes inside is held for ``owner``."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, owner: str) -> None:
    """Deletes what is held for ``owner``; nothing may read it any more."""
    for name in _held.pop(owner, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``make`` with its result written, and all that it wrote on the way deleted; for results that are small beside the input."""

    @wraps(make)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        own = uuid.uuid4().hex
        with holding(own):
            made = make(docs, *args, **kwargs)
        made = cut(made)
        release(docs.sparkSession, own)
        return made

    return run


def running(rows: DataFrame, group: str, order: list[str], weight: Column) -> DataFrame:
    """``rows`` with _before: the weight of the rows that stand before each one in its group.

    Rows are dealt out to ranges of (group, order), so a group of any size is
    spread over tasks; what stands before a range is summed from the ranges'
    totals. Rows equal in ``order`` stand in any order.
    """
    dealt = cut(rows.repartitionByRange(group, *order).withColumns({"_range": F.spark_partition_id(), "_weight": weight}))
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = dealt.groupBy(group, "_range").agg(F.sum("_weight").alias("_total"))
    first = totals.select(group, "_range", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_first"))
    within = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_within", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return summed.join(first, [group, "_range"]).withColumn("_before", F.col("_first") + F.col("_within")).drop("_range", "_weight", "_first", "_within")


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with c_ before each name, so that no column is named like one that an operator adds."""
    return docs.toDF(*(f"c_{c}" for c in docs.columns))


def unshielded(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns of shielded() under their own names, and ``more``."""
    return df.select(*(F.col(f"`c_{c}`").alias(c) for c in columns), *more)


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of a column as text, modulo; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def slices(column: pa.ChunkedArray | pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``limit`` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def map_texts(df: DataFrame, keep: list[str], text: str, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = BATCH_BYTES) -> DataFrame:
    """Runs ``make`` over slices of (keep..., text) rows; a slice holds a bounded number of bytes."""
    columns = [F.col(c) for c in keep] + [F.coalesce(F.col(text), F.lit("")).alias("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), limit):
                made = make(batch.slice(a, b - a))
                if made is not None and made.num_rows:
                    yield made

    return df.select(*columns).mapInArrow(run, schema)


#: DuckDB has no crc32; this macro's text stands in for it: the reflected polynomial, eight bit steps for each byte.
CRC32_SQL = """(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))))"""
