"""Shards of near equal bytes: a k-d tree over the documents' metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import cut, holding, release, running, settled

#: Bytes that a row is charged besides its text.
ROW_BYTES = 16
#: Low bits of a tie that tell repeated rows apart; the bits above them come from id and text.
PLACE_BITS = 20


def codes(rows: DataFrame, column: str) -> DataFrame:
    """(column, _code): the rank of each distinct value, so that values of any length keep their whole order."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_all", F.lit(0))
    return running(values, "_all", [column], F.lit(1)).select(column, F.col("_before").alias("_code"))


def _split(rows: DataFrame, dimensions: list[str], whole: dict[str, float]) -> DataFrame:
    """One level: every box of two leaves or more is cut at the weighted median of its widest dimension.

    A box is named by its first leaf. With an odd number of leaves the cut is
    next to the median, so that each leaf has its share of the bytes. A row
    goes below if its middle does. Ties in the dimension go by _tie.
    """
    bounds = [f(d).cast("double").alias(f"{k}{d}") for d in dimensions for k, f in (("a", F.min), ("b", F.max))]
    stats = rows.groupBy("_box").agg(F.sum("size").alias("_bytes"), F.min("_leaves").alias("_of"), *bounds)
    widths = [F.struct(F.coalesce((F.col(f"b{d}") - F.col(f"a{d}")) / F.lit(whole[d]), F.lit(0.0)).alias("width"), F.lit(-i).alias("i")) for i, d in enumerate(dimensions)]
    widest = -F.greatest(*widths)["i"] if len(widths) > 1 else F.lit(0)
    goal = F.col("_bytes") * F.floor(F.col("_of") / 2) / F.col("_of")
    # Boxes are few where they are large; where they are many, none is hot, and Spark joins them by _box.
    boxes = cut(stats.select("_box", widest.alias("_widest"), goal.alias("_goal")))
    joined = rows.join(boxes, "_box").withColumn("_v", F.get(F.array(*(F.col(d).cast("double") for d in dimensions)), F.col("_widest")))
    placed = running(joined, "_box", ["_v", "_tie"], F.col("size"))
    below, half = F.col("_before") + F.col("size") / 2 < F.col("_goal"), F.floor(F.col("_leaves") / 2).cast("int")
    return placed.withColumns({"_box": F.when(below, F.col("_box")).otherwise(F.col("_box") + half), "_leaves": F.when(below, half).otherwise(F.col("_leaves") - half)}).drop("_widest", "_goal", "_v", "_before")


def grow(rows: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """``rows`` with ``shard``: boxes are split until ``shards`` leaves are left, all boxes of one level together.

    ``rows`` has the dimensions as numbers, _tie and size. Widths are shares
    of the whole table's range; nulls come first and have no width. Each level
    is written before the next, and the one before it is deleted. No box,
    bound or median passes through the driver but the whole table's range.
    """
    spread = rows.agg(*((F.max(d) - F.min(d)).cast("double").alias(d) for d in dimensions)).first()
    whole = {d: spread[d] or 1.0 for d in dimensions}
    rows, done, levels = rows.withColumns({"_box": F.lit(0), "_leaves": F.lit(shards)}), [], []
    for _ in range(max(0, shards - 1).bit_length()):
        levels.append(uuid.uuid4().hex)
        with holding(levels[-1]):
            rows = cut(_split(rows, dimensions, whole))
        if len(levels) > 1 and len(done) == 0:
            release(rows.sparkSession, levels[-2])
        if shards >> len(levels) <= 1:  # from here on boxes may have one leaf
            done.append(rows.where("_leaves = 1"))
        rows = rows.where("_leaves > 1")
    for part in done:
        rows = rows.unionByName(part)
    return rows.withColumnRenamed("_box", "shard").drop("_leaves")


@settled
def shard(docs: DataFrame, shards: int = 40, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Puts every document into one of ``shards`` shards of near equal bytes.

    With ``target_bytes`` the number of shards follows from the total. A
    document's size is the UTF-8 bytes of its text (a null text has none) plus
    ROW_BYTES. Returns id, size, text_crc32, law, shard, slot and grown_shard.
    Dimensions that are no numbers count by the rank of their distinct values.
    Documents alike in all dimensions are told apart by a hash of id and text,
    and repeated rows by a hash of their place in the input, so no group is
    too large for a shard. Nulls in a dimension come first. An empty table
    gives no rows; further columns are not read.
    """
    raw = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    own = F.shiftleft(F.shiftright(F.xxhash64(id_column, text_column), PLACE_BITS), PLACE_BITS)
    tie = own.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS))
    names = [f"_d{i}" for i in range(len(dimensions))]
    found = docs.select(
        F.col(id_column).alias("_id"), (F.length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), tie.alias("_tie"), *(F.col(c).alias(n) for c, n in zip(dimensions, names, strict=True))
    )
    rows = cut(found)
    for name in names:
        if not isinstance(rows.schema[name].dataType, NumericType):
            ranked = cut(codes(rows, name))
            rows = rows.join(ranked, name, "left").drop(name).withColumnRenamed("_code", name)
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = running(grow(cut(rows), names, shards), "shard", ["_tie", "_id"], F.lit(1))
    return placed.select(F.col("_id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
