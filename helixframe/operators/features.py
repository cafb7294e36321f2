"""Feature activations as rows: moments, maxima by family, breadth, top activations and variance shares."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import among_first

def exploded(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row for each key and dimension: (keys..., feat, x)."""
    return vectors.select(*keys, F.posexplode(vector).alias("feat", "x")).withColumn("x", F.col("x").cast("double"))


def moments(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean and population standard deviation."""
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def guarded_means(df: DataFrame, position: list[str], value: str, least: int = 100) -> DataFrame:
    """The mean at each position, 0 where fewer than ``least`` rows contribute."""
    return df.groupBy(*position).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.avg(value)).otherwise(0.0).alias("mean"))


def centered(df: DataFrame, position: list[str], value: str, least: int = 100) -> DataFrame:
    """Rows less their position's guarded mean."""
    means = guarded_means(df, position, value, least).select(*position, "mean")
    return df.join(means, position).withColumn("centered", F.col(value) - F.col("mean")).drop("mean")


def variance_share(df: DataFrame, group: str, dimension: str, value: str) -> DataFrame:
    """Sum of squares between groups over the total, pooled over dimensions; 0 if nothing varies.

    Counts, means and squared deviations of each (group, dimension) are
    merged, so rows are read once and the sums stay centred.
    """
    cells = df.groupBy(group, dimension).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    whole = cells.groupBy(dimension).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    sums = cells.join(whole, dimension).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))).alias("ss_between"),
        F.sum(F.col("n") * F.col("v")).alias("_within"),
        F.sum("n").alias("n"),
    )
    total = F.col("ss_between") + F.col("_within")
    return sums.select("n", "ss_between", total.alias("ss_total"), F.when(total > 0, F.col("ss_between") / total).otherwise(0.0).alias("share"))


def family_max(acts: DataFrame, feature: str = "feat", family: str = "label", value: str = "x") -> DataFrame:
    """(feature, family, max_act): the largest activation, 0 at least."""
    return acts.groupBy(feature, family).agg(F.max(F.greatest(F.col(value), F.lit(0.0))).alias("max_act"))


def breadth(maxima: DataFrame, feature: str = "feat", family: str = "label", share: float = 0.25, strict_dead: bool = True) -> DataFrame:
    """For each feature its maximum, the families in which it reaches ``share`` of it, and its bucket.

    With ``strict_dead`` false, a feature that never fires counts as present in
    every family, as 0 >= 0.
    """
    w = Window.partitionBy(feature)
    top = F.max("max_act").over(w)
    present = (F.col("max_act") >= share * top) & ((top > 0) | F.lit(not strict_dead))
    found = maxima.withColumns({"_top": top, "_here": present}).groupBy(feature).agg(F.max("_top").alias("feat_max"), F.sum(F.col("_here").cast("bigint")).alias("breadth"))
    b = F.col("breadth")
    return found.withColumn("bucket", F.when(F.col("feat_max") == 0, "dead").when(b <= 2, "specialist").when(b <= 9, "moderate").otherwise("generalist"))


def presence(maxima: DataFrame, feature: str = "feat", family: str = "label", share: float = 0.25) -> DataFrame:
    """The (feature, family) rows that count towards breadth."""
    top = F.max("max_act").over(Window.partitionBy(feature))
    return maxima.withColumn("_top", top).where((F.col("max_act") >= share * F.col("_top")) & (F.col("_top") > 0)).drop("_top")


def top_activations(acts: DataFrame, k: int = 8, feature: str = "feat", value: str = "x", ties: list[str] | None = None) -> DataFrame:
    """The k highest positive activations of each feature, ties by ``ties``."""
    order = Window.partitionBy(feature).orderBy(F.desc(value), *(ties or []))
    return acts.where(F.col(value) > 0).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def batch_top(acts: DataFrame, batch: str, k: int, rows: str, value: str = "x", ties: list[str] | None = None) -> DataFrame:
    """The largest activations of each whole batch, k times its number of rows; zeros are dropped.

    Ties are told apart by ``ties``, which leave none. A batch of any size is
    selected from by counts (selection.among_first), not sorted.
    """
    takes = acts.groupBy(batch).agg((F.count_distinct(rows) * k).alias("_take"))
    kept = among_first(acts.where(F.col(value) > 0), [batch], [-F.col(value), *(ties or [])], takes, "_top")
    return kept.where("_top").drop("_top")


def pooled(acts: DataFrame, entity: list[str], feature: str = "feat", value: str = "x") -> DataFrame:
    """Mean and maximum of each feature over an entity's tokens."""
    return acts.groupBy(*entity, feature).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))


def explained_variance(df: DataFrame, value: str, predicted: str, by: list[str]) -> DataFrame:
    """1 - var(residual) / var(input), population variances over all elements; null if the input does not vary."""
    whole = F.var_pop(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.when(whole > 0, 1 - F.var_pop(F.col(value) - F.col(predicted)) / whole).alias("explained"))


def sparsity(acts: DataFrame, rows: str, feature: str = "feat", value: str = "x") -> DataFrame:
    """Mean number of active features of a row, and the share of features that never fire."""
    fired = acts.groupBy(feature).agg(F.max((F.col(value) > 0).cast("int")).alias("f")).agg((1 - F.avg("f")).alias("dead_share"))
    active = acts.groupBy(rows).agg(F.sum((F.col(value) > 0).cast("bigint")).alias("a")).agg(F.avg("a").alias("active"))
    return active.crossJoin(fired)  # one row each


def scatter_traces(acts: DataFrame, group: str, feature: str = "feat", value: str = "x") -> DataFrame:
    """Traces of the total and the between-class scatter, and their ratio."""
    s = variance_share(acts, group, feature, value)
    return s.select(F.col("ss_total").alias("trace_total"), F.col("ss_between").alias("trace_between"), F.col("share").alias("eta"))


def merged_windows(hits: DataFrame, keys: list[str], value: str = "act", start: str = "start") -> DataFrame:
    """One row for each key from overlapping windows: the largest activation, the first window's on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), start)
    return hits.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def kmer_table(df: DataFrame, keys: list[str], sequence: str = "seq", k: int = 3, letters: str = "ACGU") -> DataFrame:
    """(keys..., kmer, n, valid): how often each k-mer over these letters stands in a sequence, and how many valid ones it has.

    One pass over the letters' codes; overlapping k-mers count, and none spans
    two rows. Null and short sequences give no row.
    """
    code = np.full(256, len(letters), np.int64)
    code[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    words = np.array(["".join(w) for w in itertools.product(letters, repeat=k)])

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        text = rows.column(len(keys)).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        own = code[raw]
        row = np.repeat(np.arange(len(text)), np.diff(offsets))
        n = max(0, len(own) - k + 1)
        word, fine = np.zeros(n, np.int64), row[:n] == row[k - 1 :][:n]
        for i in range(k):
            word = word * len(letters) + own[i : i + n]
            fine &= own[i : i + n] < len(letters)
        cells = np.bincount(row[:n][fine] * len(words) + word[fine], minlength=len(text) * len(words)).reshape(len(text), len(words))
        at, which = np.nonzero(cells)
        kept = [rows.column(i).take(pa.array(at)) for i in range(len(keys))]
        return pa.record_batch([*kept, pa.array(words[which].tolist(), pa.string()), pa.array(cells[at, which]), pa.array(cells.sum(1)[at])], [*keys, "kmer", "n", "valid"])

    def run(batches):
        for batch in batches:
            size, a = 0, 0
            for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column(len(keys))), 0).to_pylist()):
                if i > a and size + length > 1 << 21:  # letters that are arrays at once
                    yield count(batch.slice(a, i - a))
                    size, a = 0, i
                size += length
            if batch.num_rows > a:
                yield count(batch.slice(a))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.select(*keys, sequence).mapInArrow(run, f"{kinds}, kmer string, n long, valid long")
