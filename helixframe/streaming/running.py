"""The bounded-memory accumulators as streaming aggregates: state grows with the keys, not with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features


def running_family_max(acts: DataFrame) -> DataFrame:
    """Each feature's largest activation in each family so far, from a stream of (feat, label, x)."""
    return features.family_max(acts)


def running_moments(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, sum and sum of squares so far; mean and population variance follow from them."""
    sums = values.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*by, "n", mean.alias("mean"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and values by key and window; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
