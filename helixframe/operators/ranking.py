"""Ranks, areas under curves, correlations and their tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from .selection import SENT, among_first, order_statistics, with_state

#: Rows of a range, which a task may put in order.
RANGE_ROWS = 1 << 16


def _same(by: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in by))


def _cumulated(values: DataFrame, value: str, weights: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, int]:
    """cumulated(), and the number of its rows."""
    held = written(values)
    n = held.count()
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if n <= RANGE_ROWS:
        return held.withColumns({f"before_{w}": F.coalesce(F.sum(w).over(upto(*by)), F.lit(0)) for w in weights}), n
    dealt = written(held.repartitionByRange(-(-n // RANGE_ROWS), *by, value).withColumn("_range", F.spark_partition_id()))
    keys = [*by, "_range"]
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of a group's ranges
    totals = dealt.groupBy(*keys).agg(*(F.sum(w).alias(f"_t_{w}") for w in weights))
    first = written(totals.select(*keys, *(F.coalesce(F.sum(f"_t_{w}").over(ahead), F.lit(0)).alias(f"_o_{w}") for w in weights)))
    summed = dealt.withColumns({f"before_{w}": F.coalesce(F.sum(w).over(upto(*keys)), F.lit(0)) for w in weights})
    placed = with_state(summed, first, keys)
    return placed.withColumns({f"before_{w}": F.col(f"before_{w}") + F.col(f"_o_{w}") for w in weights}).select(*values.columns, *(f"before_{w}" for w in weights)), n


def cumulated(values: DataFrame, value: str, weights: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``values`` (one row for each distinct value of a group) with ``before_<w>``: the sum of each weight over the group's smaller values.

    The rows are written and counted. Beyond RANGE_ROWS they are dealt out to
    ranges of (by, value), as many as there are times RANGE_ROWS rows; windows
    run within the ranges, and what stands before a range is added up from the
    ranges' sums. So a group of any size is spread over tasks that follow it.
    """
    return _cumulated(values, value, weights, by)[0]


def _ranked(df: DataFrame, ranks_of: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the average rank that its value has in ``ranks_of``."""
    counts = ranks_of.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed, n = _cumulated(counts, value, ["_ties"], by)
    ranked = placed.select(*(F.col(k).alias(f"_r_{k}") for k in (*by, value)), (F.col("before__ties") + (F.col("_ties") + 1) / 2).alias(name))
    ranked = F.broadcast(ranked) if n <= SENT else ranked
    same = F.col(value) == F.col(f"_r_{value}")
    return df.join(ranked, _same(by, "_r_") & same if by else same, "left").drop(*(f"_r_{k}" for k in (*by, value)))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based ranks in which ties share their mean, within ``by`` or over everything; null for a null.

    Values are counted before they are ranked, so a frequent one costs nothing,
    and rows meet their value's rank in a join that Spark may split.
    """
    return _ranked(df, df, value, by, name)


def mann_whitney(df: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """For each group n_pos, n_neg, auc, z (without tie correction), the positives' mean rank share, and u with the sum of t^3 - t over ties.

    auc and z are null if a class is empty. Values are counted before they are
    ranked, so ties cost nothing.
    """
    held = df.where(F.col(score).isNotNull())
    values = held.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.when(positive, 1).otherwise(0)).alias("_p"))
    ranked = cumulated(values, score, ["_c"], by).withColumn("_r", F.col("before__c") + (F.col("_c") + 1) / 2)
    c = F.col("_c").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum("_p").alias("n_pos"), F.sum(F.col("_r") * F.col("_p")).alias("_ranks"), F.sum(c * c * c - c).alias("ties"))
    sums = sums.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pairs = (F.col("n_pos") * F.col("n_neg")).cast("double")
    u = F.col("_ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return sums.select(
        *by, "n_pos", "n_neg",
        F.when(both, u / pairs).alias("auc"),
        F.when(both, (u - pairs / 2) / F.sqrt(pairs * (F.col("n") + 1) / 12)).alias("z"),
        F.when(F.col("n_pos") > 0, F.col("_ranks") / F.col("n_pos") / F.col("n")).alias("mean_percentile"),
        u.alias("u"), "ties",
    )


def corrected_p(tested: DataFrame) -> DataFrame:
    """mann_whitney()'s rows with ``p``: two-sided, with tie and continuity correction."""
    n, pairs = (F.col("n_pos") + F.col("n_neg")).cast("double"), (F.col("n_pos") * F.col("n_neg")).cast("double")
    spread = F.sqrt(pairs / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - pairs / 2) - 0.5) / F.nullif(spread, F.lit(0.0))
    return tested.withColumn("p", F.when(F.col("auc").isNotNull(), F.when(z <= 0, 1.0).otherwise(two_sided_p(z))))


#: A Chebyshev fit of the complementary error function, off by 1.2e-7 of it at most.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_p(z: Column | str) -> Column:
    """The normal two-sided tail, by built-in functions."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = reduce(lambda s, c: s * t + c, reversed(ERFC), F.lit(0.0))
    return t * F.exp(power - x * x)


def binomial_tail(k: Column | str, n: Column | str, p: Column) -> Column:
    """P(at least k of n); each term follows from the one before it."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (k, n))
    start = F.struct((n * F.log(1 - p)).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    ratio = lambda i: F.log(F.greatest(n - i, F.lit(1e-300)) / (i + 1) * p / (1 - p))
    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, lambda s, i: F.struct((s["log"] + ratio(i)).alias("log"), (s["sum"] + F.when(i >= k, F.exp(s["log"])).otherwise(0.0)).alias("sum")))["sum"]


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r for each group; 0 if either does not vary."""
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.covar_pop(x, y) / spread, F.lit(0.0)).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r of average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = _ranked(_ranked(both.select(*by, x, y), both, x, by, "_rx"), both, y, by, "_ry")
    return correlation(ranked, "_rx", "_ry", by)


def named_percentiles(scores: DataFrame, named: DataFrame, by: list[str], position: str = "pos", score: str = "score") -> DataFrame:
    """Rank (highest first, earlier position on ties) and 1 - (rank - 1) / length of the named positions.

    Positions are placed over ranges that follow the rows, so a group of any
    length is spread over tasks.
    """
    rows = scores.select(*by, position, F.struct((-F.col(score)).alias("s"), F.col(position).alias("p")).alias("_order"), F.lit(1).alias("_one"))
    ranked = cumulated(rows, "_order", ["_one"], by)
    found = ranked.join(named.select(*by, position).distinct(), [*by, position], "left_semi")
    lengths = written(scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_l")))
    placed = with_state(found.withColumn("rank", F.col("before__one") + 1), lengths, by)
    return placed.select(*by, position, "rank", (1 - (F.col("rank") - 1) / F.col("_l")).alias("percentile"))


def top_positions(length: Column, share: float, rounded: bool) -> Column:
    """How many positions make the top share, one at least; both conventions, half to even or cut off."""
    return F.greatest(F.lit(1), (F.bround(length * share) if rounded else F.floor(length * share)).cast("bigint"))


def region_enrichment(scores: DataFrame, regions: DataFrame, by: list[str], share: float = 0.15, rounded: bool = True) -> DataFrame:
    """Means inside and outside of each group's region [lo, hi] (1-based), their ratio, and the top positions' share inside.

    ``scores`` has pos and score, ``regions`` lo and hi; regions without a
    position inside or outside give no row.
    """
    lengths = written(scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_l")))
    takes = lengths.select(*by, top_positions(F.col("_l"), share, rounded).alias("_take"))
    placed = among_first(scores.select(*by, "pos", "score"), by, [-F.col("score"), "pos"], takes, "_first")
    named = written(with_state(regions.select(*by, "lo", "hi"), lengths, by))
    marked = with_state(placed, named, by).withColumn("_in", F.col("pos").between(F.col("lo"), F.col("hi")))
    grouped = marked.groupBy(*by, "lo", "hi").agg(
        F.avg(F.when(F.col("_in"), F.col("score"))).alias("mean_in"), F.avg(F.when(~F.col("_in"), F.col("score"))).alias("mean_out"),
        F.avg(F.col("_in").cast("double")).alias("region_share"), F.max("_l").alias("_n"), F.sum(F.when(F.col("_in") & F.col("_first"), 1).otherwise(0)).alias("_top"),
    )
    hit = F.col("_top") / top_positions(F.col("_n"), share, rounded)
    kept = grouped.where(F.col("mean_in").isNotNull() & F.col("mean_out").isNotNull())
    return kept.select(*by, "lo", "hi", "mean_in", "mean_out", F.when(F.col("mean_out") > 0, F.col("mean_in") / F.col("mean_out")).alias("ratio"), "region_share", hit.alias("top_share"), (hit / F.col("region_share")).alias("fold"))


def novel_positions(scores: DataFrame, annotated: DataFrame, by: list[str], pad: int = 2, limit: int = 10) -> DataFrame:
    """The highest positions that are more than ``pad`` away from every annotated one; a reported top list of each group."""
    near = annotated.select(*by, F.explode(F.sequence(F.col("pos") - pad, F.col("pos") + pad)).alias("pos")).distinct()
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "pos")
    return scores.join(near, [*by, "pos"], "left_anti").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def scaled(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds ``by_max`` (value over the group's maximum, or over 1 if that is 0) and ``by_range`` (0 if there is no range)."""
    w = Window.partitionBy(*by)
    top, low = F.max(value).over(w), F.min(value).over(w)
    return df.withColumns({"by_max": F.col(value) / F.when(top == 0, 1.0).otherwise(top), "by_range": F.when(top > low, (F.col(value) - low) / (top - low)).otherwise(0.0)})


def quantile_cut(df: DataFrame, value: str, by: list[str], share: float) -> DataFrame:
    """Rows at or below the value that stands at max(0, floor(share n) - 1) in each group's order, and that value as ``cut``."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.withColumn("_place", F.greatest(F.lit(0), F.floor(F.col("_n") * share) - 1))
    cuts = order_statistics(df, by, value, wanted).select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_value").alias("cut"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by))
    return df.join(cuts, same).where(F.col(value) <= F.col("cut")).drop(*(f"_k_{k}" for k in by))


def cumulative_threshold(df: DataFrame, order: str, value: str, by: list[str], share: float) -> DataFrame:
    """The first place at which the running sum reaches a share of the total, for each group; the order leaves no ties.

    Running sums are made over ranges that follow the rows (cumulated).
    """
    rows = df.select(*by, order, value, F.lit(1).alias("_one"))
    totals = written(rows.groupBy(*by).agg(F.sum(value).alias("_t"), F.count(F.lit(1)).alias("_d")))
    run = with_state(cumulated(rows, order, [value, "_one"], by), totals, by)
    there = F.col(f"before_{value}") + F.coalesce(F.col(value), F.lit(0)) >= share * F.col("_t") - 1e-12
    return run.groupBy(*by).agg(F.coalesce(F.min(F.when(there, F.col("before__one") + 1)), F.max("_d")).cast("bigint").alias("reached"))
