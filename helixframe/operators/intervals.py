"""Membership of points in intervals, where no key but the range itself joins them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .ranking import cumulated

#: Items that a node of a tree of sums holds, in their order.
NODE = 256
#: Lengths are told apart in powers of this; an interval covers so many bins of its power and one more at most.
BASE = 4.0


def _level(length: Column) -> Column:
    """The power of BASE whose bins are as long as the interval or longer; single points have a level of their own."""
    return F.when(length <= 0, F.lit(-1000)).otherwise(F.ceil(F.log(length) / F.log(F.lit(BASE)) - 1e-9)).cast("int")


def _bin(x: Column, level: Column) -> Column:
    """The bin of a value at a level; at that of single points, the value itself."""
    return F.when(level == -1000, x).otherwise(F.floor(x / F.pow(F.lit(BASE), level)).cast("double"))


def members(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, by: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """Each point with each interval [lo, hi) that it lies in, within ``by`` where the two have keys; with ``closed``, hi is inside too.

    Intervals are put into levels by their lengths, whose bins are as long as
    they or longer, so that an interval goes to two bins at most. A point goes
    to one bin of each level that some interval has; both are written first,
    and the levels, a few dozen at most whatever the tables' sizes, are the
    only thing that comes to the driver. Points and intervals of one bin meet
    by an equality that Spark may split where it is hot, and the exact bounds
    are checked then. Overlapping intervals of any lengths are all found.
    Null points and bounds lie nowhere; an interval that ends before it begins
    holds nothing. Columns of the two tables must differ in name, but for ``by``.
    """
    held = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) >= F.col(lo)))
    length = (F.col(hi) - F.col(lo)).cast("double")
    bins = F.sequence(_bin(F.col(lo).cast("double"), F.col("_level")).cast("long"), _bin(F.col(hi).cast("double"), F.col("_level")).cast("long"))
    levelled = written(held.withColumn("_level", _level(length)))
    levels = sorted(r["_level"] for r in levelled.select("_level").distinct().collect())
    if not levels:
        return points.join(intervals.limit(0), list(by)) if by else points.limit(0).crossJoin(intervals.limit(0))
    spread = levelled.withColumn("_bin", F.explode(F.when(F.col("_level") == -1000, F.array(F.col(lo).cast("double"))).otherwise(F.transform(bins, lambda b: b.cast("double")))))
    placed = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.lit(levels))).withColumn("_bin", _bin(F.col(point).cast("double"), F.col("_level")))
    inside = (F.col(point) >= F.col(lo)) & ((F.col(point) <= F.col(hi)) if closed else (F.col(point) < F.col(hi)))
    return placed.join(spread, [*by, "_level", "_bin"]).where(inside).drop("_level", "_bin")


def _tree(places: DataFrame, by: Sequence[str]) -> tuple[DataFrame, int]:
    """(by..., _level, _node, _sums) and the number of levels: each node lists the sums _s of up to NODE items in their order.

    The items of level 0 are the places, those of the next level the nodes of
    the one before, until one node holds them all.
    """
    most = places.agg(F.max("_i")).first()[0] or 0
    items, found = places, []
    while not found or most:
        level, most = len(found), most // NODE
        listed = items.groupBy(*by, F.expr(f"_i div {NODE}").alias("_node")).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_x"))  # NODE items at most
        found.append(written(listed.select(*by, F.lit(level).alias("_level"), "_node", F.col("_x._s").alias("_sums"))))
        items = found[-1].select(*by, F.col("_node").alias("_i"), _total("_sums").alias("_s"))
    return reduce(DataFrame.unionByName, found), len(found)


def _total(items: str | Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def _pieces(first: str, end: str, levels: int) -> Column:
    """The stretches (_level, _node, _from, _length) of nodes that together hold the places from ``first`` to before ``end``, each once: two of a level at most."""
    a, b, out = F.col(first), F.col(end), []
    stretch = lambda level, node, at, length: F.struct(F.lit(level).alias("_level"), node.alias("_node"), (at + 1).cast("int").alias("_from"), length.cast("int").alias("_length"))
    node = lambda i: F.floor(i / NODE)
    for level in range(levels):
        head, tail = node(a), node(b - 1)
        out.append(F.when(a < b, stretch(level, head, a - head * NODE, F.least(b, (head + 1) * NODE) - a)))
        out.append(F.when((a < b) & (head < tail), stretch(level, tail, F.lit(0), b - tail * NODE)))
        a, b = head + 1, F.when(a < b, tail).otherwise(head)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def sums_inside(summed: DataFrame, intervals: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(keys..., n_in, _in): the sums of _n and _s over the places _at in [_lo, _hi), for each of ``keys`` that has any.

    ``summed`` has by..., _at, _n, _s, each place once. Places and bounds are
    numbered in one order (ranking.cumulated), so that an interval is a range
    of places. _n is the difference of running counts. _s is put together from
    stretches of the nodes of a tree of sums: two of a level at most, and a
    level for each power of NODE, however many places lie inside and however
    intervals overlap. No sums are subtracted, so small ones keep their digits
    beside large ones, and what is no number stays in the intervals that hold it.
    """
    held = intervals.where(F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (F.col("_hi") > F.col("_lo"))).select(*keys, "_lo", "_hi")
    bounds = held.select(*by, F.explode(F.array("_lo", "_hi")).alias("_at")).distinct()
    bounds = bounds.select("*", F.lit(None).cast("long").alias("_n"), F.lit(None).cast("double").alias("_s"), F.lit(0).alias("_place"), F.lit(1).alias("_bound"))
    marks = summed.select(*by, "_at", "_n", F.col("_s").cast("double").alias("_s"), F.lit(1).alias("_place"), F.lit(0).alias("_bound")).unionByName(bounds)
    values = marks.groupBy(*by, "_at").agg(*(F.max(c).alias(c) for c in ("_n", "_s", "_place", "_bound")))
    numbered = written(cumulated(values, "_at", ["_place", "_n"], by).withColumnsRenamed({"before__place": "_i", "before__n": "_upto"}))
    tree, levels = _tree(numbered.where("_place = 1").select(*by, "_i", "_s"), by)
    number = lambda bound, side: numbered.where("_bound = 1").select(*by, F.col("_at").alias(bound), F.col("_i").alias(f"_i_{side}"), F.col("_upto").alias(f"_upto_{side}"))
    ranges = held.join(number("_lo", "a"), [*by, "_lo"]).join(number("_hi", "b"), [*by, "_hi"]).where("_i_a < _i_b")
    pieces = ranges.select(*keys, (F.col("_upto_b") - F.col("_upto_a")).alias("_n"), F.posexplode(_pieces("_i_a", "_i_b", levels)).alias("_p", "_x"))
    pieces = pieces.select(*keys, F.when(F.col("_p") == 0, F.col("_n")).otherwise(0).alias("_n"), "_x.*")  # an interval's count goes with its first piece
    within = _total(F.slice("_sums", F.col("_from"), F.col("_length")))
    return pieces.join(tree, [*by, "_level", "_node"]).groupBy(*keys).agg(F.sum("_n").alias("n_in"), F.sum(within).alias("_in"))


def inside_outside(points: DataFrame, intervals: DataFrame, point: str, value: str, interval: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., interval, n_in, mean_in, n_out, mean_out, ratio) for each interval: the means of ``value`` inside and outside of [lo, hi).

    Points of one place are summed first, and an interval gets its sums from
    those of stretches of places (sums_inside), so the work grows with points and
    intervals and not with the pairs of them. What lies outside is what the whole has besides.
    Intervals without a point inside have n_in 0 and no mean; ratio is null
    where the mean outside is not over 0.
    """
    keys = [*by, interval]
    sums = points.where(F.col(point).isNotNull() & F.col(value).isNotNull()).groupBy(*by, F.col(point).alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    summed = written(sums)
    found = sums_inside(summed, intervals.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), keys, by)
    whole = summed.groupBy(*by).agg(F.sum("_n").alias("_all"), F.sum("_s").alias("_total"))
    if by:
        joined = intervals.select(*keys).join(found, keys, "left").join(whole, list(by), "left")
    else:
        one = whole.first()
        joined = intervals.select(*keys).join(found, keys, "left").withColumns({"_all": F.lit(one["_all"]).cast("long"), "_total": F.lit(one["_total"]).cast("double")})
    n_in = F.coalesce("n_in", F.lit(0))
    n_out = F.coalesce("_all", F.lit(0)) - n_in
    mean_in, mean_out = F.when(n_in > 0, F.col("_in") / n_in), F.when(n_out > 0, (F.col("_total") - F.coalesce("_in", F.lit(0.0))) / n_out)
    return joined.select(*keys, n_in.alias("n_in"), mean_in.alias("mean_in"), n_out.alias("n_out"), mean_out.alias("mean_out"), F.when(mean_out > 0, mean_in / mean_out).alias("ratio"))
