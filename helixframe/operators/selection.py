"""Exact order statistics and first rows of groups of any size, by counts over ranges instead of a sort of the group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

#: Rows of a group, or of a range of one, that a task may put in order.
LIMIT = 1 << 17
#: Values that cut a group's open range at once, and the accuracy of the sketch that proposes them.
CUTS, ACCURACY = 64, 1000
#: So many rows of a small table go to every task; beyond, tables are joined as they are.
SENT = 100_000
_ALL = "_all"


def with_state(rows: DataFrame, state: DataFrame, by: Sequence[str], how: str = "inner", size: int | None = None) -> DataFrame:
    """``rows`` with the columns that ``state`` has besides the keys ``by``; nulls are keys too. ``state`` is a written table, or ``size`` says how many rows it has."""
    keyed = state.select(*(F.col(k).alias(f"_k_{k}") for k in by), *(c for c in state.columns if c not in by))
    keyed = F.broadcast(keyed) if (keyed.count() if size is None else size) <= SENT else keyed
    if not by:
        return rows.crossJoin(keyed)  # one row, as there are no keys
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by))
    return rows.join(keyed, same, how).drop(*(f"_k_{k}" for k in by))


def _narrowed(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One round for the wanted places whose range holds too many rows: (the places that a cut's own value answers, the others with smaller ranges).

    A sketch proposes cuts of each range, which are values in it. Rows are
    counted at each cut and between cuts, and the place lies in one of these.
    """
    keys = [*by, "_place"]
    here = with_state(rows, state, by).where(_inside())
    cuts = here.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], ACCURACY))).alias("_cuts"))
    held = written(_matched(state, cuts, keys))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    at_cut = F.coalesce(F.get("_cuts", below) == F.col("_v"), F.lit(False)).cast("int")
    counts = with_state(rows, held, by).where(_inside()).groupBy(*keys, (2 * below + at_cut).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))  # two rows for each cut and one more at most
    reached = _matched(held, counts.withColumn("_upto", upto), keys).where(F.col("_before") + F.col("_upto") > F.col("_place"))
    bins = reached.groupBy(*keys).agg(F.min(F.struct("_bin", "_upto", "_c", "_before", "_cuts", "_lo", "_hi")).alias("_x")).select(*keys, "_x.*")
    at = F.floor(F.col("_bin") / 2).cast("int")
    next_ = bins.select(
        *keys, (F.col("_bin") % 2 == 1).alias("_done"), F.get("_cuts", at).alias("_value"), F.coalesce(F.when(at > 0, F.get("_cuts", F.greatest(at - 1, F.lit(0)))), F.col("_lo")).alias("_lo"), F.coalesce(F.get("_cuts", at), F.col("_hi")).alias("_hi"),
        (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"), F.col("_c").alias("_n"),
    )
    next_ = written(next_)
    return next_.where("_done").select(*keys, "_value", "_before"), next_.where("NOT _done").select(*keys, "_lo", "_hi", "_before", "_n")


def _matched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tables' rows of equal keys, nulls among them."""
    other = b.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    return a.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))).drop(*(f"_k_{k}" for k in keys))


def _inside() -> Column:
    return (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))


def order_statistics(df: DataFrame, by: Sequence[str], value: str | Column, wanted: DataFrame) -> DataFrame:
    """(by..., _place, _value, _before): the value at each wanted place of its group, from 0 in ascending order, and how many rows have a smaller one.

    ``wanted`` has by..., _place, and _n, the group's rows with a value. A place
    begins with its whole group as its open range, and rounds of counts narrow
    it until LIMIT rows are left, which are counted by value and put in order.
    Each round needs two aggregations of what a range holds, with partial sums
    before the shuffle; a group of any size gives a few rows for each task.
    Numbers, dates and times can be selected; nulls are left out.
    """
    if not by:
        return order_statistics(df.withColumn(_ALL, F.lit(0)), [_ALL], value, wanted.withColumn(_ALL, F.lit(0))).drop(_ALL)
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, column.alias("_v")).where("_v IS NOT NULL")
    kind = rows.schema["_v"].dataType
    keys = [*by, "_place"]
    state = wanted.select(*keys, *(F.lit(None).cast(kind).alias(c) for c in ("_lo", "_hi")), F.lit(0).cast("long").alias("_before"), F.col("_n").cast("long").alias("_n")).where("_place >= 0 AND _place < _n")
    size, hot = state.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > LIMIT)).first()
    state = written(state) if hot else state
    found = []
    while True:
        few = state.where(F.col("_n") <= LIMIT)
        here = with_state(rows, few, by, size=size).where(_inside())
        counts = here.groupBy(*keys, "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
        reached = counts.withColumn("_upto", upto).where(F.col("_upto") > F.col("_place"))
        found.append(reached.groupBy(*keys).agg(F.min(F.struct("_v", (F.col("_upto") - F.col("_c")).alias("b"))).alias("_x")).select(*keys, F.col("_x._v").alias("_value"), F.col("_x.b").alias("_before")))
        if not hot:
            return reduce(DataFrame.unionByName, found)
        large = state.where(F.col("_n") > LIMIT)
        if len(found) == 1:
            rows = written(with_state(rows, large.select(*by).distinct(), by))  # the large groups' values alone from here on
        done, state = _narrowed(rows, large, by)
        found.append(done)
        size, hot = state.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > LIMIT)).first()


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(by..., name): the middle value of each group, or the mean of the middle two; a group without values has no row."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.withColumn("_place", F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))))
    return order_statistics(df, by, F.col(value).cast("double"), wanted).groupBy(*by).agg(F.avg("_value").alias(name))


def among_first(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], takes: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first ``_take`` rows of its group in this order.

    ``takes`` has by... and _take; groups it lacks have no first rows. The
    order's columns are numbers, dates or times, ascending with nulls first,
    and leave no ties. Groups of LIMIT rows or fewer are numbered in a window.
    Of a larger one the last row that counts is found column by column: the
    value of the first column at its place, of the second among the rows that
    share it, and so on; rows up to it are the first ones. No task has a large
    group's rows.
    """
    by = list(by) or [_ALL]
    own = df.withColumn(_ALL, F.lit(0)) if by == [_ALL] else df
    takes = takes.withColumn(_ALL, F.lit(0)) if by == [_ALL] and _ALL not in takes.columns else takes
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = [p for c in columns for p in (c.isNotNull().cast("int"), c)]
    named = own.withColumns({f"_o{i}": p for i, p in enumerate(parts)})
    sizes = _matched(own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), takes.select(*by, F.col("_take").cast("long").alias("_take")), by)
    is_hot = (F.col("_n") > LIMIT) & (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
    groups, large, many = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > LIMIT), F.count_if(is_hot)).first()
    ordered = [f"_o{i}" for i in range(len(parts))]
    if not large:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(*ordered))
        rows = with_state(named, takes.select(*by, F.col("_take").cast("long").alias("_take")), by, "left", groups)
        return rows.withColumn(name, F.coalesce(number <= F.col("_take"), F.lit(False))).select(*df.columns, name)
    sizes = written(sizes)
    hot = sizes.where(is_hot)
    bounds = hot.select(*by, F.col("_take").alias("_left"))
    for i in range(len(parts) if many else 0):
        # Among the rows that share the last row's values so far; where it has a null, the values' column has nothing to select.
        bounds = written(bounds)
        tied = with_state(named, bounds, by).where(reduce(lambda a, b: a & b, (F.col(f"_o{j}").eqNullSafe(F.col(f"_t{j}")) for j in range(i)), F.lit(True)))
        some = tied.where(F.col(f"_o{i}").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        wanted = _matched(bounds.select(*by, (F.col("_left") - 1).alias("_place")), some, by)
        last = order_statistics(tied, by, f"_o{i}", wanted).select(*by, F.col("_value").alias(f"_t{i}"), F.col("_before").alias("_before"))
        other = last.select(*(F.col(k).alias(f"_k_{k}") for k in by), f"_t{i}", "_before")
        joined = bounds.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by)), "left").drop(*(f"_k_{k}" for k in by))
        bounds = joined.withColumn("_left", F.col("_left") - F.coalesce("_before", F.lit(0))).drop("_before")
    kinds = {f"_t{i}": named.schema[f"_o{i}"].dataType for i in range(len(parts))}
    for c, kind in kinds.items():
        if c not in bounds.columns:
            bounds = bounds.withColumn(c, F.lit(None).cast(kind))
    told = written(sizes.join(bounds.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.lit(True).alias("_hot"), *kinds), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by)), "left").drop(*(f"_k_{k}" for k in by)))
    rows = with_state(named, told, by, "left")
    upto, equal = F.lit(False), F.lit(True)
    for i in range(len(parts)):
        o, t = F.col(f"_o{i}"), F.col(f"_t{i}")
        upto = upto | (equal & F.coalesce(o < t, F.lit(False)))
        equal = equal & o.eqNullSafe(t)
    # A large group's rows are spread over windows that nobody asks.
    rows = rows.withColumn("_salt", F.when(F.col("_n") > LIMIT, F.pmod(F.xxhash64(*ordered), F.lit(1 << 30))).otherwise(0))
    number = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*ordered))
    first = F.when(F.col("_hot"), upto | equal).when(F.col("_n") > LIMIT, F.col("_take") >= F.col("_n")).otherwise(number <= F.col("_take"))
    return rows.withColumn(name, F.coalesce(first, F.lit(False))).select(*df.columns, name)
