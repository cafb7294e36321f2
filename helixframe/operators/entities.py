"""Entity tables: first-row lookups, shared keys, labels, splits and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import cumulated
from .selection import among_first, medians


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_per_group(df: DataFrame, group: str, order: list[str | Column], n: int, name: str = "nth") -> DataFrame:
    """At most n rows of each group in this order, numbered from 1: a sampling operator."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).where(F.col(name) <= n)


def lookup(df: DataFrame, side: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """``df`` with the side's columns, and these values where it has no row."""
    out = df.join(side, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def shared_entities(frames: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first frame joined with all others, where each has the key."""
    return reduce(lambda a, b: a.join(b, key), frames)


def dense_codes(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, code) with codes from 0 in the order of distinct values."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return cumulated(distinct, value, ["_one"]).select(value, F.col("before__one").cast("bigint").alias(name))


def first_of_text(df: DataFrame, text: str, key: str) -> DataFrame:
    """The least key of each text; texts are told apart by 128 bits of hash and their lengths, so they are not shuffled themselves."""
    return df.groupBy(F.md5(text).alias("_m"), F.length(text).alias("_l")).agg(F.min(key).alias(key)).select(key)


def numbered(df: DataFrame, order: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in an order without ties, within ``by`` or over everything; no task has all rows."""
    rows = df.withColumns({"_order": order, "_one": F.lit(1)})
    return cumulated(rows, "_order", ["_one"], by or []).withColumnRenamed("before__one", name).drop("_order", "_one")


def truncated(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of a seeded order: a sampling operator."""
    return df.orderBy(*order).limit(n)


def stride_sample(df: DataFrame, order: Column, step: int) -> DataFrame:
    """Every ``step``-th row of an order without ties, from the first on: a sampling operator."""
    return numbered(df, order, "_n").where(F.col("_n") % step == 0).drop("_n")


def stratified_folds(df: DataFrame, label: str, order: Column, folds: int = 5) -> DataFrame:
    """Adds ``fold``: each class is dealt out evenly in an order without ties."""
    return numbered(df, order, "_n", [label]).withColumn("fold", (F.col("_n") % folds).cast("int")).drop("_n")


def allowed_families(df: DataFrame, family: str, most: int) -> DataFrame:
    """The rows of the ``most`` largest families."""
    top = df.where(F.col(family).isNotNull()).groupBy(family).count().orderBy(F.desc("count"), family).limit(most)
    return df.join(top.select(family), family, "left_semi")


def cv_summary(folds: DataFrame, score: str) -> DataFrame:
    """Folds, their mean and population deviation."""
    return folds.agg(F.count(score).alias("folds"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def top_k_accuracy(df: DataFrame, truth: str, scores: str, k: int) -> DataFrame:
    """Rows, and the share whose true class (a place in the array of scores) has fewer than k classes above it."""
    own = F.get(scores, F.col(truth))
    above = F.aggregate(scores, F.lit(0), lambda n, x: n + F.when(x > F.get(scores, F.col(truth)), 1).otherwise(0))
    return df.where(own.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((above < k).cast("double")).alias("accuracy"))


def merged_panels(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both, the second's where both have the key."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(0)))
    return keep_first(both, [key], ["_p"]).drop("_p")


def population_label(positive: Column, seen: Column) -> Column:
    """1 for positives, 0 for what the population has, null for both or neither."""
    return F.when(positive & ~seen, 1).when(seen & ~positive, 0).cast("bigint")


def family_rollup(df: DataFrame, family: str, score: str, value: str, example: str) -> DataFrame:
    """For each family: rows, highest and median score, highest value, and the id of the highest score.

    The median is selected by counts over ranges, so that no task holds a
    family's scores; it is null in a family without scores.
    """
    best = F.min_by(example, F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(example))))  # a null would come before all scores
    sums = df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("max_p"), F.max(value).alias("max_value"), best.alias("example"))
    middle = medians(df, [family], score, "median_p").withColumnRenamed(family, "_family")
    return sums.join(middle, F.col(family).eqNullSafe(F.col("_family")), "left").select(family, "n", "max_p", "median_p", "max_value", "example")


def wide_consensus(df: DataFrame, key: str, model: str, score: str, models: list[str]) -> DataFrame:
    """A column for each model, their least and mean, for entities that all models score."""
    wide = df.groupBy(key).agg(*(F.max(F.when(F.col(model) == m, F.col(score))).alias(f"p_{m}") for m in models))
    columns = [F.col(f"p_{m}") for m in models]
    full = reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))
    return wide.where(full).withColumns({"p_min": F.least(*columns), "p_mean": sum(columns[1:], columns[0]) / len(columns)})


def mean_maps(maps: DataFrame, gene: str = "gene", model: str = "model", position: str = "pos", score: str = "score") -> DataFrame:
    """Each gene's mean score at each position, over models; genes with one model or unequal lengths are left out."""
    lengths = maps.groupBy(gene, model).agg(F.count(F.lit(1)).alias("l"))
    fit = lengths.groupBy(gene).agg(F.count(F.lit(1)).alias("m"), F.min("l").alias("a"), F.max("l").alias("b")).where("m >= 2 AND a = b")
    return maps.join(fit.select(gene), gene, "left_semi").groupBy(gene, position).agg(F.avg(score).alias("score"))


def stratified_split(df: DataFrame, group: str, order: list[str | Column], share: float = 0.25) -> DataFrame:
    """Adds ``test``: in each group the first max(1, round(share n)) rows of the order, which leaves no ties; groups of one are all train."""
    size = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("bigint"))).otherwise(0)
    takes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).select(group, size.alias("_take"))
    return among_first(df, [group], order, takes, "test")


def tail_split(df: DataFrame, order: list[str | Column], share: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adds ``tail``: the last floor(share n) rows of the order, which leaves no ties, within ``by`` or of all."""
    sizes = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("_n"))
    takes = sizes.select(*(by or []), (F.col("_n") - F.floor(F.col("_n") * share)).alias("_take"))
    return among_first(df, by or [], order, takes, "_head").withColumn("tail", ~F.col("_head")).drop("_head")


def _greedy(sizes: list[tuple[int, int]], folds: int) -> list[tuple]:
    """(size, [(first place, fold)], place from which the folds of the last list take turns, that list) for (size, number of groups), largest first."""
    loads, out = [0] * folds, []
    for size, many in sizes:
        at, runs = 0, []
        while at < many and max(loads) - min(loads) >= size:
            (low, f), (next_low, g) = sorted((x, i) for i, x in enumerate(loads))[:2] if folds > 1 else ((loads[0], 0), (loads[0], 0))
            times = max(1, -(-(next_low - low + (f < g)) // size)) if folds > 1 else many
            times = min(times, many - at)
            runs.append((at, f))
            loads[f] += times * size
            at += times
        turns = [i for _, i in sorted((x, i) for i, x in enumerate(loads))]
        for place, f in enumerate(turns):
            loads[f] += size * ((many - at + folds - 1 - place) // folds)
        out.append((size, [a for a, _ in runs], [f for _, f in runs], at, turns))
    return out


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): groups largest first, each to the fold of the least rows so far.

    Groups of one size are alike, so only the sizes and how many groups have
    each pass through the driver, which finds the folds' turns; a group's fold
    follows from its place among those of its size.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    sizes = [(r["_size"], r["n"]) for r in counts.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_size")).collect()]
    plan = df.sparkSession.createDataFrame(_greedy(sizes, folds), "_size long, _at array<long>, _to array<int>, _from long, _turns array<int>")
    named = counts.where(F.col(group).isNotNull()).withColumn("_one", F.lit(1))
    placed = cumulated(named, group, ["_one"], ["_size"]).join(plan, "_size")
    n = F.col("before__one")
    early = F.get("_to", F.size(F.filter("_at", lambda a: a <= n)) - 1)
    return placed.select(group, F.when(n < F.col("_from"), early).otherwise(F.get("_turns", ((n - F.col("_from")) % folds).cast("int"))).alias("fold"))


def permuted_labels(df: DataFrame, key: str, label: str, order: Column | None = None, seed: int = 0) -> DataFrame:
    """(key, label) with the labels dealt out anew: a negative control. The i-th key gets the label of the i-th row of ``order``, else of a seeded hash; keys are distinct."""
    keys = numbered(df.select(key), F.col(key), "_i")
    labels = numbered(df.select(key, label), F.xxhash64(key, F.lit(seed)) if order is None else order, "_i").drop(key)
    return keys.join(labels, "_i").select(key, label)


def classifier_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows, accuracy, and the mean F1 over classes that the truth has."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    right = cells.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    called = cells.groupBy(F.col(predicted).alias("c")).agg(F.sum("n").alias("called"))
    each = right.join(called, "c", "left")
    f1 = 2 * F.col("tp") / (F.col("support") + F.coalesce("called", F.lit(0)))
    return each.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def profile(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """For each column its filled rows and distinct values, and each of its ``most`` commonest values: a report."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where(F.trim(F.coalesce("value", F.lit(""))) != "")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    ranked = counts.withColumns({"filled": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "value")).cast("bigint")})
    return ranked.where(F.col("rank") <= most)


def value_add(results: DataFrame, key: str, block: str, score: str, full: str, base: str) -> DataFrame:
    """For each contrast the score of the full block less that of the base; contrasts without both are left out."""
    of = lambda b: F.max(F.when(F.col(block) == b, F.col(score)))
    both = results.groupBy(key).agg(of(full).alias("full"), of(base).alias("base"))
    return both.where(F.col("full").isNotNull() & F.col("base").isNotNull()).withColumn("delta", F.col("full") - F.col("base"))


def rediscovery(df: DataFrame, name: str, score: str, groups: dict[str, list[str]]) -> DataFrame:
    """Mean score and size of each named group of families, by their prefixes; the first group that fits counts."""
    label = F.lit("other")
    for g, prefixes in reversed(list(groups.items())):
        fits = F.lit(False)
        for p in prefixes:
            fits = fits | F.startswith(F.col(name), F.lit(p))
        label = F.when(fits, g).otherwise(label)
    return df.groupBy(label.alias("named")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
