"""Agreement of feature sets across models: shared families, Jaccard pairs and reciprocal best matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def _sets(p: DataFrame, least: int, most: int, feature: str, family: str) -> DataFrame:
    """(f, fams, n): each feature's set of families, if it has ``least`` to ``most``; a set is that short by the band."""
    counted = p.select(F.col(feature).alias("f"), F.col(family).alias("family")).where("family IS NOT NULL").distinct()
    # A feature of too many families is left out before its set is put together.
    upto = counted.withColumn("_rn", F.row_number().over(Window.partitionBy("f").orderBy("family"))).where(F.col("_rn") <= most + 1)
    return upto.groupBy("f").agg(F.collect_list("family").alias("fams"), F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n").between(least, most))


def _ordered(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """Both sides' sets with their families from the rarest to the most frequent one."""
    counts = a.select(F.explode("fams").alias("family")).unionByName(b.select(F.explode("fams").alias("family"))).groupBy("family").agg(F.count(F.lit(1)).alias("often"))

    def side(x: DataFrame) -> DataFrame:
        rows = x.select("f", "n", F.explode("fams").alias("family")).join(counts, "family")
        return rows.groupBy("f", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "family"))), lambda s: s["family"]).alias("fams"))

    return [side(a), side(b)]


def _candidates(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """(fa, fb, na, nb, ga, gb): the pairs of sets that may be so similar, each once.

    Sets of na and nb families that are similar enough share o at least, where
    o is the least whole number of similarity / (1 + similarity) x (na + nb).
    So of each set's families, from the rarest on, the first n - o + 1 hold a
    shared one. Prefixes meet by (family, na, nb), for the sizes that can match
    at all; a family that every set has comes last in all of them, and meets
    nowhere while o is over 1. A pair counts at its first shared family only.
    """
    most = lambda n: F.floor(n / similarity + 1e-9).cast("int")
    least = lambda n: F.ceil(n * similarity - 1e-9).cast("int")

    def side(x: DataFrame, own: str, other: str, f: str, g: str) -> DataFrame:
        sized = x.select(F.col("f").alias(f), F.col("fams").alias(g), F.col("n").alias(own)).withColumn(other, F.explode(F.sequence(least(F.col(own)), most(F.col(own)))))
        overlap = F.greatest(F.lit(1), F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)).cast("int")
        return sized.withColumn("family", F.explode(F.slice(F.col(g), F.lit(1), F.greatest(F.lit(0), F.col(own) - overlap + 1))))

    met = side(a, "na", "nb", "fa", "ga").join(side(b, "nb", "na", "fb", "gb"), ["family", "na", "nb"])
    return met.where(F.get(F.array_intersect("ga", "gb"), F.lit(0)) == F.col("family")).drop("family")


def _similar(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """jaccard_pairs() of two sides' sets, which are written first: both their counts and their prefixes are read from them."""
    met = _candidates(*_ordered(written(a), written(b)), similarity)
    shared = F.size(F.array_intersect("ga", "gb"))
    found = met.select("fa", "fb", F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"), shared.cast("long").alias("shared"))
    return found.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") >= similarity - 1e-9)


def jaccard_pairs(a: DataFrame, b: DataFrame, least: int = 2, most: int = 9, feature: str = "feat", family: str = "label", similarity: float | None = None) -> DataFrame:
    """(fa, fb, shared, na, nb, jaccard) of features that have ``least`` to ``most`` families and share one.

    The band is applied before the join, so a family's features bound its
    pairs; sets that share nothing make no row. With a ``similarity`` only
    pairs of that Jaccard index or more are returned, and only those are
    joined that a size and prefix filter leaves (_candidates), so a family of
    all features makes no quadratic join. Null families do not count.
    """
    if similarity is not None:
        if not 0 < similarity <= 1:
            raise ValueError("a similarity is over 0, and 1 at most")
        return _similar(*(_sets(p, least, most, feature, family) for p in (a, b)), similarity)

    def banded(p: DataFrame, f: str, n: str) -> DataFrame:
        size = F.count(F.lit(1)).over(Window.partitionBy(feature))
        return p.select(feature, family).where(F.col(family).isNotNull()).distinct().withColumn(n, size).where(F.col(n).between(least, most)).withColumnRenamed(feature, f)

    both = banded(a, "fa", "na").join(banded(b, "fb", "nb"), family)
    pairs = both.groupBy("fa", "fb", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.withColumn("jaccard", F.col("shared") / F.greatest(F.col("na") + F.col("nb") - F.col("shared"), F.lit(1)))


def reciprocal_best(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs that are each other's best, ties to the lower feature, at ``least`` or more.

    Each side's best is a minimum that tasks find before they shuffle.
    """
    near = written(pairs.where(F.col("jaccard") >= least))  # a better partner of such a pair is one itself
    best = lambda own, other: near.groupBy(own).agg(F.min(F.struct(-F.col("jaccard"), other)).alias("x")).select(own, F.col(f"x.{other}").alias(other))
    return near.join(best("fa", "fb"), ["fa", "fb"], "left_semi").join(best("fb", "fa"), ["fa", "fb"], "left_semi").select(*pairs.columns)


def mutual_best(a: DataFrame, b: DataFrame, least: int = 2, most: int = 9, feature: str = "feat", family: str = "label", similarity: float = 0.5) -> DataFrame:
    """reciprocal_best() of two sides' features, by the prefix filter.

    Of features with equal sets the lowest stands for all: a partner prefers
    it to the others, so none of them can be in a mutual pair.
    """

    def lowest(p: DataFrame) -> DataFrame:
        sets = _sets(p, least, most, feature, family).withColumn("fams", F.array_sort("fams"))
        return sets.groupBy("fams", "n").agg(F.min("f").alias("f"))

    return reciprocal_best(_similar(lowest(a), lowest(b), similarity), similarity)


def shared_vocabulary(a: DataFrame, b: DataFrame, family: str = "label") -> tuple[DataFrame, DataFrame]:
    """Both sides without the families that the other has never seen."""
    common = a.select(family).intersect(b.select(family))
    return a.join(common, family, "left_semi"), b.join(common, family, "left_semi")


def model_pairs(models: DataFrame, name: str = "model") -> DataFrame:
    """Each unordered pair of models once; models are few, and the inequality is the join."""
    return models.select(F.col(name).alias("a")).join(models.select(F.col(name).alias("b")), F.col("a") < F.col("b"))


def best_feature_by_family(features: DataFrame, families: str = "families", value: str = "act", feature: str = "feat") -> DataFrame:
    """Each family's feature of the highest activation, the lower one on ties."""
    rows = features.select(feature, value, F.explode(families).alias("family"))
    order = Window.partitionBy("family").orderBy(F.desc(value), feature)
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def support(matches: DataFrame, families: str = "families", pair: str = "pair", jaccard: str = "jaccard") -> DataFrame:
    """For each set of families, whatever its order: the model pairs that found it, and the best match."""
    key = F.array_sort(F.array_distinct(F.col(families)))
    rows = matches.withColumn("key", key)
    order = Window.partitionBy("key").orderBy(F.desc(jaccard), pair)
    best = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("key", F.col(jaccard).alias("best"), F.col(pair).alias("best_pair"))
    return rows.groupBy("key").agg(F.count_distinct(pair).alias("n_pairs")).join(best, "key")


def connection_flags(members: DataFrame, key: str, length: str, gc: str, long: float = 200.0, diverse: float = 1.8) -> DataFrame:
    """Length and GC spread of each connected set, and whether all are long or their lengths differ."""
    found = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("lo"), F.max(length).alias("hi"), (F.max(gc) - F.min(gc)).alias("gc_spread"))
    ratio = F.col("hi") / F.greatest(F.col("lo"), F.lit(1.0))
    return found.withColumns({"len_ratio": ratio, "all_long": F.col("lo") >= long, "len_diverse": ratio >= diverse})


def top_overlap(a: DataFrame, b: DataFrame, key: str, score: str, sizes: list[int]) -> DataFrame:
    """Jaccard overlap of two rankings' first n, for each n asked for; the report's lists hold max(sizes) rows."""
    most = max(sizes)
    first = lambda df, n: df.orderBy(F.desc(score), key).limit(most).select(F.col(key), F.row_number().over(Window.orderBy(F.desc(score), key)).alias(n))
    both = first(a, "ra").join(first(b, "rb"), key, "full")
    parts = []
    for n in sizes:
        in_a, in_b = F.coalesce(F.col("ra") <= n, F.lit(False)), F.coalesce(F.col("rb") <= n, F.lit(False))
        parts.append(both.agg(F.lit(n).cast("bigint").alias("n"), F.sum((in_a & in_b).cast("bigint")).alias("shared"), F.sum((in_a | in_b).cast("bigint")).alias("united")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("jaccard", F.col("shared") / F.greatest(F.col("united"), F.lit(1)))


def class_sets(matches: DataFrame, types: DataFrame, key: list[str], families: str = "families", family: str = "family", kind: str = "kind") -> DataFrame:
    """For each match the sorted classes of its families, "" for a family without one, and whether they differ."""
    rows = matches.select(*key, F.explode(families).alias(family)).join(types, family, "left")
    found = rows.groupBy(*key).agg(F.array_sort(F.collect_set(F.coalesce(kind, F.lit("")))).alias("classes"))
    named = F.filter("classes", lambda c: c != "")
    return found.withColumn("crosses", F.size(named) > 1)
