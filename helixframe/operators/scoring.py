"""Mutation scans around a pluggable scorer, and verdicts on what features recognise.

A scorer is any function of a list of sequences that returns one list of
numbers for each (an embedding, or log probabilities). Model inference itself
stays outside the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import distance
from ..sources.storage import written

Scorer = Callable[[list[str]], list[list[float] | None]]

BASES = "ACGU"


def substitutions(seqs: DataFrame, keys: list[str], sequence: str = "seq", letters: str = BASES) -> DataFrame:
    """(keys..., pos, wt, alt, mutant): every position with every other letter."""
    sites = seqs.select(*keys, F.col(sequence).alias("_s"), F.posexplode(F.split(F.col(sequence), "")).alias("_p", "wt")).where(F.col("wt") != "")
    alts = F.explode(F.filter(F.array(*map(F.lit, letters)), lambda a: a != F.col("wt")))
    return sites.select(*keys, (F.col("_p") + 1).cast("bigint").alias("pos"), "wt", alts.alias("alt"), "_s").select(
        *keys, "pos", "wt", "alt", F.overlay("_s", "alt", F.col("pos").cast("int"), F.lit(1)).alias("mutant")
    )


def scored(df: DataFrame, sequence: str, scorer: Scorer, name: str = "vector") -> DataFrame:
    """Adds the scorer's array for each sequence, and ``error`` where it failed; a failed batch is tried row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(sequence)).to_pylist()
            errors: list[str | None] = [None] * len(texts)
            try:
                vectors = scorer(texts)
            except Exception:  # a scorer may fail on one row only
                vectors = []
                for i, t in enumerate(texts):
                    try:
                        vectors += scorer([t])
                    except Exception as e:
                        vectors.append(None)
                        errors[i] = str(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], [*batch.schema.names, name, "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {name} array<double>, error string")


def embedding_criticality(seqs: DataFrame, keys: list[str], scorer: Scorer, sequence: str = "seq") -> DataFrame:
    """(keys..., pos, score): the mean distance of a position's mutants from the wild type.

    Sequences are numbered and dealt out to all tasks, whatever files they came
    in, and each different one is scored once with its mutants; every row that
    has it gets its positions. Rows of equal keys count as one.
    """
    rows = seqs.select(*keys, F.col(sequence).alias("_seq")).where(F.col("_seq") != "")
    each = written(rows.select("_seq").distinct().withColumn("_q", F.monotonically_increasing_id()))
    dealt = each.repartition(each.sparkSession.sparkContext.defaultParallelism)
    wild = scored(dealt, "_seq", scorer, "w").select("_q", "w")
    mutants = scored(substitutions(dealt, ["_q"], "_seq"), "mutant", scorer, "m").where(F.col("error").isNull())
    apart = distance(F.col("m"), F.col("w"))
    sites = mutants.join(wild, "_q").groupBy("_q", "pos").agg(F.sum(apart).alias("_s"), F.count(apart).alias("_n"))
    listed = sites.groupBy("_q").agg(F.collect_list(F.struct("pos", "_s", "_n")).alias("_sites"))  # a sequence's positions
    found = rows.join(each.join(listed, "_q").select("_seq", "_sites"), "_seq")
    placed = found.repartition(*keys).select(*keys, F.explode("_sites").alias("_x")).select(*keys, "_x.*")
    total = F.sum("_n")
    return placed.groupBy(*keys, "pos").agg(F.when(total > 0, F.sum("_s") / total).alias("score"))


def masked_criticality(seqs: DataFrame, keys: list[str], log_probs: Scorer, sequence: str = "seq", mask: str = "N") -> DataFrame:
    """(keys..., pos, score): mean of logp(wild type) - logp(alternative) at each masked position.

    The scorer gets the sequence with the position masked and returns log
    probabilities in the order of BASES.
    """
    sites = seqs.select(*keys, F.col(sequence).alias("_s"), F.posexplode(F.split(F.col(sequence), "")).alias("_p", "wt")).where(F.col("wt").isin(*BASES))
    hidden = sites.select(*keys, (F.col("_p") + 1).cast("bigint").alias("pos"), "wt", F.overlay("_s", F.lit(mask), F.col("_p") + 1, F.lit(1)).alias("masked"))
    found = scored(hidden, "masked", log_probs, "lp").where(F.col("error").isNull())
    own = F.element_at("lp", F.expr(f"locate(wt, '{BASES}')"))
    total = F.aggregate("lp", F.lit(0.0), lambda s, x: s + x)
    return found.select(*keys, "pos", ((own * len(BASES) - total) / (len(BASES) - 1)).alias("score"))


def hits(peaks: DataFrame, features: DataFrame, share: float = 0.25) -> DataFrame:
    """Peaks (gene, feat, peak, pos) of features that reach ``share`` of their own maximum, with what is known of them."""
    return peaks.join(features, "feat").where((F.col("feat_max") > 0) & (F.col("peak") >= share * F.col("feat_max"))).withColumn("peak_share", F.col("peak") / F.col("feat_max"))


def verdicts(genes: DataFrame, found: DataFrame) -> DataFrame:
    """For each gene its hits, specialist hits and whether it is recognised."""
    sums = found.groupBy("gene").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("breadth") <= 2).alias("n_specialist"))
    both = genes.select("gene").distinct().join(sums, "gene", "left").na.fill(0, ["n_hits", "n_specialist"])
    return both.withColumn("verdict", F.when(F.col("n_specialist") > 0, "RECOGNIZED").when(F.col("n_hits") > 0, "weak").otherwise("NOT recognized"))


def rollup(found: DataFrame, family: str = "family", positions: int = 12) -> DataFrame:
    """For each gene and family: hits, the best share of a maximum, and the first positions in ranked order."""
    ranked = found.withColumn("_rn", F.row_number().over(Window.partitionBy("gene", family).orderBy(F.desc("peak_share"), "pos", "feat")))
    kept = F.array_sort(F.collect_list(F.when(F.col("_rn") <= positions, F.struct("_rn", "pos"))))
    return ranked.groupBy("gene", family).agg(F.count(F.lit(1)).alias("n"), F.max("peak_share").alias("best"), F.transform(kept, lambda x: x["pos"]).alias("positions"))


def control(members: DataFrame, least: float = 0.5, pass_rate: float = 0.6) -> DataFrame:
    """Positive control: (feat, best, feat_max) features pass at ``least`` of their maximum; the share that does, and the verdict."""
    ok = F.col("best") >= least * F.col("feat_max")
    return members.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("rate")).withColumn("passed", F.col("rate") >= pass_rate)


def pairs(df: DataFrame, keys: list[str], structure: str) -> DataFrame:
    """(keys..., at, partner) for each place of a dot-bracket string, from 1; 0 for none. ``keys`` tell rows apart.

    A closing bracket of any kind pairs with the last open one, and with none
    if none is open. The depth is a running sum of steps up and down, less the
    least sum so far, as closing brackets without an open one do not count.
    Among the places of one depth, opening and closing ones take turns, so
    neighbours are partners. Null and empty strings have no places.
    """
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sign = F.col("_sign")
    step = F.when(sign.isin(*"([{<"), 1).when(sign.isin(*")]}>"), -1).otherwise(0)
    signs = df.select(*keys, F.posexplode(F.split(F.col(structure), "")).alias("_p", "_sign")).where(sign != "")
    sums = signs.select(*keys, (F.col("_p") + 1).cast("bigint").alias("at"), step.alias("_step")).withColumn("_sum", F.sum("_step").over(upto))
    floor = F.least(F.lit(0), F.min("_sum").over(upto))
    before = F.coalesce(F.lag("_floor").over(order), F.lit(0))
    floors = sums.withColumn("_floor", floor).withColumn("_unmatched", (F.col("_step") < 0) & (F.col("_floor") < before))
    level = F.when((F.col("_step") != 0) & ~F.col("_unmatched"), F.col("_sum") - F.col("_floor") + F.when(F.col("_step") < 0, 1).otherwise(0))
    turns = Window.partitionBy(*keys, "_level").orderBy("at")
    partner = F.when(F.col("_level").isNotNull(), F.when(F.col("_step") > 0, F.lead("at").over(turns)).otherwise(F.lag("at").over(turns)))
    return floors.withColumn("_level", level).select(*keys, "at", F.coalesce(partner, F.lit(0)).alias("partner"))
