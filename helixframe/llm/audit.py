"""Filter interaction audit: a histogram of failure masks tells what every order of the filters would do."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, cut, settled

#: Filter i fails where bit i of a mask is set.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BLANKS = " \t\n\x0b\x0c\r"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text, none of which is null, fails the filters that read it alone."""
    inner = F.trim(text, F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP, -1))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, part, mask, n): n rows of this id and part have this failure mask.

    Filters A to D read the text. E fails a row whose text some smaller id has
    too: texts are grouped by their SHA-256, so that whole texts are not
    shuffled, and the least id of each group is looked up by (digest, id). No
    join is by the text alone, as a third of all rows may have one text; rows
    equal in all this are one row with a count before they meet.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    bits = sum((F.when(failed, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0)) for name, failed in text_failures(F.col("text")).items()), F.lit(0))
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = read.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("own"))
    rows = cut(rows.groupBy("digest", "id", "part", "own").agg(F.count(F.lit(1)).alias("n")))
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("own") + F.when(repeated, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return rows.join(first, ["digest", "id"], "left").groupBy("id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))


def cells(masks: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): the rows in each of a part's 32 cells; an id with several labels has all of them."""
    marks = labels.groupBy(F.col(id_column).alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    marks = marks.where("id IS NOT NULL AND good + toxic > 0").withColumn("salt", F.lit(0))
    # Rows without an id have no label; their salt spreads them over the join's tasks.
    salted = masks.withColumn("salt", F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("part", "mask"), F.lit(1024)).cast("int")).otherwise(0))
    marked = salted.join(marks, ["id", "salt"], "left")
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def interactions(histogram: DataFrame) -> DataFrame:
    """The row of each part, order and step, from the cells alone.

    In an order a row goes at the first filter that it fails. Over all orders
    each of the k filters that a row fails is the first of them in 120 / k,
    which is the row's share in that filter's Shapley sum.
    """
    spread = histogram.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bit_sum = lambda where: sum((F.when(where(place[f]), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))
    spread = spread.withColumns({"own": bit_sum(lambda p: p == F.col("step")), "earlier": bit_sum(lambda p: p < F.col("step"))})
    mask, n = F.col("mask"), F.col("n")
    fails, gone = mask.bitwiseAND(F.col("own")) != 0, mask.bitwiseAND(F.col("earlier")) != 0
    share = F.when(fails, n * F.get(F.lit([0, *(len(ORDERS) // k for k in range(1, len(FILTERS) + 1))]), F.bit_count(mask)))
    found = {
        "kept": F.when(~fails & ~gone, n),
        "removed": F.when(fails & ~gone, n),
        "redundant": F.when(fails & gone, n),
        "unique_fails": F.when(mask == F.col("own"), n),
        "good_lost": F.when(fails & ~gone, F.col("good")),
        "toxic_lost": F.when(fails & ~gone, F.col("toxic")),
        "shapley": share,
    }
    return spread.groupBy("part", "filter_order", "step").agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(k) for k, c in found.items()))


@settled
def filter_audit(docs: DataFrame, labels: DataFrame, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What filters A to E remove in each of their 120 orders, for each part.

    Returns part, filter_order, step and the counts kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley; zeros have rows too.
    A null text counts as empty, a null part as the empty string, and a row
    without an id neither repeats a text nor has a label. Repeated rows all
    count, and as no id is smaller than itself they do not fail E by one
    another. Labels may miss, repeat or be null. An empty table gives no rows.
    Further columns are not read.
    """
    return interactions(cut(cells(failure_masks(docs, part_column, id_column, text_column), labels, id_column)))


SQL = rf"""
WITH marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
lists AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
masks AS (SELECT part, doc_id, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM lists),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
orders AS (SELECT unnest({ORDERS}) AS filter_order),
steps AS (SELECT filter_order, u.step, 1 << (instr('{FILTERS}', substr(filter_order, u.step, 1)) - 1) AS own,
  list_sum([CASE WHEN instr(filter_order, f) < u.step THEN 1 << (instr('{FILTERS}', f) - 1) ELSE 0 END FOR f IN {list(FILTERS)}])::INTEGER AS earlier FROM orders, unnest([1, 2, 3, 4, 5]) AS u(step)),
each AS (SELECT part, filter_order, step, own, n, good, toxic, mask, mask & own <> 0 AS fails, mask & earlier <> 0 AS gone FROM cells CROSS JOIN steps),
rows AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM rows
"""
