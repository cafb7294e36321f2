"""Removal of lines that many sites repeat, by HyperLogLog sketches of each line's sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shielded, unshielded
from .quality import BLANKS

MIN_SITES = 5
#: log2 of a sketch's registers; the estimate's standard error is 1.04 / 64.
SKETCH_BITS = 12
#: Estimates within this share of the threshold, and one more, are counted exactly; over six standard errors.
NEAR = 0.1
#: So many widespread lines go to every task; beyond, lines are joined, a hot one in SALTS parts.
SENT, SALTS = 50_000, 32


def _line(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def _rows(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """One row for each line that has a word: the row it is from, its place, its site, and 96 bits of hash."""
    parts = docs.select(
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_row"), F.coalesce(F.col(site_column).cast("string"), F.lit("")).alias("_site"), F.posexplode(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)).alias("_at", "_line")
    )
    own = parts.withColumn("_line", _line(F.col("_line"))).where(F.col("_line") != "")
    return own.select("_id", "_row", "_site", "_at", F.xxhash64("_line").alias("_h"), F.hash("_line").alias("_g"))


def widespread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(_h, _g, _first) of each line that stands on at least ``min_sites`` distinct sites.

    Each line's sketch is merged from the tasks' partial sketches. Only lines
    whose estimate is near the threshold have their sites counted exactly.
    _first is the line's first occurrence by (id, row hash, place).
    """
    seen = F.min(F.struct("_id", "_row", "_at")).alias("_first")
    spread = cut(
        lines.groupBy("_h", "_g")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(SKETCH_BITS))).alias("_sites"), seen)
        .where(F.col("_sites") >= min_sites * (1 - NEAR) - 1)
    )
    near = F.col("_sites") <= min_sites * (1 + NEAR) + 1
    exact = (
        lines.select("_h", "_g", "_site")
        .join(spread.where(near).select("_h", "_g"), ["_h", "_g"], "left_semi")
        .distinct()
        .groupBy("_h", "_g")
        .count()
        .where(F.col("count") >= min_sites)
        .select("_h", "_g")
    )
    return spread.where(~near).select("_h", "_g", "_first").unionByName(spread.where(near).join(exact, ["_h", "_g"], "left_semi").select("_h", "_g", "_first"))


def _matched(lines: DataFrame, wide: DataFrame) -> DataFrame:
    """The rows of ``lines`` that are in ``wide``, with _first."""
    if wide.count() <= SENT:
        return lines.join(F.broadcast(wide), ["_h", "_g"])
    salted = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64("_row", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["_h", "_g", "_salt"]).drop("_salt")


def remove_widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """``docs`` without the later occurrences of lines that ``min_sites`` sites or more repeat.

    Lines are compared without the blanks around them. A line's first
    occurrence stays (the lowest id, then place), so no passage is lost from
    the corpus. Adds ``_lines`` and ``_removed`` (numbers of lines). Lines
    without a word are never removed. A null text stays null with no lines; a
    null site is one site of its own. Equal rows are treated alike, so both
    keep a first occurrence. All other columns are returned as they came.
    """
    own, key, text = shielded(docs), F.col(f"`c_{id_column}`"), F.col(f"`c_{text_column}`")
    lines = cut(_rows(docs, id_column, text_column, site_column))
    wide = cut(widespread(lines, min_sites))
    gone = (
        _matched(lines, wide)
        .where(~F.struct("_id", "_row", "_at").eqNullSafe(F.col("_first")))
        .groupBy("_id", "_row")
        .agg(F.sort_array(F.collect_set("_at")).alias("_gone"))
    )
    joined = own.withColumns({"_own": F.xxhash64(text), "_parts": F.split(text, "\n", -1)}).join(gone.hint("shuffle_hash"), key.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_row")), "left")
    # The lines between removed ones, slice by slice. _parts and _gone are columns: a lambda evaluates what it refers to anew each time.
    parts, size = F.col("_parts"), F.size("_parts")
    begins, ends = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda x: x + 1)), F.concat("_gone", F.array(size))
    kept = F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(parts, a + 1, b - a))), "\n")
    changed = joined.withColumns(
        {
            f"c_{text_column}": F.when(F.col("_gone").isNull(), text).otherwise(kept),
            "_lines": F.when(text.isNull(), 0).otherwise(size).cast("long"),
            "_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
        }
    )
    return unshielded(changed, docs.columns, "_lines", "_removed")


def drop_emptied(cleaned: DataFrame, text_column: str = "text") -> DataFrame:
    """Without documents of which removal left no word, and without the two added columns."""
    left = F.length(_line(F.coalesce(F.col(text_column), F.lit("")))) > 0
    return cleaned.where(left | (F.col("_removed") == 0)).drop("_lines", "_removed")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT rid, doc_id, site, i, trim(p[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, p[i] AS part
  FROM (SELECT rid, doc_id, site, string_split(text, chr(10)) AS p FROM d), unnest(generate_series(1, len(p))) AS u(i)),
wide AS (SELECT line, min((doc_id, i)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT l.*, wide.line IS NOT NULL AND (doc_id, i) <> first AS gone FROM l LEFT JOIN wide USING (line)),
built AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(part, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN built USING (rid)
"""
