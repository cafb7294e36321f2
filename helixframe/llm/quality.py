"""Quality rules whose cutoffs keep a proven bound on false rejections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, GAP, crc_mod, cut, settled, shielded, unshielded

#: A rule's measure is compared with 1/STEPS, 2/STEPS, ... 1.
STEPS = 50
#: Of a language's good documents the cutoffs together may falsely reject one in fifty at most: what a corpus can spare for its cleaning ...
RISK = 0.02
#: ... with this probability, over all languages together, that any of them loses more.
DELTA = 0.05
#: Levels, each with lower cutoffs than the one before: the share of the proposing good documents that each rule may reject, and steps added to the cutoff for safety.
LEVELS = ((0, 4), (0, 2), (0, 0), *((RISK * x, 0) for x in (1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)))
#: A cutoff has to reject a share of the bad documents so many times that of the good ones.
LIFT = 10
RULES = ("symbols", "dup_lines", "repeats", "shouting", "long_words")
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
#: Bits for the number of a window of three words within its text.
NUMBER_BITS = 24
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_loud")


def _count(text: Column, pattern: str) -> Column:
    """How many characters of this class the text has."""
    return F.regexp_count(text, F.lit(pattern))


def _numbered(hashes: Column) -> Column:
    """The windows' hashes in order, with the windows' numbers in place of their low bits: plain long integers sort fast."""
    return F.sort_array(F.transform(hashes, lambda x, i: F.shiftleft(x, NUMBER_BITS).bitwiseOR(i.cast("long"))))


def _starts(hashes: Column, order: Column) -> Column:
    """Sorted numbers of the windows whose hash is found twice.

    Neighbours in ``order`` that agree in the remaining bits are compared in
    full. Both arguments are plain columns, as a lambda evaluates what it
    refers to anew for each element.
    """
    number = lambda x: x.bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    full = lambda x: F.get(hashes, number(x).cast("int"))
    equal = lambda x, y: F.coalesce((F.shiftrightunsigned(x, NUMBER_BITS) == F.shiftrightunsigned(y, NUMBER_BITS)) & (full(x) == full(y)), F.lit(False))
    again = F.filter(order, lambda x, i: equal(x, F.get(order, i - 1)) | equal(x, F.get(order, i + 1)))
    return F.sort_array(F.transform(again, number))


def _starts_of_any(pairs: Column) -> Column:
    """As _starts(), from sorted (hash, number) pairs: for texts of more windows than a number has room for."""
    again = F.filter(pairs, lambda x, i: F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)))
    return F.sort_array(F.transform(again, lambda x: x["i"].cast("long")))


def _covered(starts: Column) -> Column:
    """Words in the windows of three that begin at these numbers."""
    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), i - s["last"])).alias("n")))["n"]


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_q`` of the counts that the rules need.

    A null text counts as empty, and an empty text has zero of everything.
    Windows are equal if 64-bit hashes of their words' hashes are, within one text.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    inner = F.trim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    out = docs.withColumns({"_q_words": F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(inner, GAP, -1), lambda x: F.xxhash64(x))), "_q_lines": lines})
    w = F.col("_q_words")
    windows = F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    out = out.withColumn("_q_hashes", windows)
    h = F.col("_q_hashes")
    repeats, fits = F.size(F.array_distinct(h)) < F.size(h), F.size(h) < 1 << NUMBER_BITS
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumns({"_q_order": F.when(repeats & fits, _numbered(h)), "_q_pairs": F.when(repeats & ~fits, pairs)})
    starts = F.coalesce(_starts(h, F.col("_q_order")), _starts_of_any(F.col("_q_pairs")))
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(text) - _count(text, r"[\x20\x09-\x0D]"),
        "n_symbols": _count(text, r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.coalesce(_covered(starts), F.lit(0)),
        "n_lines": F.size("_q_lines"),
        "n_loud": _count(text, "[A-Z!]"),
    }
    return out.withColumn("_q", F.struct(*(c.cast("long").alias(k) for k, c in found.items()))).drop("_q_words", "_q_lines", "_q_hashes", "_q_order", "_q_pairs")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def exceeded(q: Column) -> dict[str, Column]:
    """For each rule the number of its cutoffs that the measure exceeds, in whole numbers; 0 where it is undefined."""
    parts = {
        "symbols": (q["n_symbols"], q["word_chars"]),
        "dup_lines": (q["n_dup_lines"], q["n_lines"]),
        "repeats": (q["n_repeat_words"], q["n_words"]),
        "shouting": (q["n_loud"], q["word_chars"]),
        "long_words": (q["word_chars"], 20 * q["n_words"]),
    }
    return {k: F.when(d > 0, F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor((STEPS * n + d - 1) / F.greatest(d, F.lit(1))).cast("int") - 1))).otherwise(0) for k, (n, d) in parts.items()}


def _tail(n: Column, k: Column) -> Column:
    """P(at most k of n falsely rejected) if the true share were RISK; the exact binomial sum."""
    odds = RISK / (1 - RISK)
    zero = F.struct(n.cast("double").alias("n"), (n * F.log(F.lit(1 - RISK))).alias("log"), F.lit(0.0).alias("sum"))
    steps = F.sequence(F.lit(0).cast("long"), k.cast("long"))
    return F.aggregate(
        steps,
        zero,
        lambda s, i: F.struct(s["n"].alias("n"), (s["log"] + F.log(F.greatest(s["n"] - i, F.lit(1e-300)) / (i + 1) * odds)).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")),
        lambda s: F.least(F.lit(1.0), s["sum"]),
    )


def _grouped(sizes: DataFrame) -> DataFrame:
    """(stratum, grp) of (stratum, n): strata whose holdout is too small to admit anything share a group.

    A stratum needs as many good holdout rows as admit a level without one
    false rejection. The smallest strata are put together until they have so
    many and the next one has them by itself; group 0 is theirs. Numbers of
    rows alone decide, so no test is spent on it.
    """
    up, whole = Window.orderBy("n", "stratum"), Window.partitionBy()  # a row for each stratum
    need = F.log(F.count(F.lit(1)).over(whole) / F.lit(DELTA)) / F.lit(-math.log(1 - RISK))
    enough = (F.sum("n").over(up) >= need) & F.coalesce(F.lead("n").over(up) >= need, F.lit(True))
    marked = sizes.withColumns({"enough": enough.cast("int"), "place": F.row_number().over(up)})
    earlier = F.coalesce(F.max("enough").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.select("stratum", F.when(earlier == 1, F.col("place")).otherwise(0).alias("grp"))


def _proposed(rows: DataFrame) -> DataFrame:
    """(grp, one array for each rule): the rule's cutoff at each level, STEPS + 1 where it has none."""
    counted = (
        rows.where(~F.col("holdout"))
        .select("grp", "_good", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("step")) for k in RULES))).alias("x"))
        .groupBy("grp", "x.rule", "x.step")
        .agg(*(F.sum(F.when(F.col("_good") == good, 1).otherwise(0)).alias(name) for name, good in (("good", 1), ("bad", 0))))
    )
    # At most STEPS + 1 rows for each group and rule from here on.
    whole = Window.partitionBy("grp", "rule")
    above = whole.orderBy(F.desc("step"))
    cumulated = counted.select("grp", "rule", "step", *(F.sum(c).over(above).alias(c) for c in ("good", "bad")), *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("good", "bad")))
    useful = (F.col("step") >= 1) & (F.col("bad") > 0) & (F.col("bad") * F.col("all_good") >= LIFT * F.col("good") * F.col("all_bad"))
    least = [F.least(F.coalesce(F.min(F.when(useful & (F.col("good") <= F.col("all_good") * share), F.col("step"))) + more, F.lit(STEPS + 1)), F.lit(STEPS + 1)) for share, more in LEVELS]
    path = cumulated.groupBy("grp", "rule").agg(F.array(*least).alias("path"))
    return path.groupBy("grp").agg(*(F.max(F.when(F.col("rule") == r, F.col("path"))).alias(f"p_{r}") for r in RULES))


def _spared(path: Column, step: Column) -> Column:
    """How many levels, from the first on, do not reject this measure."""
    return F.size(F.filter(path, lambda x: x > step))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum_column: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """(stratum, rule, cutoff) for each cutoff that the labelled holdout supports.

    ``measured`` has id, stratum and ``_q``; ``labels`` has id and quality.
    Labelled rows with an even crc32 of their id propose a path of levels for
    each stratum, each with cutoffs for all rules at once (_proposed). The
    other labelled rows are the holdout. Levels are tested in their order,
    which the holdout has no part in: one is admitted if its joint false
    rejections among the holdout's good rows are so few that a share over RISK
    would give them with probability DELTA / (number of strata tested) at most
    (the exact binomial bound; Bonferroni's correction over strata, and none
    within one, as testing ends at the first level that fails). So all rules
    together reject RISK of a stratum's good documents at most. Small strata
    are tested together (_grouped), and the bound then holds for them together.
    Rows that fail the base rules take no part. A null stratum is one of its
    own; one without labelled rows gets no cutoff.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("_good"))
    steps = exceeded(F.col("_q"))
    rows = cut(
        measured.where(~base_failed(F.col("_q")))
        .select(F.col(id_column).alias("_id"), F.coalesce(F.col(stratum_column), F.lit("")).alias("stratum"), *(c.cast("int").alias(k) for k, c in steps.items()))
        .join(marks, "_id")
        .select("stratum", "_good", (crc_mod("_id", 2) == 1).alias("holdout"), *RULES)
    )
    tested = F.col("holdout") & (F.col("_good") == 1)
    # Tables of a row for each stratum are written, so that Spark knows their size when it joins them.
    groups = cut(_grouped(rows.groupBy("stratum").agg(F.count(F.when(tested, 1)).alias("n"))).coalesce(1))
    grouped = rows.join(groups, "stratum")
    paths = cut(groups.join(_proposed(grouped), "grp").coalesce(1))
    level = F.least(*(_spared(F.col(f"p_{r}"), F.col(r)) for r in RULES))
    rejected = F.array(*(F.count(F.when(level <= i, 1)) for i in range(len(LEVELS))))
    holdout = rows.where(tested).join(paths, "stratum").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), rejected.alias("k"))
    many = F.count(F.lit(1)).over(Window.partitionBy())
    admitted = holdout.withColumn("tests", many).select("grp", "n", "tests", F.posexplode("k").alias("level", "k")).where(_tail(F.col("n"), F.col("k")) <= DELTA / F.col("tests")).groupBy("grp").agg(F.max("level").alias("level"))
    chosen = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.get(f"p_{r}", F.col("level")).alias("cutoff")) for r in RULES)))
    return paths.join(admitted, "grp").select("stratum", chosen.alias("x")).select("stratum", "x.rule", "x.cutoff").where(F.col("cutoff") <= STEPS)


def verdict(measured: DataFrame, limits: DataFrame, stratum_column: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept; ``limits`` as cutoffs() returns them.

    The limits are written first: their size is then known, and Spark sends
    them to every task only while they are below its own broadcast threshold.
    """
    wide = cut(limits.groupBy(F.col("stratum").alias("_q_stratum")).agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_q_{r}") for r in RULES)).coalesce(1))
    steps = exceeded(F.col("_q"))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(steps[r] >= F.col(f"_q_{r}"), F.lit(False))
    joined = measured.join(wide, F.coalesce(F.col(stratum_column), F.lit("")) == F.col("_q_stratum"), "left")
    failed = base_failed(F.col("_q"))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~bad}).drop("_q_stratum", *(f"_q_{r}" for r in RULES))


@settled
def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """Counts and verdict of every document.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept. Null and empty texts count zero words and fail the
    base rules. Repeated rows stay. Without labels no cutoff is set, and the
    base rules alone decide. Further columns are not read.
    """
    measured = cut(measures(docs.select(id_column, F.col(stratum_column).alias("_stratum"), F.col(text_column).alias("_text")), "_text").drop("_text"))
    judged = verdict(measured, cutoffs(measured, labels, "_stratum", id_column), "_stratum")
    return judged.select(id_column, *(F.col("_q")[k].alias(k) for k in BASE), "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """The documents that pass, with the columns they came with.

    Documents are written with their counts, so that these are made once: a
    filter on an expression would have Spark evaluate it for each of its uses.
    """
    marks = labels.select(F.col(id_column).alias(f"c_{id_column}"), "quality")
    measured = cut(measures(shielded(docs), f"c_{text_column}"))
    limits = cutoffs(measured, marks, f"c_{stratum_column}", f"c_{id_column}")
    return unshielded(verdict(measured, limits, f"c_{stratum_column}").where("kept"), docs.columns)


SQL = rf"""
WITH marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
lists AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM lists, unnest(generate_series(1, len(w) - 2)) AS u(i)),
twice AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM twice GROUP BY rid),
q AS (SELECT lists.rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(repeated.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(translate(t, '{CAPITALS}', '')) AS n_loud
  FROM lists LEFT JOIN repeated USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q),
parts AS (SELECT rid, doc_id, stratum, base_failed, unnest([
  {{'rule': 'symbols', 'n': n_symbols, 'd': word_chars}}, {{'rule': 'dup_lines', 'n': n_dup_lines, 'd': n_lines}},
  {{'rule': 'repeats', 'n': n_repeat_words, 'd': n_words}}, {{'rule': 'shouting', 'n': n_loud, 'd': word_chars}},
  {{'rule': 'long_words', 'n': word_chars, 'd': 20 * n_words}}], recursive := true) FROM judged),
steps AS (SELECT rid, doc_id, stratum, base_failed, rule, CASE WHEN d > 0 THEN greatest(0, least({STEPS}, ({STEPS} * n + d - 1) // d - 1)) ELSE 0 END AS step FROM parts),
labelled AS (SELECT stratum, rid, rule, step, good, {CRC32_SQL.format('doc_id::VARCHAR')} % 2 = 1 AS holdout FROM steps JOIN marks USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT stratum, count(DISTINCT rid) FILTER (holdout AND good = 1) AS n FROM labelled GROUP BY stratum),
needs AS (SELECT *, ln(count(*) OVER () / {DELTA}) / -ln(1 - {RISK}) AS need, sum(n) OVER up AS upto, lead(n) OVER up AS next, row_number() OVER up AS place
  FROM sizes WINDOW up AS (ORDER BY n, stratum)),
groups AS (SELECT stratum, CASE WHEN place > (SELECT min(place) FROM needs WHERE upto >= need AND (next IS NULL OR next >= need)) THEN place ELSE 0 END AS grp FROM needs),
counted AS (SELECT grp, rule, step, count(*) FILTER (good = 1) AS good, count(*) FILTER (good = 0) AS bad FROM labelled JOIN groups USING (stratum) WHERE NOT holdout GROUP BY ALL),
cumulated AS (SELECT grp, rule, step, sum(good) OVER a AS good, sum(bad) OVER a AS bad, sum(good) OVER p AS all_good, sum(bad) OVER p AS all_bad
  FROM counted WINDOW a AS (PARTITION BY grp, rule ORDER BY step DESC), p AS (PARTITION BY grp, rule)),
levels AS (SELECT unnest({list(range(len(LEVELS)))}) AS level, unnest({[x for x, _ in LEVELS]}::DOUBLE[]) AS share, unnest({[x for _, x in LEVELS]}) AS more),
path AS (SELECT grp, rule, level, min(step) + more AS cutoff FROM cumulated, levels
  WHERE step >= 1 AND bad > 0 AND bad * all_good >= {LIFT} * good * all_bad AND good <= all_good * share GROUP BY grp, rule, level, more HAVING min(step) + more <= {STEPS}),
held AS (SELECT grp, count(DISTINCT rid) AS n, count(*) OVER () AS tests FROM labelled JOIN groups USING (stratum) WHERE holdout AND good = 1 GROUP BY grp),
lost AS (SELECT grp, level, count(DISTINCT rid) AS k FROM labelled JOIN groups USING (stratum) JOIN path USING (grp, rule) WHERE holdout AND good = 1 AND step >= cutoff GROUP BY ALL),
tails AS (SELECT grp, level, tests, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))
  FROM unnest(generate_series(0, coalesce(k, 0)::BIGINT)) AS u(i)) AS tail FROM held CROSS JOIN levels LEFT JOIN lost USING (grp, level)),
admitted AS (SELECT grp, max(level) AS level FROM tails WHERE tail <= {DELTA} / tests GROUP BY grp),
limits AS (SELECT stratum, rule, cutoff FROM groups JOIN admitted USING (grp) JOIN path USING (grp, level)),
rejected AS (SELECT DISTINCT rid FROM steps JOIN limits USING (stratum, rule) WHERE step >= cutoff)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rejected.rid IS NULL AS kept
FROM judged LEFT JOIN rejected USING (rid)
"""
