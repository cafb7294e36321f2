"""Queries on ranks, statistics and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, intervals, ranking
from ..operators.selection import medians
from ..sources.storage import written
from .common import POS, Query, positions, r6, table, tail_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


_add(
    "avg_rank",
    lambda s, d: ranking.average_rank(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_extendedprice"),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rank FROM lineitem",
)

_add(
    "auc_mwu",
    lambda s, d: ranking.mann_whitney(positions(s, d), "score", F.col("event_type") == "error", ["user_id"]).select("user_id", "n_pos", "n_neg", *r6("auc", "z", "mean_percentile")),
    f"""WITH {POS}, r AS (SELECT user_id, event_type = 'error' AS y, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2 AS rk FROM pos),
    g AS (SELECT user_id, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, sum(rk) FILTER (y) AS s FROM r GROUP BY user_id)
    SELECT user_id, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc,
    CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((s - n_pos * (n_pos + 1) / 2 - n_pos * n_neg / 2) / sqrt(n_pos * n_neg * (n_pos + n_neg + 1) / 12), 6) END AS z,
    CASE WHEN n_pos > 0 THEN round(s / n_pos / (n_pos + n_neg), 6) END AS mean_percentile FROM g""",
)

_add(
    "auc_p_value",
    lambda s, d: ranking.mann_whitney(table(s, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R", ["l_linenumber"]).withColumn("p", ranking.two_sided_p("z")).select("l_linenumber", *r6("auc", "z"), F.round("p", 6).alias("p")),
    f"""WITH r AS (SELECT l_linenumber, l_returnflag = 'R' AS y, rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2 AS rk FROM lineitem),
    g AS (SELECT l_linenumber, (count(*) FILTER (y))::DOUBLE AS a, (count(*) FILTER (NOT y))::DOUBLE AS b, sum(rk) FILTER (y) AS s FROM r GROUP BY l_linenumber),
    u AS (SELECT l_linenumber, (s - a * (a + 1) / 2) / (a * b) AS auc, (s - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b * (a + b + 1) / 12) AS z FROM g)
    SELECT l_linenumber, round(auc, 6) AS auc, round(z, 6) AS z, round({tail_sql("z")}, 6) AS p FROM u""",
)

_add(
    "spearman",
    lambda s, d: ranking.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "n", *r6("r")),
    """WITH r AS (SELECT l_returnflag, l_linestatus, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) - 1) / 2 AS x,
    rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_extendedprice) - 1) / 2 AS y FROM lineitem)
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(x, y), 6) AS r FROM r GROUP BY ALL""",
)
_add(
    "pearson",
    lambda s, d: ranking.correlation(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", *r6("r")),
    "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL",
)

_add(
    "max_normalise",
    lambda s, d: ranking.scaled(positions(s, d), "score", ["user_id"]).select("user_id", "pos", *r6("by_max", "by_range")),
    f"""WITH {POS} SELECT user_id, pos, round(score / CASE WHEN max(score) OVER w = 0 THEN 1 ELSE max(score) OVER w END, 6) AS by_max,
    CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) ELSE 0.0 END AS by_range FROM pos WINDOW w AS (PARTITION BY user_id)""",
)


def _regions(spark, sf_dir):
    return positions(spark, sf_dir).select("user_id").distinct().select("user_id", (F.col("user_id") % 20 + 5).alias("lo"), (F.col("user_id") % 20 + 20).alias("hi"))


_add(
    "interval_enrichment",
    lambda s, d: ranking.region_enrichment(positions(s, d), _regions(s, d), ["user_id"]).select("user_id", "lo", "hi", *r6("mean_in", "mean_out", "ratio", "region_share", "top_share", "fold")),
    f"""WITH {POS}, m AS (SELECT *, user_id % 20 + 5 AS lo, user_id % 20 + 20 AS hi, count(*) OVER (PARTITION BY user_id) AS l, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS rn FROM pos),
    k AS (SELECT *, pos BETWEEN lo AND hi AS inside, greatest(1, round_even(l * 0.15::DOUBLE, 0)) AS top FROM m),
    g AS (SELECT user_id, lo, hi, avg(score) FILTER (inside) AS a, avg(score) FILTER (NOT inside) AS b, avg(inside::INTEGER) AS share, (count(*) FILTER (inside AND rn <= top)) / max(top) AS t FROM k GROUP BY user_id, lo, hi)
    SELECT user_id, lo, hi, round(a, 6) AS mean_in, round(b, 6) AS mean_out, CASE WHEN b > 0 THEN round(a / b, 6) END AS ratio, round(share, 6) AS region_share, round(t, 6) AS top_share, round(t / share, 6) AS fold FROM g WHERE a IS NOT NULL AND b IS NOT NULL""",
)

_add(
    "named_percentile",
    lambda s, d: ranking.named_percentiles(positions(s, d), positions(s, d).where("event_type = 'purchase'"), ["user_id"]).select("user_id", "pos", "rank", *r6("percentile")),
    f"""WITH {POS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY user_id) AS l FROM pos)
    SELECT user_id, pos, rank, round(1 - (rank - 1) / l, 6) AS percentile FROM r WHERE event_type = 'purchase'""",
)

_add(
    "anti_band",
    lambda s, d: ranking.novel_positions(positions(s, d), positions(s, d).where("event_type = 'error'"), ["user_id"]).select("user_id", "pos", "score", "rank"),
    f"""WITH {POS}, far AS (SELECT * FROM pos a WHERE NOT EXISTS (SELECT 1 FROM pos b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND abs(a.pos - b.pos) <= 2))
    SELECT user_id, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS rank FROM far) WHERE rank <= 10""",
)

_add(
    "quantile_cut",
    lambda s, d: ranking.quantile_cut(positions(s, d), "score", ["user_id"], 0.3).select("user_id", "pos", "score", "cut"),
    f"""WITH {POS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM pos),
    c AS (SELECT *, max(score) FILTER (rn = greatest(1, floor(n * 0.3::DOUBLE))) OVER (PARTITION BY user_id) AS cut FROM r) SELECT user_id, pos, score, cut FROM c WHERE score <= cut""",
)

_add(
    "cumulative_threshold",
    lambda s, d: ranking.cumulative_threshold(positions(s, d), "pos", "score", ["user_id"], 0.5),
    f"""WITH {POS}, c AS (SELECT user_id, pos, sum(score) OVER (PARTITION BY user_id ORDER BY pos) AS s, sum(score) OVER (PARTITION BY user_id) AS t FROM pos)
    SELECT user_id, min(pos) FILTER (s >= 0.5 * t - 1e-12) AS reached FROM c GROUP BY user_id""",
)

_add(
    "position_summary",
    lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_score"), F.min("l_discount").alias("min_score"), F.round(F.avg("l_tax"), 6).alias("mean_covariate")).where("n >= 5"),
    "SELECT l_partkey, count(*) AS n, round(avg(l_discount), 6) AS mean_score, min(l_discount) AS min_score, round(avg(l_tax), 6) AS mean_covariate FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5",
)


def sign_test(spark, sf_dir):
    """Groups whose AUC is over one half, their median, and the chance of as many wins."""
    each = ranking.mann_whitney(positions(spark, sf_dir), "score", F.col("event_type") == "error", ["user_id"])
    each = written(each.where("auc IS NOT NULL"))
    panel = each.agg(F.count("auc").alias("n"), F.count_if(F.col("auc") > 0.5).alias("wins"), F.count_if(F.abs("z") > 1.96).alias("significant"))
    panel = panel.withColumn("median_auc", F.lit(medians(each, [], "auc").agg(F.first("median")).first()[0]).cast("double"))
    return panel.select("n", "wins", "significant", F.round("median_auc", 6).alias("median_auc"), F.round(ranking.binomial_tail("wins", F.col("n").cast("int"), F.lit(0.5)), 6).alias("p"))


_add(
    "sign_test",
    sign_test,
    f"""WITH {POS}, r AS (SELECT user_id, event_type = 'error' AS y, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2 AS rk FROM pos),
    g AS (SELECT user_id, (count(*) FILTER (y))::DOUBLE AS a, (count(*) FILTER (NOT y))::DOUBLE AS b, sum(rk) FILTER (y) AS s FROM r GROUP BY user_id),
    u AS (SELECT (s - a * (a + 1) / 2) / (a * b) AS auc, (s - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b * (a + b + 1) / 12) AS z FROM g WHERE a > 0 AND b > 0),
    p AS (SELECT count(*) AS n, count(*) FILTER (auc > 0.5) AS wins, count(*) FILTER (abs(z) > 1.96) AS significant, median(auc) AS m FROM u)
    SELECT n, wins, significant, round(m, 6) AS median_auc, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM unnest(generate_series(wins, n)) AS t(i)), 6) AS p FROM p""",
)


def triage(spark, sf_dir):
    """Variant rows labelled by the clinic or the population, and each predictor's AUC."""
    rows = table(spark, sf_dir, "lineitem").withColumn("y", entities.population_label((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.col("l_tax") > 0.05)).where("y IS NOT NULL")
    long = rows.select("y", F.explode(F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("discount"), F.col("l_discount"))).alias("predictor", "score"))
    return ranking.mann_whitney(long, "score", F.col("y") == 1, ["predictor"]).select("predictor", "n_pos", "n_neg", *r6("auc"))


_add(
    "triage_auc",
    triage,
    """WITH t AS (SELECT l_returnflag = 'R' AND l_linestatus = 'F' AS p, l_tax > 0.05 AS q, l_extendedprice, l_discount FROM lineitem), l AS (SELECT p AS y, unnest(['price', 'discount']) AS predictor, unnest([l_extendedprice, l_discount]) AS score FROM t WHERE p <> q),
    r AS (SELECT predictor, y, rank() OVER (PARTITION BY predictor ORDER BY score) + (count(*) OVER (PARTITION BY predictor, score) - 1) / 2 AS rk FROM l)
    SELECT predictor, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r GROUP BY predictor""",
)
_add(
    "population_label",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", entities.population_label(F.col("l_returnflag") == "R", F.col("l_discount") > 0.05).alias("y")).where("y IS NOT NULL"),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::BIGINT AS y FROM lineitem WHERE (l_returnflag = 'R') <> (l_discount > 0.05)",
)


def interval_membership(spark, sf_dir):
    """Discounts of lines inside and outside of overlapping price bands, a band for each part and as wide as its size says."""
    bands = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * F.pmod(F.col("p_partkey"), F.lit(97)) + 1).alias("lo"), F.pow(F.lit(1.25), F.col("p_size") - 10).alias("width"))
    points = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount")
    found = intervals.inside_outside(points, bands.withColumn("hi", F.col("lo") + F.col("width")), "l_extendedprice", "l_discount", "p_partkey", "lo", "hi")
    return found.select("p_partkey", "n_in", *r6("mean_in"), "n_out", *r6("mean_out", "ratio"))


_add(
    "interval_membership",
    interval_membership,
    """WITH b AS (SELECT p_partkey, p_retailprice * (p_partkey % 97) + 1 AS lo, pow(1.25::DOUBLE, p_size - 10) AS width FROM part),
    i AS (SELECT p_partkey, count(*) AS n_in, sum(l_discount) AS s FROM b JOIN lineitem ON l_extendedprice >= lo AND l_extendedprice < lo + width GROUP BY p_partkey),
    w AS (SELECT count(*) AS n, sum(l_discount) AS t FROM lineitem),
    m AS (SELECT p_partkey, coalesce(n_in, 0) AS n_in, s / n_in AS mean_in, n - coalesce(n_in, 0) AS n_out, (t - coalesce(s, 0)) / nullif(n - coalesce(n_in, 0), 0) AS mean_out FROM part LEFT JOIN i USING (p_partkey), w)
    SELECT p_partkey, n_in, round(mean_in, 6) AS mean_in, n_out, round(mean_out, 6) AS mean_out, round(CASE WHEN mean_out > 0 THEN mean_in / mean_out END, 6) AS ratio FROM m""",
)
