"""Queries on agreement between two halves of the features, as between two models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .common import PRESENCE, Query, presence, r6, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _halves(spark, sf_dir):
    """Features 0 to 31 stand for one model and 32 to 63 for another."""
    rows = presence(spark, sf_dir)
    return rows.where("feat < 32"), rows.where("feat >= 32").withColumn("feat", F.col("feat") - 32)


def _pairs(spark, sf_dir):
    return matching.jaccard_pairs(*_halves(spark, sf_dir), most=10)


PAIRS = f"""{PRESENCE}, n AS (SELECT *, count(*) OVER (PARTITION BY feat) AS n FROM present),
  j AS (SELECT a.feat AS fa, b.feat - 32 AS fb, a.n AS na, b.n AS nb, count(*) AS shared, count(*) / greatest(a.n + b.n - count(*), 1) AS jaccard FROM n a JOIN n b USING (label)
  WHERE a.feat < 32 AND b.feat >= 32 AND a.n BETWEEN 2 AND 10 AND b.n BETWEEN 2 AND 10 GROUP BY a.feat, b.feat, a.n, b.n)"""
_add("jaccard_pairs", lambda s, d: _pairs(s, d).select("fa", "fb", "na", "nb", "shared", *r6("jaccard")), f"WITH {PAIRS} SELECT fa, fb, na, nb, shared, round(jaccard, 6) AS jaccard FROM j")
BEST = f"""{PAIRS}, best AS (SELECT *, row_number() OVER (PARTITION BY fa ORDER BY jaccard DESC, fb) AS ra, row_number() OVER (PARTITION BY fb ORDER BY jaccard DESC, fa) AS rb FROM j), mutual AS (SELECT * FROM best WHERE ra = 1 AND rb = 1 AND jaccard >= 0.5)"""
_add("reciprocal_best", lambda s, d: matching.reciprocal_best(_pairs(s, d)).select("fa", "fb", *r6("jaccard")), f"WITH {BEST} SELECT fa, fb, round(jaccard, 6) AS jaccard FROM mutual")


def _orders(spark, sf_dir, flag):
    """Orders as features and suppliers of their returned, or else of their unreturned lines as families."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("feat"), F.col("l_suppkey").alias("label"))


SUPPLIED = """o AS (SELECT DISTINCT l_returnflag AS flag, l_orderkey AS f, l_suppkey AS fam FROM lineitem), z AS (SELECT *, count(*) OVER (PARTITION BY flag, f) AS n FROM o),
  j AS (SELECT a.f AS fa, b.f AS fb, a.n AS na, b.n AS nb, count(*) AS shared, count(*) / (a.n + b.n - count(*)) AS jaccard FROM z a JOIN z b USING (fam)
  WHERE a.flag = 'R' AND b.flag = 'N' AND a.n BETWEEN 2 AND 9 AND b.n BETWEEN 2 AND 9 GROUP BY a.f, b.f, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*)))"""
_add(
    "jaccard_similar",
    lambda s, d: matching.jaccard_pairs(_orders(s, d, "R"), _orders(s, d, "N"), similarity=0.5).select("fa", "fb", "na", "nb", "shared", *r6("jaccard")),
    f"WITH {SUPPLIED} SELECT fa, fb, na, nb, shared, round(jaccard, 6) AS jaccard FROM j",
)
_add(
    "mutual_best",
    lambda s, d: matching.mutual_best(_orders(s, d, "R"), _orders(s, d, "N")).select("fa", "fb", *r6("jaccard")),
    f"""WITH {SUPPLIED}, best AS (SELECT *, row_number() OVER (PARTITION BY fa ORDER BY jaccard DESC, fb) AS ra, row_number() OVER (PARTITION BY fb ORDER BY jaccard DESC, fa) AS rb FROM j)
    SELECT fa, fb, round(jaccard, 6) AS jaccard FROM best WHERE ra = 1 AND rb = 1""",
)


def shared_vocabulary(spark, sf_dir):
    """Events' users and orders' customers without those that the other lacks."""
    a, b = matching.shared_vocabulary(table(spark, sf_dir, "events").select(F.col("user_id").alias("label")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("label")))
    return a.groupBy("label").count().unionByName(b.groupBy("label").count()).groupBy("label").agg(F.sum("count").alias("n"))


_add(
    "shared_vocabulary",
    shared_vocabulary,
    """WITH a AS (SELECT user_id AS label FROM events), b AS (SELECT o_custkey AS label FROM orders), c AS (SELECT label FROM a INTERSECT SELECT label FROM b)
    SELECT label, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE label IN (SELECT label FROM c) GROUP BY label""",
)
_add(
    "pair_combinations",
    lambda s, d: matching.model_pairs(table(s, d, "region").select(F.col("r_name").alias("model"))),
    "SELECT x.r_name AS a, y.r_name AS b FROM region x JOIN region y ON x.r_name < y.r_name",
)
_add(
    "explode_best",
    lambda s, d: matching.best_feature_by_family(presence(s, d).groupBy("feat").agg(F.collect_set("label").alias("families"), F.max("max_act").alias("act"))).select("family", "feat", *r6("act")),
    f"WITH {PRESENCE}, f AS (SELECT feat, max(max_act) AS act FROM present GROUP BY feat) SELECT label AS family, feat, round(act, 6) AS act FROM present JOIN f USING (feat) QUALIFY row_number() OVER (PARTITION BY label ORDER BY act DESC, feat) = 1",
)


def support_count(spark, sf_dir):
    """Sets of nations that orders connect, by how many priorities connect them."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    matches = rows.select(F.array(F.col("c_nationkey"), (F.col("o_orderkey") % 25).cast("int")).alias("families"), F.col("o_orderpriority").alias("pair"), F.round(F.col("o_totalprice") / 600_000, 4).alias("jaccard"))
    return matching.support(matches).select(F.array_join(F.col("key").cast("array<string>"), ",").alias("families"), "n_pairs", "best", "best_pair")


_add(
    "support_count",
    support_count,
    """WITH m AS (SELECT list_sort(list_distinct([c_nationkey, (o_orderkey % 25)::INTEGER])) AS k, o_orderpriority AS pair, round(o_totalprice / 600000, 4) AS j FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT k, j, pair FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY j DESC, pair) = 1), n AS (SELECT k, count(DISTINCT pair) AS n_pairs FROM m GROUP BY k)
    SELECT array_to_string(k, ',') AS families, n_pairs, j AS best, pair AS best_pair FROM n JOIN b USING (k)""",
)
_add(
    "connection_flags",
    lambda s, d: matching.connection_flags(table(s, d, "documents").withColumn("gc", F.col("doc_id") % 100 / 100).withColumn("n", F.col("n_chars").cast("double")), "source", "n", "gc").select("source", F.col("n"), "lo", "hi", *r6("gc_spread", "len_ratio"), "all_long", "len_diverse"),
    """SELECT source, count(*) AS n, min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, round(max(doc_id % 100 / 100) - min(doc_id % 100 / 100), 6) AS gc_spread, round(max(n_chars) / greatest(min(n_chars), 1), 6) AS len_ratio, min(n_chars) >= 200 AS all_long, max(n_chars) / greatest(min(n_chars), 1) >= 1.8 AS len_diverse FROM documents GROUP BY source""",
)


def topn_jaccard(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("a"), F.sum("l_linenumber").cast("double").alias("b"))
    return matching.top_overlap(parts.select("l_partkey", F.col("a").alias("score")), parts.select("l_partkey", F.col("b").alias("score")), "l_partkey", "score", [25, 50, 100]).select("n", "shared", "united", *r6("jaccard"))


_add(
    "topn_jaccard",
    topn_jaccard,
    """WITH p AS (SELECT l_partkey, sum(l_quantity) AS a, sum(l_linenumber)::DOUBLE AS b FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY a DESC, l_partkey) AS ra, row_number() OVER (ORDER BY b DESC, l_partkey) AS rb FROM p),
    s AS (SELECT n, count(*) FILTER (ra <= n AND rb <= n) AS shared, count(*) FILTER (ra <= n OR rb <= n) AS united FROM r, (SELECT unnest([25, 50, 100])::BIGINT AS n) GROUP BY n) SELECT n, shared, united, round(shared / united, 6) AS jaccard FROM s""",
)


def class_sets(spark, sf_dir):
    """Regions of the families that each feature is present in; families above 7 have none."""
    types = table(spark, sf_dir, "nation").where("n_nationkey < 8").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("family"), F.col("r_name").alias("kind"))
    matches = presence(spark, sf_dir).groupBy("feat").agg(F.collect_set("label").alias("families"))
    return matching.class_sets(matches, types, ["feat"]).select("feat", F.array_join("classes", ",").alias("classes"), "crosses")


_add(
    "class_sets",
    class_sets,
    f"""WITH {PRESENCE}, t AS (SELECT n_nationkey AS label, r_name AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 8), c AS (SELECT DISTINCT feat, coalesce(kind, '') AS kind FROM present LEFT JOIN t USING (label))
    SELECT feat, string_agg(kind, ',' ORDER BY kind) AS classes, count(*) FILTER (kind <> '') > 1 AS crosses FROM c GROUP BY feat""",
)
