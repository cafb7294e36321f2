"""Queries on entity tables: lookups, labels, splits, rollups and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import entities, features, models, ranking, scoring
from .common import POS, Query, activations, positions, r6, sequences, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


_add(
    "token_meta_join",
    lambda s, d: entities.lookup(table(s, d, "events").select("event_id", F.col("user_id").alias("c_custkey")), table(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment"), ["c_custkey"], {"c_mktsegment": "none"}),
    "SELECT event_id, user_id AS c_custkey, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey",
)
_add(
    "dense_dictionary",
    lambda s, d: entities.lookup(table(s, d, "documents").select("doc_id", "source"), entities.dense_codes(table(s, d, "documents").where("lang <> 'fr'"), "source", "code"), ["source"], {"code": -1}),
    "WITH c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents WHERE lang <> 'fr')) SELECT doc_id, source, coalesce(code, -1) AS code FROM documents LEFT JOIN c USING (source)",
)
_add(
    "keyfirst_lookup",
    lambda s, d: table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").count().join(entities.keep_first(table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice"]), ["l_partkey", "l_suppkey"]),
    "SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS count, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1",
)
_add(
    "exact_text_dedup",
    lambda s, d: entities.first_of_text(table(s, d, "documents"), "text", "doc_id"),
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
)


def three_way_shared(spark, sf_dir):
    """Customers with orders of three statuses, and the three totals."""
    o = table(spark, sf_dir, "orders")
    totals = [o.where(F.col("o_orderstatus") == x).groupBy("o_custkey").agg(F.sum("o_totalprice").alias(f"p_{x}")) for x in "OFP"]
    return entities.shared_entities(totals, "o_custkey").select("o_custkey", *(F.round(f"p_{x}", 2).alias(f"p_{x}") for x in "OFP"))


_add(
    "three_way_shared",
    three_way_shared,
    "SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS \"p_O\", round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS \"p_F\", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS \"p_P\" FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('O', 'F', 'P')) = 3",
)
_add(
    "left_composite",
    lambda s, d: table(s, d, "lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_partkey").join(table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("sge_score")), ["l_orderkey", "l_linenumber"], "left"),
    "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, sge_score FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS sge_score FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b USING (l_orderkey, l_linenumber) WHERE l_discount > 0.05",
)
_add(
    "semi_anti_novel",
    lambda s, d: table(s, d, "orders").select("o_orderkey", "o_custkey").join(table(s, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
_add(
    "panel_merge",
    lambda s, d: entities.merged_panels(table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v")).groupBy("k").agg(F.max("v").alias("v")), table(s, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v")), "k"),
    "SELECT k, coalesce(b.v, a.v) AS v FROM (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b USING (k)",
)
_add(
    "candidate_lookup",
    lambda s, d: s.createDataFrame([(1,), (5,), (-3,), (99,)], "o_orderkey long").join(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "left").withColumn("found", F.col("o_totalprice").isNotNull()),
    "SELECT k.o_orderkey, o_totalprice, o_totalprice IS NOT NULL AS found FROM (SELECT unnest([1, 5, -3, 99])::BIGINT AS o_orderkey) k LEFT JOIN orders USING (o_orderkey)",
)
_add(
    "top_counts",
    lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(100),
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100",
)
_add(
    "family_stats",
    lambda s, d: table(s, d, "documents").select("source", "n_chars").unionAll(table(s, d, "documents").where("lang = 'en'").select("source", "n_chars")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_length")),
    "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_length FROM (SELECT source, n_chars FROM documents UNION ALL SELECT source, n_chars FROM documents WHERE lang = 'en') GROUP BY source",
)
_add(
    "family_rollup",
    lambda s, d: entities.family_rollup(table(s, d, "lineitem").withColumn("v", F.when(F.col("l_tax") > 0, F.col("l_tax"))), "l_suppkey", "l_discount", "v", "l_orderkey"),
    "SELECT l_suppkey, count(*) AS n, max(l_discount) AS max_p, median(l_discount) AS median_p, max(CASE WHEN l_tax > 0 THEN l_tax END) AS max_value, arg_min(l_orderkey, (-l_discount, l_orderkey)) AS example FROM lineitem GROUP BY l_suppkey",
)


def consensus_map(spark, sf_dir):
    """Two event types as two models' maps; users whose maps differ in length are left out."""
    w = Window.partitionBy("user_id", "event_type").orderBy("pos")
    maps = positions(spark, sf_dir).where("event_type IN ('click', 'view')").select(F.col("user_id").alias("gene"), F.col("event_type").alias("model"), F.row_number().over(w).cast("bigint").alias("pos"), "score")
    return entities.mean_maps(maps).select("gene", "pos", *r6("score"))


_add(
    "consensus_map",
    consensus_map,
    f"""WITH {POS}, m AS (SELECT user_id AS gene, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS pos, score FROM pos WHERE event_type IN ('click', 'view')),
    l AS (SELECT gene, event_type, count(*) AS l FROM m GROUP BY ALL), f AS (SELECT gene FROM l GROUP BY gene HAVING count(*) >= 2 AND min(l) = max(l)) SELECT gene, pos, round(avg(score), 6) AS score FROM m WHERE gene IN (SELECT gene FROM f) GROUP BY gene, pos""",
)
_add(
    "model_min_mean",
    lambda s, d: entities.wide_consensus(table(s, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_discount").alias("p")), "l_partkey", "l_returnflag", "p", ["A", "N", "R"]).select("l_partkey", *r6("p_min", "p_mean")),
    "WITH m AS (SELECT l_partkey, l_returnflag, avg(l_discount) AS p FROM lineitem GROUP BY ALL) SELECT l_partkey, round(min(p), 6) AS p_min, round(avg(p), 6) AS p_mean FROM m GROUP BY l_partkey HAVING count(*) = 3",
)


def hit_rollup(spark, sf_dir):
    """Hits by user and event type, with the first positions in order of their share of the user's maximum."""
    w = Window.partitionBy("user_id")
    rows = positions(spark, sf_dir).withColumn("peak_share", F.col("score") / F.max("score").over(w)).select(F.col("user_id").alias("gene"), F.col("event_type").alias("family"), "peak_share", "pos", F.lit(0).alias("feat")).where("peak_share >= 0.25")
    return scoring.rollup(rows).select("gene", "family", "n", *r6("best"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


_add(
    "hit_rollup",
    hit_rollup,
    f"""WITH {POS}, h AS (SELECT user_id AS gene, event_type AS family, score / max(score) OVER (PARTITION BY user_id) AS share, pos FROM pos), r AS (SELECT *, row_number() OVER (PARTITION BY gene, family ORDER BY share DESC, pos) AS rn FROM h WHERE share >= 0.25)
    SELECT gene, family, count(*) AS n, round(max(share), 6) AS best, string_agg(pos::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 12) AS positions FROM r GROUP BY gene, family""",
)
_add(
    "coverage_report",
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.round(F.avg(F.col("quality").isNotNull().cast("double")), 6).alias("share"), F.count_if(F.col("quality") == 1).alias("good")),
    "SELECT lang, count(*) AS n, count(quality) AS labelled, round(count(quality) / count(*), 6) AS share, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
_add(
    "macro_f1",
    lambda s, d: entities.classifier_metrics(table(s, d, "embeddings").withColumn("p", F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), "label", "p").select("n", *r6("accuracy", "macro_f1")),
    """WITH p AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings), c AS (SELECT label, count(*) AS s, count(*) FILTER (label = p) AS tp FROM p GROUP BY label), q AS (SELECT p AS label, count(*) AS called FROM p GROUP BY p)
    SELECT sum(s)::BIGINT AS n, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(2 * tp / (s + coalesce(called, 0))), 6) AS macro_f1 FROM c LEFT JOIN q USING (label)""",
)
_add(
    "sample_n_per_family",
    lambda s, d: entities.first_per_group(table(s, d, "documents").select("doc_id", "source"), "source", [F.expr("doc_id * 7919 % 10007"), "doc_id"], 25).select("doc_id", F.concat_ws("_", "source", F.lpad(F.col("nth").cast("string"), 2, "0")).alias("name")),
    "SELECT doc_id, source || '_' || lpad(nth::VARCHAR, 2, '0') AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 10007, doc_id) AS nth FROM documents) WHERE nth <= 25",
)
_add(
    "stratified_split",
    lambda s, d: entities.stratified_split(table(s, d, "documents").select("doc_id", "source"), "source", [F.expr("doc_id * 7919 % 10007"), "doc_id"]),
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 10007, doc_id) <= CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.25::DOUBLE, 0)) ELSE 0 END AS test FROM documents",
)


def tail_split(spark, sf_dir):
    """The last twentieth of each label's vectors in key order is for evaluation."""
    rows = entities.tail_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"], by=["label"])
    return rows.withColumnRenamed("tail", "evaluation")


_add("tail_split", tail_split, "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) > count(*) OVER (PARTITION BY label) - floor(count(*) OVER (PARTITION BY label) * 0.05::DOUBLE) AS evaluation FROM embeddings")


def set_algebra(spark, sf_dir):
    """Sizes of two position sets' union, intersection and differences."""
    p = positions(spark, sf_dir)
    a, b = (p.where(F.col("event_type") == t).select((F.col("pos") % 97).alias("k"), F.col("user_id") % 20).distinct() for t in ("error", "purchase"))
    parts = {"union": a.union(b).distinct(), "intersection": a.intersect(b), "only_a": a.exceptAll(b), "only_b": b.exceptAll(a)}
    out = None
    for k, v in parts.items():
        one = v.agg(F.lit(k).alias("operation"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_add(
    "set_algebra",
    set_algebra,
    f"""WITH {POS}, a AS (SELECT DISTINCT pos % 97 AS k, user_id % 20 AS u FROM pos WHERE event_type = 'error'), b AS (SELECT DISTINCT pos % 97 AS k, user_id % 20 AS u FROM pos WHERE event_type = 'purchase')
    SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
_add(
    "group_kfold",
    lambda s, d: table(s, d, "documents").select("doc_id", "source").join(entities.group_folds(table(s, d, "documents"), "source"), "source"),
    None,
)
_add(
    "label_shuffle",
    lambda s, d: entities.permuted_labels(table(s, d, "labels"), "doc_id", "quality", F.expr("doc_id * 7919 % 10007 * 1000000000000 + doc_id")),
    """SELECT doc_id, quality FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM labels) JOIN (SELECT quality, row_number() OVER (ORDER BY doc_id * 7919 % 10007, doc_id) AS i FROM labels) USING (i)""",
)


def logreg_cv(spark, sf_dir):
    """AUC of each fold for one label against the others, folds by hash of the vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).cast("int").alias("fold"), "embedding")
    data = rows.withColumn("features", models.array_to_vector("embedding")).drop("embedding")
    return models.fold_aucs(models.out_of_fold(data, "features", "y"), "y")


_add("logreg_cv", logreg_cv, None)


def fitted_coefficients(spark, sf_dir):
    """The 15 largest coefficients of the model that tells one label from the others."""
    data = table(spark, sf_dir, "embeddings").select((F.col("label") == 0).cast("int").alias("y"), models.array_to_vector("embedding").alias("features"))
    rows = [(i + 1, f, c) for i, (f, c) in enumerate(models.top_coefficients(data, "features", "y"))]
    return spark.createDataFrame(rows, "rank int, feat int, coef double").select("rank", "feat", *r6("coef"))


_add("fitted_coefficients", fitted_coefficients, None)


def kmer_probe(spark, sf_dir):
    """Do 3-mer shares tell labelled quality? Folds hold whole sources, so none is on both sides."""
    seqs = sequences(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    words = [a + b + c for a in "ACGU" for b in "ACGU" for c in "ACGU"]
    # Counts as rows and a map gathered from them: a map written out for each word would repeat the whole expression.
    counts = features.kmer_table(seqs, ["doc_id", "source", "y"]).groupBy("doc_id", "source", "y").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("m"), F.max("valid").alias("total"))
    vectors = counts.select("doc_id", "source", "y", models.array_to_vector(F.array(*(F.coalesce(F.try_element_at("m", F.lit(w)), F.lit(0)) / F.col("total") for w in words))).alias("features"))
    folded = vectors.join(entities.group_folds(vectors, "source"), "source").select("doc_id", "y", "fold", "features")
    return models.fold_aucs(models.out_of_fold(folded, "features", "y"), "y")


_add("kmer_probe", kmer_probe, None)
_add(
    "feature_floor",
    lambda s, d: activations(s, d).groupBy("label").agg(F.round(F.avg(S.relative_drop(F.greatest(F.col("x"), F.lit(0.0)), F.lit(0.05))), 6).alias("drop")),
    "SELECT label, round(avg(greatest(greatest(x, 0) - 0.05::DOUBLE, 0) / greatest(greatest(x, 0), 1e-6)), 6) AS drop FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label",
)


def value_add(spark, sf_dir):
    """How much better the price tells returned rows than the discount does, for each line number."""
    long = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", F.explode(F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("discount"), F.col("l_discount"))).alias("block", "score"))
    each = ranking.mann_whitney(long, "score", F.col("l_returnflag") == "R", ["l_linenumber", "block"])
    return entities.value_add(each, "l_linenumber", "block", "auc", "price", "discount").select("l_linenumber", *r6("full", "base", "delta"))


_add(
    "value_add",
    value_add,
    """WITH l AS (SELECT l_linenumber, l_returnflag = 'R' AS y, unnest(['price', 'discount']) AS block, unnest([l_extendedprice, l_discount]) AS score FROM lineitem),
    r AS (SELECT *, rank() OVER (PARTITION BY l_linenumber, block ORDER BY score) + (count(*) OVER (PARTITION BY l_linenumber, block, score) - 1) / 2 AS rk FROM l),
    a AS (SELECT l_linenumber, block, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM r GROUP BY ALL)
    SELECT l_linenumber, round(max(auc) FILTER (block = 'price'), 6) AS "full", round(max(auc) FILTER (block = 'discount'), 6) AS base, round(max(auc) FILTER (block = 'price') - max(auc) FILTER (block = 'discount'), 6) AS delta FROM a GROUP BY l_linenumber""",
)
_add(
    "rediscovery_means",
    lambda s, d: entities.rediscovery(table(s, d, "part"), "p_type", "p_retailprice", {"economy": ["ECONOMY"], "large": ["LARGE", "MEDIUM"]}).select("named", "n", *r6("mean")),
    "SELECT CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'economy' WHEN starts_with(p_type, 'LARGE') OR starts_with(p_type, 'MEDIUM') THEN 'large' ELSE 'other' END AS named, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1",
)
