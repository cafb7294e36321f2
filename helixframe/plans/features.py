"""Queries on activations: moments, maxima, breadth, variance shares and autoencoder steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import features, models, scoring
from .common import ACT, Query, activations, r6, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def feature_breadth(spark, sf_dir):
    """Families in which each feature is present, and its bucket."""
    return features.breadth(features.family_max(activations(spark, sf_dir))).select("feat", *r6("feat_max"), "breadth", "bucket")


BREADTH = f"""{ACT}, fm AS (SELECT feat, label, max(greatest(x, 0)) AS m FROM act GROUP BY feat, label), mx AS (SELECT *, max(m) OVER (PARTITION BY feat) AS mm FROM fm),
  br AS (SELECT feat, max(mm) AS feat_max, (count(*) FILTER (m >= 0.25 * mm AND mm > 0)) AS breadth FROM mx GROUP BY feat)"""
_add(
    "feature_breadth",
    feature_breadth,
    f"WITH {BREADTH} SELECT feat, round(feat_max, 6) AS feat_max, breadth, CASE WHEN feat_max = 0 THEN 'dead' WHEN breadth <= 2 THEN 'specialist' WHEN breadth <= 9 THEN 'moderate' ELSE 'generalist' END AS bucket FROM br",
)
_add("feature_family_max", lambda s, d: features.family_max(activations(s, d)).select("feat", "label", *r6("max_act")), f"WITH {ACT} SELECT feat, label, round(max(greatest(x, 0)), 6) AS max_act FROM act GROUP BY feat, label")
_add(
    "active_counts",
    lambda s, d: activations(s, d).groupBy("feat").agg(F.count_if(F.col("x") > 0).alias("active"), F.count(F.lit(1)).alias("n")),
    f"WITH {ACT} SELECT feat, count(*) FILTER (x > 0) AS active, count(*) AS n FROM act GROUP BY feat",
)
_add("global_moments", lambda s, d: features.moments(activations(s, d), "x").select("n", *r6("mean", "std")), f"WITH {ACT} SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM act")
_add(
    "position_mean_guard",
    lambda s, d: features.guarded_means(activations(s, d), ["label", "feat"], "x", 50).select("label", "feat", "n", *r6("mean")),
    f"WITH {ACT} SELECT label, feat, count(x) AS n, round(CASE WHEN count(x) >= 50 THEN avg(x) ELSE 0 END, 6) AS mean FROM act GROUP BY label, feat",
)
_add(
    "position_center",
    lambda s, d: features.centered(activations(s, d), ["label", "feat"], "x", 50).select("vec_id", "feat", *r6("centered")),
    f"WITH {ACT}, g AS (SELECT label, feat, CASE WHEN count(x) >= 50 THEN avg(x) ELSE 0 END AS m FROM act GROUP BY label, feat) SELECT vec_id, feat, round(x - m, 6) AS centered FROM act JOIN g USING (label, feat)",
)
ANOVA = f"""{ACT}, mu AS (SELECT feat, avg(x) AS mu FROM act GROUP BY feat), c AS (SELECT label, feat, avg(x) AS m, count(x) AS n FROM act GROUP BY label, feat),
  b AS (SELECT sum(n * (m - mu) * (m - mu)) AS b FROM c JOIN mu USING (feat)), t AS (SELECT sum((x - mu) * (x - mu)) AS t, count(*) AS n FROM act JOIN mu USING (feat))"""
_add("anova_fraction", lambda s, d: features.variance_share(activations(s, d), "label", "feat", "x").select("n", *r6("ss_between", "ss_total", "share")), f"WITH {ANOVA} SELECT n::BIGINT AS n, round(b, 6) AS ss_between, round(t, 6) AS ss_total, round(b / t, 6) AS share FROM b, t")
_add("eta_scatter", lambda s, d: features.scatter_traces(activations(s, d), "label").select(*r6("trace_total", "trace_between", "eta")), f"WITH {ANOVA} SELECT round(t, 6) AS trace_total, round(b, 6) AS trace_between, round(b / t, 6) AS eta FROM b, t")
_add("pooling", lambda s, d: features.pooled(activations(s, d), ["label"]).select("label", "feat", *r6("mean", "max")), f"WITH {ACT} SELECT label, feat, round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM act GROUP BY label, feat")
_add(
    "topk_per_feature",
    lambda s, d: features.top_activations(activations(s, d), 8, ties=["vec_id"]).select("feat", "rank", "vec_id", "label", *r6("x")),
    f"WITH {ACT} SELECT feat, rank, vec_id, label, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY x DESC, vec_id) AS rank FROM act WHERE x > 0) WHERE rank <= 8",
)
_add(
    "batch_topk",
    lambda s, d: features.batch_top(activations(s, d).withColumn("batch", F.floor(F.col("vec_id") / 50).cast("bigint")), "batch", 8, "vec_id", ties=["vec_id", "feat"]).select("batch", "vec_id", "feat", *r6("x")),
    f"""WITH {ACT}, r AS (SELECT vec_id // 50 AS batch, vec_id, feat, x, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY greatest(x, 0) DESC, vec_id, feat) AS rn FROM act),
    z AS (SELECT vec_id // 50 AS batch, count(*) AS b FROM embeddings GROUP BY 1) SELECT batch, vec_id, feat, round(x, 6) AS x FROM r JOIN z USING (batch) WHERE rn <= b * 8 AND x > 0""",
)
_add(
    "sparsity",
    lambda s, d: features.sparsity(activations(s, d), "vec_id").select(*r6("active", "dead_share")),
    f"WITH {ACT} SELECT round((SELECT avg(a) FROM (SELECT count(*) FILTER (x > 0) AS a FROM act GROUP BY vec_id)), 6) AS active, round((SELECT 1 - avg(f) FROM (SELECT max((x > 0)::INTEGER) AS f FROM act GROUP BY feat)), 6) AS dead_share",
)
_add(
    "explained_variance",
    lambda s, d: features.explained_variance(activations(s, d).join(features.pooled(activations(s, d), ["label"]).select("label", "feat", "mean"), ["label", "feat"]), "x", "mean", ["label"]).select("label", "n", *r6("explained")),
    f"WITH {ACT}, g AS (SELECT label, feat, avg(x) AS mean FROM act GROUP BY label, feat) SELECT label, count(x) AS n, round(1 - var_pop(x - mean) / var_pop(x), 6) AS explained FROM act JOIN g USING (label, feat) GROUP BY label",
)


def cosine_centroid(spark, sf_dir):
    """Each vector's cosine with its family's mean vector."""
    acts = activations(spark, sf_dir)
    means = acts.groupBy("label", "feat").agg(F.avg("x").alias("m"))
    sums = acts.join(means, ["label", "feat"]).groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("m") * F.col("m")).alias("b"))
    return sums.select("vec_id", F.round(F.col("d") / (F.sqrt("a") * F.sqrt("b") + 1e-9), 6).alias("cosine"))


_add(
    "cosine_centroid",
    cosine_centroid,
    f"WITH {ACT}, g AS (SELECT label, feat, avg(x) AS m FROM act GROUP BY label, feat) SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-9), 6) AS cosine FROM act JOIN g USING (label, feat) GROUP BY vec_id",
)
_add(
    "marker_mean",
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(S.marker_mean("embedding", [0, 5, 9, 63, 64]), 6).alias("marker_mean")),
    "SELECT vec_id, round(list_avg([embedding[i]::DOUBLE FOR i IN [1, 6, 10, 64] IF i <= len(embedding)]), 6) AS marker_mean FROM embeddings",
)
_add(
    "centroid_fingerprint",
    lambda s, d: features.top_activations(features.pooled(activations(s, d), ["label"]).withColumnRenamed("mean", "m"), 10, "label", "m", ["feat"]).select("label", "rank", "feat", *r6("m")),
    f"WITH {ACT}, g AS (SELECT label, feat, avg(x) AS m FROM act GROUP BY label, feat) SELECT label, rank, feat, round(m, 6) AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, feat) AS rank FROM g WHERE m > 0) WHERE rank <= 10",
)
_add(
    "l2_shift",
    lambda s, d: table(s, d, "embeddings").alias("a").join(table(s, d, "embeddings").alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), F.round(S.distance(F.col("a.embedding"), F.col("b.embedding")), 6).alias("shift")),
    "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS shift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)


def _autoencoder(width: int = 64, n: int = 16) -> models.Autoencoder:
    """Small weights in closed form, so that SQL can state them."""
    i, j = np.arange(1, width + 1)[:, None], np.arange(1, n + 1)[None]
    weight = np.sin(0.1 * i * j)
    return models.Autoencoder(weight, 0.01 * np.arange(1, n + 1), weight.T / 10, 0.001 * np.arange(1, width + 1))


ENCODED = f"""{ACT}, w AS (SELECT i::INTEGER AS feat, j::INTEGER AS unit, sin(0.1::DOUBLE * (i + 1) * (j + 1)) AS w FROM range(64) t(i), range(16) u(j)),
  h AS (SELECT vec_id, unit, greatest(sum((x - 0.001::DOUBLE * (feat + 1)) * w) + 0.01::DOUBLE * (unit + 1), 0) AS h FROM act JOIN w USING (feat) GROUP BY vec_id, unit)"""


def sae_encode(spark, sf_dir):
    codes = models.encoded(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", _autoencoder())
    return codes.select("vec_id", F.posexplode("features").alias("unit", "h")).select("vec_id", "unit", F.round("h", 6).alias("h"))


_add("sae_encode", sae_encode, f"WITH {ENCODED} SELECT vec_id, unit, round(h, 6) AS h FROM h")


def sae_decode(spark, sf_dir):
    model = _autoencoder()
    codes = models.encoded(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", model)
    return models.decoded(codes, ["vec_id"], "features", model).select("vec_id", F.posexplode("vector").alias("feat", "y")).select("vec_id", "feat", F.round("y", 6).alias("y"))


_add("sae_decode", sae_decode, f"WITH {ENCODED} SELECT vec_id, feat, round(sum(h * w / 10) + 0.001::DOUBLE * (feat + 1), 6) AS y FROM h JOIN w USING (unit) GROUP BY vec_id, feat")


def resample_candidates(spark, sf_dir):
    """Residual directions that dead features would take: those of the rows that the model reconstructs worst, four for each feature."""
    model, rows = _autoencoder(), table(spark, sf_dir, "embeddings")
    back = models.decoded(models.encoded(rows, ["vec_id", "embedding"], "embedding", model), ["vec_id", "embedding"], "features", model)
    worst = models.worst_losses(back, "embedding", "vector", 4 * model.encoder.shape[1], ["vec_id"])
    return worst.select("vec_id", *r6("loss"), F.posexplode("residual").alias("feat", "d")).select("vec_id", "loss", "feat", F.round("d", 6).alias("residual"))


_add(
    "resample_candidates",
    resample_candidates,
    f"""WITH {ENCODED}, y AS (SELECT vec_id, feat, sum(h * w / 10) + 0.001::DOUBLE * (feat + 1) AS y FROM h JOIN w USING (unit) GROUP BY vec_id, feat), e AS (SELECT vec_id, feat, x - y AS d FROM act JOIN y USING (vec_id, feat)),
    l AS (SELECT vec_id, sum(d * d) AS loss FROM e GROUP BY vec_id ORDER BY loss DESC, vec_id LIMIT 64) SELECT vec_id, round(loss, 6) AS loss, feat, round(d, 6) AS residual FROM l JOIN e USING (vec_id)""",
)


def dead_resample(spark, sf_dir):
    """The model after its least active features are taken for dead: they decode to residual directions, the others as before."""
    model, rows = _autoencoder(), table(spark, sf_dir, "embeddings")
    codes = models.encoded(rows, ["vec_id", "embedding"], "embedding", model)
    fired = codes.select(F.posexplode("features").alias("unit", "h")).groupBy("unit").agg(F.count_if(F.col("h") > 0).alias("n")).orderBy("n", "unit").limit(3)  # three of the model's features
    dead = np.array(sorted(r["unit"] for r in fired.collect()))
    back = models.decoded(codes, ["vec_id", "embedding"], "features", model)
    residuals = np.array([r["residual"] for r in models.worst_rows(back, "embedding", "vector", len(dead)).collect()])  # three rows
    fresh = model.resampled(residuals, dead)
    decoder = [(i, int(i in dead.tolist()), j, float(v)) for i, row in enumerate(fresh.decoder) for j, v in enumerate(row)]
    return spark.createDataFrame(decoder, "unit int, dead int, feat int, w double").select("unit", "dead", "feat", *r6("w"))


_add("dead_resample", dead_resample, None)


def pca_geometry(spark, sf_dir):
    """Spectrum of the scatter and what the class means have of it."""
    g = models.class_geometry(table(spark, sf_dir, "embeddings"), "embedding", "label")
    rows = [(i + 1, float(v), float(m)) for i, (v, m) in enumerate(zip(g.variance, g.class_mass, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, class_mass double").select("component", *r6("variance", "class_mass"), F.lit(round(g.eta, 6)).alias("eta"), F.lit(g.reach(0.9)).alias("reach_90"), F.lit(round(g.top_share(32), 6)).alias("top_32"))


_add("pca_geometry", pca_geometry, None)


def whitened_spectrum(spark, sf_dir):
    """Spectrum of the class means after each component of the scatter is scaled to variance 1."""
    spectrum = models.class_geometry(table(spark, sf_dir, "embeddings"), "embedding", "label").whitened()
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(spectrum)], "direction int, class_variance double").select("direction", *r6("class_variance"))


_add("whitened_spectrum", whitened_spectrum, None)


def stub_scorer(sequences: list[str]) -> list[list[float]]:
    """Stands in for a model: shares of letters, weighted by place."""
    return [[sum((k + 1) / len(s) for k, c in enumerate(s) if c == b) for b in "ACGU"] for s in sequences]


def ism_criticality(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(spark.sparkContext.defaultParallelism, "p_partkey")  # a file that packs well is few tasks
    seqs = names.select("p_partkey", S.cleaned(F.col("p_name")).alias("seq")).where(F.length("seq") > 0)
    return scoring.embedding_criticality(seqs, ["p_partkey"], stub_scorer).select("p_partkey", "pos", *r6("score"))


_add(
    "ism_criticality",
    ism_criticality,
    f"""WITH q AS (SELECT p_partkey, regexp_replace(translate(translate(replace(p_name, ' ', ''), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g') AS seq FROM part),
    s AS (SELECT p_partkey, seq, unnest(range(1, length(seq) + 1)) AS pos FROM q), a AS (SELECT *, substr(seq, pos::BIGINT, 1) AS wt, unnest(['A', 'C', 'G', 'U']) AS alt FROM s)
    SELECT p_partkey, pos::BIGINT AS pos, round(avg(pos / length(seq) * CASE WHEN wt = 'N' THEN 1 ELSE sqrt(2) END), 6) AS score FROM a WHERE alt <> wt GROUP BY p_partkey, pos""",
)


def recognition_verdict(spark, sf_dir):
    """Which labels' vectors make a feature peak, by the features' own maxima and breadth over all other labels."""
    acts = activations(spark, sf_dir)
    known = features.breadth(features.family_max(acts.where("label % 2 = 0"))).select("feat", "feat_max", "breadth")
    peaks = acts.where("label % 2 = 1").groupBy(F.col("label").alias("gene"), "feat").agg(F.max("x").alias("peak"), F.min_by("vec_id", F.struct(-F.col("x"), F.col("vec_id"))).alias("pos"))
    return scoring.verdicts(peaks.select("gene"), scoring.hits(peaks, known, 0.8))


_add(
    "recognition_verdict",
    recognition_verdict,
    f"""WITH {ACT}, fm AS (SELECT feat, label, max(greatest(x, 0)) AS m FROM act WHERE label % 2 = 0 GROUP BY feat, label), mx AS (SELECT *, max(m) OVER (PARTITION BY feat) AS mm FROM fm),
    br AS (SELECT feat, max(mm) AS feat_max, count(*) FILTER (m >= 0.25 * mm AND mm > 0) AS breadth FROM mx GROUP BY feat), p AS (SELECT label AS gene, feat, max(x) AS peak FROM act WHERE label % 2 = 1 GROUP BY label, feat),
    h AS (SELECT gene, breadth, feat_max > 0 AND peak >= 0.8 * feat_max AS hit FROM p JOIN br USING (feat)), g AS (SELECT gene, count(*) FILTER (hit) AS n_hits, count(*) FILTER (hit AND breadth <= 2) AS n_specialist FROM h GROUP BY gene)
    SELECT gene, n_hits, n_specialist, CASE WHEN n_specialist > 0 THEN 'RECOGNIZED' WHEN n_hits > 0 THEN 'weak' ELSE 'NOT recognized' END AS verdict FROM g""",
)
_add(
    "max_merge_windows",
    lambda s, d: features.merged_windows(table(s, d, "lineitem").select("l_partkey", "l_linenumber", F.col("l_extendedprice").alias("act"), F.col("l_orderkey").alias("start")), ["l_partkey", "l_linenumber"]),
    "SELECT l_partkey, l_linenumber, l_extendedprice AS act, l_orderkey AS start FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_extendedprice DESC, l_orderkey) = 1",
)
