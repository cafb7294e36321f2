"""Closed loops: published inputs give the published results."""

import json
import os

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import entities, matching, ranking, selection

with open(f"{os.path.dirname(os.path.abspath(__file__))}/fixtures/published.json") as f:
    PUBLISHED = json.load(f)


@pytest.fixture(scope="module")
def criticality(spark):
    scores = PUBLISHED["criticality"]
    return spark.createDataFrame([("RNU4-2", i + 1, float(s)) for i, s in enumerate(scores)], "gene string, pos long, score double")


def test_pathogenic_enrichment(spark, criticality):
    report = PUBLISHED["enrichment"]
    spots = spark.createDataFrame([(int(p), True) for p in report["positions"]], "pos long, y boolean")
    marked = criticality.join(spots, "pos", "left")
    r = ranking.mann_whitney(marked, "score", F.coalesce("y", F.lit(False)), ["gene"]).withColumn("p", ranking.two_sided_p("z")).first()
    want = report["result"]
    assert r["n_pos"] == want["n_pathogenic"]
    assert round(r["auc"], 3) == want["auc"]
    assert round(r["mean_percentile"], 3) == want["mean_percentile"]
    assert abs(r["p"] - want["p_value"]) < 1e-3 * want["p_value"] + 1e-6


def test_region_and_percentiles(spark, criticality):
    region = spark.createDataFrame([("RNU4-2", 62, 79)], "gene string, lo long, hi long")
    r = ranking.region_enrichment(criticality, region, ["gene"]).first()
    assert (round(r["ratio"], 3), round(r["region_share"], 3), r["top_share"], r["fold"]) == (0.775, 0.128, 0.0, 0.0)
    named = spark.createDataFrame([("RNU4-2", p) for p in (64, 65, 77, 78)], "gene string, pos long")
    got = {x["pos"]: round(x["percentile"], 3) for x in ranking.named_percentiles(criticality, named, ["gene"]).collect()}
    assert got == {64: 0.092, 65: 0.199, 77: 0.113, 78: 0.248}


def test_unknown_variants(spark):
    report = PUBLISHED["unknown_variants"]
    rows = [(v, p, float(c), s) for v, p, c, s in report["rows"]]
    df = spark.createDataFrame(rows, "variant string, pos long, score double, sge double").withColumn("g", F.lit(1))
    auc = ranking.mann_whitney(df.where("sge IS NOT NULL"), "score", F.col("sge") < report["threshold"], ["g"]).first()["auc"]
    assert round(auc, 3) == report["auc"]
    top = df.orderBy(F.desc("score")).limit(20).where(F.col("sge") < report["threshold"])
    assert {r["variant"] for r in top.collect()} == set(report["confirmed"])


def test_panel_sign_test(spark):
    report = PUBLISHED["panel"]
    rows = list(map(tuple, report["rows"]))
    df = spark.createDataFrame(rows, "gene string, model string, auc double")
    medians = {r["model"]: round(r["m"], 3) for r in selection.medians(df, ["model"], "auc", "m").collect()}
    assert sorted(medians.values()) == [0.553, 0.585]
    auc = {m: F.max(F.when(F.col("model") == m, F.col("auc"))).alias(m) for m in ("rnafm", "erniarna")}
    wins = df.groupBy("gene").agg(*auc.values()).agg(F.count_if(F.col("erniarna") > F.col("rnafm")).cast("int").alias("k"), F.count(F.lit(1)).cast("int").alias("n"))
    r = wins.select("k", "n", ranking.binomial_tail("k", "n", F.lit(0.5)).alias("p")).first()
    assert (r["k"], r["n"], round(r["p"], 9)) == (report["first_wins"], report["pairs"], round(report["p"], 9))


def test_consensus_minimum(spark):
    top = PUBLISHED["consensus"]
    rows = [(name, m, float(p)) for name, *scores, _ in top for m, p in zip("abc", scores, strict=True)]
    df = spark.createDataFrame(rows, "id string, model string, p double")
    got = {r["id"]: r["p_min"] for r in entities.wide_consensus(df, "id", "model", "p", ["a", "b", "c"]).collect()}
    least = [row[-1] for row in top]
    assert all(abs(got[row[0]] - row[-1]) < 1e-9 for row in top) and least == sorted(least, reverse=True)


def test_counts(spark):
    df = spark.createDataFrame([(p,) for p in PUBLISHED["scores"]], "p double")
    assert (df.count(), df.where("p >= 0.5").count()) == (85, 2)
    sums = spark.createDataFrame(list(map(tuple, PUBLISHED["aligned"])), "f string, status string, a int, n int")
    r = sums.agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.count_if(F.col("status") == "ok").alias("ok")).first()
    assert (r["a"], r["n"], r["ok"]) == (959, 962, 127)


def test_variance_report():
    for between, total, share in PUBLISHED["position_variance"]:
        assert abs(between / total - share) < 1e-3


def test_connection_flags(spark):
    leads = PUBLISHED["connections"]
    rows = [(i, float(v)) for i, lead in enumerate(leads) for v in lead["lengths"]]
    df = spark.createDataFrame(rows, "lead long, n double").withColumn("gc", F.lit(0.0))
    got = {r["lead"]: r for r in matching.connection_flags(df, "lead", "n", "gc").collect()}
    for i, lead in enumerate(leads):
        assert got[i]["all_long"] == lead["all_long"]
        assert abs(got[i]["len_ratio"] - lead["ratio"]) <= 0.02


def test_learning_rates(spark):
    df = spark.createDataFrame([(int(s), float(x)) for s, x in PUBLISHED["rates"]], "step long, lr double")
    r = df.select(F.max(F.abs(S.warmup_cosine(F.col("step"), F.lit(4e-4), F.lit(400), F.lit(16_000)) - F.col("lr"))).alias("d")).first()
    assert r["d"] < 1e-9
