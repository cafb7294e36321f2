"""Invariants and edge cases of the ranking, matching, entity and model operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import entities, features, matching, models, ranking


def test_ranks_sum_and_ties(spark):
    rows = [(i, float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = {r["id"]: r["rank"] for r in ranking.average_rank(df, "v").collect()}
    assert sum(got.values()) == 100 * 101 / 2
    by = {r["id"]: r["rank"] for r in ranking.average_rank(df.withColumn("g", F.lit(1)), "v", ["g"]).collect()}
    assert got == by


def test_empty_rank(spark):
    assert ranking.average_rank(spark.createDataFrame([], "id int, v double"), "v").count() == 0


def test_auc_is_symmetric_and_null_for_one_class(spark):
    df = spark.createDataFrame([(1, float(i * 37 % 11), i % 3 == 0) for i in range(50)] + [(2, 1.0, True)], "g int, v double, y boolean")
    a = {r["g"]: r["auc"] for r in ranking.mann_whitney(df, "v", F.col("y"), ["g"]).collect()}
    b = {r["g"]: r["auc"] for r in ranking.mann_whitney(df.withColumn("v", -F.col("v")), "v", F.col("y"), ["g"]).collect()}
    assert abs(a[1] + b[1] - 1) < 1e-12 and a[2] is None


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)], "g int, x double, y double")
    assert ranking.spearman(df, "x", "y", ["g"]).first()["r"] == 0.0


def test_dead_features(spark):
    df = spark.createDataFrame([(0, 0, -1.0), (0, 1, -2.0), (1, 0, 1.0), (1, 1, 0.1)], "feat int, label int, x double")
    strict = {r["feat"]: (r["breadth"], r["bucket"]) for r in features.breadth(features.family_max(df)).collect()}
    loose = {r["feat"]: r["breadth"] for r in features.breadth(features.family_max(df), strict_dead=False).collect()}
    assert strict == {0: (0, "dead"), 1: (1, "specialist")} and loose == {0: 2, 1: 1}


def test_centred_means_vanish(spark):
    df = spark.createDataFrame([(i % 4, float(i)) for i in range(400)], "p int, x double")
    means = features.centered(df, ["p"], "x").groupBy("p").agg(F.avg("centered").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in means)
    assert all(r["mean"] == 0 for r in features.guarded_means(df, ["p"], "x", 101).collect())


def test_no_variance(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, 2.0)], "g int, d int, x double")
    assert features.variance_share(df, "g", "d", "x").first()["share"] == 0.0


def test_reciprocal_matches_are_symmetric(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3)], "feat int, label int")
    b = spark.createDataFrame([(5, 1), (5, 2), (6, 3), (6, 2)], "feat int, label int")
    ab = {(r["fa"], r["fb"]) for r in matching.reciprocal_best(matching.jaccard_pairs(a, b)).collect()}
    ba = {(r["fb"], r["fa"]) for r in matching.reciprocal_best(matching.jaccard_pairs(b, a)).collect()}
    assert ab == ba == {(0, 5), (1, 6)}


def test_split_and_shuffle(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(10)], "id int, g string")
    got = {r["id"]: r["test"] for r in entities.stratified_split(df, "g", ["id"]).collect()}
    assert sum(got.values()) == 2 and not got[9]
    shuffled = entities.permuted_labels(df, "id", "g").collect()
    assert sorted(r["g"] for r in shuffled) == ["a"] * 9 + ["b"]


def greedy_folds(sizes, folds):
    loads, out = [0] * folds, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(folds), key=lambda i: (loads[i], i))
        loads[f] += n
        out[name] = f
    return out


@pytest.mark.parametrize("folds", [1, 3, 5])
def test_group_folds(spark, folds):
    r = np.random.default_rng(folds)
    sizes = {f"g{i:03d}": int(n) for i, n in enumerate([90, 41, 40, 7, 7, 7, *r.integers(1, 6, 120)])}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    assert {r["g"]: r["fold"] for r in entities.group_folds(df, "g", folds).collect()} == greedy_folds(sizes, folds)


def test_ranks_and_samples_over_ranges(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(g), float(v)) for i, (g, v) in enumerate(zip(r.integers(0, 2, 2000), r.integers(0, 300, 2000), strict=True))]
    df = spark.createDataFrame(rows, "id int, g int, v double")
    by = {x["id"]: x["rank"] for x in ranking.average_rank(df, "v", ["g"]).collect()}
    for g in (0, 1):
        own = sorted(v for _, k, v in rows if k == g)
        for i, k, v in rows[:200]:
            if k == g:
                assert by[i] == own.index(v) + (own.count(v) + 1) / 2
    assert sorted(x["n"] for x in entities.numbered(df, F.col("id"), "n").collect()) == list(range(2000))
    folded = entities.stratified_folds(df, "g", F.col("id")).groupBy("g", "fold").count().collect()
    assert max(x["count"] for x in folded) - min(x["count"] for x in folded if x["g"] == folded[0]["g"]) < 60
    assert {x["id"] for x in entities.stride_sample(df, F.col("id"), 100).collect()} == set(range(0, 2000, 100))


def test_tails(spark):
    df = spark.createDataFrame([(z / 4, k, 40) for k, z in enumerate(range(-20, 21))], "z double, k int, n int")
    for x in df.select("z", "k", ranking.two_sided_p("z").alias("p"), ranking.binomial_tail("k", "n", F.lit(0.3)).alias("b")).collect():
        assert x["p"] == pytest.approx(math.erfc(abs(x["z"]) / math.sqrt(2)), rel=2e-7)
        assert x["b"] == pytest.approx(sum(math.comb(40, i) * 0.3**i * 0.7 ** (40 - i) for i in range(x["k"], 41)), rel=1e-9)


def test_kmers_of_awkward_sequences(spark):
    df = spark.createDataFrame([(1, "ACGUACGN"), (2, ""), (3, None), (4, "AC"), (5, "AAAAA"), (5, "GGG")], "id int, seq string")
    got = sorted((x["id"], x["kmer"], x["n"], x["valid"]) for x in features.kmer_table(df, ["id"]).collect())
    assert got == [(1, "ACG", 2, 5), (1, "CGU", 1, 5), (1, "GUA", 1, 5), (1, "UAC", 1, 5), (5, "AAA", 3, 3), (5, "GGG", 1, 1)]


def test_logistic_against_newton(spark):
    """Weights of the balanced model solve the penalised equations that numpy solves too."""
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 3))
    y = (x @ [1.0, -2.0, 0.5] + r.standard_normal(300) > 0.8).astype(int)
    df = models.assembled(spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y int"), ["a", "b", "c"])
    got = models.balanced_logistic(df, "features", "y")
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))
    full, theta = np.column_stack((x, np.ones(300))), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ theta))
        penalty = np.array([1, 1, 1, 0]) * 1.0
        theta -= np.linalg.solve((full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (weight * (p - y)) + penalty * theta)
    assert np.allclose([*got.coefficients, got.intercept], theta, atol=1e-4)


def test_probes(spark):
    r = np.random.default_rng(5)
    centers = r.standard_normal((4, 6)) * 3
    rows = [(i, i % 4, i % 5 == 0, *map(float, centers[i % 4] + r.standard_normal(6) * 0.3)) for i in range(200)]
    df = models.assembled(spark.createDataFrame(rows, "id int, label int, test boolean, a double, b double, c double, d double, e double, f double"), list("abcdef"))
    found = models.softmax_probe(df.where("NOT test"), df.where("test"), "features", "label").collect()
    assert len(found) == 40 and all(x["above"] == 0 and x["prediction"] == x["label"] for x in found)
    scored = models.transferred(df.where("NOT test").withColumn("y", (F.col("label") == 1).cast("int")), df.where("test"), "features", "y").collect()
    assert all((x["p"] > 0.5) == (x["label"] == 1) for x in scored)


def test_autoencoder_steps(spark):
    random = np.random.default_rng(1)
    m = models.Autoencoder(random.standard_normal((4, 6)), np.zeros(6), random.standard_normal((6, 4)), random.standard_normal(4))
    assert np.allclose(np.linalg.norm(m.unit_rows().decoder, axis=1), 1)
    fresh = m.resampled(random.standard_normal((2, 4)), np.array([1, 3]))
    assert np.allclose(np.linalg.norm(fresh.decoder[[1, 3]], axis=1), 1) and np.allclose(fresh.decoder[0], m.decoder[0])
    df = spark.createDataFrame([(i, [float(x) for x in random.standard_normal(4)]) for i in range(20)], "id int, v array<double>")
    codes = models.encoded(df, ["id"], "v", m)
    for r in codes.join(df, "id").collect():
        assert np.allclose(r["features"], m.encode(np.array(r["v"])))
    back = models.decoded(codes, ["id"], "features", m).join(df, "id")
    assert models.worst_rows(back.withColumnRenamed("vector", "p"), "v", "p", features=3).count() == 3


def test_geometry_matches_numpy(spark):
    random = np.random.default_rng(2)
    x, y = random.standard_normal((60, 5)), np.arange(60) % 3
    df = spark.createDataFrame([([float(v) for v in row], int(c)) for row, c in zip(x, y, strict=True)], "v array<double>, y int")
    g = models.class_geometry(df, "v", "y")
    c = x - x.mean(0)
    assert np.allclose(g.variance, np.sort(np.linalg.eigvalsh(c.T @ c))[::-1])
    between = sum((y == k).sum() * ((x[y == k].mean(0) - x.mean(0)) ** 2).sum() for k in range(3))
    assert g.eta == pytest.approx(between / (c**2).sum())
    assert g.reach(1.0) == 5 and len(g.whitened()) == 5
    values, basis = np.linalg.eigh(c.T @ c)
    means = np.stack([np.sqrt((y == k).sum()) * (x[y == k].mean(0) - x.mean(0)) for k in range(3)])
    white = means @ (basis / np.sqrt(values))
    assert np.allclose(g.whitened(), np.maximum(np.sort(np.linalg.eigvalsh(white.T @ white))[::-1], 0), atol=1e-9)
    assert np.allclose(np.sort(g.class_mass), np.sort(((means @ basis) ** 2).sum(0)))


def test_leading_components_of_wide_vectors(spark):
    """The range finder against numpy on a spectrum that falls off, with many classes and rows that take no part."""
    random = np.random.default_rng(3)
    d, n = 60, 500
    x, y = random.standard_normal((n, d)) * 0.8 ** np.arange(d) + 50, random.integers(0, 90, n)
    rows = [([float(v) for v in row], int(c)) for row, c in zip(x, y, strict=True)] + [(None, 1), (x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "v array<double>, y int").repartition(3)
    g = models.class_geometry(df, "v", "y", components=8)
    c = x - x.mean(0)
    values, basis = np.linalg.eigh(c.T @ c)
    values, basis = values[::-1], basis[:, ::-1]
    means = np.stack([np.sqrt((y == k).sum()) * (x[y == k].mean(0) - x.mean(0)) for k in np.unique(y)])
    assert np.allclose(g.variance, values[:8], rtol=1e-6) and np.allclose(g.class_mass, ((means @ basis[:, :8]) ** 2).sum(0), rtol=1e-3)
    assert g.total == pytest.approx(values.sum()) and g.class_total == pytest.approx((means**2).sum()) and g.width == d
    assert g.top_share(8) == pytest.approx(values[:8].sum() / values.sum()) and g.reach(0.5) == int(np.searchsorted(np.cumsum(values), 0.5 * values.sum())) + 1
    assert models.class_geometry(df.limit(0), "v", "y").width == 0


def test_coefficients_of_a_fit(spark):
    """The largest coefficients against Newton's steps on the same loss."""
    random = np.random.default_rng(12)
    x = random.standard_normal((300, 6)) * [1, 5, 0.1, 1, 1, 1] + 3
    y = (x[:, 0] - 0.3 * x[:, 1] + 20 * x[:, 2] + random.standard_normal(300) > 3 - 0.9 + 60).astype(int)
    df = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y int, v array<double>").select("y", models.array_to_vector("v").alias("f"))
    z = np.column_stack(((x - x.mean(0)) / x.std(0), np.ones(300)))
    weight, theta = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum()))), np.zeros(7)
    penalty = np.diag([1.0] * 6 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ theta))
        theta -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (p - y)) + penalty @ theta)
    for signed in (False, True):
        got = models.top_coefficients(df, "f", "y", 4, signed)
        want = sorted(range(6), key=lambda i: -theta[i] if signed else -abs(theta[i]))[:4]
        assert [i for i, _ in got] == want and np.allclose([c for _, c in got], theta[want], atol=1e-3)
