"""Prefix-filtered Jaccard pairs and binned interval joins, against plain comparisons."""

import itertools
import random

import pytest


from helixframe.operators import intervals, matching


def sets(seed, n, families=40):
    """Sets of unlike sizes, some of them equal, all of which hold one family and a third another."""
    r, out = random.Random(seed), {}
    for i in range(n):
        own = set(r.sample(range(families), r.randint(0, 9)))
        out[i] = out[i - 1] if i % 11 == 3 else own | {1000} | ({1001} if i % 3 == 0 else set())
    return out


def frame(spark, found):
    return spark.createDataFrame([(f, x) for f, own in found.items() for x in own] + [(0, None), (1, 1000)], "feat int, label int").repartition(3)


@pytest.mark.parametrize("similarity", [0.25, 0.5, 2 / 3, 0.8, 1.0])
def test_similar_pairs(spark, similarity):
    a, b = sets(1, 120), sets(2, 150)
    a[5], b[9] = set(range(20)), {3}  # outside of the band
    got = matching.jaccard_pairs(frame(spark, a), frame(spark, b), similarity=similarity)
    want = set()
    for (i, x), (j, y) in itertools.product(a.items(), b.items()):
        if 2 <= len(x) <= 9 and 2 <= len(y) <= 9 and len(x & y) / len(x | y) >= similarity - 1e-9:
            want.add((i, j, len(x), len(y), len(x & y)))
    rows = got.select("fa", "fb", "na", "nb", "shared").collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want


def test_a_family_of_all_features_makes_no_quadratic_join(spark):
    n = 1500
    a = {i: {10 * i, 10 * i + 1, -1} for i in range(n)}  # only -1 is shared, by every feature of both sides
    b = {i: {10 * i, 10 * i + 1, -1} if i < 20 else {10 * i + 5, 10 * i + 6, -1} for i in range(n)}
    sides = matching._ordered(*(matching._sets(frame(spark, x), 2, 9, "feat", "label") for x in (a, b)))
    met = matching._candidates(*sides, 0.5)
    assert met.count() == 20  # of more than two million pairs
    assert {(r["fa"], r["fb"]) for r in matching.jaccard_pairs(frame(spark, a), frame(spark, b), similarity=0.5).collect()} == {(i, i) for i in range(20)}


def test_mutual_best_equals_best_of_all_pairs(spark):
    a, b = sets(3, 140, 25), sets(4, 110, 25)
    got = matching.mutual_best(frame(spark, a), frame(spark, b), similarity=0.5)
    pairs = {}
    for (i, x), (j, y) in itertools.product(a.items(), b.items()):
        if 2 <= len(x) <= 9 and 2 <= len(y) <= 9 and x & y:
            pairs[i, j] = len(x & y) / len(x | y)
    best_a = {i: min((-v, j) for (k, j), v in pairs.items() if k == i)[1] for i, _ in pairs}
    best_b = {j: min((-v, i) for (i, k), v in pairs.items() if k == j)[1] for _, j in pairs}
    want = {(i, j) for (i, j), v in pairs.items() if v >= 0.5 and best_a[i] == j and best_b[j] == i}
    assert {(r["fa"], r["fb"]) for r in got.collect()} == want and want
    plain = matching.reciprocal_best(matching.jaccard_pairs(frame(spark, a), frame(spark, b)))
    assert {(r["fa"], r["fb"]) for r in plain.collect()} == want


@pytest.mark.parametrize("similarity", [0, -1, 1.5])
def test_similarity_out_of_range(spark, similarity):
    with pytest.raises(ValueError):
        matching.jaccard_pairs(frame(spark, {}), frame(spark, {}), similarity=similarity)


@pytest.mark.parametrize("closed", [False, True])
def test_interval_members(spark, closed):
    r = random.Random(8)
    points = [(i, r.choice((0.0, 1.0, -5.0, 64.0, r.uniform(-100, 100))), i % 2) for i in range(300)] + [(900, None, 0), (901, 1e6, 0), (902, -1e-9, 1)]
    ranges = [(i, lo := r.choice((0.0, -64.0, r.uniform(-100, 90))), lo + r.choice((0.0, 1e-9, 0.001, 1.0, 4.0, 16.0, r.uniform(0, 150))), i % 2) for i in range(120)]
    ranges += [(500, -1e7, 1e7, 0), (501, 5.0, 4.0, 0), (502, None, 3.0, 0), (503, 3.0, None, 1)]
    p, q = spark.createDataFrame(points, "i int, x double, g int"), spark.createDataFrame(ranges, "k int, lo double, hi double, g int")
    hit = lambda x, lo, hi: x is not None and lo is not None and hi is not None and lo <= x and (x <= hi if closed else x < hi)
    want = {(i, k) for i, x, _ in points for k, lo, hi, _ in ranges if hit(x, lo, hi)}
    rows = [(r["i"], r["k"]) for r in intervals.members(p, q.drop("g"), "x", "lo", "hi", closed=closed).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    keyed = {(r["i"], r["k"]) for r in intervals.members(p, q, "x", "lo", "hi", by=["g"], closed=closed).collect()}
    assert keyed == {(i, k) for i, x, g in points for k, lo, hi, h in ranges if g == h and hit(x, lo, hi)}
    assert intervals.members(p, q.drop("g").limit(0), "x", "lo", "hi").count() == 0


def test_whole_numbers_and_means_outside(spark):
    r = random.Random(9)
    points = [(r.randint(0, 50), float(r.randint(0, 9)), i % 3) for i in range(400)]
    ranges = [(k, r.randint(0, 50), 0) for k in range(30)]
    ranges = [(k, lo, lo + r.randint(0, 20), k % 3) for k, lo, _ in ranges] + [(40, 0, 51, 0), (41, 60, 70, 1)]
    p, q = spark.createDataFrame(points, "x int, v double, g int"), spark.createDataFrame(ranges, "k int, lo int, hi int, g int")
    for by in ([], ["g"]):
        got = {x["k"]: x for x in intervals.inside_outside(p, q, "x", "v", "k", "lo", "hi", by=by).collect()}
        assert len(got) == len(ranges)
        for k, lo, hi, g in ranges:
            own = [(x, v) for x, v, h in points if not by or g == h]
            inside, outside = [v for x, v in own if lo <= x < hi], [v for x, v in own if not lo <= x < hi]
            mean = lambda a: sum(a) / len(a) if a else None
            assert (got[k]["n_in"], got[k]["n_out"]) == (len(inside), len(outside))
            assert got[k]["mean_in"] == (pytest.approx(mean(inside)) if inside else None) and got[k]["mean_out"] == (pytest.approx(mean(outside)) if outside else None)



def joined_rows(df):
    """The most rows that a join of the plan made, after ``df`` was collected."""
    found, open_ = [0], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name, children = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            open_.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        open_ += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_wide_intervals_do_not_meet_their_points(spark):
    points = spark.range(3000).selectExpr("id / 7 AS x", "double(id % 10) AS v")
    ranges = spark.range(400).selectExpr("int(id) AS k", "-1.0D - id AS lo", "1000.0D + id AS hi")
    found = intervals.inside_outside(points, ranges, "x", "v", "k", "lo", "hi")
    rows = found.collect()
    assert {(r["n_in"], r["mean_in"], r["n_out"], r["mean_out"]) for r in rows} == {(3000, 4.5, 0, None)} and len(rows) == 400
    assert 400 <= joined_rows(found) < 400 * 20


@pytest.mark.parametrize("node", [2, 3, 256])
def test_sums_of_stretches(spark, monkeypatch, node):
    monkeypatch.setattr(intervals, "NODE", node)
    r = random.Random(10)
    points = [(r.choice((0.0, -0.0, 1.0, r.uniform(-20, 20))), r.choice((1e15, 0.01, 0.02)), i % 2) for i in range(150)]
    ranges = [(i, lo := r.choice((0.0, r.uniform(-25, 20), points[i % 150][0])), lo + r.choice((0.0, 1e-9, 1.0, r.uniform(0, 50))), i % 2) for i in range(200)]
    ranges += [(500, -1e7, 1e7, 0), (501, 5.0, 4.0, 0), (502, None, 3.0, 0), (503, 3.0, None, 1), (504, -1.0, 1.0, 7)]
    p, q = spark.createDataFrame(points, "x double, v double, g int"), spark.createDataFrame(ranges, "k int, lo double, hi double, g int")
    for by in ([], ["g"]):
        got = {x["k"]: x for x in intervals.inside_outside(p, q, "x", "v", "k", "lo", "hi", by=by).collect()}
        assert len(got) == len(ranges)
        for k, lo, hi, g in ranges:
            inside = [v for x, v, h in points if lo is not None and hi is not None and lo <= x < hi and (not by or g == h)]
            assert got[k]["n_in"] == len(inside) and got[k]["mean_in"] == (pytest.approx(sum(inside) / len(inside), rel=1e-12) if inside else None)
