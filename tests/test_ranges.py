"""Ranks, places and running sums over ranges that follow the rows, against plain sorting."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import entities, ranking, selection


@pytest.fixture(params=[1 << 16, 30])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", request.param)
    monkeypatch.setattr(selection, "LIMIT", request.param)


def data():
    r = random.Random(11)
    rows = [("hot", i, r.choice((1.0, 1.0, 2.5, r.random())), r.random() < 0.3) for i in range(400)]
    rows += [(None, i, r.random(), r.random() < 0.5) for i in range(40)] + [("one", 0, 3.0, True), ("hot", 400, None, True)]
    r.shuffle(rows)
    return rows


def by_group(rows):
    out = collections.defaultdict(list)
    for g, p, v, y in rows:
        if v is not None:
            out[g].append((p, v, y))
    return out


def table(spark):
    return spark.createDataFrame(data(), "g string, pos long, score double, y boolean").repartition(4)


def test_average_ranks(spark, ranges):
    for by, groups in ((["g"], by_group(data())), ([], {0: [x for own in by_group(data()).values() for x in own]})):
        got = collections.Counter((r["g"] if by else 0, r["score"], r["rank"]) for r in ranking.average_rank(table(spark), "score", by).collect())
        want = collections.Counter()
        for g, own in groups.items():
            v = sorted(x for _, x, _ in own)
            want.update((g, x, v.index(x) + (v.count(x) + 1) / 2) for x in v)
        want[("hot" if by else 0, None, None)] += 1
        assert got == want


def test_areas(spark, ranges):
    got = {r["g"]: r for r in ranking.mann_whitney(table(spark), "score", F.col("y"), ["g"]).collect()}
    for g, own in by_group(data()).items():
        a, b = [v for _, v, y in own if y], [v for _, v, y in own if not y]
        wins = sum((x > z) + (x == z) / 2 for x in a for z in b)
        assert got[g]["auc"] == (pytest.approx(wins / len(a) / len(b)) if a and b else None)


def test_named_places_and_running_sums(spark, ranges):
    df = table(spark).where("score IS NOT NULL")
    named = df.where("pos % 5 = 0")
    got = {(r["g"], r["pos"]): (r["rank"], r["percentile"]) for r in ranking.named_percentiles(df, named, ["g"]).collect() if r["g"] is not None}
    reached = {r["g"]: r["reached"] for r in ranking.cumulative_threshold(df, "pos", "score", ["g"], 0.4).collect()}
    for g, own in by_group(data()).items():
        order = [p for p, _, _ in sorted(own, key=lambda x: (-x[1], x[0]))]
        if g is not None:
            for p in (p for p, _, _ in own if p % 5 == 0):
                assert got[g, p] == (order.index(p) + 1, pytest.approx(1 - order.index(p) / len(order)))
        total, run = sum(v for _, v, _ in own), 0
        for n, (_, v, _) in enumerate(sorted(own), 1):
            run += v
            if run >= 0.4 * total - 1e-12:
                break
        assert reached[g] == n


def test_regions(spark, ranges):
    df = table(spark).where("score IS NOT NULL AND g = 'hot'")
    regions = spark.createDataFrame([("hot", 10, 60), ("hot", 0, 399), ("none", 1, 2)], "g string, lo long, hi long")
    rows = ranking.region_enrichment(df, regions, ["g"]).collect()
    own = by_group(data())["hot"]
    top = {p for p, _, _ in sorted(own, key=lambda x: (-x[1], x[0]))[: round(0.15 * len(own))]}
    assert len(rows) == 1  # the whole has nothing outside
    inside = [p for p, _, _ in own if 10 <= p <= 60]
    assert rows[0]["top_share"] == pytest.approx(sum(p in top for p in inside) / len(top)) and rows[0]["region_share"] == pytest.approx(len(inside) / len(own))
    assert rows[0]["mean_in"] == pytest.approx(sum(v for p, v, _ in own if 10 <= p <= 60) / len(inside))


def test_numbers_and_codes(spark, ranges):
    df = spark.range(500).repartition(5)
    assert sorted((r["id"], r["i"]) for r in entities.numbered(df, -F.col("id"), "i").collect()) == [(i, 499 - i) for i in range(500)]
    named = df.select(F.concat(F.lit("w"), F.lpad((F.col("id") % 90).cast("string"), 3, "0")).alias("w"))
    assert {r["w"]: r["code"] for r in entities.dense_codes(named, "w", "code").collect()} == {f"w{i:03}": i for i in range(90)}
    grouped = {r["id"]: r["i"] for r in entities.numbered(df.withColumn("g", F.col("id") % 3), F.col("id"), "i", ["g"]).collect()}
    assert grouped == {i: i // 3 for i in range(500)}
