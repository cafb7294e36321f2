"""Order statistics and first rows by counted ranges, against plain sorting."""

import collections
import random
import statistics

import pytest
from pyspark.sql import functions as F

from helixframe.operators import entities, features, ranking, selection


@pytest.fixture(params=[1 << 17, 25])
def limit(request, monkeypatch):
    """Limits under a group's size make rounds of counts; few cuts make many rounds."""
    monkeypatch.setattr(selection, "LIMIT", request.param)
    monkeypatch.setattr(selection, "CUTS", 16)
    return request.param


def values():
    r = random.Random(4)
    rows = [("hot", r.choice((0.5, 0.5, 0.5, r.random(), -1e300, 1e-300, float(r.randint(0, 9))))) for _ in range(900)]
    rows += [("flat", 7.0)] * 120 + [(None, r.random()) for _ in range(90)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0), ("hot", None)]
    r.shuffle(rows)
    return rows


def groups(rows):
    out = collections.defaultdict(list)
    for g, v in rows:
        if v is not None:
            out[g].append(v)
    return out


def test_order_statistics(spark, limit):
    df = spark.createDataFrame(values(), "g string, v double").repartition(4)
    want = groups(values())
    sizes = df.where("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("_n"))
    wanted = sizes.withColumn("_place", F.explode(F.array(F.lit(0), F.floor(F.col("_n") / 3), F.col("_n") - 1, F.col("_n"), F.lit(-1))))
    got = {(r["g"], r["_place"]): (r["_value"], r["_before"]) for r in selection.order_statistics(df, ["g"], "v", wanted).collect()}
    assert got == {(g, p): (sorted(v)[p], sum(x < sorted(v)[p] for x in v)) for g, v in want.items() for p in (0, len(v) // 3, len(v) - 1)}


def test_medians(spark, limit):
    df = spark.createDataFrame(values(), "g string, v double").repartition(4)
    got = {r["g"]: r["m"] for r in selection.medians(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v) for g, v in groups(values()).items()}
    whole = [v for _, v in values() if v is not None]
    assert selection.medians(df, [], "v").first()["median"] == statistics.median(whole)
    assert selection.medians(df.where("g = 'none'"), ["g"], "v").count() == 0


def test_family_rollup(spark, limit):
    rows = [(g, v, None if v is None else -v, i) for i, (g, v) in enumerate(values())]
    got = {r[0]: tuple(r)[1:] for r in entities.family_rollup(spark.createDataFrame(rows, "f string, s double, c double, id long"), "f", "s", "c", "id").collect()}
    for g in {g for g, _ in values()}:
        own = [(v, i) for f, v, _, i in rows if f == g]
        some = [(v, i) for v, i in own if v is not None]
        n, top, median, most, example = got[g]
        assert n == len(own) and (top, median, most) == ((max(some)[0], statistics.median(v for v, _ in some), -min(some)[0]) if some else (None, None, None))
        assert not some or example == min((-v, i) for v, i in some)[1]


def test_among_first(spark, limit):
    r = random.Random(5)
    rows = [(r.choice(("hot", "hot", "hot", "b", None)), r.choice((None, 1.0, 1.0, 2.0, r.random())), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(3)
    for share in (0.01, 0.4, 1.0):
        takes = df.groupBy("g").agg(F.floor(F.count(F.lit(1)) * share).alias("_take"))
        got = {x["id"] for x in selection.among_first(df, ["g"], ["v", "id"], takes, "first").where("first").collect()}
        want = set()
        for g in ("hot", "b", None):
            own = sorted(((v is not None, v or 0, i) for f, v, i in rows if f == g))
            want |= {i for _, _, i in own[: int(len(own) * share)]}
        assert got == want
    assert selection.among_first(df, ["g"], ["v", "id"], takes.where("g = 'b'"), "first").where("first").select("g").distinct().count() == 1


def test_splits_and_cuts(spark, limit):
    rows = [("hot" if i % 10 else f"g{i}", (i * 7919) % 10007, float(i % 37)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(3)
    test = {r["id"] for r in entities.stratified_split(df, "g", ["id"]).where("test").collect()}
    hot = sorted(i for g, i, _ in rows if g == "hot")
    assert test == set(hot[: round(0.25 * len(hot))])  # groups of one are all train
    tail = {r["id"] for r in entities.tail_split(df, ["id"]).where("tail").collect()}
    assert tail == set(sorted(i for _, i, _ in rows)[-30:])
    cut = ranking.quantile_cut(df, "v", ["g"], 0.3)
    v = sorted(x for g, _, x in rows if g == "hot")
    got = cut.where("g = 'hot'").collect()
    assert {r["cut"] for r in got} == {v[int(0.3 * len(v)) - 1]} and len(got) == sum(x <= v[int(0.3 * len(v)) - 1] for x in v)
    assert cut.where("g <> 'hot'").count() == 60


def test_batch_top_with_ties(spark, limit):
    r = random.Random(6)
    rows = [(0 if i < 50 else 1, i, f, float(r.choice((0, 0, -1, 1, 1, 2, r.random())))) for i in range(60) for f in range(12)]
    df = spark.createDataFrame(rows, "batch int, id int, feat int, x double").repartition(3)
    got = {(x["id"], x["feat"]) for x in features.batch_top(df, "batch", 3, "id", ties=["id", "feat"]).collect()}
    want = set()
    for b, n in ((0, 50), (1, 10)):
        own = sorted((-max(x, 0), i, f) for batch, i, f, x in rows if batch == b)[: 3 * n]
        want |= {(i, f) for x, i, f in own if x < 0}
    assert got == want
