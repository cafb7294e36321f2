"""Rules, lines, shards and the near-duplicate join on small tables, against SQL and plain versions."""

import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import classifier, lines, lm, near, quality, sharding
from helixframe.llm.common import cut

from .helpers import awkward, frame, words


def texts(spark, rows, schema="doc_id long, text string, source string, lang string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def saved(tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return db


# -- op10


@pytest.fixture(scope="module")
def labelled(spark):
    """Good and bad documents of three languages; only the first has labels enough by itself."""
    rows, labels = [], []
    for i in range(1700):
        lang = "en" if i < 1200 else "de" if i < 1500 else None
        bad = i % 8 == 0
        own = words(i, 60)
        rows.append((i, own.replace(" ", "### ") if bad else own, "s", lang, 1))
        labels.append((i, 0 if bad else 1, 0))
    return texts(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_admitted_cutoffs_reject(spark, labelled, tmp_path):
    docs, labels = labelled
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(docs, labels).collect()}
    db = saved(tmp_path, documents=docs, labels=labels)
    assert got == {i: (b, k) for i, *_, b, k in db.execute(quality.SQL).fetchall()}
    assert all(not b for b, _ in got.values())
    assert not any(k for i, (_, k) in got.items() if i % 8 == 0)  # all bad ones go, in every language
    good = [k for i, (_, k) in got.items() if i % 8]
    assert good.count(False) <= quality.RISK * len(good)


def test_false_rejections_stay_within_the_bound(spark):
    """Good documents whose measures overlap the bad ones' cannot be rejected beyond RISK on rows that took no part."""
    r, rows, labels = random.Random(7), [], []
    for i in range(6000):
        bad = i % 10 == 0
        marks = r.randint(0, 40) if bad else r.choice([0] * 19 + [r.randint(0, 12)])
        own = words(i, 60).split()
        rows.append((i, " ".join(w + ("#" if j < marks else "") for j, w in enumerate(own)), "s", "en", 1))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
        elif i % 4 == 0 and bad:
            labels.append((i, 0, 0))
    kept = {x["doc_id"]: x["kept"] for x in quality.quality_rules(texts(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    unseen = [i for i in range(6000) if i % 2 == 0 and i % 10]
    assert sum(not kept[i] for i in unseen) / len(unseen) < quality.RISK * 1.5
    assert any(not k for k in kept.values())


def test_few_labels_admit_nothing(spark, labelled):
    docs, labels = labelled
    few = labels.where("doc_id < 60")
    assert quality.cutoffs(cut(quality.measures(docs)), few).count() == 0
    assert quality.quality_rules(docs, few).where("kept").count() == 1700


# -- op3


def test_lines_at_the_threshold(spark, monkeypatch):
    rows, i = [], itertools.count()
    for sites in (4, 5, 6, 60):
        rows += [(next(i), f"line of {sites} sites\n{words(1000 + sites * 100 + s, 4)}", f"site{s}", "en", 1) for s in range(sites)]
    docs = texts(spark, rows)
    got = {r["doc_id"]: r["_removed"] for r in lines.remove_widespread_lines(docs).collect()}
    firsts = {0 + 4, 4 + 5, 4 + 5 + 6}
    assert got == {d: int(d >= 4 and d not in firsts) for d in range(75)}
    monkeypatch.setattr(lines, "SENT", -1)  # the salted join gives the same
    assert got == {r["doc_id"]: r["_removed"] for r in lines.remove_widespread_lines(docs).collect()}


def test_many_removed_lines(spark):
    shared = [f"boiler {i}" for i in range(20_000)]
    rows = [(d, "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {d} {i}")), f"s{d}", "en", 1) for d in range(6)]
    got = {r["doc_id"]: r for r in lines.remove_widespread_lines(texts(spark, rows)).collect()}
    assert got[0]["_removed"] == 0 and all(got[d]["_removed"] == 20_000 for d in range(1, 6))
    assert got[3]["text"] == "\n".join(f"own 3 {i}" for i in range(20_000))


# -- op4


def plain_tree(rows, shards):
    """rows: (key, size, dimensions, tie); shard of each by the same rule, on lists."""
    whole = [max(1.0, max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) for d in range(len(rows[0][2]))]
    out = {}

    def split(own, first, leaves):
        if leaves == 1:
            out.update((r[0], first) for r in own)
            return
        widths = [((max(r[2][d] for r in own) - min(r[2][d] for r in own)) / whole[d], -d) for d in range(len(whole))]
        d = -max(widths)[1]
        own, goal, before = sorted(own, key=lambda r: (r[2][d], r[3])), sum(r[1] for r in own) * (leaves // 2) / leaves, 0
        sides = ([], [])
        for r in own:
            sides[before + r[1] / 2 >= goal].append(r)
            before += r[1]
        split(sides[0], first, leaves // 2)
        split(sides[1], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, shards)
    return out


def test_tree_against_a_plain_one(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randint(0, 300), f"https://example.org/a/long/path/{r.randint(0, 40):03d}", r.choice(["en", "de", "fr"]), i * 7919 % 10007) for i in range(500)]
    got = {x["doc_id"]: x for x in sharding.shard(texts(spark, rows), 11).collect()}
    sources, langs = (sorted({x[k] for x in rows}) for k in (2, 3))
    tied = {x["doc_id"]: x["t"] for x in texts(spark, rows).select("doc_id", F.xxhash64("doc_id", "text").alias("t")).collect()}
    want = plain_tree([(i, len(t) + 16, (sources.index(s), langs.index(lang), n), tied[i]) for i, t, s, lang, n in rows], 11)
    assert {i: x["shard"] for i, x in got.items()} == want
    for k in range(11):
        own = sorted(x["slot"] for x in got.values() if x["shard"] == k)
        assert own == list(range(len(own)))


def test_repeated_rows_are_parted(spark):
    rows = [(1, "z" * 80, "s", "en", 1)] * 300 + [(i, "y" * (i % 50), "s", "de", i) for i in range(98)] + [(None, None, None, None, None)] * 5
    sizes = sharding.shard(texts(spark, rows), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = sum(r["b"] for r in sizes)
    assert len(sizes) == 8 and max(abs(r["b"] - total / 8) for r in sizes) < 200
    leaves = sharding.shard(texts(spark, rows), target_bytes=500).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(leaves) == -(-total // 500) and max(r["b"] for r in leaves) < 500 + 200


# -- op1


def shingle_set(text):
    own = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_join_finds_every_link(spark, similarity):
    """One large group of close copies beside pairs of every similarity around the threshold."""
    r, rows = random.Random(1), []
    base = words(1, 200).split()
    for i in range(150):
        own = list(base)
        own[r.randrange(200)] = f"n{i}"
        rows.append(" ".join(own))
    for i in range(120):
        own = words(500 + i, 100).split()
        other = list(own)
        for k in range(r.randint(1, 6)):
            other[5 + 16 * k] = f"c{k}"
        rows += [" ".join(own), " ".join(other)]
    docs = texts(spark, [(i, t, "s", "en", 1) for i, t in enumerate(rows)])
    got = {x["doc_id"]: x["n_links"] for x in near.near_duplicates(docs, similarity=similarity).collect()}
    sets = [shingle_set(t) for t in rows]
    want = dict.fromkeys(range(len(rows)), 0)
    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            want[a] += 1
            want[b] += 1
    found, all_of_them = sum(got.values()), sum(want.values())
    assert all(got[i] <= want[i] for i in want) and found >= 0.999 * all_of_them


def test_no_unlike_text_is_lost(spark):
    rows = [(None, words(1, 40)), (None, words(2, 40)), (7, words(3, 40)), (7, words(4, 40)), (8, words(3, 40)), (9, None), (None, None)]
    kept = near.keep_one(texts(spark, [(i, t, "s", "en", 1) for i, t in rows])).collect()
    assert sorted((x["text"] or "") for x in kept) == sorted([words(k, 40) for k in (1, 2, 3, 4)] + ["", ""])


# -- op2


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_texts(docs.repartition(n)).collect()} for n in (2, 9))
    assert a == b


# -- the pipeline


def test_pipeline_with_awkward_rows(spark, tmp_path):
    docs = frame(spark, awkward() + awkward()[:3])
    saved(tmp_path, documents=docs, labels=spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(0 < r["length"] <= 2048 for r in out)
    empty = tmp_path / "empty"
    os.mkdir(empty)
    saved(empty, documents=docs.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_a_class_of_long_texts_is_learnt(spark):
    """Texts over the size that comes first are fitted where a class has no others, and others keep their places."""
    good = [(i, words(40_000 + i, 80)) for i in range(100)]
    bad = [(100 + i, ("zap pow " + words(50_000 + i, 3) + " ") * 8000) for i in range(40)]
    assert min(len(t) for _, t in bad) > classifier.FIT_BYTES
    docs = spark.createDataFrame(good + bad, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in classifier.classify(docs, labels).collect()}
    assert [i for i in got if got[i] != int(i < 100)] == []
