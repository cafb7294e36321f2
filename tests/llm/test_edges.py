"""Awkward rows, empty tables and clashing column names, operator by operator."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import classifier, jpeg, lines, lm, near, packing, pieces, quality, sharding, tokens

from .helpers import awkward, frame, rows, words

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, None)], LABELS)


def _by_id(df, column):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r[column])
    return out


def test_near_classes(docs, empty):
    got = near.near_duplicates(docs)
    assert got.count() == docs.count() and near.near_duplicates(empty).count() == 0
    links, classes = _by_id(got, "n_links"), _by_id(got, "class_id")
    assert [links[i] for i in range(5)] == [[0]] * 5
    # 5 twice (a repeated row), 6 and 8 (other case) are equal sets, 7 is near: each has four partners.
    assert links[5] == [4, 4] and links[6] == [4] and links[7] == [4] and links[8] == [4]
    assert {classes[i][0] for i in (5, 6, 7, 8)} == {5}
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and not {6, 7, 8} & set(ids) and {0, 1, 2} <= set(ids)


def test_near_keeps_unlike_texts_of_one_id_or_none(spark):
    a, b, c, d, e = (words(700 + i, 60) for i in range(5))
    data = [(None, a), (None, b), (7, c), (7, d), (8, c), (None, e), (9, e), (9, e), (None, ""), (None, a)]
    kept = near.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e), (None, "")], key=repr)


def test_near_large_group_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 8)  # many chunks, as a hot node would have
    base = words(9, 100).split()
    texts = [" ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(0, 60)] + [words(500 + i, 50) for i in range(10)]
    got = near.near_duplicates(frame(spark, rows(texts)).select("doc_id", "text"))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    want = [sum(1 for b, s in enumerate(sets) if b != a and len(s & sets[a]) >= 0.8 * len(s | sets[a]) - 1e-9) for a in range(len(texts))]
    assert [x[0] for _, x in sorted(_by_id(got, "n_links").items())] == want


def test_near_pairs_at_the_threshold_beside_a_hot_group(spark):
    """Similar pairs without number do not stand in for those at 0.80, which are the hardest to meet."""
    base, texts = words(9, 100), []
    texts += [f"{base} w{i}" for i in range(300)]
    for i in range(800):
        own = words(10_000 + i, 49)
        other = own.split()
        other[24] = "changed"
        texts += [own, " ".join(other)]  # 40 of 50 shingles
    links = _by_id(near.near_duplicates(frame(spark, rows(texts)).select("doc_id", "text")), "n_links")
    assert [links[i] for i in range(300)] == [[299]] * 300
    assert [i for i in range(300, len(texts)) if links[i] != [1]] == []


def test_near_pair_that_meets_last_is_found_whatever_else_there_is(spark):
    """One pair just over 0.80 that shares four hashes and no fifth; close copies beside it end nothing."""

    def depth(a, b):
        sets, _ = near.shingle_sets(pa.array([a, b]))
        same = np.equal(*near.signatures(sets).reshape(2, near.TREES, near.DEPTH))
        return int(np.cumprod(same, axis=1).sum(1).max())

    def pair(seed):
        own = words(20_000 + seed, 95)
        other = own.split()
        other[30] = other[60] = "changed"  # 81 of 101 shingles
        return own, " ".join(other)

    late = next(p for p in map(pair, range(5000)) if depth(*p) == 4)
    close = words(30_000, 400).split()
    beside = [" ".join(close), " ".join(close[:-1] + ["end"])]
    for texts in (late, (*late, *beside)):
        got = near.near_duplicates(frame(spark, rows(texts)).select("doc_id", "text"))
        assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got.collect()} == {i: (1, i - i % 2) for i in range(len(texts))}


def test_near_depth_follows_the_threshold():
    assert [near.depth_for(s, 0.999) for s in (0.95, 0.8, 0.5)] == [6, 4, 1]
    with pytest.raises(ValueError):
        near.depth_for(0.1, 0.999)


def test_scores(docs, empty):
    got = lm.score_texts(docs)
    assert got.count() == docs.count() and lm.score_texts(empty).count() == 0
    score = _by_id(got, "score")
    assert score[0] == score[1] and score[5][0] == score[5][1] == score[6][0]


def test_scores_without_training_rows(spark):
    import zlib

    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score_texts(spark.createDataFrame([(held, "some words here")], "doc_id long, text string")).first()
    assert (r["n_known"], r["train_tokens"], r["held_out"]) == (0, 0, True) and r["score"] < 0


def test_lines(spark, docs, empty):
    got = lines.remove_widespread_lines(docs)
    assert got.columns == [*docs.columns, "_lines", "_removed"] and got.count() == docs.count()
    text = _by_id(got, "text")
    assert text[0] == [None] and text[1] == [""] and text[10] == ["line a\nline b\nline a\n"]
    holders = [i for i, x in text.items() if x[0] and "shared boilerplate line here" in x[0]]
    assert holders == [11]  # the first one keeps it
    assert lines.remove_widespread_lines(empty).count() == 0
    assert lines.drop_emptied(got).columns == docs.columns


def test_shards(docs, empty):
    got = sharding.shard(docs, 4)
    assert got.count() == docs.count() and sharding.shard(empty, 4).count() == 0
    assert _by_id(got, "size")[0] == [16]
    slots = collections.defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_without_variety(spark):
    df = spark.createDataFrame([(i, "same text", "en", "one", 9) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = sharding.shard(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 8 and max(r["s"] for r in sizes) <= 1.1 * min(r["s"] for r in sizes)
    assert sharding.shard(df, target_bytes=5000).select("shard").distinct().count() == 2


def test_media(docs, empty):
    media = jpeg.media_column(docs)
    back = _by_id(jpeg.decode_media(media), "text")
    want = _by_id(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    assert back == want
    feature = _by_id(jpeg.media_features(media), "feature")
    assert feature[0] == feature[1] and feature[5][0] == feature[6][0]
    assert jpeg.media_features(jpeg.media_column(empty)).count() == 0


def test_pieces(docs, empty):
    ids = pieces.encode_texts(docs)
    back = _by_id(pieces.decode_ids(ids), "text")
    assert back == _by_id(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    other = pieces.encode_texts(docs, seed=7)
    assert _by_id(ids, "ids") == _by_id(pieces.encode_texts(docs), "ids") != _by_id(other, "ids")
    assert pieces.round_trip(empty).count() == 0 and pieces.round_trip(docs).where("NOT lossless").count() == 0


def test_tokens(docs, empty):
    got = _by_id(tokens.token_counts(docs), "n_tokens")
    assert got[0] == got[1] == [0] and got[5][0] == got[5][1]
    assert tokens.token_counts(empty).count() == 0


def test_classifier(spark, docs, empty, labels):
    got = classifier.classify(docs, labels)
    assert got.count() == docs.count() and classifier.classify(empty, labels).count() == 0
    score = _by_id(got, "score")
    assert score[0] == score[1] and score[5][0] == score[6][0]
    assert classifier.keep_predicted(docs, labels, threshold=0.0).columns == docs.columns
    nothing = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in classifier.classify(docs, nothing).collect()} == {0.5}
    assert classifier.keep_predicted(docs, nothing).count() == docs.count()


def test_packing(docs, empty):
    got = packing.pack(docs)
    assert packing.pack(empty).count() == 0
    length = _by_id(got, "length")
    assert length[0] == length[1] == [1]
    places = {(r["sequence_id"], r["offset"]) for r in got.collect()}
    assert len(places) == got.count()


def test_rules(spark, docs, empty, labels):
    got = quality.quality_rules(docs, labels)
    assert got.count() == docs.count() and quality.quality_rules(empty, labels).count() == 0
    n = _by_id(got, "n_words")
    assert [n[i] for i in range(5)] == [[0], [0], [0], [1], [4]]
    assert _by_id(got, "n_repeat_words")[15] == [300] and _by_id(got, "n_dup_lines")[10] == [1]
    kept = quality.keep_good(docs, spark.createDataFrame([], LABELS))
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in got.where("NOT base_failed").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and 15 not in want


def test_classifier_after_a_filter(spark):
    """With no bad row left among its documents, the filter still rejects bad ones by a model of the whole table."""
    texts = [words(900 + i, 80) if i % 2 else " ".join(w.upper() + "!!" for w in words(900 + i, 80).split()) for i in range(120)]
    whole = frame(spark, rows(texts))
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    clean = whole.where("doc_id % 2 = 1")
    mixed = clean.unionByName(frame(spark, [(1001, " ".join(w.upper() + "!!" for w in words(5, 80).split()), "en", "src1", 1, 1, "k", "x", False)]))
    kept = {r["doc_id"] for r in classifier.keep_predicted(mixed, marks, training=whole).collect()}
    assert kept == {r["doc_id"] for r in clean.collect()}
    # Fitted on what is left, there is one class only and nothing goes.
    assert classifier.keep_predicted(mixed, marks).count() == mixed.count()
