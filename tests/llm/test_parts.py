"""The pieces that run inside tasks, against plain versions."""

import heapq
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from helixframe.llm import classifier, jpeg, lm, near, packing, pieces
from helixframe.llm.hashing import Words, mix, shingles
from helixframe.llm.pieces import Pieces

from .helpers import words


def test_words_and_shingles():
    texts = ["", "  ", "A b\n\nc", "a B c d e f", "é ü", "x"]
    w = Words(pa.array(texts), lower=True)
    assert w.count.tolist() == [0, 0, 3, 6, 2, 1]
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 9
    value, row = shingles(w, 5)
    assert row.tolist() == [2, 3, 3, 4, 5] and len(set(value.tolist())) == 5
    assert Words(pa.array(texts)[3:5], lower=True).count.tolist() == [6, 2]


def test_forest_recall():
    assert near.recall_at(np.array([0.8]), 4)[0] > 0.999
    random_sets = np.random.default_rng(0)
    base = random_sets.integers(0, 1 << 63, 2000, dtype=np.uint64)
    found = 0
    for i in range(60):
        a = np.sort(base[i : i + 900])
        b = np.sort(np.concatenate((a[:850], random_sets.integers(0, 1 << 63, 100, dtype=np.uint64))))
        s = near.signatures([a, b]).reshape(2, near.TREES, near.DEPTH)
        found += any((s[0, t, :4] == s[1, t, :4]).all() for t in range(near.TREES))
    assert found == 60


def test_jpeg_payloads():
    r = np.random.default_rng(1)
    payloads = [bytes(64), bytes([255]) * 128, bytes(range(256)), r.integers(0, 256, 64 * 700, dtype=np.uint8).tobytes()]
    files = jpeg.encode_payloads(payloads)
    images = [jpeg.Image(f) for f in files]
    for p, f, im, c in zip(payloads, files, images, jpeg.decode_coefficients(images), strict=True):
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert jpeg.payload_of(im, c[0]) == p
        small = jpeg.thumbnail(im, c[0]).ravel()[: len(p) // 64]
        assert small.tolist() == list(p[::64])  # the DC step is 8, so a block's mean is its first byte
    with pytest.raises(jpeg.BadImage):
        jpeg.Image(b"GIF89a")


def test_jpeg_without_restarts_and_with_colours():
    """A two-component image coded by hand: 2x1 luminance blocks and one chroma block, zero runs and ends of blocks."""
    table_dc, table_ac = jpeg.DC_TABLE, ([0, 2, 2, 1], bytes([0x00, 0x01, 0xF0, 0x02, 0x21]))
    code = lambda t: {s: format(c, f"0{n}b") for s, c, n in jpeg._codes(t)}
    dc, ac = code(table_dc), code(table_ac)
    amplitude = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    bits = dc[3] + amplitude(5) + ac[0x01] + amplitude(1) + ac[0x21] + amplitude(-1) + ac[0x00]
    bits += dc[2] + amplitude(-3) + ac[0xF0] + ac[0x02] + amplitude(3) + ac[0x00]
    bits += dc[0] + ac[0x00]
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    packed = lambda kind, t: bytes([kind]) + bytes(t[0] + [0] * (16 - len(t[0]))) + t[1]
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, 16] + [1] * 63)) + jpeg._segment(0xC0, bytes([8, 0, 8, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0]))
    head += jpeg._segment(0xC4, packed(0, table_dc) + packed(0x10, table_ac)) + jpeg._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    im = jpeg.Image(head + scan + b"\xff\xd9")
    luminance, chroma = jpeg.decode_coefficients([im])[0]
    assert luminance[0, 0, [0, 1, 4]].tolist() == [5, 1, -1] and luminance[0, 1, [0, 17]].tolist() == [2, 3] and not chroma.any()
    assert jpeg.thumbnail(im, luminance).tolist() == [[128 + 10, 128 + 4]]


def agenda(p, run, key):
    """Merge-dropout of one run, candidate by candidate over all that are there."""
    symbols, starts, skipped = list(run), list(range(len(run) + 1)), set()
    while True:
        found = [(int(p.rank[p.score[a + b]]), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in p.score and (starts[i], starts[i + 2]) not in skipped]
        if not found:
            return [i for s in symbols for i in ([p.id[s]] if s in p.id else p._bytes(s))]
        _, i = min(found)
        ends = np.array([(starts[i] * pieces._FROM + starts[i + 2] * pieces._TO) % (1 << 64)], np.uint64)
        if int(mix(ends ^ np.array([key], np.uint64))[0]) >> 32 < p.dropout:
            skipped.add((starts[i], starts[i + 2]))
        else:
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del starts[i + 1]


def plainly(p, text):
    """A whole text's ids by agenda()."""
    own = np.array([xxhash.xxh64_intdigest(text.encode(), p.seed)], np.uint64)
    runs, first = [], True
    for at, part in enumerate(text.split("▁")):
        runs += [None] if at else []
        runs += re.findall("▁*[^▁]+|▁+", ("▁" if first else "") + part.replace(" ", "▁"))
        first = False
    out = []
    for i, run in enumerate(runs):
        key = int(mix(np.array([i], np.uint64) * np.uint64(pieces._FROM) + own)[0])
        out += p._bytes("▁") if run is None else agenda(p, run, key)
    return out


TEXTS = [words(i, 30) for i in range(8)] + ["", " a  b", "▁▁ x", "x▁ y  ", "日本 語😀", "a" * 200, "        deep", "wh" * 50 + "  x▁y"]


def test_dropout_agenda():
    p, q = Pieces("piece_bpe_32k.model", dropout=0.0), Pieces("piece_bpe_32k.model", dropout=0.3)
    for text in TEXTS:
        if "▁" not in text:
            assert p.encode(text).tolist() == p.library.encode(text)
        for x in (p, q):
            assert x.decode(x.encode(text)) == text
            assert x.encode(text).tolist() == (plainly(x, text) if text else [])
    assert [x.tolist() for x in q.encode_all(TEXTS)] == [q.encode(t).tolist() for t in TEXTS]


def test_seeds_are_unrelated():
    text = words(5, 400)
    encoded = [Pieces("piece_bpe_32k.model", seed=s).encode(text).tolist() for s in range(100, 104)]
    assert len({tuple(x) for x in encoded}) == 4


def test_long_text_goes_in_parts(monkeypatch):
    q, text = Pieces("piece_bpe_32k.model"), words(1, 3000) + "  " + "ab" * 40 + " ▁ " + words(2, 50)
    whole = q.encode(text).tolist()
    monkeypatch.setattr(pieces, "SEGMENT", 500)
    assert len(q._parts(text)) > 10 and q.encode(text).tolist() == whole


def test_dropout_of_each_occurrence():
    q = Pieces("piece_bpe_32k.model")
    for c in "aesty":
        ids = q.encode(" ".join([c] * 6000))
        dropped = len(ids) - 6000  # one merge, of the blank and the letter
        assert 0.085 * 6000 < dropped < 0.115 * 6000


def model(n, seq):
    pairs = np.zeros((lm.SYMBOLS + 1, lm.SYMBOLS + 1))
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    return lm.counts_of(np.bincount(seq, minlength=n), pairs, np.minimum(np.arange(n), lm.SYMBOLS))


def test_gradients():
    r = np.random.default_rng(0)
    n = 40
    seq = r.integers(1, n, 600).astype(np.uint16)
    c = model(n, seq)
    t = {k: v.astype(np.float64) for k, v in lm.first_tables().items()}
    w, owner = lm.windows(seq, np.array([0, 100, 101]), np.array([100, 101, 600]), 0)
    targets = w[:, lm.STRIDE + 1 :]
    assert targets[targets != lm.NONE].tolist() == seq.tolist() and owner.tolist() == [0] * 7 + [1] + [2] * 32
    weight = r.random(len(w)) + 0.5
    _, g = lm.gradients(c, t, w, weight)
    for name in t:
        if isinstance(g[name], tuple):
            rows, found = g[name]
            i = (int(rows[3]), 2)
            want = found[3, 2]
        else:
            i = tuple(int(r.integers(0, d)) for d in t[name].shape)
            want = g[name][i]
        at = t[name][i]
        t[name][i] = at + 1e-4
        up = lm.gradients(c, t, w, weight)[0]
        t[name][i] = at - 1e-4
        down = lm.gradients(c, t, w, weight)[0]
        t[name][i] = at
        assert want == pytest.approx((up - down) / 2e-4, abs=1e-6)


def test_probabilities_of_all_subwords_sum_to_one():
    r = np.random.default_rng(1)
    n = 2500  # more than have symbols of their own
    seq = r.integers(1, n, 9000).astype(np.uint16)
    pairs = np.zeros((lm.SYMBOLS + 1, lm.SYMBOLS + 1))
    symbol = np.minimum(np.arange(n), lm.SYMBOLS)
    np.add.at(pairs, (symbol[seq[:-1]], symbol[seq[1:]]), 1)
    c, t = lm.counts_of(np.bincount(seq, minlength=n), pairs, symbol), lm.first_tables()
    w, _ = lm.windows(seq, np.array([0]), np.array([len(seq)]), 0, 3, 4)
    every = np.repeat(w, n, 0)
    every[:, lm.STRIDE + 4] = np.arange(n)
    got = lm.log10_scores(c, t, every)[:, 3]
    assert (10.0 ** got.astype(np.float64)).sum() == pytest.approx(1.0, abs=1e-4)
    assert len(set(got[lm.SYMBOLS :].tolist())) > 3  # shares of their own, not one for all


def test_units_open_into_windows():
    seq = np.arange(1, 5001).astype(np.uint16)
    starts, ends = np.array([0, 900, 901, 3000]), np.array([900, 901, 3000, 5000])
    w, _ = lm.windows(seq, starts, ends, 0)
    units, _ = lm.windows(seq, starts, ends, 0, targets=lm.UNIT * lm.STRIDE)
    opened, weight = lm.opened(units, np.arange(len(units)))
    assert (opened == w).all() and len(weight) == len(w)


def test_units_have_the_gradient_of_their_windows():
    r = np.random.default_rng(4)
    seq = r.integers(1, 40, 3000).astype(np.uint16)
    starts, ends = np.array([0, 700, 701, 1900]), np.array([700, 701, 1900, 3000])
    c, t = model(40, seq), {k: v.astype(np.float64) for k, v in lm.first_tables().items()}
    units, _ = lm.windows(seq, starts, ends, 0, targets=lm.UNIT * lm.STRIDE)
    weight = r.random(len(units)) + 0.5
    (a, whole), (b, parts) = lm.gradients(c, t, units, weight), lm.gradients(c, t, *lm.opened(units, weight))
    assert a == pytest.approx(b, rel=1e-9)
    for name in t:
        both = []
        for g in (whole[name], parts[name]):
            both.append(np.zeros(t[name].shape))
            both[-1][g[0] if isinstance(g, tuple) else slice(None)] = g[1] if isinstance(g, tuple) else g
        assert np.allclose(*both, rtol=0, atol=1e-7)
    assert np.allclose(lm.log10_scores(c, t, units).sum(), lm.log10_scores(c, t, lm.opened(units, weight)[0]).sum())


def test_recurring_words_are_encoded_as_in_whole_texts(monkeypatch):
    r = np.random.default_rng(5)
    blanks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \x0b", "\n  "]
    words = ["a", "B", "don't", "'s", "é", "1", "12", "!!", "中文", "🙂", "The", "\x1c", "<|endoftext|>"]
    odd = ["\u00a0", "\u3000", "\x85", "\u2028"]
    encoding = lm.Encoding(kept=6)
    slots, calls = {}, []
    once = encoding.encoder

    class Counted:
        def encode_ordinary(self, text):
            calls.append(len(text))
            return once.encode_ordinary(text)

    monkeypatch.setattr(encoding, "encoder", Counted())
    for i in range(120):
        pool = blanks * 2 + words + (odd if i % 2 else [])
        texts = pa.array(["".join(r.choice(pool, r.integers(0, 15))) for _ in range(i % 20)], pa.string())
        monkeypatch.setattr(lm, "SPANS", int(r.choice([1, 7, 1 << 18])))
        found = Words(texts, lower=True)
        value, place = np.unique(found.hash, return_inverse=True)
        for v in value.tolist():
            if len(slots) < 6:
                slots.setdefault(v, len(slots))
        ids, ends = encoding.of(texts, found, place, np.array([slots.get(v, -1) for v in value.tolist()], np.int64))
        want = [lm.subwords(x) for x in texts.to_pylist()]
        assert ids.tobytes() == b"".join(want) and ends.tolist() == np.cumsum([len(x) // 2 for x in want]).tolist()
    texts = pa.array(["same words again " * 5000])
    found = Words(texts, lower=True)
    value, place = np.unique(found.hash, return_inverse=True)
    calls.clear()
    encoding.of(texts, found, place, np.full(len(value), -1))
    assert sum(calls) < 100  # and not the text's 85,000 characters


def test_scores_do_not_depend_on_neighbours():
    r = np.random.default_rng(2)
    seq = r.integers(1, 60, 6000).astype(np.uint16)
    c, t, text = model(60, seq), lm.first_tables(), seq[:333]
    got = set()
    for before in (1, 7, 100, 5003):
        ids = np.concatenate((seq[:before], text))
        got.add(lm.text_scores(c, t, ids, np.array([0, before]), np.array([before, before + 333]), 0)[1])
    assert len(got) == 1


def test_training_lowers_the_loss():
    r = np.random.default_rng(3)
    seq = np.tile(r.integers(1, 30, 50), 80).astype(np.uint16)
    c = lm.counts_of(np.bincount(seq, minlength=30), r.random((lm.SYMBOLS + 1, lm.SYMBOLS + 1)), np.minimum(np.arange(30), lm.SYMBOLS))
    trainer = lm.Trainer(c, lm.first_tables())
    units, _ = lm.windows(seq, np.array([0]), np.array([len(seq)]), 0, targets=lm.UNIT * lm.STRIDE)
    w, weight = lm.opened(units, np.ones(len(units), np.float32))
    first = lm.gradients(c, trainer.t, w, weight)[0]
    for _ in range(40):
        trainer.learn(units, np.ones(len(units), np.float32))
    assert lm.gradients(c, trainer.t, w, weight)[0] < 0.7 * first


def test_memory_follows_a_long_text():
    text = words(9, 40_000) * 16  # over 5 MB without a line end
    size = len(text)
    for make in (lambda: Words(pa.array([text]), True), lambda: near.shingle_sets(pa.array([text])), lambda: jpeg.decode_coefficients([jpeg.Image(jpeg.encode_payloads([text.encode().ljust(-(-size // 64) * 64, b"\0")])[0])])):
        tracemalloc.start()
        make()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 * size + (64 << 20)


def test_words_over_blocks():
    long = "q" * 700_000
    w = Words(pa.array([f"a {long} b", long, "B"]), True)
    assert w.hash[1] == w.hash[3] and w.hash[2] == w.hash[4] and len(w) == 5


def test_hinge_fit_separates():
    r = np.random.default_rng(4)
    good = np.arange(60) % 2
    features = [np.unique(np.concatenate((r.integers(100, 400, 20), [y * 50 + 1]))) for y in good]
    ratio = classifier.log_ratios(features, good)
    weight, bias = classifier.hinge_fit(features, good, ratio)
    margin = np.array([ratio[f] / np.linalg.norm(ratio[f]) @ weight[f] + bias for f in features])
    assert ((margin > 0) == (good == 1)).all()


def test_fullest_against_brute_force():
    r = random.Random(5)
    for _ in range(50):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}
        room = r.randint(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        chosen = packing.fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(sums) and all(k <= counts[n] for n, k in chosen.items())


def test_patterns_use_every_row_once():
    r = random.Random(6)
    counts = {r.randint(1, 100): r.randint(1, 40) for _ in range(25)}
    made, used = packing.patterns(counts, 100), {}
    for times, parts in made:
        assert sum(n * u for n, u in parts) <= 100
        for n, u in parts:
            used[n] = used.get(n, 0) + times * u
    assert used == counts
    ffd, heap = 0, []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):  # worst fit, for scale
        if heap and -heap[0] >= n:
            heapq.heappush(heap, heapq.heappop(heap) + n)
        else:
            heapq.heappush(heap, n - 100)
            ffd += 1
    assert sum(t for t, _ in made) <= ffd


def test_binomial_tail_in_columns(spark):
    from pyspark.sql import functions as F

    from helixframe.llm import quality

    df = spark.createDataFrame([(100, 0), (2000, 1), (3000, 3), (5, 5)], "n long, k long")
    for r in df.select("n", "k", quality._tail(F.col("n"), F.col("k")).alias("t")).collect():
        want = sum(math.comb(r["n"], i) * quality.RISK**i * (1 - quality.RISK) ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["t"] == pytest.approx(min(1.0, want), rel=1e-9)
