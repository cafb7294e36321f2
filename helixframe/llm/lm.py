"""Language-model scores: causal self-attention over subword ids, trained in numpy.

The model predicts a subword in steps: its class, from attention over the
subwords before it and a feed-forward layer, and the subword within the class,
from corpus counts of neighbours. Counts cover all training texts; the
attention's tables are trained on all their windows, which a hash of their
content deals out to rounds and buckets. A bucket is trained in the order of
that hash and the buckets' tables are averaged, so that neither partitions nor
tasks have a part in the result.
"""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, crc_mod, cut, map_texts, settled, slices
from .hashing import Words, mix

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
HELD_OUT = 10
#: Subwords with a symbol of their own; the others share one and have their own share of it.
SYMBOLS = 2047
#: Rows of the attention's tables for the other subwords, by a hash of the id.
HASHED = 2048
CLASSES, WIDTH, INNER = 32, 16, 32
#: A window scores STRIDE subwords, each by itself and all before it in the window, STRIDE of the window before included.
STRIDE = 16
#: Ids of a window: the keys, and one more, as each place predicts the next.
SPAN = 2 * STRIDE + 1
#: Stands for no subword, before a text's begin and after its end.
NONE = 0xFFFF
#: Words whose counts every task has at hand; the counts of rarer ones come by a join.
HEAD = 400_000
#: Windows of a text in a row that are dealt out and trained on together.
UNIT = 8
#: Windows are dealt out to so many rounds; each is trained on in one of them.
ROUNDS = 2
#: A round's n windows go to sqrt(n / BUCKET) buckets, so both their number and their size grow with the corpus, up to MOST_BUCKETS.
BUCKET, MOST_BUCKETS = 1 << 13, 4096
#: Units in a step, and the length of steps before they are divided by the root of a row's summed squares.
BATCH, RATE = 16, 0.15
#: Units scored at once, and their windows.
BLOCK, SCORED = 64, 4
#: Tables are averaged, and window scores summed, as whole multiples of these: such sums are the same in any order.
FINE, FINE_SCORE = 1 << 32, 1 << 24
#: Weight of the class's own distribution against a neighbour's counts, and what a subword never seen is given.
BACKOFF, UNSEEN = 1.0, 0.05
#: Taken off each count of neighbours.
DISCOUNT = 0.75
_LOG10 = np.float32(1 / np.log(10))

# -- words


def _counted(docs: DataFrame, text_column: str) -> DataFrame:
    """(h, n): the hash of each word of these texts and how often it stands there."""

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        _kept_memory()
        h, n = np.unique(Words(rows.column("text"), lower=True).hash, return_counts=True)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    parts = map_texts(docs.select(F.col(text_column).alias("text")), [], "text", make, "h long, n long", 4 * BATCH_BYTES)  # fewer rows, as words recur
    return parts.groupBy("h").agg(F.sum("n").alias("n"))


# -- subwords

_encoders: dict[str, object] = {}


def _encoder(name: str):
    if name not in _encoders:
        import public_tokenizers as files
        import tiktoken

        with open(files.path(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("lm", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    return _encoders[name]


def subwords(text: str, name: str = TOKENIZER) -> bytes:
    """Ids, of 16 bits, of a text with A-Z in lower case, and one end id, which follows the vocabulary's."""
    encoder, end = _encoder(name)
    ids = encoder.encode_ordinary(text.encode().lower().decode())  # of bytes, lower() changes A-Z alone
    ids.append(end)
    return array("H", ids).tobytes()


#: The white space of the tokenizer's pattern that parts no words here; a text that holds some is encoded whole.
ODD_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Spans whose ids are put together at once.
SPANS = 1 << 18


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each entry, n of them."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Encoding:
    """subwords() of many texts in which words recur: each word is encoded once in a batch, and frequent ones once in a task.

    The pattern parts a text before the last blank ahead of each word. A word
    with its space is therefore encoded by itself, and so are another last
    blank, the blanks further ahead and those after the last word. New words
    are encoded joined, in one call, and told apart by their tokens' lengths.
    """

    def __init__(self, name: str = TOKENIZER, kept: int = 0):
        self.encoder, self.end_id = _encoder(name)
        self.length = np.array([len(self.encoder.decode_single_token_bytes(i)) for i in range(self.end_id)])
        self.first, self.size, self.body = np.zeros(2 * kept, np.int64), np.zeros(2 * kept, np.int64), np.zeros(0, np.uint16)

    def _words(self, words: Words, which: np.ndarray, place: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each of these words, with a space ahead or none, has its ids in an array, how many, that array, and whether there is a space."""
        start, raw = words.start[which], words.raw.tobytes()
        space = (start > 0) & (words.raw[start - 1] == 32) & (start > self.begin[words.row[which]])
        kind = 2 * place[which] + space
        seen = np.full(2 * len(slot), -1)
        seen[kind] = np.arange(len(which))
        kinds = np.flatnonzero(seen >= 0)
        own = np.where(slot[kinds >> 1] < 0, -1, 2 * slot[kinds >> 1] + (kinds & 1))
        new = np.flatnonzero((own < 0) | (self.size[own] == 0) if len(self.size) else own < 2)
        new = np.concatenate((new[own[new] >= 0], new[own[new] < 0]))  # those to be kept come first
        spans = zip(words.start[which[seen[kinds[new]]]].tolist(), words.end[which[seen[kinds[new]]]].tolist(), (kinds[new] & 1).tolist(), strict=True)
        parts = [b" " + raw[a:b] if blank else b"\n" + raw[a:b] for a, b, blank in spans]
        ids = np.array(self.encoder.encode_ordinary(b"".join(parts).decode()), np.uint16)
        stop = np.cumsum([len(x) for x in parts], dtype=np.int64)
        upto = np.searchsorted(np.cumsum(self.length[ids]), stop, "right")
        first = np.concatenate(([0], upto[:-1])) if len(upto) else upto
        first = first + 1 - (kinds[new] & 1)  # without the line feed
        keep = int((own[new] >= 0).sum())
        whole = int(upto[keep - 1]) if keep else 0
        first += len(self.body)
        self.first[own[new[:keep]]], self.size[own[new[:keep]]] = first[:keep], (upto + len(self.body) - first)[:keep]
        begin, size = (x[own] if len(x) else np.zeros(len(own), np.int64) for x in (self.first, self.size))
        begin[new], size[new] = first, upto + len(self.body) - first
        pool = np.concatenate((self.body, ids))
        self.body = pool[: len(self.body) + whole]
        number = np.zeros(len(seen), np.int64)
        number[kinds] = np.arange(len(kinds))
        return begin[number[kind]], size[number[kind]], pool, space

    def of(self, texts: pa.Array, words: Words, place: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, joined, and where each text's end.

        ``words`` are theirs in lower case, ``place`` numbers each word's kind,
        and ``slot`` is the kind's number among those to be kept, or -1.
        """
        finish = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        self.begin = begin = np.concatenate(([0], finish[:-1])) if len(finish) else finish
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        some = np.flatnonzero(words.count > 0)
        after = begin.copy()  # where a text's last blanks begin
        after[some] = words.end[words.first[some] + words.count[some] - 1]
        before = np.concatenate(([0], words.end[:-1])) if len(words) else words.end
        before[words.first[some]] = begin[some]
        which = np.flatnonzero(~odd[words.row])
        at, size, pool, space = self._words(words, which, place, slot)
        start, before, row = words.start[which], before[which], words.row[which]
        last = np.maximum(before, start - 1)  # the last blank ahead, or the word
        single, run, tail, odd = np.flatnonzero(~space & (last < start)), np.flatnonzero(before < last), np.flatnonzero(~odd & (after < finish)), np.flatnonzero(odd & (begin < finish))
        other = [(last[single], start[single], row[single]), (before[run], last[run], row[run]), (after[tail], finish[tail], tail), (begin[odd], finish[odd], odd)]
        a, b, r = (np.concatenate(x) for x in zip(*other, strict=True))
        raw, numbers, more = words.raw.tobytes(), {}, []
        number = np.array([numbers.setdefault(raw[x:y], len(numbers)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        more = [np.array(self.encoder.encode_ordinary(x.decode()), np.uint16) for x in numbers]
        sizes = np.array([len(x) for x in more], np.int64)
        at = np.concatenate((at, (np.cumsum(sizes) - sizes + len(pool))[number]))
        size, row = np.concatenate((size, sizes[number])), np.concatenate((row, r))
        pool = np.concatenate((pool, *more))
        order = np.argsort(np.concatenate((start - space, a)), kind="stable")
        ends = np.cumsum(np.bincount(row, size, len(texts)).astype(np.int64) + 1)
        ids = np.full(int(ends[-1]) if len(ends) else 0, self.end_id, np.uint16)
        done = 0
        for i in range(0, len(order), SPANS):
            part = order[i : i + SPANS]
            found, owner = pool[_ragged(at[part], size[part])], np.repeat(row[part], size[part])
            ids[np.arange(done, done + len(found)) + owner] = found  # an end follows each text before
            done += len(found)
        return ids, ends


def _kept_memory() -> None:
    """Lets glibc keep up to twice this block when memory is freed, once it has seen one so large go; else each step's arrays are new pages."""
    np.empty(31 << 20, np.uint8)


# -- the model


@dataclass
class Counts:
    """What the corpus counts give: symbols of ids, classes of symbols, and log probabilities."""

    symbol: np.ndarray  # of each id; the last symbol is shared
    row: np.ndarray  # of each id in the attention's tables
    klass: np.ndarray  # of each symbol
    next_class: np.ndarray  # [symbol before, class], natural log
    within: np.ndarray  # [symbol before, symbol], log10 of the symbol given its class and the one before
    share: np.ndarray  # log10 of each id's share of its symbol


def classes_of(pairs: np.ndarray, classes: int = CLASSES, seed: int = 5) -> np.ndarray:
    """A class for each symbol: k-means over leading directions of the neighbours' pointwise information."""
    n, random = len(pairs), np.random.default_rng(seed)
    total = pairs.sum()
    if not total:
        return np.arange(n) % classes
    before, after = pairs.sum(1) + 1.0, pairs.sum(0) + 1.0
    info = np.log1p(pairs * (total / np.outer(before, after))).astype(np.float32)
    both = np.concatenate((info, info.T), 1)
    basis = np.linalg.qr(both @ random.standard_normal((both.shape[1], 24)).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(both @ (both.T @ basis))[0]
    weight = np.sqrt(after)[:, None]
    points = both @ (both.T @ basis)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-6)
    centers = points[np.argsort(-after, kind="stable")[: 4 * classes : 4][:classes]]
    if len(centers) < classes:
        return np.arange(n) % classes
    for _ in range(25):
        klass = np.argmax(points @ centers.T, 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, klass, points * weight)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.maximum(size, 1e-9), centers)
    return klass


def counts_of(id_counts: np.ndarray, pairs: np.ndarray, symbol: np.ndarray) -> Counts:
    klass = classes_of(pairs)
    n, size = len(pairs), len(symbol)
    totals = np.bincount(symbol, id_counts, n) + UNSEEN
    members = np.zeros((n, CLASSES))
    members[np.arange(n), klass] = 1
    by_class = totals @ members
    base = totals / by_class[klass]
    seen, kinds = pairs @ members, (pairs > 0) @ members
    class_share = by_class / by_class.sum()
    # A class without members is never aimed at; it has next to no probability.
    next_class = np.log(np.maximum((seen + BACKOFF * class_share) / (seen.sum(1, keepdims=True) + BACKOFF), 1e-30))
    # Absolute discounting: what is taken off the seen neighbours is spread by the class's own distribution.
    left = np.maximum(DISCOUNT * kinds, BACKOFF * (seen == 0))
    within = np.log10((np.maximum(pairs - DISCOUNT, 0) + left[:, klass] * base) / np.maximum(seen, BACKOFF * (seen == 0))[:, klass])
    # Ids by 16 bits, so that NONE has an entry too.
    wide = lambda x, kind: np.concatenate((x, np.zeros(NONE + 1 - size, x.dtype))).astype(kind)
    own = id_counts + UNSEEN
    share = np.log10(own / np.bincount(symbol, own, n)[symbol])
    row = np.where(symbol < n - 1, symbol, n - 1 + (np.arange(size) * 2_654_435_761 >> 7) % HASHED)
    return Counts(wide(symbol, np.int64), wide(row, np.int64), klass.astype(np.int64), next_class.astype(np.float32), within.astype(np.float32), wide(share, np.float32))


Tables = dict[str, np.ndarray]


def first_tables(seed: int = 3) -> Tables:
    """Query, and key with value, of each row, a bias for each distance, the way from values to classes, and a layer beside it."""
    random, rows = np.random.default_rng(seed), SYMBOLS + HASHED
    shapes = {"query": (rows, WIDTH), "held": (rows, 2 * WIDTH), "out": (WIDTH, CLASSES), "inner": (WIDTH, INNER)}
    tables = {k: (random.standard_normal(s) * 0.3).astype(np.float32) for k, s in shapes.items()}
    zeros = {"far": 2 * STRIDE, "bias": INNER, "outer": (INNER, CLASSES)}
    return tables | {k: np.zeros(s, np.float32) for k, s in zeros.items()}


def window_counts(starts: np.ndarray, ends: np.ndarray, targets: int = STRIDE) -> np.ndarray:
    """How many windows each sequence has: one for each ``targets`` ids begun."""
    return -(-(ends - starts) // targets)


def windows(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_id: int, a: int = 0, b: int | None = None, targets: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Windows a to b over joined sequences, as rows of ids, and the sequence of each.

    The last ``targets`` ids of a window are its targets, before them are STRIDE
    and one. A sequence begins after an end, which is no target. Places before
    that and after the sequence are NONE. Each id is one target.
    """
    count = window_counts(starts, ends, targets)
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    number = np.arange(a, total if b is None else min(b, total))
    owner = np.searchsorted(upto, number, "right")
    first = starts[owner] + (number - (upto[owner] - count[owner])) * targets
    place = first[:, None] + np.arange(-STRIDE - 1, targets)
    begin = starts[owner][:, None]
    out = np.full(place.shape, NONE, np.uint16)
    inside = (place >= begin) & (place < ends[owner][:, None])
    out[inside] = ids[place[inside]]
    out[place == begin - 1] = end_id
    return out, owner


def opened(units: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of units of UNIT x STRIDE targets, and their weights; windows without a target are left out."""
    w = np.lib.stride_tricks.sliding_window_view(units, SPAN, axis=1)[:, ::STRIDE].reshape(-1, SPAN)
    live = w[:, STRIDE + 1] != NONE
    return w[live], np.repeat(weight, UNIT)[live]


#: The end has symbol 0.
END = 0
_ROWS = np.arange(STRIDE)[:, None]
_BACK = _ROWS + STRIDE - np.arange(2 * STRIDE)[None]  # distance from query to key
_CAUSAL = _BACK >= 0


def _windowed(x: np.ndarray, axis: int) -> np.ndarray:
    """Rows' overlapping windows of 2 x STRIDE places, as a view: (row, window, ...) for places on this axis."""
    shape, strides = list(x.shape), list(x.strides)
    n, step = shape[axis] // STRIDE - 1, STRIDE * strides[axis]
    shape[axis] = 2 * STRIDE
    return np.lib.stride_tricks.as_strided(x, (shape[0], n, *shape[1:]), (strides[0], step, *strides[1:]), writeable=False)


def attend(t: Tables, rows: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Masked attention of every window in one batch: contexts, and what training needs (weights before they are divided by their sums).

    ``rows`` are the keys' rows in the tables, ``held`` says which places hold a
    subword. A row of n windows has n + 1 times STRIDE places, fetched once.
    Values are also given turned: BLAS multiplies small matrices several times
    as fast if neither is turned on the way.
    """
    both = t["held"].take(rows, 0)
    turned = np.ascontiguousarray(both.swapaxes(1, 2))
    q = t["query"].take(rows[:, STRIDE:], 0).reshape(len(rows), -1, STRIDE, WIDTH)
    q *= np.float32(WIDTH**-0.5)
    score = q @ _windowed(turned[:, :WIDTH], 2)
    score += np.where(_CAUSAL, t["far"][np.maximum(_BACK, 0) % (2 * STRIDE)], np.float32(-1e9))
    np.minimum(score, np.float32(40), out=score)
    np.exp(score, out=score)
    own = _windowed(held, 1)
    edge = ~(own[:, :, 0] & own[:, :, -1])  # windows at a sequence's begin or end
    if edge.any():
        score[edge] *= own[edge][:, None, :]
    total = np.maximum(score @ np.ones((2 * STRIDE, 1), score.dtype), np.float32(1e-30))
    context = score @ _windowed(both[:, :, WIDTH:], 1)
    context /= total
    context = context.reshape(len(rows), -1, WIDTH)
    return context, score, total, q, _windowed(both[:, :, :WIDTH], 1), _windowed(turned[:, WIDTH:], 2)


def _logits(c: Counts, t: Tables, context: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log odds of the classes, and the feed-forward layer's inner values, for (row, target).

    Contexts are multiplied row by row: one product of all is slower and rounds by their places in it.
    """
    inner = context @ t["inner"]
    inner += t["bias"]
    np.maximum(inner, 0, out=inner)
    logits = inner @ t["outer"]
    logits += context @ t["out"]
    logits += c.next_class.take(before, 0)
    return logits, inner


def log10_scores(c: Counts, t: Tables, w: np.ndarray) -> np.ndarray:
    """log10 probability of each target of these windows, or units of several; 0 where there is none."""
    held, ids = w != NONE, w[:, STRIDE + 1 :]
    context = attend(t, c.row[w[:, :-1]], held[:, :-1])[0]
    symbols = c.symbol[w[:, STRIDE:]]
    before, aim = symbols[:, :-1], symbols[:, 1:]
    logits, _ = _logits(c, t, context, before)
    own = np.take_along_axis(logits, c.klass[aim][..., None], 2)[..., 0]
    np.exp(logits, out=logits)
    found = (own - np.log((logits @ np.ones((CLASSES, 1), logits.dtype))[..., 0])) * _LOG10 + c.within.take(before * (SYMBOLS + 1) + aim) + c.share[ids]
    return np.where(held[:, STRIDE + 1 :], found, 0)


def text_scores(c: Counts, t: Tables, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """log10 probability of each sequence, BLOCK units of SCORED windows at a time, whatever their lengths."""
    targets = SCORED * STRIDE
    upto = np.cumsum(window_counts(starts, ends, targets))
    total, fixed = int(upto[-1]) if len(upto) else 0, np.zeros(len(starts), np.int64)
    for a in range(0, total, BLOCK):
        w, owner = windows(ids, starts, ends, end_id, a, a + BLOCK, targets)
        full = w if len(w) == BLOCK else np.concatenate((w, np.full((BLOCK - len(w), w.shape[1]), NONE, np.uint16)))  # one shape, one way of rounding
        found = np.rint(log10_scores(c, t, full)[: len(w)].sum(1, dtype=np.float64) * FINE_SCORE).astype(np.int64)
        np.add.at(fixed, owner, found)
    return fixed / FINE_SCORE


Rows = tuple[np.ndarray, np.ndarray]


def _gathered(index: np.ndarray, rows: np.ndarray) -> Rows:
    """The distinct values of an index, and the sums of their rows, of an even width: columns are summed two by two, as complex numbers."""
    index = index.astype(np.uint16)
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    pairs = rows.take(order, 0).view(np.result_type(rows, np.complex64))
    return index[first].astype(np.int64), np.add.reduceat(pairs, first, axis=0).view(rows.dtype)


def gradients(c: Counts, t: Tables, w: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray | Rows]]:
    """Mean loss of the classes in nats over these targets, each by its row's weight, and its gradient; of tables by rows those that are not zero.

    Rows of ``w`` are windows, or units of several.
    """
    held = w != NONE
    rows = c.row[w[:, :-1]]
    context, a, total, q, k, v_turned = attend(t, rows, held[:, :-1])
    a /= total
    live = (held[:, STRIDE + 1 :] * weight[:, None]).ravel()
    live /= max(1e-30, live.sum())
    p, inner = _logits(c, t, context, c.symbol[w[:, STRIDE:-1]])
    np.exp(p, out=p)
    p /= p @ np.ones((CLASSES, 1), p.dtype)
    aim = c.klass[c.symbol[w[:, STRIDE + 1 :]].ravel()]
    at, flat = np.arange(len(aim)), p.reshape(-1, CLASSES)
    own = flat[at, aim]
    loss = float((-np.log(np.maximum(own, 1e-30)) * live).sum())
    flat[at, aim] = own - 1
    flat *= live.astype(np.float32)[:, None]
    d_inner = p @ np.ascontiguousarray(t["outer"].T)
    d_inner *= inner > 0
    d_context = p @ np.ascontiguousarray(t["out"].T)
    d_context += d_inner @ np.ascontiguousarray(t["inner"].T)
    d_context = d_context.reshape(q.shape)
    d_score = d_context @ v_turned
    d_score -= np.einsum("bnij,bnij->bni", a, d_score)[..., None]
    d_score *= a
    ones = lambda x: np.ones(len(x), x.dtype) @ x
    far = np.bincount(_BACK[_CAUSAL], ones(d_score.reshape(-1, _BACK.size)).reshape(_BACK.shape)[_CAUSAL], 2 * STRIDE).astype(np.float32)
    # Of each place the gradients of its query, key and value; the first places are no query, and neighbouring windows share keys and values.
    d_query, d_key, d_value = (np.zeros((len(w), q.shape[1] + 1, STRIDE, WIDTH), q.dtype) for _ in range(3))
    np.multiply(d_score @ k, np.float32(WIDTH**-0.5), out=d_query[:, 1:])
    for sums, x in ((d_key, d_score.swapaxes(2, 3) @ q), (d_value, a.swapaxes(2, 3) @ d_context)):
        sums[:, :-1] = x[:, :, :STRIDE]
        sums[:, 1:] += x[:, :, STRIDE:]
    at, sums = _gathered(rows.ravel(), np.concatenate((d_query, d_key, d_value), 3).reshape(-1, 3 * WIDTH))
    return loss, {
        "out": (context.swapaxes(1, 2) @ p).sum(0),
        "outer": (inner.swapaxes(1, 2) @ p).sum(0),
        "inner": (context.swapaxes(1, 2) @ d_inner).sum(0),
        "bias": ones(d_inner.reshape(-1, INNER)),
        "far": far,
        "query": (at, sums[:, :WIDTH]),
        "held": (at, sums[:, WIDTH:]),
    }


class Trainer:
    """Steps over one bucket's units, in their order, BATCH at a time, each row's shorter the more it has moved."""

    def __init__(self, counts: Counts, tables: Tables):
        self.c, self.t = counts, {k: v.copy() for k, v in tables.items()}
        self.moved = {k: np.zeros((len(x), 1) if x.ndim == 2 else x.shape, np.float32) for k, x in tables.items()}

    def learn(self, units: np.ndarray, weight: np.ndarray) -> None:
        for a in range(0, len(units), BATCH):
            _, g = gradients(self.c, self.t, units[a : a + BATCH], weight[a : a + BATCH])
            for k, x in g.items():
                at, x = x if isinstance(x, tuple) else (slice(None), x)  # rows without a gradient stay as they are
                own = self.moved[k][at] + (np.einsum("ij,ij->i", x, x)[:, None] / np.float32(x.shape[1]) if x.ndim == 2 else x * x)
                self.moved[k][at] = own
                x *= np.float32(RATE) / (np.sqrt(own) + np.float32(1e-6))
                self.t[k][at] -= x


# -- the job


def _sequences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's ids in one array, and where each row's begin and end."""
    blobs = part.column("ids").to_pylist()
    ends = np.cumsum([len(b) // 2 for b in blobs])
    starts = np.concatenate(([0], ends[:-1])) if len(blobs) else ends
    return np.frombuffer(b"".join(blobs), np.uint16), starts, ends


def _encoded(docs: DataFrame, head, tokenizer: str, id_column: str, text_column: str) -> DataFrame:
    """Each text's subwords, the part of its base score that frequent words give, and its rarer words' counts."""

    task = {}  # each has its own

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        hashes, logs, unseen = head.value
        if not task:
            _kept_memory()
            task["encoding"] = Encoding(tokenizer, len(hashes))
        texts = rows.column("text")
        words = Words(texts, lower=True)
        size = len(texts)
        value, place = np.unique(words.hash.view(np.int64), return_inverse=True)
        at = np.minimum(np.searchsorted(hashes, value), max(0, len(hashes) - 1))
        held = hashes[at] == value if len(hashes) else np.zeros(len(value), bool)
        frequent = held[place]
        base = np.bincount(words.row[frequent], logs[at[place[frequent]]], size) if len(hashes) else np.zeros(size)
        known = np.bincount(words.row[frequent], minlength=size)
        rare = words.row[~frequent].astype(np.int64) << 32 | place[~frequent]
        pair, times = np.unique(rare, return_counts=True)
        offsets = np.searchsorted(pair >> 32, np.arange(size + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(value[pair & 0xFFFFFFFF]), pa.array(times.astype(np.int32))], ["h", "times"])
        ids, ends = task["encoding"].of(texts, words, place, np.where(held, at, -1))
        bounds = np.concatenate(([0], 2 * ends)).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
        columns = [rows.column(0), rows.column(1), pa.array(words.count + 1), pa.array(base), pa.array(known), pa.ListArray.from_arrays(pa.array(offsets), entries), blobs]
        return pa.record_batch(columns, [id_column, "held_out", "n_tokens", "base", "known", "rare", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, held_out boolean, n_tokens long, base double, known long, rare array<struct<h: long, times: int>>, ids binary"
    rows = docs.select(F.col(id_column), (crc_mod(id_column, HELD_OUT) == 0).alias("held_out"), F.col(text_column).alias("text"))
    return map_texts(rows, [id_column, "held_out"], "text", make, schema)


def _id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the training texts; at most ``size`` rows reach the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for a, b in slices(batch.column("ids"), 1 << 20):
                total += np.bincount(_sequences(batch.slice(a, b - a))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = encoded.where(~F.col("held_out")).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def _pair_counts(encoded: DataFrame, symbol, symbols: int) -> np.ndarray:
    """Counts of neighbouring symbols in the training texts; at most symbols^2 rows reach the driver, as Arrow."""

    def run(batches):
        total = np.zeros(symbols * symbols, np.int64)
        for batch in batches:
            for a, b in slices(batch.column("ids"), 1 << 22):
                s, starts, _ = _sequences(batch.slice(a, b - a))
                s = symbol.value[s]
                if len(s):
                    before = np.concatenate(([END], s[:-1]))
                    before[starts] = END
                    total += np.bincount(before * symbols + s, minlength=symbols * symbols)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 100_000):
            yield pa.record_batch([pa.array(some[a : a + 100_000]), pa.array(total[some[a : a + 100_000]])], ["pair", "n"])

    rows = encoded.where(~F.col("held_out")).select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols * symbols)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(symbols, symbols)


def _hashed(units: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit's ids."""
    out = np.zeros(len(units), np.uint64)
    for i in range(units.shape[1]):
        out = (out ^ units[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def _round_units(encoded: DataFrame, round_no: int, buckets: int, end_id: int) -> DataFrame:
    """(bucket, h, n, u) of this round's training units; equal ones of a slice of rows are one row with a count."""
    targets = UNIT * STRIDE

    def run(batches):
        _kept_memory()
        for batch in batches:
            for a, b in slices(batch.column("ids"), 1 << 20):
                ids, starts, ends = _sequences(batch.slice(a, b - a))
                for x in range(0, int(window_counts(starts, ends, targets).sum()), 1 << 12):
                    units, _ = windows(ids, starts, ends, end_id, x, x + (1 << 12), targets)
                    h = _hashed(units)
                    own = np.flatnonzero((h >> np.uint64(8)) % np.uint64(ROUNDS) == round_no)
                    h, first, n = np.unique(h[own], return_index=True, return_counts=True)
                    bucket = ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
                    rows = np.ascontiguousarray(units[own[first]])
                    body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * units.shape[1]), len(h), [None, pa.py_buffer(rows)])
                    yield pa.record_batch([pa.array(bucket), pa.array(h.view(np.int64)), pa.array(n), body.cast(pa.binary())], ["bucket", "h", "n", "u"])

    return encoded.where(~F.col("held_out")).select("ids").mapInArrow(run, "bucket int, h long, n long, u binary")


def _trained(encoded: DataFrame, counts, tables: Tables, round_no: int, buckets: int, end_id: int) -> Tables:
    """The mean of all buckets' tables, each after it has learnt from its windows of this round.

    A unit that recurs is one row whose gradient counts as often as it occurs. A bucket's units
    come in the order of their hashes, so its batches do not depend on how
    rows are dealt out; a task streams through its buckets one by one.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(tables)
    names = sorted(tables)

    def run(batches):
        _kept_memory()
        whole, done, trainer, bucket = 0, 0, None, None
        none = np.zeros((0, SPAN + (UNIT - 1) * STRIDE), np.uint16)
        w, weight, last = none, np.zeros(0), ()

        def flush(all_of_it: bool) -> None:
            nonlocal w, weight, whole, done
            n = len(w) if all_of_it else max(0, len(w) - 1) // BATCH * BATCH  # the last unit may go on
            if trainer is not None and n:
                trainer.learn(w[:n], weight[:n].astype(np.float32))
            w, weight = w[n:], weight[n:]
            if all_of_it and trainer is not None:
                whole = whole + np.concatenate([np.rint(trainer.t[k].astype(np.float64).ravel() * FINE).astype(np.int64) for k in names])
                done += 1

        for batch in batches:
            owner, h, n = (batch.column(i).to_numpy() for i in range(3))
            rows = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, none.shape[1])
            cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if bucket != owner[a]:
                    flush(True)
                    trainer, bucket, last = Trainer(counts.value, sent.value), owner[a], ()
                    w, weight = none, np.zeros(0)
                new = np.concatenate(([last != (h[a],)], h[a + 1 : b] != h[a : b - 1]))
                group = np.cumsum(new) - 1
                sums = np.bincount(group + 1, n[a:b], group[-1] + 2)
                if len(weight):
                    weight[-1] += sums[0]
                w, weight = np.concatenate((w, rows[a:b][new])), np.concatenate((weight, sums[1:]))
                last = (h[b - 1],)
                flush(False)
        flush(True)
        if done:
            yield pa.record_batch([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole), pa.array(np.full(len(whole), done))], ["i", "x", "n"])

    dealt = _round_units(encoded, round_no, buckets, end_id).repartition("bucket").sortWithinPartitions("bucket", "h")
    rows = dealt.mapInArrow(run, "i int, x long, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return tables
    flat = np.zeros(rows.num_rows)
    flat[rows.column("i").to_numpy()] = rows.column("x").to_numpy() / rows.column("n").to_numpy() / FINE
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + tables[k].size].reshape(tables[k].shape).astype(np.float32)
        at += tables[k].size
    return out


@settled
def score_texts(docs: DataFrame, tokenizer: str = TOKENIZER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores every whole text under a model learnt from the rows whose id's crc32 is not divisible by HELD_OUT.

    Returns id, held_out, n_tokens (words and one end), n_known, train_tokens,
    base_score, score and n_subwords. base_score sums log10 unigram shares of
    the lower-cased words with 0.1 added to each count; score is the model's
    log10 probability of the text's subwords and end. Words are told apart by
    64-bit hashes. A null text counts as empty: its end alone is scored.
    Equal texts have equal scores. Without training rows both scores come
    from the added constants. Windows are built and scored BLOCK at a time,
    whatever a text's length.
    """
    spark = docs.sparkSession
    training = docs.where(crc_mod(id_column, HELD_OUT) != 0)
    word_counts = cut(_counted(training, text_column))
    ends = training.count()
    sums = word_counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    total = n + 0.1 * (v + 1)
    # Counts that at most HEAD words reach; the steps of the search are a few hundred.
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2("n") * 16)).cast("int")
    room, least = HEAD, None
    for r in sorted(word_counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    top = word_counts.where(F.col("n") >= F.lit(least)).toArrow()
    order = np.argsort(top.column("h").to_numpy())
    logs = np.log10((top.column("n").to_numpy()[order] + 0.1) / total)
    head = spark.sparkContext.broadcast((top.column("h").to_numpy()[order], logs, np.log10(0.1 / total)))
    encoded = cut(_encoded(docs, head, tokenizer, id_column, text_column).withColumn("_r", F.monotonically_increasing_id()))

    rare = encoded.select("_r", F.explode("rare").alias("w")).select("_r", "w.h", "w.times").join(word_counts, "h", "left")
    tail = rare.groupBy("_r").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(total))).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))

    size = _encoder(tokenizer)[1] + 1
    id_counts = _id_counts(encoded, size)
    rank = np.argsort(-id_counts, kind="stable")
    rank = np.concatenate(([size - 1], rank[rank != size - 1]))[:SYMBOLS]
    symbol = np.full(size, SYMBOLS, np.int64)
    symbol[rank] = np.arange(len(rank))
    pairs = _pair_counts(encoded, spark.sparkContext.broadcast(symbol), SYMBOLS + 1)
    counts = spark.sparkContext.broadcast(counts_of(id_counts, pairs, symbol))
    tables = first_tables()
    n_windows = encoded.where(~F.col("held_out")).agg(F.sum(F.ceil(F.length("ids") / (2 * STRIDE)))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(1, (n_windows / ROUNDS / BUCKET) ** 0.5)))
    for i in range(ROUNDS):
        tables = _trained(encoded, counts, tables, i, buckets, size - 1)
    sent = spark.sparkContext.broadcast(tables)

    def run(batches):
        _kept_memory()
        for batch in batches:
            for a, b in slices(batch.column("ids"), 1 << 20):
                part = batch.slice(a, b - a)
                ids, starts, ends = _sequences(part)
                score = text_scores(counts.value, sent.value, ids, starts, ends, size - 1)
                yield pa.record_batch([*(part.column(i) for i in range(6)), pa.array(score), pa.array(ends - starts)], [*part.schema.names[:6], "score", "n_subwords"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = encoded.select("_r", id_column, "held_out", "n_tokens", "base", "known", "ids").mapInArrow(run, f"_r long, `{id_column}` {kind}, held_out boolean, n_tokens long, base double, known long, score double, n_subwords long")
    end_log = float(np.log10(((ends or 0) + 0.1) / total))
    # Written first: else Spark may score again when it plans the join anew.
    joined = cut(scored).join(tail, "_r", "left")
    return joined.select(
        id_column,
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        "score",
        "n_subwords",
    )
