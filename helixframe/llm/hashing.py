"""Words of many texts as arrays of 64-bit hashes, by numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd base and its inverse modulo 2^64, and bytes hashed at once.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64."""
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


_UP, _DOWN = _power(_BASE, _BLOCK), _power(_INVERSE, _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit integers over all bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words of a column of texts, in order.

    hash: of each word; row: the text that it is in; first, count: of each
    text the first word and their number; start, end: in ``raw``, the bytes.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.raw = raw = _LOWER[raw] if lower else raw
        edges = offsets[1:-1]
        begins, finishes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(raw), _BLOCK):  # with a neighbour on each side
            b = min(len(raw), a + _BLOCK)
            solid = np.zeros(b - a + 2, bool)
            low, high = max(0, a - 1), min(len(raw), b + 1)
            solid[low - a + 1 : high - a + 1] = ~_SPACE[raw[low:high]]
            begin, finish = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
            x, y = np.searchsorted(edges, (a, b))
            begin[edges[x:y] - a] = solid[1:-1][edges[x:y] - a]
            x, y = np.searchsorted(edges, (a + 1, b + 1))
            finish[edges[x:y] - 1 - a] = solid[1:-1][edges[x:y] - 1 - a]
            begins.append(np.flatnonzero(begin) + a)
            finishes.append(np.flatnonzero(finish) + a + 1)
        self.start, self.end = np.concatenate(begins), np.concatenate(finishes)
        self.hash = self._hashed(raw)
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def _hashed(self, raw: np.ndarray) -> np.ndarray:
        """The hash of each word, block by block; a word over a block's end is summed from its parts."""
        out = np.zeros(len(self.start), np.uint64)
        for a in range(0, len(raw), _BLOCK):
            part = raw[a : a + _BLOCK]
            x, y = np.searchsorted(self.end, a, "right"), np.searchsorted(self.start, a + len(part))
            if x == y:
                continue
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=total[1:])
            begin, finish = np.maximum(self.start[x:y] - a, 0), np.minimum(self.end[x:y] - a, len(part))
            sums = (total[finish] - total[begin]) * _DOWN[begin]
            if self.start[x] < a:
                sums[:1] *= np.uint64(pow(_BASE, int(a - self.start[x]), 1 << 64))
            out[x:y] += sums
        return mix(out)

    def __len__(self) -> int:
        return len(self.hash)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words; a text with fewer words, but one at least, is one run of all."""
    h, count = words.hash, words.count
    runs = np.where(count >= width, count - width + 1, 0)
    row = np.repeat(np.arange(len(count)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(words.first, runs)
    value = np.zeros(len(at), np.uint64)
    for i in range(width):
        value = mix(value + h[at + i] * np.uint64(2 * i + 3)) if i else h[at] * np.uint64(3)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array([int(mix(np.array([hash_of(h[words.first[i] : words.first[i] + count[i]].tolist())], np.uint64))[0]) for i in short.tolist()], np.uint64)
        row, value = np.concatenate((row, short)), np.concatenate((value, extra))
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    return value, row


def hash_of(values: list[int]) -> int:
    """One 64-bit hash of a short list of them, with its length."""
    out = len(values)
    for v in values:
        out = (out * _BASE + v) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out
