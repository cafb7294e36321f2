"""SentencePiece segmentations varied by seeded merge-dropout, and their decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import map_texts
from .hashing import mix

#: Share of candidate merges that are skipped.
DROPOUT = 0.1
SEED = 20_240_601
#: Runs of so many characters at most are merged in step, longer ones by themselves with a heap.
LONGEST = 64
#: Runs merged in step at once, and characters of a text looked at together.
TOGETHER, SEGMENT = 1 << 16, 1 << 20
#: Slots of the table of pairs, as a power of two.
SLOT_BITS = 20

SPACE = "▁"
_STUCK = np.int32(2**31 - 1)
_FULL = (1 << 64) - 1
#: No pair's key, not even of a code and nothing after it.
_FREE = np.int64(-(1 << 62))
_FROM, _TO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mixed(x: int) -> int:
    """hashing.mix() of one number."""
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _FULL
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _FULL
    return x ^ x >> 33


class Pieces:
    """A merge-type model with byte fallback: its pieces, their ranks, and how runs are cut into them."""

    def __init__(self, name: str, dropout: float = DROPOUT, seed: int = SEED):
        import public_tokenizers as files
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=files.path(name))
        size = m.vocab_size()
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(size) if m.is_byte(i)}
        own = {i: m.id_to_piece(i) for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.id = {p: i for i, p in own.items()}
        #: A piece's code is its place by score; rank says which merge comes first, and is equal where scores are.
        order = sorted(own, key=lambda i: -m.get_score(i))
        self.score = {own[i]: k for k, i in enumerate(order)}
        scores = np.array([-m.get_score(i) for i in order])
        self.rank = np.searchsorted(np.unique(scores), scores).astype(np.int32)
        #: No piece spans the end of a word, so runs of blanks and a word can be cut on their own.
        if len(self.byte) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("the model lacks byte fallback, or has pieces that span words")
        spelled = [own[i].replace(SPACE, " ").encode() if i in own else b"" for i in range(size)]
        for value, i in self.byte.items():
            spelled[i] = bytes([value])
        self.spelled = spelled
        self.dropout, self.seed = int(dropout * (1 << 32)), seed
        #: Codes of characters: those of pieces, others above all pieces' codes.
        self.known = len(order)
        self.base = self.known + 0x110000
        self.char = np.arange(0x110000, dtype=np.int64) + self.known
        for p, k in self.score.items():
            if len(p) == 1:
                self.char[ord(p)] = k
        self.id_of = np.array(order, np.uint32)
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """A table of open addresses: a pair of codes to the code of the piece that they make."""
        code = lambda p: int(self.char[ord(p)]) if len(p) == 1 else self.score.get(p)
        found = {}
        for p, k in self.score.items():
            for cut in range(1, len(p)):
                a, b = code(p[:cut]), code(p[cut:])
                if a is not None and b is not None:
                    found[a * self.base + b] = k
        self.slot_key, self.slot_code = np.full(1 << SLOT_BITS, _FREE), np.zeros(1 << SLOT_BITS, np.int32)
        for key, k in found.items():
            slot = (key * _FROM & _FULL) >> 64 - SLOT_BITS
            while self.slot_key[slot] >= 0:
                slot = slot + 1 & (1 << SLOT_BITS) - 1
            self.slot_key[slot], self.slot_code[slot] = key, k

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The code of the piece that each pair makes, -1 where it makes none. ``right`` is -1 where nothing follows."""
        key = left * self.base + right
        slot = (key.view(np.uint64) * np.uint64(_FROM) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.slot_key[slot]
        code = np.where(held == key, self.slot_code[slot], -1)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & (1 << SLOT_BITS) - 1
            held = self.slot_key[slot[todo]]
            hit = held == key[todo]
            code[todo[hit]] = self.slot_code[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return code

    def _candidates(self, code: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Agenda entries: rank << 6 | place, so that the least is the best and then the leftmost; _STUCK for no merge."""
        return np.where(code >= 0, self.rank[code] << 6 | place, _STUCK).astype(np.int32)

    def _bytes(self, symbol: str) -> list[int]:
        return [self.byte[b] for b in symbol.encode()]

    def segment(self, run: str, key: int) -> list[int]:
        """Codes of one run's pieces, by an agenda of candidate merges: best score first, then leftmost.

        A candidate that comes up is skipped for good if the hash of the
        occurrence's key and the candidate's ends is below the dropout; a
        merge beside it puts new candidates on the agenda.
        """
        return [self.score.get(s, self.known + ord(s[0])) for s in self._merged_long(run, key)]

    def _in_step(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes left of each run, joined, and their numbers: segment()'s agenda for many runs, one candidate of each at a time.

        A column is a run, a row a place in it. A symbol stands at its first
        place, and after[] and before[] lead to its neighbours.
        """
        n, most = len(start), int(length.max())
        place = np.arange(most)[:, None]
        alive = place < length
        symbol = np.full((most + 1, n), -1, np.int64)
        symbol[:most][alive] = codes[(start + place)[alive]]
        agenda, made = np.full((most, n), _STUCK, np.int32), np.full((most, n), -1, np.int32)
        for i in range(most - 1):
            made[i] = self._merged(symbol[i], symbol[i + 1])
            agenda[i] = self._candidates(made[i], i)
        agenda[~alive] = _STUCK
        after, before = (np.repeat(np.arange(a, a + most + 1, dtype=np.int8)[:, None], n, 1) for a in (1, -1))
        todo = np.arange(n)
        while len(todo):
            best = agenda[:, todo].min(0)
            live = best < _STUCK
            todo, best = todo[live], best[live]
            k, at = best & 63, todo
            middle = after[k, at].astype(np.int64)
            to = after[middle, at].astype(np.int64)
            if self.dropout:
                drawn = mix(key[at] ^ (k.astype(np.uint64) * np.uint64(_FROM) + to.astype(np.uint64) * np.uint64(_TO))) >> np.uint64(32)
                skipped = drawn < np.uint64(self.dropout)
                agenda[k[skipped], at[skipped]] = _STUCK
                taken = ~skipped
                at, k, middle, to = at[taken], k[taken], middle[taken], to[taken]
            code = made[k, at].astype(np.int64)
            symbol[k, at] = code
            alive[middle, at] = False
            agenda[middle, at] = _STUCK
            after[k, at], before[to, at] = to, k
            found = self._merged(code, symbol[to, at])
            made[k, at], agenda[k, at] = found, self._candidates(found, k)
            left = before[k, at].astype(np.int64)
            some = np.flatnonzero(left >= 0)
            left, own = left[some], at[some]
            found = self._merged(symbol[left, own], code[some])
            made[left, own], agenda[left, own] = found, self._candidates(found, left)
        return symbol[:most].T[alive.T], alive.sum(0)

    def _merged_long(self, run: str, key: int) -> list[str]:
        rank_of = lambda p: None if (k := self.score.get(p)) is None else self.rank[k]
        symbols = list(run)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] + symbols[i + 1])
            if rank is not None:
                agenda.append((rank, i, i + 2))
        if agenda:
            heapq.heapify(agenda)
            pop, push, limit = heapq.heappop, heapq.heappush, self.dropout
            # Of the symbol that begins at i, end[i]; of the one that ends at i, start[i]. Merged ones' inner places keep old values.
            end, start = list(range(1, n + 1)), list(range(-1, n))
            while agenda:
                _, i, to = pop(agenda)
                j = end[i]
                if symbols[i] is None or j >= n or end[j] != to or symbols[j] is None:
                    continue  # one of its parts has been merged meanwhile
                if limit and _mixed(key ^ (i * _FROM + to * _TO & _FULL)) >> 32 < limit:
                    continue
                merged = symbols[i] = symbols[i] + symbols[j]
                symbols[j] = None
                end[i], start[to] = to, i
                if to < n:
                    rank = rank_of(merged + symbols[to])
                    if rank is not None:
                        push(agenda, (rank, i, end[to]))
                if i:
                    left = start[i]
                    rank = rank_of(symbols[left] + merged)
                    if rank is not None:
                        push(agenda, (rank, left, to))
        return [s for s in symbols if s is not None]

    def _parts(self, text: str) -> list[str]:
        """A text in parts of about SEGMENT characters, cut before blanks that follow a word, so that runs stay whole."""
        parts, a = [], 0
        while len(text) - a > SEGMENT:
            e = text.rfind(" ", a + 1, a + SEGMENT)
            while e > a and text[e - 1] in (" ", SPACE):
                e -= 1
            if e <= a:
                break
            parts.append(text[a:e])
            a = e
        return [*parts, text[a:]]

    def _encode_parts(self, bodies: list[np.ndarray], owns: list[int], firsts: list[int]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of parts of texts whose runs are numbered from ``firsts``, and the numbers after their last runs.

        A run is blanks and the word after them. The blank's own sign in a text
        is a run that goes to bytes, so that it stays itself.
        """
        sizes = np.array([len(b) for b in bodies])
        edge = np.cumsum(sizes) - sizes
        body = np.concatenate(bodies)
        sign, blank = body == ord(SPACE), body == 0x20
        begin = sign.copy()
        begin[1:] |= sign[:-1] | (blank[1:] & ~blank[:-1])
        begin[edge] = True
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, len(body)))
        bound = np.searchsorted(start, np.append(edge, len(body)))
        runs = np.diff(bound)
        codes = self.char[np.where(blank, ord(SPACE), body)]
        number = np.arange(len(start)) - np.repeat(bound[:-1] - np.array(firsts), runs)
        key = mix(number.astype(np.uint64) * np.uint64(_FROM) + np.repeat(np.array(owns, np.uint64), runs))
        counts, odd = np.ones(len(start), np.int64), sign[start]
        done = [(np.flatnonzero(odd), np.full(int(odd.sum()), self.known + ord(SPACE)))]
        usual = np.flatnonzero((length <= LONGEST) & ~odd)
        usual = usual[np.argsort(length[usual], kind="stable")]
        for a in range(0, len(usual), TOGETHER):  # by length, so that columns have little filler
            group = usual[a : a + TOGETHER]
            for part in np.split(group, np.flatnonzero(np.diff(-(-length[group] // 4))) + 1):
                left, counts[part] = self._in_step(codes, start[part], length[part], key[part])
                done.append((part, left))
        long = np.flatnonzero((length > LONGEST) & ~odd)
        for i in long.tolist():
            run = body[start[i] : start[i] + length[i]].tobytes().decode("utf-32-le").replace(" ", SPACE)
            left = self.segment(run, int(key[i]))
            counts[i] = len(left)
            done.append((np.array([i]), np.array(left)))
        offset = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for group, left in done:
            n = counts[group]
            flat[np.repeat(offset[group] - (np.cumsum(n) - n), n) + np.arange(len(left))] = left
        ends = np.append(offset, len(flat))[bound[1:]]
        # Characters that are no piece go to bytes.
        strange = np.flatnonzero(flat >= self.known)
        ids = self.id_of[np.where(flat < self.known, flat, 0)]
        if len(strange):
            spelt = [self._bytes(chr(c - self.known)) for c in flat[strange].tolist()]
            width = np.ones(len(flat), np.int64)
            width[strange] = [len(x) for x in spelt]
            upto = np.cumsum(width)
            ids = np.repeat(ids, width)
            at = np.repeat((upto - width)[strange], width[strange])
            w = width[strange]
            ids[at + np.arange(len(at)) - np.repeat(np.cumsum(w) - w, w)] = [b for x in spelt for b in x]
            ends = np.append(0, upto)[ends]
        return np.split(ids, ends[:-1]), (np.array(firsts) + runs).tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a long text goes part by part."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        parts = {i: self._parts(texts[i]) for i in some}
        owns = {i: xxhash.xxh64_intdigest(texts[i].encode(), self.seed) for i in some}
        todo, first, made = some, dict.fromkeys(some, 0), {i: [] for i in some}
        while todo:
            bodies = [np.frombuffer(((" " if not made[i] else "") + parts[i][len(made[i])]).encode("utf-32-le"), np.uint32) for i in todo]
            ids, after = self._encode_parts(bodies, [owns[i] for i in todo], [first[i] for i in todo])
            for i, x, n in zip(todo, ids, after, strict=True):
                made[i].append(x)
                first[i] = n
            todo = [i for i in todo if len(made[i]) < len(parts[i])]
        for i in some:
            out[i] = np.concatenate(made[i])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation, whatever merges were dropped."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids.tolist()])[1:].decode() if len(ids) else ""


_loaded: dict[tuple, Pieces] = {}


def pieces(name: str, dropout: float, seed: int) -> Pieces:
    key = (name, dropout, seed)
    if key not in _loaded:
        _loaded[key] = Pieces(*key)
    return _loaded[key]


def encode_texts(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = DROPOUT, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, ids) of every whole text under merge-dropout.

    The same seed, text and model give the same ids wherever they are
    computed; another seed gives another segmentation. With ``dropout`` 0 the
    ids are the library's own. A null text counts as empty and has no ids.
    """

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        p, texts = pieces(model, dropout, seed), rows.column("text")
        ids = p.encode_all(texts.to_pylist())
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
        return pa.record_batch([rows.column(0), pc.binary_length(texts).cast(pa.int64()), lists], [id_column, "n_bytes", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_texts(docs, [id_column], text_column, make, f"`{id_column}` {kind}, n_bytes long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_column: str = "doc_id") -> DataFrame:
    """(id, text) of encode_texts()'s rows; null ids give a null text."""

    def run(batches):
        p = pieces(model, 0.0, 0)
        for batch in batches:
            lists = batch.column("ids")
            texts = [None if not x.is_valid else p.decode(x.values.to_numpy()) for x in lists]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = DROPOUT, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of every text's ids and of the text decoded from them.

    Returns id, n_bytes, n_pieces, ids_crc32 (little-endian unsigned 32-bit
    ids), decoded_crc32 (UTF-8) and lossless. Null and empty texts have no
    pieces; repeated rows stay; further columns are not read. Long texts are
    segmented run by run, so memory follows a slice of rows.
    """

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        p, found = pieces(model, dropout, seed), []
        texts = rows.column("text").to_pylist()
        for text, ids in zip(texts, p.encode_all(texts), strict=True):
            back = p.decode(ids)
            found.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode()), back == text))
        columns = zip(*found, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.record_batch([rows.column(0), pc.binary_length(rows.column("text")).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_column, "n_bytes", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_texts(docs, [id_column], text_column, make, f"`{id_column}` {kind}, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")
