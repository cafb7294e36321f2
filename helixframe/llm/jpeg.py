"""Baseline JPEG as a media column: lossless payloads, Huffman decoding and DC-only thumbnails in numpy.

A payload byte is one quantised coefficient, the format's own unit: the
entropy coding of coefficients loses nothing, while samples would pass a
rounded cosine transform. Sixty-four bytes fill one 8x8 block: byte 0 is the
DC coefficient less 128, the others are AC coefficients plus 1, so that none
is zero and no end-of-block code is needed. Each block is a restart interval,
which a reader may decode on its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices

BLOCK = 64
#: A side of a JPEG has at most 65,535 samples.
MOST_ROWS = 65_535 // 8
#: Files read together hold about so many bytes.
GROUP_BYTES = 2 << 20
#: Blocks coded, and bytes of restart intervals decoded, at once; a large image takes several such pieces.
PIECE_BLOCKS, PIECE_BYTES = 1 << 14, 2 << 20

# Fixed values of the format: zigzag order of a block, and code lengths of the writer's two Huffman tables.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
#: Number of codes of each length from 1 on, then the symbols in order of their codes.
DC_TABLE = ([0, 1, 5, 1, 1, 1], bytes([6, 3, 4, 5, 7, 8, 2, 1, 0]))
AC_TABLE = ([1, 1, 1, 1, 1, 1, 1, 1, 1], bytes([7, 6, 8, 5, 4, 3, 2, 1, 9]))


class BadImage(ValueError):
    """The bytes are not a baseline JPEG that this module reads."""


def _codes(table: tuple[list[int], bytes]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) by the canonical assignment."""
    out, code, at = [], 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out.append((table[1][at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(table: tuple[list[int], bytes]) -> np.ndarray:
    """For each 16 bits the symbol and the length of the code that they begin with, as symbol << 8 | length; 0 where none does."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in _codes(table):
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = symbol << 8 | length
    return out


def _words(table: tuple[list[int], bytes], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Code with amplitude bits, and its length, for each value from ``low`` to ``high``."""
    by_symbol = {s: (c, n) for s, c, n in _codes(table)}
    words, sizes = [], []
    for value in range(low, high + 1):
        size = abs(value).bit_length()
        code, length = by_symbol[size]
        amplitude = value if value >= 0 else value + (1 << size) - 1
        words.append(code << size | amplitude)
        sizes.append(length + size)
    return np.array(words, np.uint64), np.array(sizes, np.int64)


_DC_WORDS, _DC_SIZES = _words(DC_TABLE, -128, 127)
_AC_WORDS, _AC_SIZES = _words(AC_TABLE, 1, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(blocks: int) -> tuple[int, int]:
    """Blocks in a row and rows, of which the last may be part filler."""
    across = max(min(8, blocks), -(-blocks // MOST_ROWS))
    return across, -(-blocks // across)


def _head(blocks: int, filled: int, across: int, down: int) -> bytes:
    table = lambda kind, t: bytes([kind]) + bytes(t[0] + [0] * (16 - len(t[0]))) + t[1]
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, struct.pack(">Q", blocks)),
            _segment(0xDB, bytes([0, 8] + [1] * 63)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)),
            _segment(0xC4, table(0x00, DC_TABLE) + table(0x10, AC_TABLE)),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def _coded(grid: np.ndarray, sizes_of: list[int], number: np.ndarray, inner: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of pieces of so many blocks each.

    ``number`` is a block's place in its image; a restart marker follows each
    ``inner`` block, and there is none after an image's last.
    """
    count = len(grid)
    # One word more than coefficients: ones up to the next whole byte.
    words, sizes = np.empty((count, BLOCK + 1), np.uint64), np.empty((count, BLOCK + 1), np.int64)
    words[:, 0], sizes[:, 0] = _DC_WORDS[grid[:, 0]], _DC_SIZES[grid[:, 0]]
    words[:, 1:BLOCK], sizes[:, 1:BLOCK] = _AC_WORDS[grid[:, 1:]], _AC_SIZES[grid[:, 1:]]
    sizes[:, BLOCK] = -sizes[:, :BLOCK].sum(1) % 8
    words[:, BLOCK] = (1 << sizes[:, BLOCK]) - 1
    words, sizes = words.ravel(), sizes.ravel()
    ends = np.cumsum(sizes)
    at = ends - sizes
    shifted = words << (64 - (at & 31) - sizes).astype(np.uint64)
    cell, n_cells = at >> 5, int(ends[-1] >> 5) + 2
    # Words do not overlap, so the sums are bitwise unions; below 2^53 they are exact.
    packed = np.bincount(cell, (shifted >> np.uint64(32)).astype(np.float64), n_cells) + np.bincount(cell + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n_cells)
    coded = packed.astype(np.uint32).astype(">u4").view(np.uint8)[: ends[-1] // 8]
    # A zero byte follows each 0xFF, then a marker if the block is inner.
    block_ends = ends[BLOCK :: BLOCK + 1] // 8
    stuffed = np.flatnonzero(coded == 0xFF) + 1
    marks = block_ends[inner]
    spots = np.concatenate((stuffed, np.repeat(marks, 2)))
    fill = np.concatenate((np.zeros(len(stuffed), np.uint8), np.stack((np.full(len(marks), 0xFF, np.uint8), (0xD0 + number[inner] % 8).astype(np.uint8)), 1).ravel()))
    order = np.argsort(spots, kind="stable")
    whole = np.insert(coded, spots[order], fill[order]).tobytes()
    last = block_ends[np.cumsum(sizes_of) - 1]
    bounds = (last + np.searchsorted(stuffed, last, "right") + 2 * np.searchsorted(marks, last, "right")).tolist()
    return [whole[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes, as one grey baseline JPEG; at most PIECE_BLOCKS blocks are coded at once."""
    shapes = [_shape(len(p) // BLOCK) for p in payloads]
    scans: list[list[bytes]] = [[] for _ in payloads]
    todo: list[tuple[int, int, int]] = []  # image, first block, number of blocks

    def flush() -> None:
        raw = b"".join(payloads[i][a * BLOCK : (a + n) * BLOCK].ljust(n * BLOCK, b"\0") for i, a, n in todo)
        number = np.concatenate([np.arange(a, a + n) for _, a, n in todo])
        inner = np.concatenate([np.arange(a, a + n) < shapes[i][0] * shapes[i][1] - 1 for i, a, n in todo])
        for (i, _, _), made in zip(todo, _coded(np.frombuffer(raw, np.uint8).reshape(-1, BLOCK), [n for *_, n in todo], number, inner), strict=True):
            scans[i].append(made)
        todo.clear()

    held = 0
    for i, (across, down) in enumerate(shapes):
        a, filled = 0, across * down
        while a < filled:
            n = min(filled - a, PIECE_BLOCKS - held)
            todo.append((i, a, n))
            a, held = a + n, held + n
            if held == PIECE_BLOCKS:
                flush()
                held = 0
    if todo:
        flush()
    return [b"".join((_head(len(p) // BLOCK, a * d, a, d), *scan, b"\xff\xd9")) for p, (a, d), scan in zip(payloads, shapes, scans, strict=True)]


class Image:
    """What the markers of one file say, and its scan's bytes."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise BadImage("no start of image")
        self.comment, self.interval, self.quant, self.huffman, at = b"", 0, {}, {}, 2
        self.width = self.height = 0
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise BadImage("a marker is missing")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker in (0xC0, 0xC1):
                precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if precision != 8:
                    raise BadImage("not 8-bit samples")
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDA:
                if not self.width or body[0] != len(self.components):
                    raise BadImage("not one interleaved scan")
                self.selected = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.scan = data[at:]
                return
            elif 0xC2 <= marker <= 0xCF:
                raise BadImage("not a baseline frame")

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC step alone is used
            body = body[1 + 64 * (1 + wide) :]

    def _tables(self, body: bytes) -> None:
        while body:
            counts = list(body[1:17])
            n = sum(counts)
            self.huffman[body[0]] = (counts, body[17 : 17 + n])
            body = body[17 + n :]

    def layout(self) -> list[int]:
        """The component of each block of one minimum coded unit."""
        if len(self.components) == 1:
            return [0]
        return [i for i, (_, h, v, _) in enumerate(self.components) for _ in range(h * v)]

    def units(self) -> tuple[int, int]:
        """Minimum coded units across and down."""
        h = 1 if len(self.components) == 1 else max(c[1] for c in self.components)
        v = 1 if len(self.components) == 1 else max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def _unstuffed(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A scan without stuffed zeros and markers, and where its restart intervals begin."""
    raw = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    over = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    stop = int(over[0]) if len(over) else len(raw)
    ff, after = ff[ff < stop], after[ff < stop]
    restart = ff[after != 0]
    gone = np.sort(np.concatenate((ff[after == 0] + 1, restart, restart + 1)))
    return np.delete(raw[:stop], gone), np.concatenate(([0], restart - np.searchsorted(gone, restart)))


def _decode(data: np.ndarray, start: np.ndarray, left: np.ndarray, owner: np.ndarray, dc_of: np.ndarray, ac_of: np.ndarray, width: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Coefficients of all blocks of these restart intervals, which begin at ``start`` and have ``left`` blocks each; one symbol of each at a time."""
    last_byte = len(data)
    data = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    window = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
    out = np.zeros((int(left.sum()), BLOCK), np.int16)
    flat = out.ravel()
    block, left, bit = np.cumsum(left) - left, left.copy(), start.astype(np.int64) * 8
    k, unit = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    live = np.flatnonzero(left > 0)
    while len(live):
        p, kk = bit[live], k[live]
        if p.max() > last_byte * 8:
            raise BadImage("the scan ends early")
        who, slot = owner[live], unit[live]
        dc = kk == 0
        which = np.where(dc, dc_of[who, slot], ac_of[who, slot])
        bits = window[p >> 3] << (p & 7).astype(np.uint64) & np.uint64(0xFFFFFFFFFF)  # 40 bits, of which 33 count at least
        found = lookup[(which << 16) + (bits >> np.uint64(24)).astype(np.int64)].astype(np.int64)
        length, symbol = found & 255, found >> 8
        if not length.all():
            raise BadImage("a code is not in the table")
        size = np.where(dc, symbol, symbol & 15)
        run = np.where(dc, 0, symbol >> 4)
        amplitude = ((bits >> (40 - length - size).astype(np.uint64)).astype(np.int64)) & ((1 << size) - 1)
        value = np.where(size == 0, 0, np.where(amplitude < (1 << size >> 1), amplitude - (1 << size) + 1, amplitude))
        to = kk + run
        stop = ~dc & (size == 0) & (run < 15)
        put = (size > 0) & (to < BLOCK)
        flat[(block[live] * BLOCK + to)[put]] = value[put]
        bit[live] = p + length + size
        k_next = np.where(stop, BLOCK, to + 1)
        ended = k_next >= BLOCK
        k[live] = np.where(ended, 0, k_next)
        if ended.any():
            done = live[ended]
            block[done] += 1
            left[done] -= 1
            unit[done] = (unit[done] + 1) % width[done]
            live = live[left[live] > 0]
    return out


def decode_coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and component its blocks of 64 quantised coefficients, in zigzag order as coded.

    Restart intervals of all images are decoded in step, PIECE_BYTES of them
    at once; a file without restart markers is one long interval.
    """
    tables: dict = {}
    lookups: list[np.ndarray] = []

    def number(t) -> int:
        key = (tuple(t[0]), bytes(t[1]))
        if key not in tables:
            tables[key] = len(lookups)
            lookups.append(_lookup(t))
        return tables[key]

    layouts = [im.layout() for im in images]
    most = max(map(len, layouts))
    dc_of, ac_of, cycle = (np.zeros((len(images), most), np.int64) for _ in range(3))
    streams, starts, owner, blocks, base = [], [], [], [], 0
    for i, (im, layout) in enumerate(zip(images, layouts, strict=True)):
        for j, c in enumerate(layout):
            dc_of[i, j], ac_of[i, j], cycle[i, j] = number(im.huffman[im.selected[c][0]]), number(im.huffman[16 + im.selected[c][1]]), c
        data, begin = _unstuffed(im.scan)
        across, down = im.units()
        units = across * down
        step = im.interval or units
        sizes = np.minimum(step, units - np.arange(0, units, step)) * len(layout)
        if len(sizes) > len(begin):
            raise BadImage("restart intervals are missing")
        streams.append(data)
        starts.append(begin[: len(sizes)] + base)
        owner.append(np.full(len(sizes), i))
        blocks.append(sizes)
        base += len(data)
    data, lookup = streams[0] if len(streams) == 1 else np.concatenate(streams), np.concatenate(lookups)
    owner, blocks, start = (np.concatenate(x) for x in (owner, blocks, starts))
    width = np.array([len(x) for x in layouts])[owner]
    stop = np.append(start[1:], base)
    cuts, parts = [0], []
    while cuts[-1] < len(start):
        a = cuts[-1]
        cuts.append(max(a + 1, int(np.searchsorted(stop, start[a] + PIECE_BYTES, "right"))))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        parts.append(_decode(data[start[a] : stop[b - 1]], start[a:b] - start[a], blocks[a:b], owner[a:b], dc_of, ac_of, width[a:b], lookup))
    out = parts[0] if len(parts) == 1 else np.concatenate(parts)
    parts.clear()
    found, at = [], 0
    for i, (im, layout) in enumerate(zip(images, layouts, strict=True)):
        across, down = im.units()
        n = across * down * len(layout)
        own = out[at : at + n].reshape(across * down, len(layout), BLOCK)
        at += n
        if im.interval:
            reset = np.arange(0, across * down, im.interval)
        else:
            reset = np.zeros(1, np.int64)
        parts = []
        for c in range(len(im.components)):
            coefficients = own[:, [j for j, x in enumerate(layout) if x == c]]
            steps = coefficients[:, :, 0].astype(np.int64)
            sums = np.cumsum(steps.ravel()).reshape(steps.shape)
            before = np.concatenate(([0], sums[:, -1]))[reset]
            sums -= np.repeat(before, np.diff(np.append(reset, len(steps))))[:, None]
            coefficients[:, :, 0] = sums
            parts.append(coefficients)
        found.append(parts)
    return found


def thumbnail(image: Image, luminance: np.ndarray) -> np.ndarray:
    """One sample for each luminance block: its mean, from the DC coefficient alone."""
    across, down = image.units()
    h, v = (1, 1) if len(image.components) == 1 else image.components[0][1:3]
    means = luminance[:, :, 0].astype(np.float64) * image.quant[image.components[0][3]] / 8 + 128
    grid = np.clip(np.rint(means), 0, 255).astype(np.uint8).reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h)
    full_h, full_v = (1, 1) if len(image.components) == 1 else (max(c[1] for c in image.components), max(c[2] for c in image.components))
    return grid[: -(-image.height * v // (8 * full_v)), : -(-image.width * h // (8 * full_h))]


def thumbnail_hash(small: np.ndarray) -> str:
    """64 bits in hexadecimal: which cells of an 8x8 grid of means exceed their median; equal pictures have equal hashes."""
    rows, columns = (np.minimum(np.arange(9) * n // 8, n - 1) for n in small.shape)
    sums = np.zeros((small.shape[0] + 1, small.shape[1] + 1))
    sums[1:, 1:] = np.cumsum(np.cumsum(small, 0, dtype=np.float64), 1)
    low_r, high_r = rows[:-1], np.maximum(rows[:-1] + 1, np.arange(1, 9) * small.shape[0] // 8)
    low_c, high_c = columns[:-1], np.maximum(columns[:-1] + 1, np.arange(1, 9) * small.shape[1] // 8)
    area = sums[np.ix_(high_r, high_c)] - sums[np.ix_(low_r, high_c)] - sums[np.ix_(high_r, low_c)] + sums[np.ix_(low_r, low_c)]
    means = area / np.outer(high_r - low_r, high_c - low_c)
    return np.packbits(means > np.median(means)).tobytes().hex()


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_payloads stored."""
    blocks = int.from_bytes(image.comment, "big")
    grid = coefficients[:blocks, 0].copy()
    grid[:, 0] += 128
    grid[:, 1:] -= 1
    return grid.astype(np.uint8).tobytes()


def media_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media) with each whole text stored as a baseline JPEG.

    A null text counts as empty; the empty text is one block of zeros. Ids may
    be null or repeat; further columns are not read.
    """

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        padded = [t + bytes(max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t)) for t in texts]
        return pa.record_batch([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_payloads(padded), pa.binary())], [id_column, "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_texts(docs, [id_column], text_column, make, f"`{id_column}` {kind}, n_bytes long, media binary", GROUP_BYTES)


def media_features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What the stored bytes hold, read back through markers and Huffman codes.

    Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    width, height and feature (dimensions, then the hash of the DC-only
    luminance thumbnail). ``media`` has id, n_bytes and media, as
    media_column() returns them; media is never null there. Null and repeated
    ids stay rows of their own, equal files have equal values, and an empty
    table gives no rows.
    """

    def run(batches):
        names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
        for batch in batches:
            for a, b in slices(batch.column("media"), GROUP_BYTES):
                part = batch.slice(a, b - a)
                files = part.column("media").to_pylist()
                images = [Image(f) for f in files]
                found = []
                for data, im, parts in zip(files, images, decode_coefficients(images), strict=True):
                    payload = payload_of(im, parts[0])
                    feature = f"{im.width}x{im.height}:{thumbnail_hash(thumbnail(im, parts[0]))}"
                    found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, im.width, im.height))
                columns = list(zip(*found, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "n_bytes", "media").mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def decode_media(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, text) as stored; the round trip's other half. A null text comes back empty; ids may be null or repeat."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("media"), GROUP_BYTES):
                part = batch.slice(a, b - a)
                images = [Image(f) for f in part.column("media").to_pylist()]
                texts = [payload_of(im, c[0])[:n].decode() for im, c, n in zip(images, decode_coefficients(images), part.column("n_bytes").to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(F.col(id_column), "n_bytes", "media").mapInArrow(run, f"`{id_column}` {kind}, text string")
