"""Token ids and counts of a byte-level BPE, exact for whole texts.

The pre-tokenizer never lets a token cross from a word into the white space
before it (but for one blank), so a text can be cut into runs of white space
and words, and equal runs have equal ids wherever they stand. Each Python
worker therefore encodes a run once and looks it up afterwards; its table is
bounded, and runs beyond it are encoded each time they occur.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_texts

TABLE_ENTRIES = 400_000
#: Of a run this long no copy is kept.
LONGEST_KEPT = 64
#: One blank and a word, or white space as the pre-tokenizer divides it.
_RUN = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: White space of which regular-expression engines hold different views, and the special token: the parts of a text with them are divided by the library.
_ODD = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_SPECIAL = "<|endoftext|>"
_WHOLE = re.compile(f"[{_ODD}]|{re.escape(_SPECIAL)}")
#: No pre-token and no special token crosses from such a character to ordinary white space after it.
_CUT = re.compile(rf"(?<=[^\s{_ODD}])(?=[\x20\t\n\r\f\v])")


def runs_of(text: str) -> list[str]:
    """A text's runs of white space and words; a stretch with odd white space or the special token, between ordinary white space, is one run."""
    if not _WHOLE.search(text):
        return _RUN.findall(text)
    return [r for part in _CUT.split(text) for r in ([part] if _WHOLE.search(part) else _RUN.findall(part))]


class RunTable:
    """Looks up what ``encode`` makes of each run of a text."""

    def __init__(self, encode, entries: int = TABLE_ENTRIES):
        self.encode, self.entries, self.known = encode, entries, {}

    def of(self, texts: list[str]) -> list[list]:
        """For each text its runs' values, in order."""
        runs = [runs_of(t) for t in texts]
        get = self.known.get
        values = [list(map(get, r)) for r in runs]
        if missing := {r for own, got in zip(runs, values, strict=True) if None in got for r, v in zip(own, got, strict=True) if v is None}:
            order = list(missing)
            fresh = dict(zip(order, self.encode(order), strict=True))
            for own, got in zip(runs, values, strict=True):
                if None in got:
                    got[:] = [fresh[r] if v is None else v for r, v in zip(own, got, strict=True)]
            if room := max(0, self.entries - len(self.known)):
                short = [r for r in order if len(r) <= LONGEST_KEPT][:room]
                self.known.update((r, fresh[r]) for r in short)
        return values


_loaded: dict[tuple[str, str], object] = {}


class Merger:
    """Ids of a run. The rank file of the same vocabulary serves ordinary runs,
    as its merges start without building alignments; the library itself encodes
    texts that hold the special token or unusual white space."""

    def __init__(self, name: str):
        import public_tokenizers as files
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pattern = files.PATTERN
        self.library = Tokenizer.from_file(files.path(name))
        with open(files.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        core = tiktoken.Encoding("runs", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.array = core.encode_ordinary, core.encode_to_numpy

    def of_text(self, text: str) -> np.ndarray:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if _WHOLE.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.array(text, disallowed_special=()).astype("<u4", copy=False)

    def count(self, run: str) -> int:
        """Number of a run's tokens, all by merges."""
        return len(self.library.encode(run, add_special_tokens=False).ids if _WHOLE.search(run) else self.ordinary(run))

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a stretch without the special token, as the library divides it."""
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


def merger(name: str) -> Merger:
    if ("merger", name) not in _loaded:
        _loaded["merger", name] = Merger(name)
    return _loaded["merger", name]


# -- token counts by the whole-token shortcut


def proven_whole(name: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token.

    Merge order decides this, not membership of the vocabulary: a listed
    string whose merges never meet encodes as several tokens. Every entry is
    therefore encoded once by the library, before any text is counted.
    """
    import regex

    library, pattern = merger(name).library, regex.compile(merger(name).pattern)
    strings = library.decode_batch([[i] for i in range(library.get_vocab_size(with_added_tokens=False))])
    single = [s for s in strings if s and "\ufffd" not in s and (m := pattern.match(s)) and m.end() == len(s)]
    return frozenset(s for s, e in zip(single, library.encode_batch_fast(single, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def count_table(name: str, whole: frozenset[str] | None = None) -> RunTable:
    """Runs to their number of tokens: one for each proven pre-token and each special token, merges for the others."""
    if ("counts", name) not in _loaded:
        import regex

        own, merged, divided, pretokens = whole or proven_whole(name), merger(name).count, merger(name).pretokens, regex.compile(merger(name).pattern).findall

        def count(run: str) -> int:
            if run in own:
                return 1
            if _WHOLE.search(run):
                parts = run.split(_SPECIAL)
                return len(parts) - 1 + sum(1 if p in own else merged(p) for part in parts for p in divided(part))
            return sum(1 if p in own else merged(p) for p in pretokens(run))

        _loaded["counts", name] = RunTable(lambda runs: list(map(count, runs)))
    return _loaded["counts", name]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The number of tokens of every whole text, by the whole-token shortcut.

    Pre-tokens proven to be one token count as one; only the others are
    merged. Returns id, n_bytes, n_tokens and over_limit (more than ``limit``).
    A null or empty text has no tokens; repeated rows and null ids stay rows
    of their own; further columns are not read. Texts of any length are
    counted whole, a slice of rows at a time. The shortcut serves all of a
    text: where odd white space or the special token stands, the library
    divides the stretch around it. What it proves, once, goes to every task: a
    set no larger than the vocabulary.
    """
    proven = docs.sparkSession.sparkContext.broadcast(proven_whole(tokenizer))

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("text")
        n = [sum(v) for v in count_table(tokenizer, proven.value).of(texts.to_pylist())]
        sizes = pc.binary_length(texts).cast(pa.int64())
        return pa.record_batch([rows.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_texts(docs, [id_column], text_column, make, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
