"""Column functions on names, labels, numbers and nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(s: Column) -> Column:
    """Upper case of a-z alone; other letters' case differs between engines."""
    return F.translate(s, LOWER, UPPER)


def to_rna(s: Column) -> Column:
    """T becomes U; the case stays."""
    return F.translate(s, "Tt", "Uu")


def masked(s: Column) -> Column:
    """Whatever is not A, C, G or U becomes N."""
    return F.regexp_replace(s, "[^ACGU]", "N")


def cleaned(s: Column) -> Column:
    """A raw sequence: upper case, RNA letters, no white space, ambiguous letters as N."""
    return masked(to_rna(ascii_upper(F.regexp_replace(s, r"\s", ""))))


def aligned(s: Column) -> Column:
    """An alignment row: RNA letters in upper case, gaps as dots, the rest as N."""
    return F.regexp_replace(F.translate(to_rna(ascii_upper(s)), "-", "."), "[^ACGU.]", "N")


def ungapped(s: Column) -> Column:
    return F.translate(s, ".", "")


def share_of(s: Column, letters: str) -> Column:
    """The share of a sequence's letters that are among these; 0 for the empty one."""
    rest = F.length(F.translate(s, letters, ""))
    return F.when(F.length(s) > 0, (F.length(s) - rest) / F.length(s)).otherwise(0.0)


def context(s: Column, position: Column, window: int) -> Column:
    """``before[X]after`` around a 0-based position, both sides padded to ``window``; null outside the sequence."""
    before = F.lpad(F.when(position > 0, F.substring(s, F.greatest(position - window, F.lit(0)) + 1, F.least(position, F.lit(window)))).otherwise(""), window, " ")
    after = F.rpad(F.substring(s, position + 2, F.lit(window)), window, " ")
    return F.when((position >= 0) & (position < F.length(s)), F.concat(before, F.lit("["), F.substring(s, position + 1, F.lit(1)), F.lit("]"), after))


def family_stem(name: Column, fallback: Column) -> Column:
    """A name without its copy number, as of SNORD115-12; ``fallback`` for a blank one."""
    trimmed = F.trim(name)
    return F.coalesce(F.nullif(F.regexp_replace(trimmed, r"[-_]\d+[A-Za-z]?$", ""), F.lit("")), fallback)


def has_prefix(name: Column, prefixes: list[str]) -> Column:
    """Whether the name begins with one of these, whatever the case; longer names of the same beginning match too."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(ascii_upper(name), F.lit(p.upper()))
    return F.coalesce(found, F.lit(False))


def nonempty(v: Column) -> Column:
    """Neither null nor blank nor the text nan."""
    t = F.trim(F.coalesce(v, F.lit("")))
    return (t != "") & (F.lower(t) != "nan")


def number(v: Column) -> Column:
    """The number that a text holds; null for none and for nan."""
    x = v.try_cast("double")
    return F.when(~F.isnan(x), x)


def first_keyword(text: Column, cases: list[tuple[str, str]], default: Column) -> Column:
    """The label of the first keyword, in this order, that the lower-cased text holds."""
    low = F.translate(text, UPPER, LOWER)
    out = F.lit(None).cast("string")
    for word, label in reversed(cases):
        out = F.when(F.contains(low, F.lit(word)), F.lit(label)).otherwise(F.coalesce(out, default) if word == cases[-1][0] else out)
    return out


#: RNA classes by the first keyword in a family's type.
CLASS_WORDS = ["snorna", "riboswitch", "rrna", "trna", "mirna", "snrna", "ribozyme", "lncrna", "crispr", "thermoregulator", "frameshift", "ires", "leader", "srp", "rnase p", "telomerase", "antisense", "srna"]
#: Kinds of RNA by the first phrase in a description.
KIND_WORDS = [
    ("small nucleolar", "snoRNA"), ("snorna", "snoRNA"), ("spliceosomal", "snRNA"), ("snrna", "snRNA"), (" u1 ", "snRNA"), (" u2 ", "snRNA"), (" u4 ", "snRNA"), (" u5 ", "snRNA"), (" u6 ", "snRNA"),
    ("transfer rna", "tRNA"), ("trna", "tRNA"), ("ribosomal", "rRNA"), ("rrna", "rRNA"), ("srp", "SRP_RNA"), ("signal recognition", "SRP_RNA"), ("rnase p", "RNase_P"), ("ribonuclease p", "RNase_P"),
]
#: Names of C/D families known to do other work.
KNOWN_FAMILIES = ["U3", "U8", "U13", "U14", "U17", "U22", "SNORD3", "SNORD118", "SNORD13"]
KNOWN_FAMILIES_WIDE = [*KNOWN_FAMILIES, "SNORD115", "SNORD116", "SNORD97", "SNORD113", "SNORD114"]


def rna_kind(description: Column) -> Column:
    return first_keyword(description, KIND_WORDS, F.lit("ncRNA"))


def family_class(kind: Column) -> Column:
    """A family's class by its type: a keyword, else cis-reg, gene-other, or the type's first field."""
    field = F.nullif(F.translate(F.trim(F.split_part(kind, F.lit(";"), F.lit(1))), UPPER, LOWER), F.lit(""))
    cases = [(w, w) for w in CLASS_WORDS] + [("cis-reg", "cis-reg"), ("gene", "gene-other")]
    return F.coalesce(first_keyword(kind, cases, field), F.lit("unknown"))


def variant_position(hgvs: Column) -> Column:
    """The first position of an ``n.`` or ``m.`` name, or null."""
    return F.regexp_extract(hgvs, r"[nm]\.(-?\d+)", 1).try_cast("bigint")


def variant_change(hgvs: Column) -> Column:
    """(pos, ref, alt) of a substitution, all null where there is none."""
    pattern = r"[nm]\.(\d+)([ACGT])>([ACGT])"
    part = lambda i: F.nullif(F.regexp_extract(hgvs, pattern, i), F.lit(""))
    return F.struct(part(1).try_cast("bigint").alias("pos"), part(2).alias("ref"), part(3).alias("alt"))


def best_match(s: Column, consensus: str, region: Column) -> Column:
    """The largest share of a consensus that matches at any place of ``region``; R stands for A or G.

    A region shorter than the consensus gives way to the whole sequence, and a
    sequence shorter than it gives 0.
    """
    n = len(consensus)
    where = F.when(F.length(region) < n, s).otherwise(region)
    hits = lambda i: sum((F.when(F.substring(where, i + k, F.lit(1)).isin(*("AG" if c == "R" else c)), 1).otherwise(0) for k, c in enumerate(consensus)), F.lit(0))
    places = F.when(F.length(where) >= n, F.transform(F.sequence(F.lit(1), F.length(where) - n + 1), hits)).otherwise(F.array(F.lit(0)))
    return F.array_max(places) / n


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def window_starts(length: Column, width: int = 200, step: int = 100, least: int = 50) -> Column:
    """0-based starts of sliding windows that hold at least ``least`` letters."""
    return F.when(length >= least, F.sequence(F.lit(0), length - least, F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(blocks: Column, starts: Column) -> Column:
    """(start, w) of each sliding window of two blocks, which are a sequence cut at every step (pieces()); both are plain columns."""
    return F.transform(starts, lambda x, i: F.struct(x.cast("bigint").alias("start"), F.concat(F.get(blocks, i), F.coalesce(F.get(blocks, i + 1), F.lit(""))).alias("w")))


def pieces(s: Column, size: int) -> Column:
    """A sequence cut into pieces of this size, the last of which may be shorter, in one pass."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def parsed_position(value: Column, hgvs: Column) -> Column:
    """A variant's position: the number in its own column, half to even, else that in its name."""
    named = F.regexp_extract(hgvs, r"(?i)[nm]\.(-?\d+)", 1).try_cast("bigint")
    return F.coalesce(F.bround(number(value)).cast("bigint"), named)


def header_flags(header: Column, root: str, seq: Column, expected: Column, most: int = 510, letters: str = "ACGUN") -> dict[str, Column]:
    """Checks of a fetched record: its header names the gene, its length is as expected, it fits the model, its letters are known."""
    return {
        "named": F.contains(ascii_upper(header), F.lit(root.upper())),
        "length_ok": F.abs(F.length(seq) - expected) <= 5,
        "too_long": F.length(seq) > most,
        "letters_ok": F.length(F.translate(seq, letters, "")) == 0,
    }


def relative_drop(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0.0)) / F.greatest(before, F.lit(1e-6))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def marker_mean(vector: Column | str, places: list[int]) -> Column:
    """The mean of a vector's components at these places, from 0; null if it has none of them."""
    chosen = F.filter(F.transform(F.lit(places), lambda i: F.get(vector, i).cast("double")), lambda x: x.isNotNull())
    return F.aggregate(chosen, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(chosen), F.lit(0))


def warmup_cosine(step: Column, peak: Column, warmup: Column, total: Column) -> Column:
    """A learning rate that rises in proportion and falls along a cosine to a tenth."""
    progress = (step - warmup) / F.greatest(total - warmup, F.lit(1))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(peak * (0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * progress))))
