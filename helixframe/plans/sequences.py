"""Queries on sequences, names and other text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import entities, features, scoring
from ..sources import fasta, tables
from .common import SEQ, Query, sequences, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def fasta_roundtrip(spark, sf_dir):
    """Documents as FASTA records, wrapped at 70 columns, and parsed again."""
    records = fasta.records(sequences(spark, sf_dir).withColumn("n", F.length("seq").cast("string")), ["doc_id", "lang", "source", "n"], "seq", wrap=70)
    return fasta.parse(records, ["family", "family_name", "length"]).select(F.col("name").cast("bigint").alias("doc_id"), "family", "family_name", F.length("sequence").cast("bigint").alias("n"), F.md5("sequence").alias("digest"))


_add("fasta_roundtrip", fasta_roundtrip, f"WITH {SEQ} SELECT doc_id, lang AS family, source AS family_name, length(seq)::BIGINT AS n, md5(seq) AS digest FROM seq")

_add(
    "text_clean",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(S.cleaned(F.col("text"))).alias("rna"), F.md5(S.ungapped(S.aligned(F.col("text")))).alias("ungapped"), F.length(S.masked(F.col("text"))).cast("bigint").alias("n")),
    f"""SELECT doc_id, md5(regexp_replace(translate(translate(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g')) AS rna,
    md5(replace(regexp_replace(translate(translate(text, '{S.LOWER}', '{S.UPPER}'), 'T-', 'U.'), '[^ACGU.]', 'N', 'g'), '.', '')) AS ungapped, length(text)::BIGINT AS n FROM documents""",
)

_add(
    "gc_fraction",
    lambda s, d: sequences(s, d).select("doc_id", F.round(S.share_of(F.col("seq"), "GC"), 6).alias("gc"), F.round(S.share_of(F.col("seq"), "ACGU"), 6).alias("acgu")),
    f"""WITH {SEQ} SELECT doc_id, CASE WHEN length(seq) > 0 THEN round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 6) ELSE 0.0 END AS gc,
    CASE WHEN length(seq) > 0 THEN round((length(seq) - length(translate(seq, 'ACGU', ''))) / length(seq), 6) ELSE 0.0 END AS acgu FROM seq""",
)

_add(
    "context_window",
    lambda s, d: sequences(s, d).select("doc_id", S.context(F.col("seq"), F.floor(F.length("seq") * F.lit(0.5)).cast("int"), 10).alias("middle"), S.context(F.col("seq"), F.lit(3), 10).alias("early"), S.context(F.col("seq"), F.length("seq") - 1, 10).alias("last")),
    f"""WITH {SEQ}, spots AS (SELECT doc_id, seq, unnest([floor(length(seq) * 0.5)::INTEGER, 3, length(seq)::INTEGER - 1]) AS p, unnest([1, 2, 3]) AS k FROM seq),
    c AS (SELECT doc_id, k, CASE WHEN p >= 0 AND p < length(seq) THEN lpad(CASE WHEN p > 0 THEN substr(seq, greatest(p - 10, 0) + 1, least(p, 10)) ELSE '' END, 10, ' ') || '[' || substr(seq, p + 1, 1) || ']' || rpad(substr(seq, p + 2, 10), 10, ' ') END AS c FROM spots)
    SELECT doc_id, max(c) FILTER (k = 1) AS middle, max(c) FILTER (k = 2) AS early, max(c) FILTER (k = 3) AS last FROM c GROUP BY doc_id""",
)

NAME = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat(upper(source), '-', doc_id % 7, 'A') WHEN 1 THEN concat(' ', source, '_', doc_id, ' ') WHEN 2 THEN ' ' WHEN 3 THEN concat('SNORD', doc_id % 150, '-', doc_id % 3) ELSE lang END"
_add(
    "family_stem",
    lambda s, d: table(s, d, "documents").select("doc_id", S.family_stem(F.expr(NAME), F.concat(F.lit("id"), "doc_id")).alias("family")),
    f"SELECT doc_id, coalesce(nullif(regexp_replace(trim({NAME}), '[-_]\\d+[A-Za-z]?$', ''), ''), 'id' || doc_id) AS family FROM documents",
)

_add(
    "known_prefix",
    lambda s, d: table(s, d, "documents").select("doc_id", S.has_prefix(F.expr(NAME), S.KNOWN_FAMILIES).alias("known"), S.has_prefix(F.expr(NAME), S.KNOWN_FAMILIES_WIDE).alias("known_wide")),
    f"SELECT doc_id, list_bool_or(list_transform({S.KNOWN_FAMILIES}, lambda p: starts_with(upper({NAME}), p))) AS known, list_bool_or(list_transform({S.KNOWN_FAMILIES_WIDE}, lambda p: starts_with(upper({NAME}), p))) AS known_wide FROM documents",
)

CELL = "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'nan' WHEN 1 THEN ' ' WHEN 2 THEN CAST(event_id % 90 AS STRING) WHEN 3 THEN 'n/a' WHEN 4 THEN '-1.5e2' END"
_add(
    "nonempty_label",
    lambda s, d: table(s, d, "events").select("event_id", F.expr(CELL).alias("c"), "event_type").select("event_id", S.nonempty(F.col("c")).alias("filled"), (S.nonempty(F.col("c")) & (F.col("event_type") == "error")).alias("canonical"), (~S.nonempty(F.col("c")) & ~F.col("event_type").isin("error", "click")).alias("orphan")),
    f"""WITH t AS (SELECT event_id, event_type, coalesce(trim(coalesce({CELL}, '')) <> '' AND lower(trim(coalesce({CELL}, ''))) <> 'nan', false) AS filled FROM events)
    SELECT event_id, filled, filled AND event_type = 'error' AS canonical, NOT filled AND event_type NOT IN ('error', 'click') AS orphan FROM t""".replace("AS STRING", "AS VARCHAR"),
)
_add(
    "safe_numeric",
    lambda s, d: table(s, d, "events").select("event_id", S.number(F.expr(CELL)).alias("x"), S.number(F.expr(CELL)).isNotNull().alias("is_number")),
    f"WITH t AS (SELECT event_id, try_cast({CELL} AS DOUBLE) AS x FROM events) SELECT event_id, CASE WHEN NOT isnan(x) THEN x END AS x, coalesce(NOT isnan(x), false) AS is_number FROM t".replace("AS STRING", "AS VARCHAR"),
)

KIND = "concat(CASE CAST(page_id % 9 AS INT) WHEN 0 THEN 'Small Nucleolar RNA' WHEN 1 THEN 'spliceosomal part' WHEN 2 THEN 'x U4 y' WHEN 3 THEN 'transfer RNA' WHEN 4 THEN 'Gene; rRNA;' WHEN 5 THEN 'Cis-reg; riboswitch' WHEN 6 THEN 'signal recognition' WHEN 7 THEN 'Intron; x' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '' ELSE ' ' END)"


def _case_sql(expression: str, words: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({expression}), '{w}') THEN '{label}'" for w, label in words) + f" ELSE {default} END"


_add(
    "ordered_case_type",
    lambda s, d: table(s, d, "pages").select("page_id", S.rna_kind(F.expr(KIND)).alias("kind"), S.family_class(F.expr(KIND)).alias("class")),
    f"SELECT page_id, {_case_sql(KIND, S.KIND_WORDS, chr(39) + 'ncRNA' + chr(39))} AS kind, coalesce({_case_sql(KIND, [(w, w) for w in S.CLASS_WORDS] + [('cis-reg', 'cis-reg'), ('gene', 'gene-other')], f'nullif(lower(trim(split_part({KIND}, {chr(39)};{chr(39)}, 1))), {chr(39)}{chr(39)})')}, 'unknown') AS class FROM pages",
)

HGVS = "CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN concat('NR_', l_partkey, '.1:n.', l_suppkey, 'A>G') WHEN 1 THEN concat('m.', l_partkey, 'T>C (n.', l_linenumber, ')') WHEN 2 THEN concat('n.', l_suppkey, '_', l_partkey, 'del') ELSE l_returnflag END"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_add(
    "hgvs_parse",
    lambda s, d: table(s, d, "lineitem").select(*KEYS, S.variant_position(F.expr(HGVS)).alias("first_pos"), S.variant_change(F.expr(HGVS)).alias("v")).select(*KEYS, "first_pos", "v.pos", "v.ref", "v.alt"),
    f"""WITH t AS (SELECT {', '.join(KEYS)}, {HGVS} AS h FROM lineitem)
    SELECT {', '.join(KEYS)}, try_cast(regexp_extract(h, '[nm]\\.(-?\\d+)', 1) AS BIGINT) AS first_pos, try_cast(nullif(regexp_extract(h, '[nm]\\.(\\d+)([ACGT])>([ACGT])', 1), '') AS BIGINT) AS pos,
    nullif(regexp_extract(h, '[nm]\\.(\\d+)([ACGT])>([ACGT])', 2), '') AS ref, nullif(regexp_extract(h, '[nm]\\.(\\d+)([ACGT])>([ACGT])', 3), '') AS alt FROM t""",
)

_add(
    "catalogue_positions",
    lambda s, d: tables.catalogue_positions(table(s, d, "lineitem").select(F.col("l_returnflag").alias("gene"), F.expr(HGVS).alias("title"), F.when(F.col("l_linestatus") == "O", "Likely Pathogenic").otherwise("Benign").alias("class")), class_part="pathogenic", title_part="n."),
    f"""SELECT DISTINCT gene, x::BIGINT AS pos FROM (SELECT l_returnflag AS gene, unnest(regexp_extract_all({HGVS}, 'n\\.(\\d+)', 1)) AS x, l_linestatus, {HGVS} AS h FROM lineitem) WHERE l_linestatus = 'O' AND contains(h, 'n.')""",
)


def consensus_match(spark, sf_dir):
    """Box motifs at both ends of each sequence; the ends are what the operator is about."""
    q = F.col("seq")
    head, tail = F.substring(q, F.lit(1), F.least(F.length(q), F.lit(30))), F.substring(q, F.greatest(F.length(q) - 14, F.lit(1)), F.lit(15))
    return sequences(spark, sf_dir).select("doc_id", F.length(q).cast("bigint").alias("length"), F.round(S.best_match(q, "RUGAUGA", head), 6).alias("c_box"), F.round(S.best_match(q, "CUGA", tail), 6).alias("d_box"))


def _box_sql(region: str, consensus: str) -> str:
    hits = " + ".join(f"(substr(w, i + {k}, 1) IN ({', '.join(repr(x) for x in ('AG' if c == 'R' else c))}))::INTEGER" for k, c in enumerate(consensus))
    n = len(consensus)
    return f"(SELECT doc_id, round(max(({hits}) / {n}), 6) AS v FROM (SELECT doc_id, w, unnest(range(1, length(w) - {n} + 2)) AS i FROM (SELECT doc_id, CASE WHEN length({region}) < {n} THEN seq ELSE {region} END AS w FROM seq)) GROUP BY doc_id)"


_add(
    "consensus_match",
    consensus_match,
    f"""WITH {SEQ} SELECT doc_id, length(seq)::BIGINT AS length, coalesce(c.v, 0.0) AS c_box, coalesce(d.v, 0.0) AS d_box FROM seq
    LEFT JOIN {_box_sql('substr(seq, 1, 30)', 'RUGAUGA')} AS c USING (doc_id) LEFT JOIN {_box_sql('substr(seq, greatest(length(seq) - 14, 1), 15)', 'CUGA')} AS d USING (doc_id)""",
)


def kmer3(spark, sf_dir):
    """Each document's 3-mers and their shares of its valid ones."""
    return features.kmer_table(sequences(spark, sf_dir), ["doc_id"]).select("doc_id", "kmer", "n", F.round(F.col("n") / F.col("valid"), 6).alias("share"))


_add(
    "kmer3",
    kmer3,
    f"""WITH {SEQ}, k AS (SELECT doc_id, substr(seq, i::BIGINT, 3) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM seq)),
    c AS (SELECT doc_id, kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGU]{{3}}') GROUP BY ALL)
    SELECT doc_id, kmer, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS share FROM c""",
)

_add(
    "sliding_windows",
    lambda s, d: sequences(s, d)
    .select("doc_id", S.pieces(F.col("seq"), 100).alias("blocks"), S.window_starts(F.length("seq")).alias("starts"))
    .select("doc_id", F.explode(S.windows(F.col("blocks"), F.col("starts"))).alias("x"))
    .select("doc_id", "x.*")
    .select("doc_id", "start", F.length("w").cast("bigint").alias("n"), F.round(S.share_of(F.col("w"), "GC"), 6).alias("gc")),
    f"""WITH {SEQ}, w AS (SELECT doc_id, start::BIGINT AS start, substr(seq, start::BIGINT + 1, 200) AS w FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 49, 100)) AS start FROM seq WHERE length(seq) >= 50))
    SELECT doc_id, start, length(w)::BIGINT AS n, round((length(w) - length(translate(w, 'GC', ''))) / length(w), 6) AS gc FROM w""",
)

_add(
    "snv_enumerate",
    lambda s, d: scoring.substitutions(table(s, d, "part").select("p_partkey", S.cleaned(F.col("p_name")).alias("seq")), ["p_partkey"]),
    f"""WITH q AS (SELECT p_partkey, regexp_replace(translate(translate(replace(p_name, ' ', ''), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g') AS seq FROM part),
    s AS (SELECT p_partkey, seq, unnest(range(1, length(seq) + 1)) AS pos FROM q), a AS (SELECT *, substr(seq, pos::BIGINT, 1) AS wt, unnest(['A', 'C', 'G', 'U']) AS alt FROM s)
    SELECT p_partkey, pos::BIGINT AS pos, wt, alt, substr(seq, 1, pos::BIGINT - 1) || alt || substr(seq, pos::BIGINT + 1) AS mutant FROM a WHERE alt <> wt""",
)


def coord_lift(spark, sf_dir):
    """Positions of a genome mapped onto each part's own coordinates, and whether the base there is as named."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), S.cleaned(F.col("p_name")).alias("seq"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") + F.col("l_partkey") * 100).alias("genome"), (F.col("l_partkey") * 100).alias("start"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("T").alias("ref"))
    local = rows.withColumn("local", F.col("genome") - F.col("start") + 1).join(parts, "l_partkey").where(F.col("local").between(1, F.length("seq")))
    match = (F.substring("seq", F.col("local").cast("int"), F.lit(1)) == S.to_rna(F.col("ref"))).cast("double")
    return local.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(match), 6).alias("match_rate"))


_add(
    "coord_lift",
    coord_lift,
    f"""WITH q AS (SELECT p_partkey AS l_partkey, regexp_replace(translate(translate(replace(p_name, ' ', ''), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g') AS seq FROM part),
    r AS (SELECT l_partkey, l_suppkey + 1 AS local, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'U' END AS ref FROM lineitem)
    SELECT l_partkey, count(*) AS n, round(avg((substr(seq, local, 1) = ref)::INTEGER), 6) AS match_rate FROM r JOIN q USING (l_partkey) WHERE local BETWEEN 1 AND length(seq) GROUP BY l_partkey""",
)

_add(
    "length_filter",
    lambda s, d: sequences(s, d).where(F.length("seq").between(50, 510) & (S.share_of(F.col("seq"), "ACGU") >= 0.2)).select("doc_id", "lang", F.length("seq").cast("bigint").alias("n")),
    f"WITH {SEQ} SELECT doc_id, lang, length(seq)::BIGINT AS n FROM seq WHERE length(seq) BETWEEN 50 AND 510 AND (length(seq) - length(translate(seq, 'ACGU', ''))) / length(seq) >= 0.2",
)


def token_mask(spark, sf_dir):
    """Tokens that count: neither the first nor the last of a sequence nor N; training keeps the ends."""
    q = F.col("seq")
    inner = F.substring(q, F.lit(2), F.greatest(F.length(q) - 2, F.lit(0)))
    kept = lambda x: (F.length(x) - F.regexp_count(x, F.lit("N"))).cast("bigint")
    return sequences(spark, sf_dir).select("doc_id", F.length(q).cast("bigint").alias("tokens"), kept(inner).alias("real"), kept(q).alias("training"))


_add("token_mask", token_mask, f"WITH {SEQ} SELECT doc_id, length(seq)::BIGINT AS tokens, length(replace(substr(seq, 2, greatest(length(seq) - 2, 0)), 'N', ''))::BIGINT AS real, length(replace(seq, 'N', ''))::BIGINT AS training FROM seq")

_add(
    "table_profile",
    lambda s, d: entities.profile(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    """WITH l AS (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS "column", unnest([o_orderstatus, o_orderpriority]) AS value FROM orders),
    c AS (SELECT "column", value, count(*) AS n FROM l WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL)
    SELECT * FROM (SELECT "column", value, n, (sum(n) OVER (PARTITION BY "column"))::BIGINT AS filled, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10""",
)


def lr_schedule(spark, sf_dir):
    """The schedule at every order key, as steps of a run of as many steps as there are keys."""
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    return steps.select("step", F.round(S.warmup_cosine(F.col("step"), F.lit(4e-4), F.lit(400), F.lit(16_000)) * 1e6, 4).alias("lr"))


_add("lr_schedule", lr_schedule, "SELECT o_orderkey AS step, round(1e6 * CASE WHEN o_orderkey < 400 THEN 4e-4 * (o_orderkey + 1) / 400 ELSE 4e-4 * (0.1 + 0.45 * (1 + cos(pi() * (o_orderkey - 400) / 15600))) END, 4) AS lr FROM orders")
