"""Queries on samples, folds, alignments, checks, nominations and verdicts."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import entities, features, models, ranking, scoring
from ..sources import fasta
from .common import ACT, POS, PRESENCE, SEQ, Query, activations, positions, presence, r6, sequences, table, tail_sql
from .sequences import HGVS

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


#: A seeded order of documents or vectors that both dialects can state; ``k`` tells rows of one hash apart.
def _shuffled(key: str) -> str:
    return f"{key} * 7919 % 10007 * 1000000000000 + {key}"


# -- filters and samples

_add(
    "family_allow_list",
    lambda s, d: entities.allowed_families(table(s, d, "documents").select("doc_id", "source"), "source", 5),
    "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)",
)
_add(
    "box_length_filter",
    lambda s, d: sequences(s, d).where(F.col("lang").isin("en", "de") & F.length("seq").between(60, 2000)).select("doc_id", "lang", F.length("seq").cast("bigint").alias("n")),
    f"WITH {SEQ} SELECT doc_id, lang, length(seq)::BIGINT AS n FROM seq WHERE lang IN ('en', 'de') AND length(seq) BETWEEN 60 AND 2000",
)
_add(
    "seeded_truncate",
    lambda s, d: entities.truncated(table(s, d, "documents").select("doc_id", "source"), [F.expr(_shuffled("doc_id"))], 300),
    f"SELECT doc_id, source FROM documents ORDER BY {_shuffled('doc_id')} LIMIT 300",
)
_add(
    "token_cap",
    lambda s, d: entities.truncated(activations(s, d).select("vec_id", "feat"), [F.expr("(vec_id * 64 + feat) * 7919 % 1000003"), "vec_id", "feat"], 5000),
    f"WITH {ACT} SELECT vec_id, feat FROM act ORDER BY (vec_id * 64 + feat) * 7919 % 1000003, vec_id, feat LIMIT 5000",
)
_add(
    "stride_sample",
    lambda s, d: entities.stride_sample(table(s, d, "documents").select("doc_id", "lang"), F.col("doc_id"), 7),
    "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 0",
)
_add(
    "stratified_folds",
    lambda s, d: entities.stratified_folds(table(s, d, "labels").select("doc_id", "quality"), "quality", F.expr(_shuffled("doc_id"))),
    f"SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {_shuffled('doc_id')}) - 1) % 5)::INTEGER AS fold FROM labels",
)
_add(
    "records_by_family",
    lambda s, d: fasta.parse(fasta.records(sequences(s, d).withColumn("family", F.when(F.col("lang") != "fr", F.col("lang")).otherwise("")), ["doc_id", "family"], "seq", wrap=60), ["family"]).where(F.coalesce(F.trim("family"), F.lit("")) != "").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("letters")),
    f"WITH {SEQ} SELECT lang AS family, count(*) AS n, sum(length(seq))::BIGINT AS letters FROM seq WHERE lang <> 'fr' GROUP BY lang",
)

# -- parsing and checks

_VALUE = "CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN CAST(l_suppkey + 0.5 AS STRING) WHEN 1 THEN 'nan' ELSE ' ' END"
_add(
    "parsed_position",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.parsed_position(F.expr(_VALUE), F.expr(HGVS)).alias("pos")),
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, try_cast({_VALUE.replace('STRING', 'VARCHAR')} AS DOUBLE) AS x, {HGVS} AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN NOT isnan(x) THEN round_even(x, 0)::BIGINT END, try_cast(nullif(regexp_extract(h, '(?i)[nm]\\.(-?\\d+)', 1), '') AS BIGINT)) AS pos FROM t""",
)
_add(
    "header_flags",
    lambda s, d: sequences(s, d).select("doc_id", *(c.alias(k) for k, c in S.header_flags(F.concat_ws(" ", F.lit("Gene"), "source", "lang"), "src1", F.col("seq"), F.lit(500)).items())),
    f"""WITH {SEQ} SELECT doc_id, contains(upper('Gene ' || source || ' ' || lang), 'SRC1') AS named, abs(length(seq) - 500) <= 5 AS length_ok, length(seq) > 510 AS too_long, length(translate(seq, 'ACGUN', '')) = 0 AS letters_ok FROM seq""",
)

# -- alignments

_ROWS = f"""rows AS (SELECT p_brand AS family, p_partkey AS seq_id, p_partkey AS row_no, rpad(regexp_replace(translate(translate(replace(p_name, ' ', '-'), '{S.LOWER}', '{S.UPPER}'), 'T-', 'U.'), '[^ACGU.]', 'N', 'g'), CASE WHEN p_brand < 'Brand#5' THEN 60 ELSE 60 + p_size % 2 END, '.') AS aligned FROM part),
  even AS (SELECT *, replace(aligned, '.', '') AS ungapped FROM rows QUALIFY min(length(aligned)) OVER (PARTITION BY family) = max(length(aligned)) OVER (PARTITION BY family)),
  alignment AS (SELECT * FROM even QUALIFY row_number() OVER (PARTITION BY family, ungapped ORDER BY row_no) = 1)"""


def _alignment(spark, sf_dir):
    """Part names as rows of their brand's alignment; some brands' rows are not equally wide and fall out."""
    width = F.when(F.col("p_brand") < "Brand#5", 60).otherwise(60 + F.col("p_size") % 2)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("seq_id"), F.col("p_partkey").alias("row_no"), F.rpad(F.translate("p_name", " ", "-"), width, F.lit("-")).alias("aligned"))
    return fasta.alignments(rows)


_add("alignment_rows", lambda s, d: _alignment(s, d).select("family", "seq_id", F.col("width").cast("bigint").alias("width"), "ungapped"), f"WITH {_ROWS} SELECT family, seq_id, length(aligned)::BIGINT AS width, ungapped FROM alignment")
_add(
    "alignment_residues",
    lambda s, d: fasta.residues(_alignment(s, d), "ACGU").groupBy("family", "column").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nth"), 6).alias("mean_nth")).select("family", F.col("column").cast("bigint").alias("position"), "n", "mean_nth"),
    f"""WITH {_ROWS}, cells AS (SELECT family, seq_id, i, substr(aligned, i + 1, 1) AS c FROM alignment, unnest(range(0, length(aligned))) AS u(i)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY family, seq_id ORDER BY i) AS nth FROM cells WHERE c IN ('A', 'C', 'G', 'U')) SELECT family, i AS position, count(*) AS n, round(avg(nth), 6) AS mean_nth FROM kept GROUP BY family, i""",
)


def alignment_context(spark, sf_dir):
    """The sequences of ten brands as queries: each one's row and how many others of its family go along; queries without a row are left out."""
    rows = _alignment(spark, sf_dir)
    queries = rows.where("family < 'Brand#3'").select("family", "ungapped").unionByName(spark.createDataFrame([("none", "ACGU")], "family string, ungapped string"))
    return fasta.contexts(queries, rows).groupBy("family", "query").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("nth") == 0, F.col("seq_id"))).alias("own"))


_add(
    "alignment_context",
    alignment_context,
    f"""WITH {_ROWS} SELECT q.family, q.seq_id AS query, 1 + least(31, (SELECT count(*) FROM alignment r WHERE r.family = q.family) - 1) AS rows, q.seq_id AS own FROM alignment q WHERE q.family < 'Brand#3'""",
)

# -- scans and structures

def _letter_model(sequences: list[str]) -> list[list[float]]:
    """Stands in for a model: log shares of the letters that it is shown, so a position that is not masked tells on itself."""
    return [[math.log((s.count(b) + 1) / (len(s) + 4)) for b in "ACGU"] for s in sequences]


_LETTER = "ln((length(seq) - length(replace(seq, '{0}', '')) - (wt = '{0}')::INTEGER + 1) / (length(seq) + 4)::DOUBLE)"
_add(
    "masked_readout",
    lambda s, d: scoring.masked_criticality(table(s, d, "part").select("p_partkey", S.cleaned(F.col("p_name")).alias("seq")), ["p_partkey"], _letter_model).select("p_partkey", "pos", *r6("score")),
    f"""WITH q AS (SELECT p_partkey, regexp_replace(translate(translate(replace(p_name, ' ', ''), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g') AS seq FROM part),
    c AS (SELECT p_partkey, seq, i AS pos, substr(seq, i, 1) AS wt FROM q, unnest(range(1, length(seq) + 1)) AS u(i) WHERE instr('ACGU', substr(seq, i, 1)) > 0),
    p AS (SELECT p_partkey, pos, wt, [{', '.join(_LETTER.format(b) for b in 'ACGU')}] AS lp FROM c)
    SELECT p_partkey, pos, round((4 * lp[instr('ACGU', wt)] - list_sum(lp)) / 3, 6) AS score FROM p""",
)
_add(
    "structure_pairs",
    lambda s, d: scoring.pairs(table(s, d, "part").select("p_partkey", F.concat(F.lit("]"), F.repeat(F.lit("("), F.col("p_size")), F.repeat(F.lit("."), F.col("p_size") % 7), F.repeat(F.lit(")"), F.col("p_size")), F.lit("[")).alias("db")), ["p_partkey"], "db"),
    """WITH t AS (SELECT p_partkey, p_size::BIGINT AS n, p_size::BIGINT % 7 AS m FROM part) SELECT p_partkey, i AS at, CASE WHEN i BETWEEN 2 AND n + 1 OR i BETWEEN n + m + 2 AND 2 * n + m + 1 THEN 2 * n + m + 3 - i ELSE 0 END AS partner FROM t, unnest(range(1, 2 * n + m + 3)) AS u(i)""",
)


def positive_control(spark, sf_dir):
    """Features pass if the family of their own number reaches half of their maximum."""
    maxima = features.family_max(activations(spark, sf_dir))
    members = maxima.groupBy("feat").agg(F.max(F.when(F.col("label") == F.col("feat") % 10, F.col("max_act"))).alias("best"), F.max("max_act").alias("feat_max"))
    return scoring.control(members).select("n", *r6("rate"), "passed")


_add("positive_control", positive_control, f"WITH {ACT}, m AS (SELECT feat, max(greatest(x, 0)) FILTER (label = feat % 10) AS best, max(greatest(x, 0)) AS top FROM act GROUP BY feat) SELECT count(*) AS n, round(avg((best >= 0.5 * top)::INTEGER), 6) AS rate, avg((best >= 0.5 * top)::INTEGER) >= 0.6 AS passed FROM m")
_add(
    "argmax_position",
    lambda s, d: positions(s, d).groupBy("user_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max("score").alias("peak")),
    f"WITH {POS} SELECT user_id, pos, score AS peak FROM pos QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) = 1",
)
_add(
    "position_join",
    lambda s, d: positions(s, d).join(table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean")).where("n >= 5"), "pos").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("score") * F.col("mean")), 6).alias("product")),
    f"WITH {POS}, p AS (SELECT l_partkey AS pos, avg(l_discount) AS mean FROM lineitem GROUP BY 1 HAVING count(*) >= 5) SELECT user_id, count(*) AS n, round(avg(score * mean), 6) AS product FROM pos JOIN p USING (pos) GROUP BY user_id",
)

# -- reports: a top list is what they are about

_add(
    "top_features",
    lambda s, d: presence(s, d).groupBy("feat").agg(F.max("max_act").alias("act")).orderBy(F.desc("act"), "feat").limit(30).select("feat", *r6("act")),
    f"WITH {PRESENCE} SELECT feat, round(max(max_act), 6) AS act FROM present GROUP BY feat ORDER BY max(max_act) DESC, feat LIMIT 30",
)
_add(
    "top_features_by_bucket",
    lambda s, d: entities.first_per_group(presence(s, d).groupBy("feat").agg(F.max("max_act").alias("act"), F.least(F.count(F.lit(1)), F.lit(4)).alias("bucket")), "bucket", [F.desc("act"), F.col("feat")], 10).select("bucket", "nth", "feat", *r6("act")),
    f"WITH {PRESENCE}, f AS (SELECT feat, max(max_act) AS act, least(count(*), 4) AS bucket FROM present GROUP BY feat) SELECT bucket, nth, feat, round(act, 6) AS act FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY act DESC, feat) AS nth FROM f) WHERE nth <= 10",
)
_add(
    "nominations",
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "part").where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("score")).where("n >= 5").orderBy(F.desc("score"), "l_partkey").limit(25),
    "SELECT l_partkey, count(*) AS n, sum(l_quantity) AS score FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_partkey HAVING count(*) >= 5 ORDER BY score DESC, l_partkey LIMIT 25",
)
_add(
    "top_coefficients",
    lambda s, d: activations(s, d).groupBy("feat").agg(F.covar_pop(F.col("x"), (F.col("label") == 0).cast("double")).alias("coef")).select("feat", F.round("coef", 9).alias("coef")).orderBy(F.desc(F.abs("coef")), "feat").limit(15),
    f"WITH {ACT} SELECT feat, round(covar_pop(x, (label = 0)::INTEGER::DOUBLE), 9) AS coef FROM act GROUP BY feat ORDER BY abs(round(covar_pop(x, (label = 0)::INTEGER::DOUBLE), 9)) DESC, feat LIMIT 15",
)

# -- statistics and models

_RANKS = "r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2 AS rk FROM rows), u AS (SELECT g, (count(*) FILTER (y))::DOUBLE AS a, (count(*) FILTER (NOT y))::DOUBLE AS b, sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2 AS u FROM r GROUP BY g)"
_FOLDS = "rows AS (SELECT l_orderkey % 5 AS g, l_returnflag = 'R' AS y, l_extendedprice AS score FROM lineitem)"


def cv_summary(spark, sf_dir):
    """Mean and population deviation of five folds' AUCs."""
    rows = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_orderkey") % 5)
    return entities.cv_summary(ranking.mann_whitney(rows, "l_extendedprice", F.col("l_returnflag") == "R", ["g"]), "auc").select("folds", *r6("mean", "std"))


_add("cv_summary", cv_summary, f"WITH {_FOLDS}, {_RANKS} SELECT count(*) AS folds, round(avg(u / (a * b)), 6) AS mean, round(stddev_pop(u / (a * b)), 6) AS std FROM u")
_add(
    "mwu_ties",
    lambda s, d: ranking.corrected_p(ranking.mann_whitney(table(s, d, "lineitem").withColumn("g", F.col("l_linenumber")), "l_discount", F.col("l_returnflag") == "R", ["g"])).select("g", "u", F.round("p", 6).alias("p")),
    f"""WITH rows AS (SELECT l_linenumber AS g, l_returnflag = 'R' AS y, l_discount AS score FROM lineitem), {_RANKS}, t AS (SELECT g, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT g, score, count(*)::DOUBLE AS c FROM rows GROUP BY g, score) GROUP BY g),
    z AS (SELECT g, u, (abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM u JOIN t USING (g)) SELECT g, u, round(CASE WHEN z <= 0 THEN 1 ELSE {tail_sql('z')} END, 6) AS p FROM z""",
)
_GATE = "CASE WHEN auc >= 0.7 AND n_pos >= 10 THEN 'strong' WHEN auc >= 0.55 THEN 'weak' WHEN auc IS NULL THEN 'untested' ELSE 'none' END"
_add(
    "verdict_gates",
    lambda s, d: ranking.mann_whitney(positions(s, d), "score", F.col("event_type") == "error", ["user_id"]).withColumn("auc", F.round("auc", 6)).select("user_id", "n_pos", "auc", F.expr(_GATE).alias("verdict")),
    f"""WITH {POS}, rows AS (SELECT user_id AS g, event_type = 'error' AS y, score FROM pos), {_RANKS}, m AS (SELECT g AS user_id, a::BIGINT AS n_pos, CASE WHEN a > 0 AND b > 0 THEN round(u / (a * b), 6) END AS auc FROM u) SELECT user_id, n_pos, auc, {_GATE} AS verdict FROM m""",
)
_add(
    "top5_accuracy",
    lambda s, d: entities.top_k_accuracy(table(s, d, "embeddings"), "label", "embedding", 5).select("n", *r6("accuracy")),
    "SELECT count(*) AS n, round(avg((len(list_filter(embedding, lambda x: x > embedding[label + 1])) < 5)::INTEGER), 6) AS accuracy FROM embeddings",
)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4 == 0).alias("test"), array_to_vector("embedding").alias("features"))


def softmax_probe(spark, sf_dir):
    """Each test vector's class by a multinomial model of the others, and how many classes are above the true one."""
    data = _vectors(spark, sf_dir)
    return models.softmax_probe(data.where("NOT test"), data.where("test"), "features", "label").select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"), "above")


def transfer_score(spark, sf_dir):
    """Vectors of odd labels scored by a model of label 0 that was fitted on vectors of even ones."""
    data = _vectors(spark, sf_dir)
    fitted = data.where("label % 2 = 0").withColumn("y", (F.col("label") == 0).cast("int"))
    return models.transferred(fitted, data.where("label % 2 = 1"), "features", "y").select("vec_id", "label", "p")


_add("softmax_probe", softmax_probe, None)
_add("transfer_score", transfer_score, None)
