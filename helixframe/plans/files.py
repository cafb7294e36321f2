"""Queries that write files of the library's formats and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import features
from ..sources import fasta, tables
from ..sources.storage import scratch
from .common import SEQ, Query, activations, presence, sequences, table
from .features import BREADTH

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# -- Stockholm files: part names as rows of their brand's alignment, each on two lines

_KIND = "CASE WHEN p_brand < 'Brand#3' THEN 'Gene; snRNA' ELSE 'Cis-reg' END"


def _stockholm(spark: SparkSession, sf_dir: str) -> str:
    """The path of a Stockholm file with a block for each brand."""
    gapped = F.translate("p_name", " ", "-")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(_KIND).alias("kind"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), p.alias("part")) for i, p in enumerate((F.substring(gapped, 1, 9), F.concat(F.lit("."), F.substring(gapped, 10, 200))))))).alias("x"))
    lines = rows.groupBy("p_brand", "kind").agg(F.array_sort(F.collect_list(F.struct("x.i", "p_partkey", F.concat(F.lit("id"), F.col("p_partkey"), F.lit("  "), F.col("x.part")).alias("line")))).alias("l"))
    head = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF AC "), F.col("p_brand"), F.lit("\n#=GF ID "), F.lower("p_brand"), F.lit("\n#=GF TP "), F.col("kind"), F.lit("\n"))
    path = scratch(spark)
    lines.select(F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n//")).alias("value")).write.text(path)
    return path


def stockholm_ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every alignment of a file, without gaps."""
    rows = fasta.read_stockholm(spark, _stockholm(spark, sf_dir))
    return rows.select("family", "family_name", "seq_id", S.ungapped(S.aligned(F.col("aligned"))).alias("ungapped"))


_add(
    "stockholm_ungapped",
    stockholm_ungapped,
    f"SELECT p_brand AS family, lower(p_brand) AS family_name, 'id' || p_partkey AS seq_id, regexp_replace(translate(translate(replace(p_name, ' ', ''), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g') AS ungapped FROM part",
)
_add(
    "stockholm_types",
    lambda s, d: fasta.read_stockholm(s, _stockholm(s, d)).groupBy("family", "kind").agg(F.count(F.lit(1)).alias("rows")),
    f"SELECT p_brand AS family, {_KIND} AS kind, count(*) AS rows FROM part GROUP BY 1, 2",
)


# -- headers that are kept whole


def whole_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose header is one name, bars and blanks included."""
    path = scratch(spark)
    fasta.write(sequences(spark, sf_dir), path, ["doc_id", "lang", "source"], "seq", wrap=70)
    found = fasta.parse(fasta.read(spark, path), sep=fasta.WHOLE)
    return found.select(F.col("name").alias("header"), F.length("sequence").cast("bigint").alias("n"), F.md5("sequence").alias("digest"))


_add("whole_headers", whole_headers, f"WITH {SEQ} SELECT doc_id || ' | ' || lang || ' | ' || source AS header, length(seq)::BIGINT AS n, md5(seq) AS digest FROM seq")


# -- nested reports


def _report(spark: SparkSession, sf_dir: str) -> str:
    """The path of an inspection report: a nested list of features for each bucket, with their families."""
    found = features.breadth(features.family_max(activations(spark, sf_dir)))
    families = presence(spark, sf_dir).groupBy("feat").agg(F.array_sort(F.collect_set("label")).alias("families"))
    rows = found.join(families, "feat").select("bucket", F.struct(F.col("feat").alias("feat_idx"), "breadth", "families", F.round("feat_max", 6).alias("max_act")).alias("f"))
    of = lambda b: F.collect_list(F.when(F.col("bucket") == b, F.col("f")))
    report = rows.agg(*(of(b).alias(f"{b}_features") for b in ("specialist", "moderate", "generalist")), F.count(F.lit(1)).alias("n"))  # a report: a row for each feature
    path = scratch(spark)
    tables.write_json(report, path)
    return path


_LIST = "array<struct<feat_idx: int, breadth: bigint, families: array<int>, max_act: double>>"


def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a report's specialist and generalist buckets, those of ten families at most."""
    report = spark.read.schema(f"specialist_features {_LIST}, generalist_features {_LIST}").json(_report(spark, sf_dir))
    found = tables.feature_table(report, ("specialist_features", "generalist_features"), most_breadth=10)
    return found.select("feat_idx", "breadth", F.array_join(F.col("families").cast("array<string>"), ",").alias("families"), "max_act")


_FAMILIES = f"{BREADTH}, fam AS (SELECT feat, string_agg(label, ',' ORDER BY label) AS families FROM mx WHERE m >= 0.25 * mm AND mm > 0 GROUP BY feat)"
_add("report_features", report_features, f"WITH {_FAMILIES} SELECT feat AS feat_idx, breadth, families, round(feat_max, 6) AS max_act FROM br JOIN fam USING (feat) WHERE breadth BETWEEN 1 AND 2 OR breadth = 10")


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report, read back as it was written: features and families of each bucket."""
    report = spark.read.schema(f"specialist_features {_LIST}, moderate_features {_LIST}, generalist_features {_LIST}, n long").json(_report(spark, sf_dir))
    long = report.select("n", F.explode(F.map_from_arrays(F.lit(["specialist", "moderate", "generalist"]), F.array("specialist_features", "moderate_features", "generalist_features"))).alias("bucket", "fs"))
    return long.select("n", "bucket", F.explode("fs").alias("f")).select("n", "bucket", F.col("f.feat_idx").alias("feat"), F.col("f.breadth").alias("breadth"), F.size("f.families").cast("bigint").alias("families"))


_add(
    "json_report",
    json_report,
    f"WITH {BREADTH} SELECT (SELECT count(*) FROM br WHERE breadth > 0) AS n, CASE WHEN breadth <= 2 THEN 'specialist' WHEN breadth <= 9 THEN 'moderate' ELSE 'generalist' END AS bucket, feat, breadth, breadth AS families FROM br WHERE breadth > 0",
)
