"""Delimited tables, JSON reports and catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .storage import write_verified as write_verified


def read_strings(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited table with every column as text; a tab if the header has at least as many of them as commas."""
    if sep is None:
        head = spark.read.text(path).limit(1).first()
        line = head["value"] if head else ""
        sep = "\t" if line.count("\t") >= line.count(",") else ","
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("error").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def feature_table(report: DataFrame, buckets: tuple[str, ...] = ("specialist_features", "moderate_features"), most_breadth: int | None = None) -> DataFrame:
    """(feat_idx, breadth, families, max_act) from an inspection report's buckets; the first bucket wins, dead features go."""
    parts = None
    for i, b in enumerate(buckets):
        rows = report.select(F.explode(b).alias("f")).select("f.feat_idx", "f.breadth", "f.families", "f.max_act", F.lit(i).alias("_b"))
        parts = rows if parts is None else parts.unionByName(rows)
    first = Window.partitionBy("feat_idx").orderBy("_b")
    kept = parts.withColumn("_rn", F.row_number().over(first)).where((F.col("_rn") == 1) & (F.col("max_act") > 0)).drop("_rn", "_b")
    return kept if most_breadth is None else kept.where(F.col("breadth") <= most_breadth)


def catalogue_positions(entries: DataFrame, class_part: str | None = None, title_part: str | None = None, prefix: str = "n", title: str = "title", gene: str = "gene", kind: str = "class") -> DataFrame:
    """Distinct (gene, pos) of all positions that the entries' titles name; filters by class and title are optional."""
    rows = entries
    if class_part is not None:
        rows = rows.where(F.contains(F.lower(kind), F.lit(class_part.lower())))
    if title_part is not None:
        rows = rows.where(F.contains(title, F.lit(title_part)))
    found = rows.select(F.col(gene).alias("gene"), F.explode(F.regexp_extract_all(title, F.lit(rf"{prefix}\.(\d+)"), F.lit(1))).alias("p"))
    return found.select("gene", F.col("p").cast("bigint").alias("pos")).distinct()


def detect_columns(df: DataFrame, hint: str = "score", sample: int = 200, length: int = 150, hints: tuple[str, ...] = ("pos", "coord", "n.", "transcript", "nt")) -> dict[str, str | None]:
    """Which column names variants, which holds positions, and which is the widest numeric one whose name has ``hint``; from the first rows.

    Positions are numbers in half of the rows at least, four in five of them
    whole and seven in ten from 1 to ``length``. Of such columns that wins
    which has most of its values there, a name like a position's counting
    three tenths; it is not taken for the score.
    """
    rows = df.limit(sample)
    checks = []
    for c in df.columns:
        v = F.col(c).cast("string")
        x = S.number(v)
        checks += [F.count_if(F.rlike(v, F.lit(r"[ncm]\.\d+"))).alias(f"h_{c}"), F.count_if(x.isNotNull()).alias(f"n_{c}"), (F.max(x) - F.min(x)).alias(f"w_{c}")]
        checks += [F.count_if(F.abs(x - F.rint(x)) < 1e-9).alias(f"i_{c}"), F.count_if(x.between(1, length)).alias(f"r_{c}")]
    r = rows.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
    least = max(5, r["rows"] / 5)
    variant = max((c for c in df.columns if r[f"h_{c}"] >= least), key=lambda c: r[f"h_{c}"], default=None)
    places = [c for c in df.columns if r[f"n_{c}"] >= max(1, r["rows"] / 2) and r[f"i_{c}"] >= 0.8 * r[f"n_{c}"] and r[f"r_{c}"] >= 0.7 * r[f"n_{c}"]]
    position = max(places, key=lambda c: r[f"r_{c}"] / r[f"n_{c}"] + (0.3 if any(h in c.lower() for h in hints) else 0), default=None)
    score = max((c for c in df.columns if c != position and r[f"n_{c}"] >= least and hint in c.lower() and r[f"w_{c}"] is not None), key=lambda c: r[f"w_{c}"], default=None)
    return {"variant": variant, "position": position, "score": score}


def usable_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without controls, insertions and deletions, whichever of these columns says so."""
    text = F.lower(F.concat_ws(" ", *columns))
    return df.where(~F.rlike(text, F.lit("control|insertion|deletion|indel")))


def resolved(entries: DataFrame, symbol: str = "symbol", accession: str = "accession", title: str = "title", length: str = "length", hints: tuple[str, ...] = ("NR_", "XR_"), least: int = 40, most: int = 520) -> DataFrame:
    """One accession for each symbol whose entry's title names it: those of the first hint first, then the lowest."""
    plain = lambda c: F.regexp_replace(F.upper(c), r"[-\s]", "")
    fit = entries.where(F.contains(plain(title), plain(symbol)) & F.col(length).between(least, most))
    rank = F.lit(len(hints))
    for i, h in reversed(list(enumerate(hints))):
        rank = F.when(F.startswith(F.col(accession), F.lit(h)), i).otherwise(rank)
    first = Window.partitionBy(symbol).orderBy("_hint", accession)
    return fit.withColumn("_hint", rank).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_hint")
