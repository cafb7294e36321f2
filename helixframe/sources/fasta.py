"""FASTA records and Stockholm alignments as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


#: A separator that no header has: the header is one name.
WHOLE = r"\x00"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) for each record; a record begins at a ``>`` that begins a line."""
    return spark.read.text(path, lineSep="\n>")


def parse(records: DataFrame, fields: list[str] | None = None, rna: bool = True, upper: bool = False, sep: str = r"\|") -> DataFrame:
    """(name, fields..., sequence) of records in column ``value``.

    Header fields are trimmed, missing ones null. Sequence lines are joined;
    With WHOLE as the separator the name is the whole header. T becomes U unless ``rna`` is false. Records without a header are left out.
    """
    value = F.regexp_replace(F.trim(F.col("value"), F.lit("\r\n\t ")), "^>", "")
    head = F.trim(F.split_part(value, F.lit("\n"), F.lit(1)), F.lit("\r\t "))
    body = F.regexp_replace(F.when(F.contains(value, F.lit("\n")), F.regexp_replace(value, r"^[^\n]*\n", "")).otherwise(""), r"\s", "")
    body = S.to_rna(body) if rna else body
    body = S.ascii_upper(body) if upper else body
    rows = records.select(head.alias("_h"), body.alias("sequence")).where(F.col("_h") != "")
    parts = F.split(F.col("_h"), sep)
    names = ["name", *(fields or [])]
    return rows.select(*(F.nullif(F.trim(F.try_element_at(parts, F.lit(i + 1))), F.lit("")).alias(n) for i, n in enumerate(names)), "sequence")


def records(df: DataFrame, header: list[str], sequence: str, wrap: int = 0, sep: str = " | ") -> DataFrame:
    """One row (value) for each record, without the last line break; lines of ``wrap`` letters if asked for."""
    body = F.regexp_replace(F.col(sequence), f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else F.col(sequence)
    return df.select(F.concat(F.lit(">"), F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header)), F.lit("\n"), body).alias("value"))


def write(df: DataFrame, path: str, header: list[str], sequence: str, wrap: int = 0, sep: str = " | ") -> None:
    records(df, header, sequence, wrap, sep).write.mode("error").text(path)


def last_by_name(parsed: DataFrame, order: str) -> DataFrame:
    """The last record of each name in this order."""
    w = Window.partitionBy("name").orderBy(F.desc(order))
    return parsed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(family, family_name, kind, seq_id, aligned) of every row of every alignment.

    Blocks end with ``//``; rows of one id are joined in their order. Bytes
    beyond ASCII in names are not decoded. A gzip file is one task, so its
    blocks are dealt out before they are parsed. What a block's lines share is
    read once for a block, before they are rows.
    """
    blocks = spark.read.text(path, lineSep="//\n").where(F.contains("value", F.lit("#=GF AC"))).repartition(spark.sparkContext.defaultParallelism)
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^#=GF {t}\s+(.*)$", 1)), F.lit(""))
    heads = blocks.select(tag("AC").alias("family"), tag("ID").alias("family_name"), tag("TP").alias("kind"), F.xxhash64("value").alias("_b"), F.split("value", "\n").alias("_lines"))
    lines = heads.select("family", "family_name", "kind", "_b", F.posexplode("_lines").alias("_i", "line"))
    rows = lines.where(~F.startswith("line", F.lit("#")) & F.rlike("line", F.lit(r"^\S+\s+\S"))).select("family", "family_name", "kind", "_b", "_i", F.regexp_extract("line", r"^(\S+)\s+(.*?)\s*$", 1).alias("seq_id"), F.regexp_extract("line", r"^(\S+)\s+(.*?)\s*$", 2).alias("part"))
    joined = rows.groupBy("_b", "family", "family_name", "kind", "seq_id").agg(F.array_sort(F.collect_list(F.struct("_i", "part"))).alias("_p"))
    return joined.where(F.col("family").isNotNull()).select("family", "family_name", "kind", "seq_id", F.array_join(F.transform("_p", lambda x: x["part"]), "").alias("aligned"), F.get("_p", F.lit(0))["_i"].alias("row_no"))


def alignments(rows: DataFrame) -> DataFrame:
    """Families whose rows are equally wide, each ungapped sequence once: its first row."""
    norm = rows.withColumn("aligned", S.aligned(F.col("aligned"))).withColumn("ungapped", S.ungapped(F.col("aligned")))
    width = Window.partitionBy("family")
    even = norm.withColumns({"_a": F.min(F.length("aligned")).over(width), "_b": F.max(F.length("aligned")).over(width)}).where("_a = _b").drop("_b").withColumnRenamed("_a", "width")
    first = Window.partitionBy("family", "ungapped").orderBy("row_no")
    return even.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def residues(rows: DataFrame, letters: str = "ACGUN") -> DataFrame:
    """(family, seq_id, column, letter, nth) of the letters of alignment rows; nth counts a row's letters from 1."""
    cells = rows.select("family", "seq_id", F.posexplode(F.split("aligned", "")).alias("column", "letter")).where(F.col("letter").isin(*letters))
    w = Window.partitionBy("family", "seq_id").orderBy("column")
    return cells.withColumn("nth", F.row_number().over(w))


def contexts(queries: DataFrame, rows: DataFrame, most: int = 31, seed: int = 0) -> DataFrame:
    """Each query (family, ungapped) found in its family's alignment, and up to ``most`` other rows in hash order: a sample.

    ``nth`` is 0 for the query's own row; queries without a row in the
    alignment are left out.
    """
    own = queries.select("family", "ungapped").distinct().join(rows.select("family", "ungapped", F.col("seq_id").alias("query"), F.col("aligned").alias("query_row")), ["family", "ungapped"])
    others = own.join(rows.select("family", F.col("seq_id").alias("seq_id"), "aligned"), "family").where(F.col("seq_id") != F.col("query"))
    w = Window.partitionBy("family", "query").orderBy(F.xxhash64("seq_id", F.lit(seed)), "seq_id")
    kept = others.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("family", "query", "seq_id", "aligned", "nth")
    return kept.unionByName(own.select("family", "query", F.col("query").alias("seq_id"), F.col("query_row").alias("aligned"), F.lit(0).alias("nth")))
