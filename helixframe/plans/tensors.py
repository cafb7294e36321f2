"""Queries on keyed tensor files, which are written from the embeddings first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tensors
from ..sources.storage import scratch
from .common import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, row, values): eight vectors in a row are a tensor of one of three layers, as activations of a sequence are."""
    group = F.floor(F.col("vec_id") / 8)
    key = F.concat(F.lit("seq"), F.lpad(group.cast("string"), 9, "0"), F.lit("__layer"), (group % 3).cast("string"))
    rows = table(spark, sf_dir, "embeddings").select(key.alias("key"), "vec_id", F.col("embedding").alias("values"))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("key").orderBy("vec_id")) - 1)


NAMED = """named AS (SELECT 'seq' || lpad((vec_id // 8)::VARCHAR, 9, '0') || '__layer' || (vec_id // 8) % 3 AS key, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS row, embedding FROM embeddings)"""


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    tensors.write_tensors(_named(spark, sf_dir), path)
    return path


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def tensor_layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all tensors of one layer, chosen by the suffix of their keys."""
    found = tensors.read_tensors(spark, _written(spark, sf_dir)).where(F.endswith("key", F.lit("__layer1")))
    return found.select("key", "row", F.size("values").cast("bigint").alias("n"), F.round(_total(F.col("values")), 6).alias("total"))


QUERIES["tensor_layer_rows"] = tensor_layer_rows
SQL["tensor_layer_rows"] = f"WITH {NAMED} SELECT key, row, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM named WHERE key LIKE '%\\_\\_layer1' ESCAPE '\\'"


def tensor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors, rows and bytes of each layer, from the headers alone."""
    keys = tensors.tensor_keys(spark, _written(spark, sf_dir))
    return keys.groupBy(F.regexp_extract("key", "__layer([0-9]+)$", 1).alias("layer")).agg(F.count(F.lit(1)).alias("tensors"), F.sum(F.get("shape", F.lit(0))).alias("rows"), F.sum("bytes").alias("bytes"))


QUERIES["tensor_headers"] = tensor_headers
SQL["tensor_headers"] = f"WITH {NAMED} SELECT regexp_extract(key, '__layer([0-9]+)$', 1) AS layer, count(DISTINCT key) AS tensors, count(*) AS rows, sum(4 * len(embedding))::BIGINT AS bytes FROM named GROUP BY 1"


def tensor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tensors read by key and held against what they were written from: the largest difference of any number."""
    path = _written(spark, sf_dir)
    sample = tensors.sampled_keys(tensors.tensor_keys(spark, path), 10)
    found = tensors.read_tensors(spark, path).where(F.col("key").isin(sample))
    source = _named(spark, sf_dir).where(F.col("key").isin(sample)).select("key", "row", F.col("values").alias("own"))
    differences = F.array_max(F.zip_with("values", "own", lambda a, b: F.abs(a - b)))
    return found.join(source, ["key", "row"]).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(differences).alias("most"))


QUERIES["tensor_gate"] = tensor_gate
SQL["tensor_gate"] = f"""WITH {NAMED}, keys AS (SELECT key, count(*) AS rows, row_number() OVER (ORDER BY key) - 1 AS i, greatest(1, (count(*) OVER ()) // 10) AS step FROM named GROUP BY key)
  SELECT key, rows, 0::DOUBLE AS most FROM keys WHERE i % step = 0 AND i < 10 * step"""
