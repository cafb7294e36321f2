"""Relations that several registered queries start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import features, ranking

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str) -> list:
    """Columns rounded to six places."""
    return [F.round(F.col(n), 6).alias(n) for n in names]


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, feat, x): a feature for each dimension of the embeddings."""
    return features.exploded(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])


ACT = "act AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS feat, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, score, event_type): a score for each position of a user's events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).cast("bigint").alias("pos"), F.col("value").alias("score"), "event_type")


POS = "pos AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value AS score, event_type FROM events)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, seq): whole texts as cleaned RNA sequences."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", S.cleaned(F.coalesce("text", F.lit(""))).alias("seq"))


SEQ = f"""seq AS (SELECT doc_id, lang, source, regexp_replace(translate(translate(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g'), '{S.LOWER}', '{S.UPPER}'), 'T', 'U'), '[^ACGU]', 'N', 'g') AS seq FROM documents)"""


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feat, label, max_act): the families in which a feature is present."""
    return features.presence(features.family_max(activations(spark, sf_dir)))


PRESENCE = f"""{ACT}, fm AS (SELECT feat, label, max(greatest(x, 0)) AS max_act FROM act GROUP BY feat, label),
  present AS (SELECT feat, label, max_act FROM (SELECT *, max(max_act) OVER (PARTITION BY feat) AS top FROM fm) WHERE max_act >= 0.25 * top AND top > 0)"""


def tail_sql(z: str) -> str:
    """ranking.two_sided_p() in SQL."""
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    t = f"(1 / (1 + {x} / 2))"
    power = "0"
    for c in reversed(ranking.ERFC):
        power = f"({power} * {t} + ({c!r})::DOUBLE)"
    return f"({t} * exp({power} - {x} * {x}))"
