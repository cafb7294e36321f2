"""The corpus pipeline: quality rules, quality classifier, line dedup, near-duplicate join, packing."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import classifier, lines, near, packing, quality
from helixframe.llm.common import cut, holding, release, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the base rules or a risk-controlled cutoff reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents predicted bad go.

    The model is fitted on the labelled rows of the whole table. Of what the
    rules keep, the bad ones may be nearly all gone, and a fit on these rows
    alone would then have one class and reject nothing.
    """
    return classifier.keep_predicted(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later occurrences of widespread lines go, and documents of which no word is left."""
    return lines.drop_emptied(lines.remove_widespread_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate group stays."""
    return near.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the remaining documents' token ids, packed into sequences."""
    return packing.pack(docs)


_PLAIN: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]


def _apply(number: int, stage: Stage, spark: SparkSession, docs: DataFrame, sf_dir: str, owner: str | None = None) -> DataFrame:
    """A stage; what the one before it wrote for itself goes, since its rows have been written and read again by now.

    Without an owner, the stages of one thread over one folder belong together.
    """
    owner = owner or f"{threading.get_ident()} {sf_dir}"
    release(spark, f"{owner} {number - 1}")
    with holding(f"{owner} {number}"):
        return stage(spark, docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [(name, partial(_apply, i, stage)) for i, (name, stage) in enumerate(_PLAIN)]

#: SQL has neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs, owner = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, owner)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
