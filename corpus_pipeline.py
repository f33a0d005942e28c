"""Corpus pipeline: documents through language ID, the quality classifier, near-duplicate removal and
packing. Each stage is written as Parquet and read again as the next one's input.

What stages do with odd rows: null, empty and letterless texts are no language and go in the first stage; null and
repeated doc_ids are judged row by row by the first two; of repeated rows the third keeps one; columns besides
doc_id, text, lang (and labels' doc_id, quality) are carried and not read, whatever their names; an empty table goes through
all stages and gives no rows; where there are no labels to learn from, the first two keep all rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import language_id, ngram_join, packing, quality
from pagewright.llm.common import delete, read, shared_dir


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is identified with enough confidence; null and empty texts go."""
    return language_id.keep_identified(docs)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, takes for good ones."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the lowest doc_id (null comes last)."""
    return ngram_join.keep_one(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, ``(doc_id, piece, tokens, sequence, position, start)``."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language),
    ("quality_classifier", stage_quality),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("best_fit_packing", stage_packing),
]

#: Trained models decide, which SQL cannot express. The tests hold the models against plain loops, the third stage against
#: comparing all documents, and the packing against its invariants.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with the rows of the last; an empty table gives none.

    Each stage's rows are written to the shared folder, and deleted when the next one's are complete.
    """
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
