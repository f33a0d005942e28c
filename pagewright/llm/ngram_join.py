"""Operator 3, n-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

Each document becomes the set of its word n-grams (hashed), a row of the incidence matrix. Documents of equal sets
are one row from there on. Columns are counted, and those of one row leave the matrix: they can't overlap. The
columns that are left are ordered by rarity, so that every similar pair shares one of the first few of both rows
and meets there; components of such meetings are blocks of the matrix outside of which all overlaps are too small.
In them the product of the matrix with its transpose is added up, and counts under what the two sizes need for
Jaccard ``threshold`` are discarded. See :mod:`setjoin` for the steps, which sample nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, cut, text_steps
from .setjoin import classes, index_of
from .words import ngram_sets


@dataclass(frozen=True)
class JoinParams:
    """``n`` words make a gram; ``block`` rows a block of the product."""

    n: int = 3
    threshold: float = 0.6
    block: int = 2048


def _classes(docs: DataFrame, ref: Column, p: JoinParams) -> DataFrame:
    def extract(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], None]]:
        for lo, hi, data, offs in text_steps(batch.column(2)):
            yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), ngram_sets(data, offs, p.n), None

    base = docs.select(F.col("doc_id").cast("long").alias("id"), ref.cast("long").alias("ref"), F.lower("text").alias("text"))
    return classes(index_of(base, extract, p.threshold), p.threshold, p.block)


def join_documents(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``(doc_id, class_id, links)`` for every document: how many others reach Jaccard ``threshold`` with it.

    ``class_id`` is the lowest doc_id that chains of links lead to, the document's own where it has no link. Defined
    results: a document is a doc_id with a set of n-grams, so repeated rows are one document and texts of one
    doc_id that differ are several, a row and possible partners each; null doc_ids, null or empty texts and texts
    without a word have no row; a text of fewer than n words is one gram; a Jaccard equal to the threshold
    links; an empty table gives no rows; other columns are not read. A doc_id that is no whole number is an error.
    """
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return _classes(rows, F.lit(0), params).select(F.col("id").alias("doc_id"), "class_id", "links")


def keep_one(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` with one row of each class of linked documents, all columns as they were.

    The lowest doc_id stays (null comes last), of texts that share it the one of the lowest hash, of repeated rows
    any one. Rows whose text is null, empty or without a word stay as they are; an empty table stays empty.
    """
    rows = cut(_classes(docs.filter("text is not null"), F.xxhash64("text"), params).filter("links > 0 or rows > 1"))
    name = F.struct(F.col("id").isNull().alias("last"), "id", "ref")
    best = rows.groupBy("comp").agg(F.min(name).alias("best"))
    judged = rows.join(best, "comp").select("id", "ref", "rows", (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.ref") == F.col("ref"))).alias("stays"))
    judged = cut(judged.select(F.col("id").alias("_id"), F.col("ref").alias("_ref"), "rows", "stays"))
    is_row = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_ref"))
    kept = docs.join(broadcast_small(judged.filter("not stays").select("_id", "_ref")), is_row, "left_anti")
    twins = judged.filter("stays and rows > 1").select("_id", "_ref")
    if twins.isEmpty():
        return kept
    twins = broadcast_small(twins)
    return kept.join(twins, is_row, "left_anti").union(kept.join(twins, is_row, "left_semi").dropDuplicates(["doc_id", "text"]))
