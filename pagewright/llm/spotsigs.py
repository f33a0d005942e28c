"""Operator 9, document fingerprints: SpotSigs.

A spot signature is a common word (the anchor) with the chain of content words that follow it; a document
is the set of its signatures. An inverted index holds each document's rarest signatures, as many as Jaccard
``threshold`` needs. Each signature's list is partitioned by the length of the sets, and a document meets only
those whose length is within the threshold of its own; meetings are then pruned by how much overlap the rest of
the two sets can still add. What meets is compared exactly, with whole sets. Signatures are counted over all
documents and nothing that reaches the threshold is lost; :mod:`setjoin` has the steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_steps
from .setjoin import classes, index_of
from .words import _PLACE, word_hashes

ANCHORS = "a an the is are was to der die das ist ein eine zu le la les est un une el los las es una que".split()
COMMON = ANCHORS + (
    "of and in that it for on with as by at from this be or not have has had he she they we you i but his her its "
    "und den dem des von mit auf für im nicht sich als auch es an werden aus er hat dass sie nach wird bei "
    "de et en du au aux ce dans par pour sur qui pas plus ne se y del al lo con por para su como no o"
).split()


@dataclass(frozen=True)
class SpotParams:
    """``distance`` content words lie between the links of a chain of ``chain`` words; ``block`` documents are
    compared with as many at a time."""

    threshold: float = 0.5
    chain: int = 2
    distance: int = 1
    block: int = 2048


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return np.unique(word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def signature_sets(data: np.ndarray, offs: np.ndarray, p: SpotParams) -> list[np.ndarray]:
    """The distinct spot signatures of each lower-cased text as sorted 64-bit hashes."""
    h, bounds = word_hashes(data, offs)
    if not len(h):
        return [np.zeros(0, np.uint64) for _ in bounds[1:]]
    content = np.flatnonzero(~_among(h, _hashes(COMMON)))
    anchor = np.flatnonzero(_among(h, _hashes(ANCHORS)))
    first = np.searchsorted(content, anchor)
    last = first + p.distance * (p.chain - 1)
    limit = np.searchsorted(content, bounds)  # content words before each text's end
    doc = np.searchsorted(bounds, anchor, side="right") - 1
    ok = last < limit[doc + 1]
    anchor, first, doc = anchor[ok], first[ok], doc[ok]
    sig = h[anchor] * _PLACE[0]
    for k in range(p.chain):
        sig = sig + h[content[first + k * p.distance]] * _PLACE[k + 1]
    sig = mix(sig)
    at = np.searchsorted(doc, np.arange(len(bounds)))
    return [np.unique(sig[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def similar_documents(docs: DataFrame, params: SpotParams = SpotParams()) -> DataFrame:
    """``(doc_id, class_id, links)`` for every document: how many others reach Jaccard ``threshold`` with it.

    ``class_id`` is the lowest doc_id that chains of links lead to, the document's own where it has no link. Defined
    results: a document is a doc_id with a set of signatures, so repeated rows are one document and texts of one
    doc_id that differ are several, a row and possible partners each; null doc_ids, null and empty texts and texts
    without a signature (no anchor, or too few content words after it) have no row; a Jaccard equal to the
    threshold links; an empty table gives no rows; other columns are not read. A doc_id that is no whole number
    is an error.
    """
    p = params

    def extract(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], None]]:
        for lo, hi, data, offs in text_steps(batch.column(2)):
            yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), signature_sets(data, offs, p), None

    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    base = rows.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("ref"), F.lower("text").alias("text"))
    return classes(index_of(base, extract, p.threshold), p.threshold, p.block).select(F.col("id").alias("doc_id"), "class_id", "links")
