"""Operator 6, best-fit packing: exact-complement hashing on the counts of lengths.

Documents are packed into sequences of ``capacity`` tokens. Documents of equal length are
interchangeable, so packing works on how many there are of each length, at most ``capacity`` numbers
however large the corpus. For the longest length left, the gap to the capacity is looked up among the
lengths (one document), the sums of two and the sums of three lengths; a combination that fills the gap
exactly is used as often as the counts allow. What finds no exact complement goes by best fit decreasing.
The result is a list of patterns (lengths, how often), which a join on length and rank turns into places
for the documents. A document longer than the capacity is cut into whole sequences and a rest.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked


@dataclass(frozen=True)
class PackParams:
    """``capacity`` in tokens; a token is a run of non-space characters unless ``tokens`` says otherwise."""

    capacity: int = 2048


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters (space, tab, line feed, vertical tab, form feed, return)."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("int")


class SumIndex:
    """Which lengths, pairs and triples of lengths add up to a sum, under the counts ``have`` that only ever fall.

    ``pairs[s]`` holds the longer lengths of the pairs with sum ``s``, ``triples[s]`` the longest of the triples, both
    in falling order; a sum is indexed when it is first asked for, and an entry whose documents are used up goes.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, np.ndarray] = {}
        self.lengths = np.flatnonzero(have)[::-1]
        self.least = np.full(len(have), len(have))  # the least longer length of the pairs with each sum
        for a in self.lengths.tolist():
            other = self.lengths[(self.lengths <= a) & (self.lengths < len(have) - a)]
            self.least[a + other] = a

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The pair with the longest part up to ``most`` that adds up to ``total``."""
        if total not in self.pairs:
            b = self.lengths[(self.lengths < total) & (2 * self.lengths >= total)]
            self.pairs[total] = b[self.have[total - b] > 0]
        b = self.pairs[total]
        if most == total:
            b = self.pairs[total] = b[(self.have[b] > 0) & (self.have[total - b] > 0)]
        b = b[(self.have[b] > 0) & (self.have[total - b] > (2 * b == total))]
        at = len(b) - int(np.searchsorted(b[::-1], most, side="right"))
        return (int(b[at]), total - int(b[at])) if at < len(b) else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One to three lengths with documents left that add up to ``gap``, the longest first."""
        if self.have[gap]:
            return (gap,)
        if two := self.pair(gap, gap):
            return two
        if gap not in self.triples:
            c = self.lengths[self.lengths < gap]
            self.triples[gap] = c[self.least[gap - c] <= c]
        left = self.triples[gap]
        for k, c in enumerate(left.tolist()):
            if self.have[c]:
                self.have[c] -= 1
                two = self.pair(gap - c, c)
                self.have[c] += 1
                if two:
                    self.triples[gap] = left[k:]
                    return (c, *two)
        self.triples[gap] = left[:0]
        return None


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, times)`` for so many pieces of each length from 1 to ``capacity``."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        have[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), int(have[capacity])))
        have[capacity] = 0
    index = SumIndex(have)
    left: list[tuple[int, int]] = []
    for a in range(capacity - 1, 0, -1):
        while have[a]:
            have[a] -= 1
            combo = index.complement(capacity - a)
            have[a] += 1
            if combo is None:
                left.append((a, int(have[a])))
                have[a] = 0
                break
            whole = (a, *combo)
            times = min(int(have[x]) // whole.count(x) for x in set(whole))
            for x in whole:
                have[x] -= times
            out.append((whole, times))
    # best fit decreasing over what is left, counts of equal bins together
    bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, lens: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bins[room] = []
            heapq.heappush(rooms, room)
        bins[room].append([lens, n])

    for a, n in left:
        while n:
            fit = min((r for r in bins if r >= a and bins[r]), default=None)
            if fit is None:
                each = min(n, max(1, capacity // a))
                whole, n = (n // each, n % each)
                put(capacity - a * each, (a,) * each, whole)
                continue
            lens, m = bins[fit][-1]
            k = min(fit // a, n)
            used = min(m, n // k)
            if used == m:
                bins[fit].pop()
            else:
                bins[fit][-1][1] -= used
            put(fit - k * a, lens + (a,) * k, used)
            n -= used * k
            if not bins[fit]:
                del bins[fit]
    for room in sorted(bins):
        out.extend((tuple(lens), n) for lens, n in bins[room])
    return out


def pack(docs: DataFrame, params: PackParams = PackParams(), tokens: Column | None = None) -> DataFrame:
    """``(doc_id, piece, tokens, sequence, position, start)``: where each piece of each document goes.

    ``piece`` counts the parts of a document that is longer than the capacity, ``position`` the pieces of
    a sequence and ``start`` is the piece's first token in it. Pieces of equal length are ordered by
    doc_id (null last) and piece. Defined results: empty and null texts have no tokens and no row;
    repeated rows and null doc_ids are documents of their own; equal lengths are interchangeable, so ties
    only decide which goes where; an empty table gives an empty result; other columns are not read.
    """
    cap = params.capacity
    n = (word_count(F.col("text")) if tokens is None else tokens).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).filter("n > 0")
    pieces = sized.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / cap))).alias("piece"), "n").select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(cap), F.col("n") - F.col("piece") * cap).cast("int").alias("tokens"))
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    pieces = ranked(pieces, "tokens", [F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("_row")])
    spark = docs.sparkSession
    counts = {r["tokens"]: r["count"] for r in pieces.groupBy("tokens").agg((F.max("rank") + 1).alias("count")).collect()}
    slots, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for lens, times in pack_counts(counts, cap):
        start, seen = 0, {}
        for k, length in enumerate(lens):
            seen.setdefault(length, []).append((k, start))
            start += length
        for length, places in seen.items():
            for j, (k, at) in enumerate(places):
                # ranks taken[length] + j, + len(places), ... : one in each of ``times`` sequences
                slots.append((length, taken[length], times * len(places), len(places), j, sequence, k, at))
            taken[length] += times * len(places)
        sequence += times
    names = ["tokens", "first", "ranks", "per", "j", "sequence0", "position", "start"]
    table = spark.createDataFrame(pd.DataFrame(slots, columns=names).astype("int64"), schema=", ".join(f"{x} long" for x in names))
    # a slot covers a range of ranks; an index by runs of ranks keeps the join an equality
    hit = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")) & ((F.col("rank") - F.col("first")) % F.col("per") == F.col("j"))
    step = F.lit(1024).cast("long")
    keyed = table.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("ranks") - 1) / step))))
    placed = pieces.withColumn("bucket", F.floor(F.col("rank") / step)).join(keyed.withColumn("tokens", F.col("tokens").cast("int")), ["tokens", "bucket"]).filter(hit)
    return placed.select("doc_id", "piece", "tokens", (F.col("sequence0") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).cast("long").alias("sequence"), F.col("position").cast("int").alias("position"), F.col("start").cast("int").alias("start"))
