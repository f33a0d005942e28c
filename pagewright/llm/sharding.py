"""Operator 8, sharding: longest-processing-time scheduling of groups that must stay together.

Groups, longest first, go to the least loaded shard through a heap. Groups of equal size are
interchangeable, so the heap runs over runs of equal sizes; what it would do in a run of more groups than shards
follows from the loads by arithmetic. The driver holds the distinct sizes and the shards, not the groups.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked


@dataclass(frozen=True)
class ShardParams:
    shards: int = 64


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """For each ``(size, groups)``, longest first: ``(size, starts, turns)``. From the ``starts[k]``-th of its groups on
    the shards of ``turns[k]`` take one group each in turn. Equal loads go to the lower shard.

    Where a size has more groups than there are shards, the heap's order follows from arithmetic: a shard of load
    ``q * size + r`` takes its first group in round ``q``, and within a round shards go by ``r``; so the turn changes
    only in rounds in which another shard joins, and what is stored doesn't grow with the number of groups.
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, n in sorted(sizes, reverse=True):
        if size == 0:
            out.append((size, [0], [[heap[0][1]]]))
            continue
        if n <= shards:
            turn = []
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                turn.append(s)
            out.append((size, [0], [turn]))
            continue
        by_rest = sorted((load % size, s, load // size) for load, s in heap)
        rounds = sorted({q for _, _, q in by_rest})
        starts, turns, done = [], [], 0
        for q, following in zip(rounds, [*rounds[1:], None]):
            turn = [s for _, s, own in by_rest if own <= q]
            starts.append(done)
            turns.append(turn)
            if following is None or done + (following - q) * len(turn) >= n:
                break
            done += (following - q) * len(turn)
        full, extra = divmod(n - done, len(turns[-1]))
        place = {s: k for k, s in enumerate(turns[-1])}
        heap = [((q + full + (place[s] < extra)) * size + rest if s in place else own * size + rest, s) for rest, s, own in by_rest]
        heapq.heapify(heap)
        out.append((size, starts, turns))
    return out


def shard(docs: DataFrame, group: Column, size: Column, params: ShardParams = ShardParams()) -> DataFrame:
    """``(doc_id, group_key, group_size, shard)`` for every row of ``docs``.

    ``group`` names what must stay together, ``size`` what a row weighs (null counts as 0). Groups of equal
    size are taken by ascending key. Defined results: a null group key is a group of its own, which comes
    before the others; repeated rows add their weight again and have a row each; groups of size 0 go to the
    shard that is least loaded then; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("group_key"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("w")))
    groups = ranked(rows.groupBy("group_key").agg(F.sum("w").alias("group_size")), "group_size", [F.col("group_key").asc_nulls_first()])
    sizes = [(r["group_size"], r["n"]) for r in groups.groupBy("group_size").agg((F.max("rank") + 1).alias("n")).collect()]
    plan = schedule(sizes, params.shards)
    table = spark.createDataFrame(pd.DataFrame(plan, columns=["group_size", "starts", "turns"]), schema="group_size long, starts array<long>, turns array<array<int>>")
    part = F.size(F.filter("starts", lambda x: x <= F.col("rank"))) - 1
    turn = F.get("turns", part)
    at = F.get(turn, ((F.col("rank") - F.get("starts", part)) % F.size(turn)).cast("int"))
    placed = groups.join(table, "group_size").select(F.col("group_key").alias("k"), "group_size", at.alias("shard"))
    return rows.join(placed, F.col("group_key").eqNullSafe(F.col("k"))).select("doc_id", "group_key", "group_size", "shard")
