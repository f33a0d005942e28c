"""Usage events and time-bound memory as batch operators: roll-ups, pacing, latency, caches, remembered rungs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import LATENCY_WEIGHT, RUNG_TTL_MS
from ..functions.text import is_security_refusal


def rollup(events: DataFrame, *by: str) -> DataFrame:
    """Counts, failures, mean latency and cost of ``events (..., ok, latency_ms, cost_usd)`` by ``by``."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"), F.avg("latency_ms").alias("mean_latency_ms"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def sorted_scan(rows: DataFrame, key: str, order: list[str], values: dict[str, Column], make, schema: str) -> DataFrame:
    """Rows of ``schema`` that ``make()`` gives for each key: an object whose ``add(*arrays)`` takes a run of the key's values
    in order and whose ``end()`` comes after the last, both returning lists of rows (without the key).

    A key's rows stream through one task in sorted order and are never held together, so a key may have any number.
    """
    names = list(values)
    kind = rows.schema[key].dataType.simpleString()
    flat = rows.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), *(v.alias(f"_v{k}") for k, v in enumerate(values.values())))
    by = [f"_o{k}" for k in range(len(order))]
    fields = [f"_v{k}" for k in range(len(names))]
    types = StructType.fromDDL(f"_key {kind}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        arrow = to_arrow_schema(types)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            columns = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(fields))]
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if state is None or keys[lo] != now:
                    out += [(now, *r) for r in state.end()] if state else []
                    now, state = keys[lo], make()
                out += [(now, *r) for r in state.add(*(c[lo:hi] for c in columns))]
                lo = hi
            if len(out) > 50_000:
                yield flush()
                out = []
        out += [(now, *r) for r in state.end()] if state else []
        if out:
            yield flush()

    ready = flat.repartition("_key").sortWithinPartitions("_key", *by).select("_key", *fields)
    return ready.mapInArrow(run, types).withColumnRenamed("_key", key)


def latency_average(events: DataFrame, host: str, order: list[str], latency: Column, weight: float = LATENCY_WEIGHT) -> DataFrame:
    """``(host, value)``: each host's smoothed latency, seeded with the first one; null latencies count for nothing.

    The smoothing is a sum with weights that fall with an event's distance from the last, so hosts of any number of
    events are added up in parts and never collected.
    """
    rows = events.select(host, *order, latency.cast("double").alias("_x")).filter("_x is not null")
    back = W.partitionBy(host).orderBy(*(F.col(c).desc() for c in order))
    rows = rows.select(host, "_x", (F.row_number().over(back) - 1).alias("_j"), F.lead("_x").over(back).isNull().alias("_first"))
    part = F.pow(F.lit(1 - weight), F.col("_j")) * F.col("_x") * F.when(F.col("_first"), 1.0).otherwise(weight)
    return rows.groupBy(host).agg(F.sum(part).alias("value"))


def interval_ms(average: Column, least: Column | int, multiplier: float = 0) -> Column:
    """Pause between requests to a host: ``least``, or more where it answers slowly."""
    floor = least if isinstance(least, Column) else F.lit(least)
    return F.when(F.lit(multiplier <= 0) | average.isNull(), floor).otherwise(F.greatest(floor, F.floor(average * multiplier + 0.5)))


def throttle_schedule(requests: DataFrame, host: str, order: list[str], at_ms: Column, gap_ms: int) -> DataFrame:
    """``requests`` with ``run_at_ms``: when each may run if a host is asked every ``gap_ms`` at most.

    A request runs at the latest of its time and the one before plus the gap; with one gap that is a running
    maximum, so no fold is needed.
    """
    seq = W.partitionBy(host).orderBy(*order)
    rows = requests.withColumn("_i", F.row_number().over(seq) - 1).withColumn("_free", at_ms - F.col("_i") * gap_ms)
    return rows.withColumn("run_at_ms", F.max("_free").over(seq.rowsBetween(W.unboundedPreceding, 0)) + F.col("_i") * gap_ms).drop("_i", "_free")


class _Pace:
    """State of one host: when it may be asked next, and how fast it answers."""

    def __init__(self, least: int, multiplier: float, weight: float):
        self.least, self.multiplier, self.weight = least, multiplier, weight
        self.free, self.average = None, None

    def add(self, name, at, latency) -> list[tuple]:
        out = []
        for i, t, x in zip(name.tolist(), at.tolist(), latency.tolist()):
            run = t if self.free is None else max(t, self.free)
            gap = self.least if self.average is None or self.multiplier <= 0 else max(self.least, math.floor(self.average * self.multiplier + 0.5))
            self.free = run + gap
            if x == x:
                self.average = x if self.average is None else self.average * (1 - self.weight) + x * self.weight
            out.append((i, run, gap))
        return out

    def end(self) -> list[tuple]:
        return []


def adaptive_schedule(requests: DataFrame, host: str, request: str, order: list[str], at_ms: Column, latency: Column, least_ms: int, multiplier: float, weight: float = LATENCY_WEIGHT) -> DataFrame:
    """``(host, request, run_at_ms, gap_ms)``: pacing by how slowly a host has answered so far.

    A request runs at the latest of its time and the one before plus the gap reserved then: ``least_ms``, or the
    smoothed latency of the answers before times ``multiplier``. Its own latency enters afterwards; a null one doesn't.
    """
    values = {"name": F.col(request).cast("long"), "at": at_ms.cast("long"), "latency": F.coalesce(latency.cast("double"), F.lit(float("nan")))}
    rows = sorted_scan(requests, host, order, values, lambda: _Pace(least_ms, multiplier, weight), "request long, run_at_ms long, gap_ms long")
    return rows.withColumnRenamed("request", request)


def rung_memory(events: DataFrame, host: str, order: list[str], at_ms: Column, rung: Column, won: Column, ttl_ms: int = RUNG_TTL_MS, excused: Column | None = None) -> DataFrame:
    """``events`` with ``remembered``: the rung known to work when each began, null if none does any more.

    A success sets it for ``ttl_ms`` anew. A failure of the remembered rung itself forgets it, unless it is
    ``excused`` (blocked or quarantined); failures of other rungs change nothing.
    """
    seq = W.partitionBy(host).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    lost = ~won & ~(excused if excused is not None else F.lit(False))
    rows = events.withColumn("_r", rung).withColumn("_lost", lost).withColumn("_t", at_ms)
    rows = rows.withColumn("_m", F.last(F.when(won, F.struct(F.col("_t").alias("at"), F.col("_r").alias("rung"))), ignorenulls=True).over(seq)).withColumn("_n", F.coalesce(F.sum(won.cast("int")).over(seq), F.lit(0)))
    since = W.partitionBy(host, "_n").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    forgot = F.coalesce(F.max((F.col("_lost") & (F.col("_r") == F.col("_m.rung"))).cast("int")).over(since), F.lit(0)) > 0
    rows = rows.withColumn("_f", forgot)
    return rows.withColumn("remembered", F.when(~F.col("_f") & (F.col("_t") < F.col("_m.at") + ttl_ms), F.col("_m.rung"))).select(*events.columns, "remembered")


def skips_direct_fetch(remembered: Column) -> Column:
    """Whether a host's remembered rung is another than the plain fetch, which then isn't tried."""
    return F.coalesce(remembered != "fetch", F.lit(False))


class _Cache:
    """State of one key: when its entry was written, and the requests so far."""

    def __init__(self, ttl: int):
        self.ttl, self.written, self.n, self.writes = ttl, None, 0, 0

    def add(self, at) -> list[tuple]:
        self.n += len(at)
        i = 0 if self.written is None else int(np.searchsorted(at, self.written + self.ttl))
        while i < len(at):
            self.written, self.writes = int(at[i]), self.writes + 1
            i = max(i + 1, int(np.searchsorted(at, self.written + self.ttl)))
        return []

    def end(self) -> list[tuple]:
        return [(self.n, self.n - self.writes)]


def cache_hits(requests: DataFrame, key: str, order: list[str], at_ms: Column, ttl_ms: int) -> DataFrame:
    """``(key, requests, hits)`` of a cache whose entries live ``ttl_ms`` from when they were written.

    ``order`` must not contradict ``at_ms``. From a write on, the next one is looked up by halving.
    """
    return sorted_scan(requests, key, order, {"at": at_ms.cast("long")}, lambda: _Cache(ttl_ms), "requests long, hits long")


def failure_streaks(events: DataFrame, source: str, order: list[str], failed: Column) -> DataFrame:
    """``(source, streak)``: the longest run of consecutive failures of each source."""
    seq = W.partitionBy(source).orderBy(*order)
    rows = events.withColumn("_f", failed).withColumn("_island", F.sum((~F.col("_f")).cast("int")).over(seq))
    runs = rows.filter("_f").groupBy(source, "_island").agg(F.count("*").alias("n"))
    return events.select(source).distinct().join(runs.groupBy(source).agg(F.max("n").alias("streak")), source, "left").select(source, F.coalesce("streak", F.lit(0)).alias("streak"))


def valid_at(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``requests (key, at_ms, ...)`` with the ``policy`` of ``known (key, policy, checked_ms, ttl_ms)`` that held then, null if none did.

    An as-of join without a range join: both sides are sorted by time once, and each request takes the last check.
    """
    both = requests.withColumn("_k", F.lit(None).cast("struct<policy:string,until:bigint>")).unionByName(
        known.select(key, F.col("checked_ms").alias("at_ms"), F.struct("policy", (F.col("checked_ms") + F.col("ttl_ms")).alias("until")).alias("_k")), allowMissingColumns=True
    )
    seq = W.partitionBy(key).orderBy("at_ms", F.col("_k").isNull())
    rows = both.withColumn("_last", F.last("_k", ignorenulls=True).over(seq)).filter("_k is null")
    return rows.withColumn("policy", F.when(F.col("at_ms") < F.col("_last.until"), F.col("_last.policy"))).select(*requests.columns, "policy")


def parity_counts(pages: DataFrame) -> DataFrame:
    """How many page records are thin, without Markdown, structured, empty or illustrated."""
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(F.length("text") < 200).alias("thin"), F.count_if(F.col("markdown") == "").alias("no_markdown"), F.count_if(F.col("structured_data.has_content_data")).alias("structured"),
        F.count_if(F.col("likely_empty_state")).alias("empty_state"), F.count_if(F.size("candidate_content_images") > 0).alias("with_images"),
    )


def usage_events(fetched: DataFrame, lane: str = "own") -> DataFrame:
    """What the usage hook is told: ``(url, host, lane, ok, reason, cost_usd)`` for each row of ``outcomes`` of fetched pages."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return fetched.select("url", host.alias("host"), F.lit(lane).alias("lane"), (F.col("outcome") != "failed").alias("ok"), "reason", F.lit(0.0).alias("cost_usd"))


def blocked_events(failures: DataFrame) -> DataFrame:
    """What the blocked hook is told: those of ``failures (..., detail)`` that are refusals for safety, not plain failures."""
    return failures.filter(is_security_refusal(F.col("detail")))


def joined_errors(attempts: DataFrame, by: str) -> DataFrame:
    """``(by, errors)``: the errors of ``attempts (by, ord, error)`` in order, joined by ``; ``; null where there is none."""
    said = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))))
    return attempts.groupBy(by).agg(F.nullif(F.array_join(F.transform(said, lambda x: x["error"]), "; "), F.lit("")).alias("errors"))
