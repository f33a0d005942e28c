"""Usage events as streams: windowed roll-ups with late data, and rungs remembered for half an hour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RUNG_TTL_MS


def windowed_rollup(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and failures of ``events (ts timestamp, kind, ok)`` by window and kind; later than ``late`` is dropped."""
    by = [F.window("ts", window).alias("w"), "kind"]
    return events.withWatermark("ts", late).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures")).select(F.col("w.start").alias("start"), "kind", "n", "failures")


def first_sightings(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``requests (ts, url)``, each URL once while the watermark remembers it: what a page cache would fetch."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])


def rung_memory(events: DataFrame, ttl_ms: int = RUNG_TTL_MS) -> DataFrame:
    """``(host, event_id, remembered)`` for ``events (host, event_id, at_ms, rung, won[, excused])``, with a state for each host.

    A success is remembered for ``ttl_ms`` and each renews that; only a failure of the remembered rung that isn't
    ``excused`` forgets it. Events of a batch are taken by time.
    """
    if "excused" not in events.columns:
        events = events.withColumn("excused", F.lit(False))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rung, until = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
        out = []
        for r in rows.itertuples():
            out.append((key[0], r.event_id, rung if rung is not None and r.at_ms < until else None))
            if r.won:
                rung, until = r.rung, r.at_ms + ttl_ms
            elif r.rung == rung and not r.excused:
                rung, until = None, -1
        state.update((rung, until))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["host", "event_id", "remembered"])

    return events.groupBy("host").applyInPandasWithState(step, "host string, event_id long, remembered string", "rung string, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def cached(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """``(url, request_id, hit)`` for ``requests (url, request_id, at_ms)``: a page cache whose entries live ``ttl_ms`` from
    when they were written; the request that finds none writes one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (until,) = state.get if state.exists else (-1,)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at_ms", "request_id"]).itertuples():
            hit = r.at_ms < until
            until = until if hit else r.at_ms + ttl_ms
            out.append((key[0], r.request_id, hit))
        state.update((until,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["url", "request_id", "hit"])

    return requests.groupBy("url").applyInPandasWithState(step, "url string, request_id long, hit boolean", "until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def robots_posture(events: DataFrame, known_ms: int = 21_600_000, unknown_ms: int = 300_000) -> DataFrame:
    """``(host, event_id, policy, ask)`` for ``events (host, event_id, at_ms, found)``: the policy each request goes by.

    A host is asked when nothing is known of it any more: what it ``found`` holds for ``known_ms``, and for
    ``unknown_ms`` if that is ``unknown`` or null.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        policy, until = state.get if state.exists else ("unknown", -1)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at_ms", "event_id"]).itertuples():
            ask = r.at_ms >= until
            if ask:
                policy = r.found if isinstance(r.found, str) else "unknown"
                until = r.at_ms + (unknown_ms if policy == "unknown" else known_ms)
            out.append((key[0], r.event_id, policy, ask))
        state.update((policy, until))
        state.setTimeoutDuration(known_ms)
        yield pd.DataFrame(out, columns=["host", "event_id", "policy", "ask"])

    return events.groupBy("host").applyInPandasWithState(step, "host string, event_id long, policy string, ask boolean", "policy string, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_validators(batch: DataFrame, path: str) -> None:
    """For ``foreachBatch``: the last validators of each ``(target, url)`` of a batch, appended as a version of their own."""
    last = batch.groupBy("target", "url").agg(F.max_by(F.struct("etag", "last_modified", "content_region_sha256", "text_sha256"), "at_ms").alias("v"), F.max("at_ms").alias("at_ms"))
    last.select("target", "url", "at_ms", "v.*").write.mode("append").parquet(path)


def current_validators(versions: DataFrame) -> DataFrame:
    """The newest version of each ``(target, url)``."""
    names = [c for c in versions.columns if c not in ("target", "url")]
    return versions.groupBy("target", "url").agg(F.max_by(F.struct(*names), "at_ms").alias("v")).select("target", "url", "v.*")
