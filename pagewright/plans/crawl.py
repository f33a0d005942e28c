"""Site crawls over tables: the frontier of every target moves on by one round a step.

A crawler's queue is first in, first out, so what a round's pages add is what the next round visits; a target's
order within a round is its page's place, then next page before links, then the link's place. That keeps
the page budget's cut exact while all targets advance in one job. Each round is written to the shared
folder, so an executor that is lost costs that round only.
"""

from __future__ import annotations

import tempfile
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MAX_PAGES
from ..functions import urls
from ..operators.policy import request_gate


@dataclass(frozen=True)
class CrawlOptions:
    """``max_seconds`` ends a crawl between rounds. ``snapshots`` names a folder that gets a numbered folder each round, with
    all that going on from there takes; ``resume`` names one of these, whose queue then takes the place of the seeds."""

    max_pages: int = MAX_PAGES
    max_depth: int = 2
    follow_links: bool = True
    follow_pagination: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_seconds: float | None = None
    snapshots: str | None = None
    resume: str | None = None


def shared(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared folder and read from there; on one machine alone a folder made here will do."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="crawl-"))
    return df.checkpoint()


def _in_scope(df: DataFrame, o: CrawlOptions) -> DataFrame:
    if o.exclude:
        df = df.filter(~F.col("url").rlike("|".join(f"(?:{p})" for p in o.exclude)))
    return df.filter(F.col("url").rlike("|".join(f"(?:{p})" for p in o.include))) if o.include else df


def _gate(found: DataFrame) -> DataFrame:
    ok = request_gate(found.withColumnRenamed("target", "base_url")).filter("reject_reason is null")
    return ok.select(F.col("base_url").alias("target"), F.col("safe_url").alias("url"), "depth", "place").withColumn("key", urls.url_dedup_key(F.col("url")))


def crawl_sites(seeds: DataFrame, site: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """``(target, seq, url, depth, ok)`` of every visit, and the run's ``truncated`` flag for each target.

    ``seeds (target, ord, url)`` with ``target`` the base URL; ``site (url, links array<struct<url,text>>, next_url
    [, not_modified])`` is what fetching gives, by dedup key. A URL that isn't in ``site`` is a failed visit, which is
    free; one that isn't modified counts but leads nowhere. Repeated addresses are visited once, at their first
    place; a null URL is dropped. A resumed crawl has a new page budget, goes on from the snapshot's queue and
    returns only its own visits, numbered on from there; what the snapshot had queued or visited isn't visited again.
    """
    o = options
    same = F.first("not_modified") if "not_modified" in site.columns else F.lit(False)
    pages = site.withColumn("key", urls.url_dedup_key(F.col("url"))).filter("key <> ''").groupBy("key").agg(F.first("links").alias("links"), F.first("next_url").alias("next_url"), F.coalesce(same, F.lit(False)).alias("not_modified"))
    order = W.partitionBy("target").orderBy("place")
    queued = visited = spent = None
    done, cut, round_, began = [], [], 0, time.monotonic()
    if o.resume:
        read = seeds.sparkSession.read
        frontier, queued, spent = (read.parquet(f"{o.resume}/{x}") for x in ("frontier", "queued", "spent"))
        spent = spent.withColumn("spent", F.lit(0).cast("long"))
        round_ = int(o.resume.rstrip("/").rpartition("/")[2]) + 1
    else:
        frontier = _gate(seeds.select("target", "url", F.lit(0).alias("depth"), F.array(F.lit(0), F.col("ord").cast("int")).alias("place")))
    known = queued
    while True:
        once = frontier.groupBy("target", "key").agg(F.min(F.struct("place", "url", "depth")).alias("x")).select("target", "key", "x.*")
        if queued is not None and queued is not known:
            once = once.join(queued.select("target", "key"), ["target", "key"], "left_anti")
        now = once.join(pages, "key", "left").withColumn("ok", F.col("links").isNotNull() | F.coalesce("not_modified", F.lit(False)))
        now = now.join(spent, "target", "left") if spent is not None else now.withColumn("spent", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
        before = F.coalesce(F.sum(F.col("ok").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("spent", F.lit(0))
        now = shared(now.withColumn("before", before).withColumn("seq", F.row_number().over(order) - 1 + F.coalesce("base", F.lit(0))))
        cut.append(now.filter(F.col("before") >= o.max_pages).select("target"))
        visited = now.filter(F.col("before") < o.max_pages)
        done.append(visited.select("target", "seq", "url", "depth", "ok"))
        keys = now.select("target", "key")
        queued = keys if queued is None else queued.union(keys)
        used = visited.groupBy("target").agg(F.count_if(F.col("ok")).alias("s"), F.count("*").alias("b"))
        spent = used.select("target", F.col("s").alias("spent"), F.col("b").alias("base")) if spent is None else shared(spent.join(used, "target", "full").select("target", (F.coalesce("spent", F.lit(0)) + F.coalesce("s", F.lit(0))).alias("spent"), (F.coalesce("base", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("base")))
        live = visited.filter("links is not null and not not_modified")
        links = live.select("target", "seq", "depth", F.posexplode("links").alias("ord", "l")).select("target", F.col("l.url").alias("url"), (F.col("depth") + 1).alias("depth"), F.array(F.col("seq").cast("int"), F.col("ord") + 1).alias("place"))
        pagers = live.filter("next_url is not null").select("target", F.col("next_url").alias("url"), "depth", F.array(F.col("seq").cast("int"), F.lit(0)).alias("place"))
        found = (links if o.follow_links else links.limit(0)).union(pagers if o.follow_pagination else pagers.limit(0)).filter(F.col("depth") <= o.max_depth)
        frontier = shared(_gate(_in_scope(found, o)).join(queued, ["target", "key"], "left_anti"))
        if o.snapshots:
            for name, part in (("queued", queued), ("spent", spent), ("frontier", frontier)):
                part.write.mode("overwrite").parquet(f"{o.snapshots}/{round_:05d}/{name}")
        round_ += 1
        if frontier.isEmpty():
            break
        if o.max_seconds is not None and time.monotonic() - began >= o.max_seconds:
            cut.append(frontier.select("target"))
            break
    visits, over = reduce(DataFrame.union, done), reduce(DataFrame.union, cut)
    return visits.join(over.distinct().withColumn("truncated", F.lit(True)), "target", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def link_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``(node, depth)``: least number of links from a seed, up to ``max_depth``. ``edges (src, dst)``, ``seeds (node)``."""
    out = front = shared(seeds.filter("node is not null").select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        reached = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).filter("node is not null").distinct()
        front = shared(reached.join(out, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def converge(pages: DataFrame) -> DataFrame:
    """``pages (target, seq, url, ...)`` without those whose resolved URL an earlier visit of the target had."""
    key = urls.url_dedup_key(F.col("url"))
    return pages.withColumn("_n", F.row_number().over(W.partitionBy("target", key).orderBy("seq"))).filter("_n = 1").drop("_n")


#: Rungs of the free ladder in the order they are tried.
LADDER = ("fetch", "local_render", "remote_render", "reader", "archive")


def first_acceptable(attempts: DataFrame) -> DataFrame:
    """Each URL's first good attempt by rung, else its last failure; ``attempts (url, rung, ok, reason, ...)``.

    A refusal or a quarantine ends the ladder: later rungs don't count.
    """
    rank = F.array_position(F.array(*map(F.lit, LADDER)), F.col("rung"))
    seq = W.partitionBy("url").orderBy("_rank")
    rows = attempts.withColumn("_rank", rank)
    ended = F.coalesce(F.max((~F.col("ok") & F.col("reason").isin("blocked", "quarantined")).cast("int")).over(seq.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    live = rows.withColumn("_ended", ended).filter("_ended = 0")
    return live.withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy(F.col("ok").desc(), F.when(F.col("ok"), F.col("_rank")).otherwise(-F.col("_rank"))))).filter("_n = 1").drop("_n", "_rank", "_ended")


def search_and_crawl(results: DataFrame, crawled: DataFrame) -> DataFrame:
    """``results (query, ord, url)`` each with what crawling it gave: ``outcome`` (page, not_modified, skipped), ``reason`` and ``detail``.

    ``crawled (url, ok, not_modified, reason, detail)`` is asked under the result's own origin. An address that can't be
    parsed is skipped as blocked without a request, one without an answer as unreachable.
    """
    asked = results.withColumn("_host", urls.host_of(F.col("url")))
    both = asked.join(crawled.select("url", "ok", "not_modified", F.col("reason").alias("_reason"), F.col("detail").alias("_detail")), "url", "left")
    bad, good = F.col("_host").isNull(), F.coalesce("ok", F.lit(False))
    outcome = F.when(bad | ~good, "skipped").when(F.coalesce("not_modified", F.lit(False)), "not_modified").otherwise("page")
    reason = F.when(bad, "blocked").when(F.col("ok").isNull(), "unreachable").when(~good, F.col("_reason"))
    detail = F.when(bad, "the search gave no address that can be parsed").when(~good, F.col("_detail"))
    return both.select("query", "ord", "url", outcome.alias("outcome"), reason.alias("reason"), detail.alias("detail"))


def result_origins(results: DataFrame) -> DataFrame:
    """``(url, base_url)``: each distinct result as a target of its own origin, which is asked for once however many
    searches found it."""
    origin = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    return results.filter(urls.host_of(F.col("url")).isNotNull()).select("url", origin.alias("base_url")).distinct()
