"""Ranking and discovery of links: detail pages, sitemaps, search results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..config import SITEMAP_CHILDREN, SITEMAP_MAX_URLS, SNIPPET_CHARS
from ..functions import guard, text, urls
from ..html import links as L
from .policy import request_gate, with_url


def pick_detail_links(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(page, field, url, text, score)``: each field's best link of each page.

    ``links (page, ord, url, text)``; ``keywords (field, field_ord, word)``, a small table that is broadcast. A word in the
    label counts 10, in the path 4; a label of 1 to 30 characters 2 more. The first of equals wins.
    """
    parts = with_url(links, "url", "_u").withColumn("path", F.lower(F.coalesce("_u.path", "url"))).withColumn("label", F.lower(F.coalesce("text", F.lit(""))))
    words = keywords.filter("word <> ''").select("field", "field_ord", F.lower("word").alias("word"))
    hit = F.when(F.col("label").contains(F.col("word")), 10).otherwise(0) + F.when(F.col("path").contains(F.col("word")), 4).otherwise(0)
    found = parts.crossJoin(F.broadcast(words)).withColumn("hit", hit).filter("hit > 0")
    summed = found.groupBy("page", "ord", "url", "text", "label", "field", "field_ord").agg(F.sum("hit").alias("hit"))
    scored = summed.withColumn("score", (F.col("hit") + F.when(F.length("label").between(1, 30), 2).otherwise(0)).cast("int"))
    best = scored.groupBy("page", "field", "field_ord").agg(F.min_by(F.struct("url", "text", "score"), F.struct(-F.col("score"), "ord")).alias("b"))
    return best.select("page", "field", "field_ord", "b.*")


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """``(site, ord, url, lastmod)`` of ``sitemaps (site, xml)``: ``<url>`` blocks first, then bare ``<loc>``; the first of equal ones.

    Read by patterns, as sitemaps in the wild are often not well-formed.
    """
    block = F.regexp_extract_all("xml", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    loc = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
    read = lambda b: F.struct(text.xml_unescape(F.regexp_extract(b, loc, 1)).alias("url"), F.nullif(guard.trim(text.xml_unescape(F.regexp_extract(b, loc.replace("loc", "lastmod"), 1))), F.lit("")).alias("lastmod"))
    bare = F.transform(F.regexp_extract_all("xml", F.lit(loc), F.lit(1)), lambda x: F.struct(text.xml_unescape(x).alias("url"), F.lit(None).cast("string").alias("lastmod")))
    rows = sitemaps.select("site", F.posexplode(F.concat(F.transform(block, read), bare)).alias("ord", "e")).select("site", "ord", "e.*").filter("url <> ''")
    return rows.groupBy("site", "url").agg(F.min(F.struct("ord", "lastmod")).alias("x")).select("site", "x.ord", "url", "x.lastmod")


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def sitemap_urls(sitemaps: DataFrame, bodies: DataFrame, most: int = SITEMAP_MAX_URLS) -> DataFrame:
    """``(site, ord, url, lastmod, truncated)``: the allowed URLs of each site's sitemap, or of its first five children.

    ``sitemaps (site, xml)`` with ``site`` the target's base URL; ``bodies (url, xml)`` holds what children answered.
    """
    index = is_sitemap_index(F.col("xml"))
    own = sitemap_entries(sitemaps.filter(~index)).select("site", F.lit(0).alias("child"), "ord", "url", "lastmod")
    child = sitemaps.filter(index).select("site", F.posexplode(F.slice(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), 1, SITEMAP_CHILDREN)).alias("child", "loc"))
    child = request_gate(child.select(F.col("site").alias("base_url"), "child", text.xml_unescape(F.col("loc")).alias("url"))).filter("reject_reason is null")
    got = child.join(bodies.select(F.col("url").alias("safe_url"), "xml"), "safe_url").filter(~is_sitemap_index(F.col("xml")))
    nested = sitemap_entries(got.select(F.struct(F.col("base_url").alias("site"), "child").alias("site"), "xml")).select("site.site", "site.child", "ord", "url", "lastmod")
    every = own.union(nested)
    total = every.groupBy("site").agg(F.count("*").alias("found"))
    ok = request_gate(every.withColumnRenamed("site", "base_url")).filter("reject_reason is null")
    first = ok.groupBy(F.col("base_url").alias("site"), "safe_url").agg(F.min(F.struct("child", "ord", "lastmod")).alias("x"))
    ranked = first.withColumn("ord", F.row_number().over(W.partitionBy("site").orderBy("x.child", "x.ord")) - 1).filter(F.col("ord") < most)
    kept = ranked.groupBy("site").agg(F.count("*").alias("kept")).join(total, "site").select("site", ((F.col("found") > F.col("kept")) & (F.col("kept") == most)).alias("truncated"))
    return ranked.join(kept, "site").select("site", "ord", F.col("safe_url").alias("url"), "x.lastmod", "truncated")


def map_site(sitemap: DataFrame, home_links: DataFrame, most: int = 500) -> DataFrame:
    """``(site, ord, url, source)``: a site's URLs, sitemap before home page, the first of each key, ``most`` a site.

    ``sitemap`` and ``home_links`` are ``(site, ord, url)``.
    """
    both = sitemap.select("site", F.lit("sitemap").alias("source"), F.lit(0).alias("rank"), "ord", "url").union(home_links.select("site", F.lit("home"), F.lit(1), "ord", "url"))
    keyed = both.withColumn("key", urls.url_dedup_key(F.col("url"))).filter("key <> ''")
    first = keyed.groupBy("site", "key").agg(F.min(F.struct("rank", "ord", "url", "source")).alias("x"))
    return first.withColumn("ord", F.row_number().over(W.partitionBy("site").orderBy("x.rank", "x.ord")) - 1).filter(F.col("ord") < most).select("site", "ord", "x.url", "x.source")


def map_counters(sitemap: DataFrame, home_links: DataFrame, most: int = 500) -> DataFrame:
    """``(site, sitemap, home, feeds, truncated)`` of :func:`map_site`: the addresses that each source brought in, repeats of
    known ones included, up to the one that found the map full; feeds among the home page's links by address."""
    both = sitemap.select("site", F.lit(0).alias("rank"), "ord", "url").union(home_links.select("site", F.lit(1), "ord", "url")).withColumn("key", urls.url_dedup_key(F.col("url")))
    order = W.partitionBy("site").orderBy("rank", "ord")
    once = both.withColumn("new", (F.col("key") != "") & (F.row_number().over(W.partitionBy("site", "key").orderBy("rank", "ord")) == 1))
    before = F.coalesce(F.sum(F.col("new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = once.withColumn("full", before >= most)
    feeds = home_links.filter(is_feed_url(F.col("url"))).groupBy("site").agg(F.countDistinct("url").alias("feeds"))
    out = told.groupBy("site").agg(F.count_if((F.col("rank") == 0) & ~F.col("full")).alias("sitemap"), F.count_if((F.col("rank") == 1) & ~F.col("full")).alias("home"), F.bool_or("full").alias("truncated"))
    return out.join(feeds, "site", "left").select("site", "sitemap", "home", F.coalesce("feeds", F.lit(0)).alias("feeds"), "truncated")


def is_feed_url(url: Column) -> Column:
    return url.rlike(r"(?i)[.](atom|ics|rss)([?#]|$)|/(atom|feed|rss)([/?#]|$)")


def normalise_results(raw: DataFrame, most: int = 3) -> DataFrame:
    """``(query, ord, title, snippet, url, injection_filtered)`` of ``raw (query, ord, title, snippet, url)``.

    Unsafe URLs and repeats are dropped, snippets cut to 300; title and snippet are tested as one text, and a
    result that fails keeps its URL alone.
    """
    safe = raw.filter(urls.is_safe_http_url(F.col("url")))
    first = safe.groupBy("query", "url").agg(F.min_by(F.struct("ord", F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("snippet", F.lit("")), 1, SNIPPET_CHARS).alias("snippet")), "ord").alias("r"))
    top = first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("r.ord"))).filter(F.col("rank") <= most)
    bad = F.size(guard.signals(F.concat("r.title", F.lit("\n"), "r.snippet"))) > 0
    told = top.withColumn("injection_filtered", bad)
    shown = lambda n: F.when(F.col("injection_filtered"), "").otherwise(F.col(f"r.{n}")).alias(n)
    return told.select("query", (F.col("rank") - 1).alias("ord"), shown("title"), shown("snippet"), "url", "injection_filtered")


#: Where the search pages of common platforms are, in the order they are tried.
SEARCH_PAGES = (("wordpress", "/?s={q}"), ("generic", "/search?q={q}"), ("squarespace", "/search?q={q}&f_collectionId="), ("drupal-ish", "/search/node?keys={q}"), ("query-param", "/search/?query={q}"))


def search_urls(queries: DataFrame) -> DataFrame:
    """``queries (base_url, query)`` times the search pages: ``(base_url, query, rank, platform, url)``; empty queries have none."""
    base, term = F.regexp_replace("base_url", "/+$", ""), F.replace(F.url_encode(guard.trim(F.col("query"))), F.lit("+"), F.lit("%20"))
    for mark in "!'()~":
        term = F.replace(term, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    pages = [F.struct(F.lit(k).alias("rank"), F.lit(n).alias("platform"), F.concat(base, F.lit(t.split("{q}")[0]), term, F.lit(t.split("{q}")[1])).alias("url")) for k, (n, t) in enumerate(SEARCH_PAGES)]
    return queries.filter(guard.trim(F.col("query")) != "").select("base_url", "query", F.explode(F.array(*pages)).alias("p")).select("base_url", "query", "p.*")


_RESULT = ArrayType(StructType([StructField("text", StringType()), StructField("url", StringType())]))


@F.arrow_udf(_RESULT)
def result_links(markdown: pa.Array, base_url: pa.Array) -> pa.Array:
    out = [[{"text": t, "url": u} for t, u in L.result_links(m or "", b or "")] for m, b in zip(markdown.to_pylist(), base_url.to_pylist())]
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())])))


def search_site(queries: DataFrame, answers: DataFrame, most: int = 25) -> DataFrame:
    """``(base_url, query, platform, ord, url)``: results from the first search page that has any.

    ``answers (url, ok, reason, markdown)`` is what the search pages gave; a refusal by policy or quarantine stops
    the search, so later pages don't count.
    """
    tried = search_urls(queries).join(answers.select("url", "ok", "reason", "markdown"), "url", "left")
    stop = tried.filter(~F.col("ok") & F.col("reason").isin("blocked", "quarantined")).groupBy("base_url", "query").agg(F.min("rank").alias("stop"))
    live = tried.filter("ok").join(stop, ["base_url", "query"], "left").filter("stop is null or rank < stop")
    found = live.withColumn("r", result_links("markdown", F.regexp_replace("base_url", "/+$", ""))).filter(F.size("r") > 0)
    first = found.groupBy("base_url", "query").agg(F.min_by(F.struct("platform", "r"), "rank").alias("x"))
    rows = first.select("base_url", "query", "x.platform", F.posexplode("x.r").alias("ord", "l")).withColumn("key", urls.url_dedup_key(F.col("l.url"))).filter("key <> ''")
    once = rows.groupBy("base_url", "query", "platform", "key").agg(F.min(F.struct("ord", "l.url")).alias("y"))
    return once.withColumn("ord", F.row_number().over(W.partitionBy("base_url", "query").orderBy("y.ord")) - 1).filter(F.col("ord") < most).select("base_url", "query", "platform", "ord", "y.url")


def site_operand(site: Column) -> Column:
    """``site:`` operand of a search: a bare host."""
    said = guard.trim(site)
    return F.coalesce(urls.host_of(F.when(said.contains("://"), said).otherwise(F.concat(F.lit("https://"), said))), said)
