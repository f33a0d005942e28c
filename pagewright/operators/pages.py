"""Page records: one parse of each page for all that needs a tree, the rest in SQL expressions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..config import EXTRACTOR_VERSION, CrawlConfig
from ..functions import guard, text, whatwg
from ..functions.arrow import by_row
from ..html import jsonld, links, markdown, tree

LINKS = "array<struct<url:string,text:string>>"
IMAGES = "array<struct<url:string,alt:string,score:int>>"
SUMMARY = "struct<types:array<string>,content_types:array<string>,node_count:int,has_content_data:boolean>"
PARSED = f"title string, markdown string, visible string, links {LINKS}, outbound_hosts array<string>, json_ld array<string>, images {IMAGES}, structured_data {SUMMARY}, error string"
_ARROW = pa.struct([
    ("title", pa.string()), ("markdown", pa.string()), ("visible", pa.string()), ("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))), ("outbound_hosts", pa.list_(pa.string())),
    ("json_ld", pa.list_(pa.string())), ("images", pa.list_(pa.struct([("url", pa.string()), ("alt", pa.string()), ("score", pa.int32())]))),
    ("structured_data", pa.struct([("types", pa.list_(pa.string())), ("content_types", pa.list_(pa.string())), ("node_count", pa.int32()), ("has_content_data", pa.bool_())])), ("error", pa.string()),
])
_HIDDEN = frozenset(("noscript", "script", "style", "template"))


def bare(host: str) -> str:
    return host.removeprefix("www.")


def page_links(doc: tree.Node, url: str, config: CrawlConfig) -> tuple[list[dict], list[str]]:
    """Same-site links in document order and the other hosts linked to."""
    base = whatwg.parse(url)
    home = bare(base.host) if base else ""
    own, other = [], {}
    for a in doc.elements("a"):
        to = whatwg.parse(a.attrs["href"], base) if a.attrs.get("href") and not any(x.name in _HIDDEN for x in a.ancestors()) else None
        if to is None or to.scheme not in ("http", "https"):
            continue
        if bare(to.host) == home:
            if len(own) < config.max_links:
                own.append({"url": str(to), "text": markdown.strip(a.string(_HIDDEN))[:200]})
        elif len(other) < config.max_outbound:
            other[to.host] = None
    return own, list(other)


def parse_page(url: str | None, html: str | None, config: CrawlConfig) -> dict | None:
    """What a page's tree tells; None without HTML."""
    if html is None:
        return None
    with tree.parsed(html) as doc:
        title = next(doc.elements("title"), None)
        scripts = [s.string() for s in doc.elements("script") if s.attrs.get("type") == "application/ld+json"]
        found = jsonld.load(scripts)
        own, other = page_links(doc, url or "", config)
        return {
            "title": markdown.strip(title.string()) or None if title else None, "markdown": markdown.to_markdown(doc, config.max_text_chars), "visible": markdown.squeeze(next(doc.elements("body")).string(_HIDDEN)), "links": own, "outbound_hosts": other,
            "json_ld": [json.dumps(v, ensure_ascii=False) for v in found], "images": [dict(zip(("url", "alt", "score"), i)) for i in markdown.content_images(doc, url or "")], "structured_data": jsonld.summarize(found),
        }


def parsed_or_error(url: str | None, html: str | None, config: CrawlConfig) -> dict | None:
    """:func:`parse_page`; a page that it can't read has only an ``error``, so that one page never ends a job."""
    try:
        return parse_page(url, html, config)
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"[:200]}


def parse_udf(config: CrawlConfig = CrawlConfig()):
    """An Arrow function ``(url, html) -> struct`` of all tree-derived columns, with the ``error`` of a page that fails."""
    return by_row(lambda url, html: parsed_or_error(url, html, config), StructType.fromDDL(PARSED), _ARROW)


def build_pages(fetched: DataFrame, config: CrawlConfig = CrawlConfig(), rung: str = "fetch") -> DataFrame:
    """One record for each row of ``fetched (url, html[, content_type, etag, last_modified])``; other columns are kept.

    ``quarantine`` holds signals, safe text and title of a page whose title, text or Markdown (the first that
    does) shows prompt injection; its other fields are then null. A null html gives a null record.
    """
    have = set(fetched.columns)
    extra = [c for c in fetched.columns if c not in ("url", "html", "content_type", "etag", "last_modified")]
    col = lambda c, d=None: F.col(c) if c in have else F.lit(d).cast("string")
    base = fetched.select(*extra, "url", "html", col("content_type", "text/html").alias("content_type"), col("etag").alias("http_etag"), col("last_modified").alias("http_last_modified"))
    df = base.withColumn("p", parse_udf(config)("url", "html"))
    df = df.select("*", F.col("p.title").alias("_title"), F.col("p.markdown").alias("_markdown"), F.col("p.visible").alias("_visible"))
    thin = text.is_thin(F.col("_visible"))
    df = df.withColumn("_recovered", F.when(thin, text.script_content(F.col("html"))))
    df = df.withColumn("_visible", F.when(F.length("_recovered") > F.length("_visible"), F.col("_recovered")).otherwise(F.col("_visible")))
    for name in ("title", "visible", "markdown"):
        df = df.withColumn(f"_{name}_safe", guard.sanitized(F.col(f"_{name}"), config.max_text_chars))
    raised = lambda name: F.size(f"_{name}_safe.signals") > 0
    evidence = lambda name, title: F.struct(F.col(f"_{name}_safe.signals").alias("signals"), F.col(f"_{name}_safe.text").alias("text"), title.alias("title"))
    quarantine = F.when(raised("title"), evidence("title", F.lit(None).cast("string"))).when(raised("visible"), evidence("visible", F.col("_title"))).when(raised("markdown"), evidence("markdown", F.col("_title")))
    ok = F.col("html").isNotNull() & F.col("quarantine").isNull()
    keep = lambda c, name: F.when(ok, c).alias(name)
    df = df.withColumn("quarantine", quarantine)
    page_text, page_markdown = F.col("_visible_safe.text"), F.col("_markdown_safe.text")
    shown = [F.col("html")] if config.include_html else []
    return df.select(
        *extra, "url", keep(page_text, "text"), keep(page_markdown, "markdown"), keep(F.lit("html"), "content_kind"), keep(text.looks_like_empty_state(F.when(page_markdown != "", page_markdown).otherwise(page_text)), "likely_empty_state"),
        keep(F.col("p.images"), "candidate_content_images"), keep(F.lit(EXTRACTOR_VERSION), "extractor_version"), keep(F.col("_visible_safe.redaction_count") + F.col("_markdown_safe.redaction_count"), "redaction_count"),
        keep(F.col("_visible_safe.truncated") | F.col("_markdown_safe.truncated"), "truncated"), keep(F.col("_title"), "title"), *shown, "content_type", keep(F.sha2("html", 256), "body_sha256"), keep(text.region_hash(F.col("html")), "content_region_sha256"),
        keep(F.sha2(page_text, 256), "text_sha256"), "http_etag", "http_last_modified", keep(F.col("p.json_ld"), "json_ld"), keep(F.col("p.structured_data"), "structured_data"), keep(F.col("p.outbound_hosts"), "outbound_hosts"), keep(F.col("p.links"), "links"),
        keep(F.lit("own"), "lane"), keep(F.lit(rung), "rung"), "quarantine",
    )


def build_text_pages(rows: DataFrame, rung: str, lane: str = "own") -> DataFrame:
    """Records of bodies that aren't HTML, from ``rows (url, text, content_kind, content_type[, title, markdown])``.

    What only HTML can tell is empty rather than made up: no links, no structured data, no region hash.
    """
    have = set(rows.columns)
    none = F.lit(None).cast("string")
    empty = lambda kind: F.array().cast(kind)
    digest = F.sha2("text", 256)
    summary = F.struct(empty("array<string>").alias("types"), empty("array<string>").alias("content_types"), F.lit(0).alias("node_count"), F.lit(False).alias("has_content_data"))
    return rows.select(
        "url", "text", (F.coalesce("markdown", F.lit("")) if "markdown" in have else F.lit("")).alias("markdown"), "content_kind", text.looks_like_empty_state(F.col("text")).alias("likely_empty_state"), empty(IMAGES).alias("candidate_content_images"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.lit(0).alias("redaction_count"), F.lit(False).alias("truncated"), (F.col("title") if "title" in have else none).alias("title"), "content_type", digest.alias("body_sha256"), F.lit("").alias("content_region_sha256"),
        digest.alias("text_sha256"), none.alias("http_etag"), none.alias("http_last_modified"), empty("array<string>").alias("json_ld"), summary.alias("structured_data"), empty("array<string>").alias("outbound_hosts"), empty(LINKS).alias("links"),
        F.lit(lane).alias("lane"), F.lit(rung).alias("rung"), F.lit(None).cast("struct<signals:array<struct<id:string,severity:string,label:string,match:string>>,text:string,title:string>").alias("quarantine"),
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """``(src, ord, dst, text)``: a row for each link of each record."""
    return pages.select(F.col("url").alias("src"), F.posexplode("links").alias("ord", "l")).select("src", "ord", F.col("l.url").alias("dst"), "l.text")


_EVENT = "event_name string, date_text string, venue_name string, price_text string, lineup array<string>, description string, image_url string"


def jsonld_udf(what: str):
    """Arrow functions over ``array<string>`` of scripts: ``events``, ``event``, ``address`` or ``summary``."""
    event = pa.struct([(n.split()[0], pa.list_(pa.string()) if "array" in n else pa.string()) for n in _EVENT.split(", ")])
    place = "street_address string, city string, state string, postal_code string"
    reader, ddl, kind = {
        "events": (jsonld.events, f"v array<struct<{_EVENT.replace(' ', ':')}>>".replace(",:", ","), pa.list_(event)),
        "event": (jsonld.only_event, f"v struct<{_EVENT.replace(' ', ':')}>".replace(",:", ","), event),
        "address": (jsonld.address, f"v struct<{place.replace(' ', ':')}>".replace(",:", ","), pa.struct([(n.split()[0], pa.string()) for n in place.split(", ")])),
        "summary": (jsonld.summarize, f"v {SUMMARY}", _ARROW.field("structured_data").type),
    }[what]
    read = lambda scripts: None if scripts is None else reader(jsonld.load([x for x in scripts if x is not None]))
    return by_row(read, StructType.fromDDL(ddl)[0].dataType, kind)


def recipe_rows(pages: DataFrame, recipe: dict) -> DataFrame:
    """``(url, ord, draft map<string,string>)`` of the rows that a recipe reads from ``pages (url, html)``."""
    def read(html: str | None) -> list[list[tuple]] | None:
        if html is None:
            return None
        with tree.parsed(html) as doc:
            found = links.apply_recipe(doc, recipe)
        return None if found is None else [list(d.items()) for d in found]

    rows = by_row(read, StructType.fromDDL("v array<map<string,string>>")[0].dataType, pa.list_(pa.map_(pa.string(), pa.string())))
    return pages.select("url", F.posexplode(rows("html")).alias("ord", "draft"))


def next_page_udf():
    return by_row(lambda html, url: None if html is None else links.next_page(html, url or ""), StringType(), pa.string())


def feeds_udf():
    """Calendar feed candidates of a page by rank: declared, embedded, guessed."""

    def find(html: str | None, url: str | None) -> list[dict]:
        ranked = (("declared", links.declared_feeds(html or "", url or "")), ("embedded", links.embedded_calendars(html or "")), ("guessed", links.guessed_feeds(url or "")))
        return [{"url": x, "source": s} for s, xs in ranked for x in xs]

    return by_row(find, StructType.fromDDL("v array<struct<url:string,source:string>>")[0].dataType, pa.list_(pa.struct([("url", pa.string()), ("source", pa.string())])))


def discover_feed(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(url, feed_url, source)``: each page's first candidate whose body in ``bodies (url, body)`` is a calendar."""
    ranked = pages.select("url", F.posexplode(feeds_udf()("html", "url")).alias("rank", "c")).select("url", "rank", F.col("c.url").alias("feed_url"), F.col("c.source").alias("source"))
    good = bodies.filter(text.looks_like_ics(F.col("body"))).select(F.col("url").alias("feed_url")).distinct()
    best = ranked.join(good, "feed_url").groupBy("url").agg(F.min_by(F.struct("feed_url", "source"), "rank").alias("b"))
    return pages.select("url").join(best, "url", "left").select("url", "b.feed_url", "b.source")


_CHARSETS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "utf8": "utf-8", "windows-1252": "cp1252", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030"}


_CP1252 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)}


def decode_body(body: bytes, content_type: str | None) -> str:
    """Text of a body by the charset of its header, else of its meta tag, else UTF-8."""
    import codecs
    import re

    m = re.search(r"""charset\s*=\s*["']?([\w-]+)""", content_type or "", re.I)
    m = m or re.search(r"""<meta[^>]+charset\s*=\s*["']?([\w-]+)""", body[:4096].decode("latin-1"), re.I)
    name = (m[1] if m else "utf-8").lower()
    try:
        codec = codecs.lookup(_CHARSETS.get(name, name)).name
    except LookupError:
        codec = "utf-8"
    if codec == "cp1252":  # the five bytes without a character stand for themselves
        return body.decode("latin-1").translate(_CP1252)
    return body.decode(codec, "replace").removeprefix("﻿")


def decode_udf():
    return by_row(lambda body, content_type: None if body is None else decode_body(body, content_type), StringType(), pa.string())
