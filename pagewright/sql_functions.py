"""Table functions for SQL: ``register(spark)``, then ``SELECT ... FROM pages, LATERAL page_links(url, html)``."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DIFF_BLOCKS, CrawlConfig
from .html import jsonld, links, markdown, tree
from .operators.pages import page_links


class PageLinks:
    def eval(self, url: str, html: str) -> Iterator[tuple]:
        if html is not None:
            own, _ = page_links(tree.parse(html), url or "", CrawlConfig())
            yield from ((k, x["url"], x["text"]) for k, x in enumerate(own))


class PageImages:
    def eval(self, url: str, html: str) -> Iterator[tuple]:
        if html is not None:
            yield from ((k, *x) for k, x in enumerate(markdown.content_images(tree.parse(html), url or "")))


class PageEvents:
    def eval(self, html: str) -> Iterator[tuple]:
        if html is None:
            return
        scripts = [s.string() for s in tree.parse(html).elements("script") if s.attrs.get("type") == "application/ld+json"]
        for k, e in enumerate(jsonld.events(jsonld.load(scripts))):
            yield k, e["event_name"], e["date_text"], e["venue_name"], e["price_text"]


class RecipeRows:
    def eval(self, html: str, recipe: str) -> Iterator[tuple]:
        known = links.parse_recipe(recipe)
        for k, row in enumerate(links.apply_recipe(tree.parse(html), known) or [] if html is not None and known else []):
            yield k, json.dumps(row, ensure_ascii=False)


class TextDiff:
    """Blocks that came or went, each as often as that; see ``operators.change.diff_content``."""

    def eval(self, previous: str, current: str) -> Iterator[tuple]:
        import re

        split = lambda t: [b for b in map(markdown.strip, re.split("\n{2,}", t or "")) if b][:DIFF_BLOCKS]
        old, new = split(previous), split(current)
        for kind, own, other in (("added", new, old), ("removed", old, new)):
            left = Counter(other)
            for block in own:
                if left[block]:
                    left[block] -= 1
                else:
                    yield kind, block


TABLES = {
    "page_links": (PageLinks, "ord int, url string, text string"), "page_images": (PageImages, "ord int, url string, alt string, score int"),
    "page_events": (PageEvents, "ord int, event_name string, date_text string, venue_name string, price_text string"), "recipe_rows": (RecipeRows, "ord int, draft string"), "text_diff": (TextDiff, "kind string, block string"),
}


def register(spark: SparkSession) -> None:
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
