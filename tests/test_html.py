"""Tree building, Markdown, selectors, images, structured data and links of single pages."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.config import CrawlConfig, from_env
from pagewright.functions import whatwg
from pagewright.functions.text import unescape_js
from pagewright.functions.urls import dedup_key
from pagewright.html import jsonld, links, markdown, tree
from pagewright.html.select import select
from pagewright.operators import pages
from pagewright.operators.pages import decode_body, parse_page

MD = [
    ("<h2>Top <em>x</em></h2><p>one<p>two", "## Top *x*\n\none\n\ntwo"),
    ("<ul><li>a<li></li><li>b</ul><ol><li>c<li> <li>d</ol>", "- a\n- b\n\n1. c\n3. d"),
    ("<table><tr><th>A<th>B<tr><td>1|2<td><b>x</b><tr><td><tr><td>3</table>", "| A | B |\n| --- | --- |\n| 1\\|2 | **x** |\n| 3 |  |"),
    ("<table><tr><td>solo<td>row</table>", "solo row"),
    ("<pre>a\n  b </pre><hr><blockquote>q</blockquote>", "```\na\n  b\n```\n\n---\n\n> q"),
    ("<p><a href=/x>go</a> <a>no</a> <img src=i.png alt='a_b'> <img src='data:x' data-src=real.png> <img src='data:x' alt=z>", "[go](/x) no ![a\\_b](i.png) ![](real.png) z"),
    ("<nav>no</nav><main><p>yes<script>1</script><aside>no</aside></main><p>after", "yes"),
    ("<p>*a* _b_ [c] `d` \\e", "\\*a\\* \\_b\\_ \\[c\\] \\`d\\` \\\\e"),
    ("<div>bare<span> run</span><br>x <code>y</code></div>", "bare\n\nrun\n\nx\n\ny"),
    ("", ""),
]


@pytest.mark.parametrize("html, want", MD)
def test_markdown(html, want):
    assert markdown.to_markdown(tree.parse(html)) == want


def test_markdown_cap_and_votes():
    long = "This paragraph is long enough to be prose, surely."
    page = f"<div id=side><p>{long[:30]}</p></div><div id=main><p>{long}</p><p>{long}</p></div>"
    assert markdown.main_region(tree.parse(page)).attrs["id"] == "main"
    assert markdown.to_markdown(tree.parse("<p>" + "y" * 50), 10) == "y" * 10 + "\n[TRUNCATED]"
    linked = f"<div><p><a href=x>{long}</a></p><p><a href=x>{long}</a></p></div>"
    assert markdown.main_region(tree.parse(linked)).name == "body"


TREES = [
    ("<p><b>one<p>two</b>three", "<p><b>one</b></p><p><b>two</b>three</p>"),
    ("<b><i>x</b>y</i>z", "<b><i>x</i></b><i>y</i>z"),
    ("<table><tr><td>a</table>b", "<table><tbody><tr><td>a</td></tr></tbody></table>b"),
    ("<table>oops<tr><td>a</table>", "oops<table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<a href=1>x<a href=2>y", "<a>x</a><a>y</a>"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<p>a<div>b</p>c", "<p>a</p><div>b<p></p>c</div>"),
    ("x<script>if(a<b)'</p>'</script>y", "x<script>if(a<b)'</p>'</script>y"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("a<!-- <p> -->b<?x?>c</nope>d", "abcd"),
]


def shown(node: tree.Node) -> str:
    return node.text if not node.name else f"<{node.name}>" + "".join(map(shown, node.children)) + ("" if node.name in tree.VOID else f"</{node.name}>")


@pytest.mark.parametrize("html, want", TREES)
def test_tree(html, want):
    body = next(tree.parse(html).elements("body"))
    assert "".join(map(shown, body.children)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> </b> <table> <tr> <td> </table> <li> <ul> </ul> <a> </a> <i> </i> <h1> </h1> <div> </div> x <form> </form> <select> <option> <svg/> < & </body> <head> <title> <!--".split()), max_size=25))
def test_any_tags_give_a_sound_tree(parts):
    doc = tree.parse(" ".join(parts))
    names = [n.name for n in doc.elements("html", "head", "body")]
    assert names.count("html") == names.count("body") == 1
    for n in doc.walk():
        assert n in n.parent.children
    markdown.to_markdown(doc)


def test_select():
    doc = tree.parse("<div class='a b' id=k><p>1</p><p data-x='yz'>2</p><span><p>3</p></span></div><p>4")
    pick = lambda s: [n.string() for n in select(doc, s)]
    assert pick(".a > p") == ["1", "2"] and pick("#k p") == ["1", "2", "3"] and pick("p[data-x^=y]") == ["2"] and pick("p + p") == ["2"]
    assert pick("p:first-child") == ["1", "3"] and pick("div p:nth-child(2)") == ["2"] and pick("p:not([data-x]), span") == ["1", "3", "3", "4"] and pick("div.b.a ~ p") == ["4"]
    with pytest.raises(ValueError):
        select(doc, "p::before(")


def test_images():
    page = "<img src=a.jpg width=100><article><img src=/p.jpg width=700 height=800 alt='A long enough text'></article><img src=x.gif><img src=/event-poster.png><img src=b.jpg alt=b>"
    assert markdown.content_images(tree.parse(page), "https://a.com/d/") == [("https://a.com/p.jpg", "A long enough text", 21), ("https://a.com/event-poster.png", "", 4), ("https://a.com/d/b.jpg", "b", 1)]


def test_events_and_addresses():
    read = lambda *v: jsonld.load([json.dumps(x) for x in v])
    one = {"@type": "Event", "name": "x", "startDate": "2026-13-01", "offers": {"price": " "}, "performer": {"name": "p"}, "location": [{"name": "v"}], "image": {"url": "javascript:1"}}
    assert jsonld.only_event(read(one)) == {"event_name": "x", "date_text": None, "venue_name": "v", "price_text": None, "lineup": ["p"], "description": None, "image_url": None}
    assert jsonld.only_event(read(one, one)) is None and len(jsonld.events(read({"a": [one, {"b": one}]}))) == 2
    prices = [("0", "Free"), (0, "Free"), (["5", 7.5], "$5-$7.5"), (["0", "3"], "$0-$3"), ([None, "x"], None), ("12.50", "$12.5")]
    for p, want in prices:
        each = p if isinstance(p, list) else [p]
        assert jsonld.price_text([{"price": x} for x in each]) == want
    assert jsonld.address_line(jsonld.address(read({"x": {"streetAddress": " 1 A ", "postalCode": "9"}}))) == "1 A, 9"
    assert jsonld.load(["{bad", "1", "NaN"]) == [1]


def test_summary_bounds():
    deep: dict = {"@type": "Deep"}
    for _ in range(12):
        deep = {"x": deep}
    assert jsonld.summarize([deep])["node_count"] == 0
    assert jsonld.summarize([[{"@type": "T"}] * 900])["node_count"] == 501
    got = jsonld.summarize([{"@type": ["http://schema.org/WebPage", "Recipe", 3], "about": {"@type": "a#B"}}])
    assert got == {"types": ["B", "Recipe", "WebPage"], "content_types": ["B", "Recipe"], "node_count": 2, "has_content_data": True}


URLS = [
    ("HTTPS://User:p@EXAMPLE.com:443/a/../b/./c?x y#f g", None, "https://User:p@example.com/b/c?x%20y#f%20g"), ("../x?q", "https://a.com/b/c/d", "https://a.com/b/x?q"), ("//c.com", "http://a.com/b", "http://c.com/"), ("?z", "http://a.com/b?y#f", "http://a.com/b?z"),
    ("#g", "http://a.com/b?y#f", "http://a.com/b?y#g"), ("http:/a.com", None, "http://a.com/"), ("https://0x7f.1/", None, "https://127.0.0.1/"), ("https://münchen.de/ü", None, "https://xn--mnchen-3ya.de/%C3%BC"), ("mailto:a@b", None, "mailto:a@b"),
    ("https://[::1]:8080/", None, "https://[::1]:8080/"), ("https://a b/", None, None), ("x", None, None), ("https://a.com:99999/", None, None), ("\\x\\y", "https://a.com/", "https://a.com/x/y"), ("https://300.1.1.1/", None, None),
]


@pytest.mark.parametrize("raw, base, want", URLS)
def test_url_parsing(raw, base, want):
    got = whatwg.parse(raw, base and whatwg.parse(base))
    assert (got and str(got)) == want


KEYS = [("https://A.com/x/", "a.com/x"), ("http://a.com:80/x?b=2&a=1&utm_source=q&FBCLID=1#f", "a.com/x?a=1&b=2"), ("https://a.com:8443/", "a.com:8443"), ("https://a.com/%7Ex?q=a+b", "a.com/%7ex?q=a b"), ("Not A Url#x", "not a url"), ("", ""), ("https://a.com/a/../b", "a.com/b")]


def test_dedup_keys(spark):
    from pagewright.functions.urls import url_dedup_key
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(KEYS)], "k int, u string").select("k", url_dedup_key(F.col("u")).alias("key")).orderBy("k").collect()
    assert [r.key for r in got] == [w for _, w in KEYS] == [dedup_key(u) for u, _ in KEYS]


def test_links():
    assert links.next_page('<a class=x rel="prev next" href="/2">', "https://a.com/1") == "https://a.com/2"
    assert links.next_page('<a href="/3"><i>Load</i>  More</a>', "https://a.com/1") == "https://a.com/3"
    assert links.next_page('<a rel=next href="javascript:x()">', "https://a.com/") is None and links.next_page("<a href='/x'>Nextel</a>", "https://a.com/") is None
    assert links.declared_feeds('<link rel="alternate" type="application/rss+xml" href="/r"><link rel=alternate href="c.ics">', "https://a.com/d/") == ["https://a.com/d/c.ics"]
    assert len(links.guessed_feeds("https://a.com/x")) == 7 and links.guessed_feeds("x") == []
    md = "[A good result](/p/1) [Home](/h) [Search again now](/search?q=2) [Other site here](https://b.com/x) [An asset file](/a.css)"
    assert links.result_links(md, "https://a.com") == [("A good result", "https://a.com/p/1")]
    assert links.reader_text("Title: T\n\nMarkdown Content:\n" + "x " * 150)[0] == "T" and links.reader_text("Title: Just a moment\n" + "x " * 300) is None


def test_recipes():
    doc = tree.parse("<div class=i><b>A</b><a href=/1>x</a></div><div class=i><b>B</b></div><div class=i></div>")
    recipe = {"version": 1, "itemSelector": ".i", "fields": {"n": {"selector": "b"}, "l": {"selector": "a", "attr": "href"}}}
    assert links.apply_recipe(doc, recipe) == [{"n": "A", "l": "/1"}, {"n": "B", "l": None}]
    assert links.apply_recipe(doc, recipe | {"requiredField": "l"}) is None and links.apply_recipe(doc, recipe | {"itemSelector": "::("}) is None
    assert links.parse_recipe(json.dumps(recipe)) == recipe and links.parse_recipe({"version": 2}) is None and links.parse_recipe("{") is None


def test_page_parts():
    got = parse_page("https://www.a.com/d/", "<title> A &amp; B </title><body><nav>x</nav><a href='../y'>Y</a><a href='https://a.com/z'>Z</a><a href='http://o.com'>O</a><a href='mailto:x'>M</a><script>s</script> t", CrawlConfig())
    assert got["title"] == "A & B" and got["visible"] == "xYZOM t" and got["links"] == [{"url": "https://www.a.com/y", "text": "Y"}, {"url": "https://a.com/z", "text": "Z"}] and got["outbound_hosts"] == ["o.com"]
    assert parse_page(None, None, CrawlConfig()) is None


def test_decoding():
    assert decode_body("é".encode("cp1252"), "text/html; charset=ISO-8859-1") == "é"
    assert decode_body('<meta charset="windows-1252">\x80'.encode("latin-1"), None).endswith("€")
    assert decode_body("é".encode(), "text/html; charset=nonsense") == "é"
    assert unescape_js('caf\\u00e9 \\"x\\" a\\/b \\ud83d\\ude00') == 'café "x" a/b 😀'


def test_config():
    c = from_env({"FIRECRAWL_API_KEY": "abcdefgh", "SERPER_API_KEY": "short", "PAGEWRIGHT_SEARCH_ORDER": "tavily, serper", "TAVILY_API_KEY": "long enough"}, max_pages=9)
    assert c.vendor_rungs() == ["firecrawl"] and c.search_providers() == ["tavily"] and c.max_pages == 9
    assert not c.has_contact() and CrawlConfig(user_agent="x (+https://y)").has_contact()


DEEP = 100_000


@pytest.mark.parametrize("html", ["<div>" * DEEP + "x", "<b>" * DEEP + "x" + "</b>" * DEEP, "<p>" + "<span>" * DEEP + "x" + "</foo>" * DEEP, "".join(f"<b id={i}>" for i in range(DEEP)) + "x", "".join(f"<p><b id={i}>x</p>" for i in range(3000)), "<table>" + "<b>x" * DEEP, "<ul><li>" * DEEP + "x", "<form>" * DEEP + "x", "<b><div></b>" * 5000 + "x"], ids=range(9))
def test_deep_pages_are_read_in_time(html):
    import time

    began = time.process_time()
    page = pages.parse_page("https://a.example/", html, CrawlConfig())
    assert "x" in page["visible"] and time.process_time() - began < 30


def test_depth_is_that_of_browsers():
    at, depth = tree.parse("<div>" * 2000 + "x"), 0
    while at.children:
        at, depth = at.children[-1], depth + 1
    assert depth <= tree.MOST_DEPTH + 2


def test_a_page_that_fails_leaves_the_others(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "https://a.example/", "<title>a</title>"), (2, "https://a.example/", None), (3, "https://a.example/", "<div>" * 30_000 + "<p>deep")], "id int, url string, html string")
    got = {r.id: r.p for r in rows.select("id", pages.parse_udf()("url", "html").alias("p")).collect()}
    assert got[1].title == "a" and got[2] is None and got[3].markdown == "deep" and got[1].error is None
    monkeypatch.setattr(pages, "parse_page", lambda *a: 1 / 0)
    assert pages.parsed_or_error("u", "<p>", CrawlConfig()) == {"error": "ZeroDivisionError: division by zero"}


def test_a_batch_is_read_in_pieces(monkeypatch):
    """What is made of the first rows is handed over before the last ones are read, however many a batch has."""
    import pyarrow as pa

    read = []
    monkeypatch.setattr(pages, "parse_page", lambda url, html, config: read.append(url) or {"title": url})
    names, page = [f"u{k}" for k in range(200)], "<p>" + "x" * 50_000
    out = pages.parse_udf().func(iter([(pa.array([*names, None]), pa.array([page] * 200 + [None])), (pa.array(["last"]), pa.array(["y" * 5_000_000]))]))
    first = next(out)
    assert len(first) == len(read) < 30
    rest = [x for piece in out for x in piece.field("title").to_pylist()]
    assert first.field("title").to_pylist() + rest == [*names, None, "last"] == read


def test_rows_without_a_recipe_are_left_out(spark):
    rows = spark.createDataFrame([("a", "<ul><li>1<li>2</ul>"), ("b", "<ul><li>1</ul>"), ("c", None)], "url string, html string")
    got = pages.recipe_rows(rows, {"itemSelector": "li", "fields": {"n": {"selector": ""}}}).collect()
    assert [(r.url, r.ord, r.draft) for r in got] == [("a", 0, {"n": "1"}), ("a", 1, {"n": "2"})]


def test_a_read_page_is_freed_at_once():
    """Trees, whose nodes know their parents, don't wait for the garbage collector."""
    import gc

    alive = lambda: sum(isinstance(x, tree.Node) for x in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        before = alive()
        assert parse_page("https://a.example/", "<title>t</title><ul><li><a href=/b>b</a><li><p>c<table><tr><td>d</table></ul>", CrawlConfig())["title"] == "t"
        assert alive() == before
    finally:
        gc.enable()


def test_urls_that_were_read_are_not_kept():
    """A worker that lives on remembers a few short URLs, however many links it has read."""
    import weakref

    page = whatwg.parse("https://a.example/dir/page")
    seen = [weakref.ref(whatwg.parse(f"link{k}", page)) for k in range(2000)] + [weakref.ref(whatwg.parse(f"https://a.example/{k}")) for k in range(2000)]
    seen += [weakref.ref(whatwg.parse(f"https://a.example/{k}?" + "x" * 5000)) for k in range(9)]
    assert sum(x() is not None for x in seen) <= 1000
    assert whatwg.parse("https://a.example/dir/page") == page and str(whatwg.parse("../x?y#z", page)) == "https://a.example/x?y#z"
