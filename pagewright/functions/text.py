"""Text functions over raw HTML and crawled text, all SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guard import collapse, trim
from .urls import SPACE, arrow_text

#: Parts of a page around its content.
FURNITURE = ("nav", "header", "footer", "aside", "script", "style", "noscript")
_QUIET = ("script", "style", "noscript")


def _drop(html: Column, tags: tuple[str, ...]) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    return html


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    return collapse(F.regexp_replace(bare, "(?i)&nbsp;", " "))


def region_text(html: Column) -> Column:
    """Text of the first ``main``, else of the first ``article``; a page with neither, or an empty one, without its furniture."""
    inner = lambda tag: F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)
    has_main = html.rlike("(?is)<main\\b[^>]*>.*?</main>")
    region = F.when(has_main, inner("main")).otherwise(inner("article"))
    return F.when(region != "", strip_tags(_drop(region, _QUIET))).otherwise(strip_tags(_drop(html, FURNITURE)))


def region_hash(html: Column) -> Column:
    return F.sha2(region_text(html), 256)


#: What bot walls say.
WALL_PHRASES = (
    "access to this page has been denied", "attention required!?\\s*\\|\\s*cloudflare", "checking if the site connection is secure", "enable javascript and cookies to continue",
    "just a moment[.]{3}", "pardon our interruption", "request unsuccessful[.] incapsula incident", "verify(?:ing)? you are (?:a )?human", "why have i been blocked", "you have been rate[^\\n\\r]?limited",
)
_B = r"\b"
EMPTY_PHRASES = (
    f"{_B}404{_B}[^\\n\\r]{{0,20}}{_B}not found{_B}", f"{_B}check back (?:later|soon){_B}", f"{_B}coming soon{_B}", f"{_B}no (?:upcoming )?(?:events?|items?|listings?|performances?|results?|shows?){_B}",
    f"{_B}nothing (?:here|planned|scheduled|to show){_B}", f"{_B}page not found{_B}", f"{_B}(?:page |site )?under construction{_B}", f"{_B}this domain is (?:for sale|parked){_B}",
)


def looks_like_block_page(text: Column) -> Column:
    said = trim(text)
    return F.length(said).between(1, 2500) & said.rlike("(?i)" + "|".join(WALL_PHRASES))


def looks_like_empty_state(text: Column) -> Column:
    said = trim(text)
    return (F.length(said) < 30) | ((F.length(said) <= 600) & said.rlike("(?i)" + "|".join(EMPTY_PHRASES)))


def is_thin(text: Column, least: int = 400) -> Column:
    return F.length(collapse(text)) < least


def better_rendering(plain: Column, rendered: Column, least: int) -> Column:
    """The rendered text where the plain one is thin (``least`` over 0) and the rendered one is longer."""
    thin = F.lit(least > 0) & (F.length(trim(plain)) < least)
    return F.when(thin & (F.length(rendered) > F.length(plain)), rendered).otherwise(plain)


def looks_like_ics(body: Column) -> Column:
    return F.substring(body, 1, 4000).rlike("(?i)BEGIN:VCALENDAR")


def unescape_js(raw: str) -> str:
    """Escapes of a script string, one kind after the other."""
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), raw)
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for mark, plain in (("\\n", " "), ("\\t", " "), ("\\r", " "), ('\\"', '"'), ("\\/", "/"), ("\\\\", "\\")):
        text = text.replace(mark, plain)
    return text


_CODE = r"[=;{}]|\bconst\b|\bfunction\b|\breturn\b|\bvar\b|&&|\|\|"
_MONTHS = "apr|aug|dec|feb|jan|jul|jun|mar|may|nov|oct|sep"


def looks_like_content(value: Column) -> Column:
    """Prose, or something with a date, a price or a time; neither a path nor code."""
    said = trim(value)
    prose = said.rlike(f"[A-Za-z]{{2,}}{SPACE}+[A-Za-z]{{2,}}")
    told = said.rlike(rf"(?i)\b(19|20)[0-9]{{2}}\b|[$][0-9]|[0-9]{{1,2}}:[0-9]{{2}}|\b({_MONTHS})")
    return F.length(said).between(12, 400) & ~said.rlike(r"^(blob:|data:|https?:|[/_#.@{}\[\]])") & ~said.rlike(_CODE) & (prose | told)


def script_strings(html: Column) -> Column:
    """Content-like string literals of inline scripts, each once, the longest first."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    raw = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r'"((?:[^"\\]|\\[^\n\r]){12,400})"'), F.lit(1))))
    plain = F.transform(raw, lambda s: _unescape_native(s))
    said = F.array_distinct(F.filter(F.transform(plain, collapse), looks_like_content))
    return F.transform(F.array_sort(F.transform(said, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")))), lambda x: x["s"])


def _unescape_native(s: Column) -> Column:
    r"""As :func:`unescape_js`; ``\uXXXX`` goes through JSON, so pairs of surrogates join."""
    coded = F.regexp_replace(F.regexp_replace(s, r"\\(?!u[0-9a-fA-F]{4})", "\\\\\\\\"), r"[\x00-\x1f\"]", " ")
    read = F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), coded, F.lit('"]')), "array<string>"), F.lit(0)), s)
    text = F.when(s.contains("\\u"), read).otherwise(s)
    for mark, plain in ((r"\\[ntr]", " "), (r"\\\"", '"'), (r"\\/", "/"), (r"\\\\", r"\\")):
        text = F.regexp_replace(text, mark, plain)
    return text


def script_content(html: Column, most: int = 12_000) -> Column:
    """The strings of :func:`script_strings` on lines of their own, up to the first that doesn't fit."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def add(acc: Column, s: Column) -> Column:
        full = acc["done"] | (F.length(acc["out"]) + F.length(s) + 1 > most)
        return F.struct(F.when(full, acc["out"]).when(acc["out"] == "", s).otherwise(F.concat(acc["out"], F.lit("\n"), s)).alias("out"), full.alias("done"))

    return F.aggregate(script_strings(html), start, add, lambda acc: acc["out"])


unescape_js_udf = arrow_text(unescape_js)


def xml_unescape(text: Column) -> Column:
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def long_date(iso: Column) -> Column:
    """``August 21, 2026`` from the digits of an ISO date, whatever its zone; null for anything else."""
    part = lambda k: F.regexp_extract(iso, "^([0-9]{4})-([0-9]{2})-([0-9]{2})", k).try_cast("int")
    month = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.nullif(part(2), F.lit(0)))
    return F.when(month.isNotNull(), F.concat(month, F.lit(" "), part(3).cast("string"), F.lit(", "), F.regexp_extract(iso, "^([0-9]{4})", 1)))


def capture_time(stamp: Column) -> Column:
    """ISO time from the fourteen digits of an archive's stamp."""
    return F.when(stamp.rlike("^[0-9]{14}$"), F.regexp_replace(stamp, "^(.{4})(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z"))


def content_kind(mime: Column) -> Column:
    """What a content type is read as; null if it is refused."""
    kind = F.lower(trim(F.substring_index(mime, ";", 1)))
    return (
        F.when(kind.isin("application/xhtml+xml", "text/html"), "html").when(kind == "text/calendar", "calendar").when(kind == "text/csv", "csv").when(kind.isin("application/atom+xml", "application/rss+xml", "application/xml", "text/xml"), "feed")
        .when((kind == "application/json") | kind.endswith("+json"), "json").when(kind == "text/plain", "text").when(kind == "application/pdf", "pdf")
    )


def refine_kind(kind: Column, path: Column) -> Column:
    """Plain text is a calendar or a table where the path ends so."""
    low = F.lower(path)
    return F.when(kind != "text", kind).when(low.endswith(".ics"), "calendar").when(low.endswith(".csv"), "csv").otherwise(kind)


_FINAL_STATUS = r"\b(400|401|404|410|451)\b"


def failure_class(reason: Column, detail: Column) -> Column:
    """``structural`` where trying again can't help, else ``transient``."""
    said = F.coalesce(detail, F.lit(""))
    dead = said.rlike(_FINAL_STATUS)
    hopeless = dead | said.rlike("(?i)no text layer|needs the optional [^\\n\\r]* package|unsupported content-type")
    return F.when(reason.isin("blocked", "no_lane_available", "quarantined") | ((reason == "unreachable") & dead) | ((reason == "empty") & hopeless), "structural").otherwise("transient")


def is_terminal(reason: Column) -> Column:
    """Whether a failure of this reason isn't tried again."""
    return reason.isin("blocked", "no_lane_available", "quarantined")


def is_security_refusal(reason: Column) -> Column:
    said = F.lower(reason)
    return said.rlike("blocked|cross-port|dns lookup (failed|returned)|off-domain|redirect hop") & ~said.contains("net::err_blocked")


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Milliseconds to wait by a Retry-After header: seconds or an HTTP date, five minutes at most; null if neither."""
    secs = trim(value).try_cast("double")
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(trim(value), "^[A-Za-z]+, *", ""), " *GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.unix_millis(at) - now_ms))
    found = F.when(secs >= 0, secs * 1000).otherwise(wait)
    return F.when(found.isNotNull(), F.least(found, F.lit(300_000.0))).cast("long")
