"""Fetching as a Spark data source with an exchangeable transport, and readers of what services answer.

``spark.dataSource.register(WebPages)`` makes ``spark.read.format("web_pages")`` known; option ``urls`` has a URL a line,
``requests`` a JSON object a line (``url``, ``etag``, ``last_modified``, ``headers``), and ``transport`` names a function
``module:name`` of ``(url, headers) -> Response``. Without it requests go over HTTPS and every hop's addresses are looked
up first, by the system or by the ``resolver`` that is named. For tables of requests there is :func:`fetch_pages`.
"""

from __future__ import annotations

import importlib
import ipaddress
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import MAX_BODY_BYTES, MAX_REDIRECTS, ROBOTS_MAX_CHARS, USER_AGENT
from ..functions import text, whatwg
from ..functions.urls import blocked_host, host_of

SCHEMA = "url string, final_url string, status int, content_type string, etag string, last_modified string, retry_after string, body binary, error string"


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


Transport = Callable[[str, dict[str, str]], Response]


def https(url: str, headers: dict[str, str]) -> Response:
    """One request without following redirects; the body is cut at the cap."""
    import http.client

    u = whatwg.parse(url)
    link = http.client.HTTPSConnection(u.netloc, timeout=20)
    try:
        link.request("GET", u.path + (f"?{u.query}" if u.query is not None else ""), headers=headers)
        got = link.getresponse()
        return Response(got.status, {k.lower(): v for k, v in got.getheaders()}, got.read(MAX_BODY_BYTES))
    finally:
        link.close()


Resolver = Callable[[str], list[str]]


def system_resolver(host: str) -> list[str]:
    """The addresses of a host by the system's resolver."""
    import socket

    return sorted({x[4][0] for x in socket.getaddrinfo(host, 443, type=socket.SOCK_STREAM)})


def resolves_publicly(host: str, resolver: Resolver) -> bool:
    """Whether a host has addresses and all of them are public ones; a resolver that fails says no."""
    try:
        found = [ipaddress.ip_address(a.partition("%")[0]) for a in resolver(host)]
    except (OSError, ValueError):
        return False
    plain = [getattr(a, "ipv4_mapped", None) or a for a in found]
    return bool(plain) and all(a.is_global and not a.is_multicast for a in plain)


#: Headers that the transport sets itself, whatever a target asks for.
_OWN_HEADERS = frozenset(("accept-encoding", "content-length", "host", "user-agent"))


def request_headers(etag: str | None = None, last_modified: str | None = None, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Headers of a request: a target's own, then the validators that let the origin answer 304."""
    out = {"accept-language": "en-US,en;q=0.9", **{k.lower(): v for k, v in (extra or {}).items() if k.lower() not in _OWN_HEADERS}}
    if etag:
        out["if-none-match"] = etag
    if last_modified:
        out["if-modified-since"] = last_modified
    return out


def fetch(url: str, transport: Transport, headers: dict[str, str] | None = None, resolver: Resolver | None = None) -> dict:
    """Follow up to five redirects, each tested again: https, the same site and port, a public host and, with a
    ``resolver``, public addresses, no credentials. Headers go with every hop, which is on the same site."""
    start = whatwg.parse(url)
    at = start
    for _ in range(MAX_REDIRECTS + 2):
        if at is None or at.scheme != "https" or at.user or at.password or blocked_host(at.host):
            return {"url": url, "error": "blocked: not a public https address"}
        if at.host.removeprefix("www.") != start.host.removeprefix("www.") or at.port != start.port:
            return {"url": url, "error": f"blocked: off-domain or cross-port redirect to {at}"}
        if resolver and not resolves_publicly(at.host, resolver):
            return {"url": url, "error": "blocked: DNS lookup returned no public address"}
        got = transport(str(at), {"user-agent": USER_AGENT, **(headers or {})})
        if not 300 <= got.status < 400 or "location" not in got.headers:
            h = got.headers
            return {"url": url, "final_url": str(at), "status": got.status, "content_type": h.get("content-type"), "etag": h.get("etag"), "last_modified": h.get("last-modified"), "retry_after": h.get("retry-after"), "body": got.body[:MAX_BODY_BYTES]}
        at = whatwg.parse(got.headers["location"], at)
    return {"url": url, "error": "too many redirects"}


def fetch_again(url: str, transport: Transport, headers: dict[str, str] | None = None, resolver: Resolver | None = None, retries: int = 2, backoff_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """:func:`fetch`, tried again after failures that may pass (no answer, 429, 5xx) and never after a refusal.

    The pause grows with each try; an origin that says how long to wait is given that long, five minutes at most.
    """
    for attempt in range(retries + 1):
        try:
            got = fetch(url, transport, headers, resolver)
        except Exception as error:  # noqa: BLE001 - a failed request is a row
            got = {"url": url, "error": str(error) or type(error).__name__}
        passing = not str(got.get("error", "")).startswith("blocked") if "error" in got else got["status"] == 429 or got["status"] >= 500
        if not passing or attempt == retries:
            return got
        said = got.get("retry_after") or ""
        sleep(max(backoff_s * (attempt + 1), min(300.0, float(said)) if said.strip().isdigit() else 0.0))
    raise AssertionError


ROBOTS_HOPS = 4


def fetch_robots(url: str, transport: Transport, resolver: Resolver | None = None) -> dict:
    """``{policy, reason, body, moved_to}`` of a page's robots.txt; ``policy`` is null where ``body`` has to be read for it.

    Redirects to other domains are followed, as the old owner's word, and the last such host is ``moved_to``. A host
    or hop without public addresses, another scheme, too many hops, 429, 5xx and no answer leave it unknown; other 4xx
    allow everything.
    """
    page = whatwg.parse(url)
    out = {"policy": "unknown", "reason": None, "body": None, "moved_to": None}
    if page is None or page.scheme not in ("http", "https"):
        return out | {"reason": "no web address"}
    at = whatwg.parse("/robots.txt", page)
    for hop in range(ROBOTS_HOPS + 1):
        if at is None or at.scheme not in ("http", "https"):
            return out | {"reason": "redirect to no web address"}
        if blocked_host(at.host) or (resolver and not resolves_publicly(at.host, resolver)):
            return out | {"reason": "no public address" if hop == 0 else "redirect to a host without a public address"}
        try:
            got = transport(str(at), {"user-agent": USER_AGENT, "accept": "text/plain"})
        except Exception:  # noqa: BLE001 - whatever went wrong, nothing is known
            return out | {"reason": "no answer"}
        if not 300 <= got.status < 400:
            break
        if "location" not in got.headers or hop == ROBOTS_HOPS:
            return out | {"reason": "too many redirects"}
        before, at = at, whatwg.parse(got.headers["location"], at)
        if at is not None and at.host.removeprefix("www.") != before.host.removeprefix("www."):
            out["moved_to"] = at.host
    if 400 <= got.status < 500 and got.status != 429:
        return out | {"policy": "allow", "reason": f"HTTP {got.status}"}
    if not 200 <= got.status < 300:
        return out | {"reason": f"HTTP {got.status}"}
    return out | {"policy": None, "body": got.body.decode("utf-8", "replace")[:ROBOTS_MAX_CHARS]}


def _named(name: str | None, default: Callable) -> Callable:
    module, _, member = (name or "").partition(":")
    return getattr(importlib.import_module(module), member) if name else default


class _Part(InputPartition):
    def __init__(self, requests: list[dict]):
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, requests: list[dict], options: dict[str, str]):
        self.requests, self.options = requests, options

    def partitions(self) -> list[InputPartition]:
        """URLs of a host stay together, so a host is asked one request at a time."""
        by: dict[str, list[dict]] = {}
        for r in self.requests:
            parsed = whatwg.parse(r["url"])
            by.setdefault(parsed.host if parsed else "", []).append(r)
        bins: list[list[dict]] = [[] for _ in range(max(1, min(int(self.options.get("partitions", 8)), len(by))))]
        for group in sorted(by.values(), key=len, reverse=True):
            min(bins, key=len).extend(group)
        return [_Part(b) for b in bins]

    def read(self, partition: _Part) -> Iterator[tuple]:
        o = self.options
        transport = _named(o.get("transport"), https)
        resolver = _named(o.get("resolver"), system_resolver) if o.get("resolver") or not o.get("transport") else None
        for r in partition.requests:
            headers = request_headers(r.get("etag"), r.get("last_modified"), r.get("headers"))
            got = fetch_again(r["url"], transport, headers, resolver, int(o.get("retries", 0)), float(o.get("backoff", 0.5)))
            yield tuple(got.get(c.split()[0]) for c in SCHEMA.split(", "))


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        asked = [{"url": u} for u in self.options.get("urls", "").split("\n") if u]
        asked += [json.loads(r) for r in self.options.get("requests", "").split("\n") if r.strip()]
        return _Reader(asked, dict(self.options))


def fetch_pages(requests: DataFrame, transport: str | None = None, resolver: str | None = None, retries: int = 0) -> DataFrame:
    """Rows of ``SCHEMA`` for ``requests (url[, etag, last_modified, headers map<string,string>])``, however many there are.

    All requests of a host are made one after the other in one task; every host that was asked keeps its connection
    rules (see :func:`fetch`). A null URL has an error. The functions are named ``module:name``.
    """
    have = set(requests.columns)
    none = F.lit(None).cast("string")
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    rows = requests.select("url", *((F.col(c) if c in have else none).alias(c) for c in ("etag", "last_modified")), (F.to_json("headers") if "headers" in have else none).alias("headers"), host.alias("_host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, find = _named(transport, https), _named(resolver, system_resolver) if resolver or not transport else None
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int32() if n == "status" else pa.binary() if n == "body" else pa.string() for n in names]
        for batch in batches:
            for r in batch.to_pylist():
                headers = request_headers(r["etag"], r["last_modified"], json.loads(r["headers"]) if r["headers"] else None)
                got = fetch_again(r["url"], send, headers, find, retries) if r["url"] is not None else {"error": "blocked: no address"}
                yield pa.RecordBatch.from_arrays([pa.array([got.get(n)], k) for n, k in zip(names, kinds)], names)

    return rows.repartition("_host").sortWithinPartitions("_host").drop("_host").mapInArrow(run, SCHEMA)


def outcomes(fetched: DataFrame) -> DataFrame:
    """``fetched`` with ``kind`` of its content, ``outcome`` (ok, not_modified, failed), ``reason`` and ``class`` of a failure."""
    status = F.col("status")
    kind = text.content_kind(F.col("content_type"))
    answered = F.coalesce(status.between(200, 299) | (status == 304), F.lit(False))
    reason = F.when(F.col("error").startswith("blocked"), "blocked").when(F.col("error").isNotNull() | ~answered, "unreachable").when(kind.isNull() & (status != 304), "empty")
    detail = F.coalesce("error", F.when(F.col("reason") == "empty", F.concat(F.lit("Unsupported content-type "), F.coalesce("content_type", F.lit("none")))).otherwise(F.concat(F.lit("HTTP "), status.cast("string"))))
    rows = fetched.withColumn("kind", kind).withColumn("reason", reason)
    return rows.withColumn("outcome", F.when(F.col("reason").isNotNull(), "failed").when(status == 304, "not_modified").otherwise("ok")).withColumn("class", F.when(F.col("reason").isNotNull(), text.failure_class(F.col("reason"), detail)))


def newest_capture(captures: DataFrame, max_age_days: int | None = None, today: str | None = None) -> DataFrame:
    """Each URL's newest archived success: ``captures (url, stamp, status)`` of fourteen-digit stamps, none too old."""
    good = captures.filter(F.col("status") == 200).withColumn("captured_at", text.capture_time(F.col("stamp")))
    best = good.groupBy("url").agg(F.max_by(F.struct("stamp", "captured_at"), "stamp").alias("c")).select("url", "c.*")
    if max_age_days is not None:
        age = F.datediff(F.to_date(F.lit(today)) if today else F.current_date(), F.to_date(F.substring("captured_at", 1, 10)))
        best = best.filter(age <= max_age_days)
    return best.withColumn("snapshot_url", F.concat(F.lit("https://web.archive.org/web/"), "stamp", F.lit("id_/"), "url"))


def read_bodies(spark: SparkSession, path: str, content_type: str) -> DataFrame:
    """Files of one content type as ``(url, text, content_kind, content_type)``, whole and as they are."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("url"), F.col("content").cast("string").alias("text"), text.refine_kind(text.content_kind(F.lit(content_type)), F.col("path")).alias("content_kind"), F.lit(content_type).alias("content_type"))
