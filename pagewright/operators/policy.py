"""Who may be crawled: target, request and redirect gates, DNS answers, robots.txt."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..config import MAX_CRAWL_DELAY_MS, ROBOTS_MAX_CHARS
from ..functions import urls, whatwg
from ..functions.guard import trim

_PARTS = StructType([StructField(n, BooleanType() if n == "login" else StringType()) for n in ("scheme", "login", "host", "port", "path", "href")])


@F.arrow_udf(_PARTS)
def _browser_parts(url: pa.Array) -> pa.Array:
    out = []
    for raw in url.to_pylist():
        u = None if raw is None else whatwg.parse(raw)
        out.append(u and {"scheme": u.scheme, "login": bool(u.user or u.password), "host": u.host, "port": u.port, "path": u.path, "href": str(u)})
    return pa.array(out, pa.struct([("scheme", pa.string()), ("login", pa.bool_()), *((n, pa.string()) for n in ("host", "port", "path", "href"))]))


def with_url(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``struct(scheme, login, host, port, path, href)``, null where the URL is invalid.

    Plain URLs are taken apart by SQL; the others go through the browser parser.
    """
    url = F.col(column)
    rest = F.regexp_extract(url, "^[^?#]*([?#].*)?$", 1)

    def read(p: Column) -> Column:
        slash = F.when(p[3] == "", "/").otherwise(p[3])
        href = F.concat(p[0], F.lit("://"), p[1], F.when(p[2] == "", "").otherwise(F.concat(F.lit(":"), p[2])), slash, rest)
        return F.struct(p[0].alias("scheme"), F.lit(False).alias("login"), p[1].alias("host"), p[2].alias("port"), slash.alias("path"), href.alias("href"))

    return df.withColumn(name, F.coalesce(urls.let(urls.plain_parts(url), lambda p: F.when(p.isNotNull(), read(p))), _browser_parts(F.when(~urls.is_plain(url), url))))


def _base_reason(base: Column) -> Column:
    return F.when(base.isNull(), "invalid_base_url").when(base["scheme"] != "https", "base_not_https").when(base["login"], "base_credentialed").when(urls.is_blocked_host(base["host"]), "base_not_public")


def target_gate(targets: DataFrame) -> DataFrame:
    """``targets (base_url, robots_policy, active, ...)`` with ``reject_reason``; null for a target that may be crawled."""
    df = with_url(targets, "base_url", "_base")
    policy = F.coalesce("robots_policy", F.lit("unknown"))
    reason = F.when(~F.coalesce("active", F.lit(True)), "inactive").when(policy == "disallow", "robots_disallow").when(policy == "unknown", "robots_unknown").otherwise(urls.let(F.col("_base"), _base_reason))
    return df.withColumn("reject_reason", reason).drop("_base")


def request_gate(requests: DataFrame, kind: str = "crawl") -> DataFrame:
    """``requests (base_url, url, ...)`` with ``reject_reason`` (null if allowed) and ``safe_url``, the normal form."""
    df = with_url(with_url(requests, "base_url", "_base"), "url", "_url")

    def reason(x: Column) -> Column:
        b, u = x["b"], x["u"]
        own = (
            F.when(u.isNull(), f"invalid_{kind}_url").when(u["scheme"] != "https", "not_https").when(u["login"], "credentialed").when(urls.is_blocked_host(u["host"]), "not_public")
            .when(~urls.hosts_match(u["host"], b["host"]), "off_domain").when(u["port"] != b["port"], "cross_port")
        )
        return F.coalesce(_base_reason(b), own)

    df = df.withColumn("_x", F.struct(F.col("_base").alias("b"), F.col("_url").alias("u"))).withColumn("reject_reason", urls.let(F.col("_x"), reason))
    return df.withColumn("safe_url", F.when(F.col("reject_reason").isNull(), F.col("_url.href"))).drop("_base", "_url", "_x")


def public_hosts(dns: DataFrame) -> DataFrame:
    """``(host, public)`` from ``dns (host, address, family)``: every record must be a valid public address."""
    address = F.lower("address")
    valid = urls.is_ipv4(address) | urls.is_ipv6(address)
    private = ((F.col("family") == 4) & urls.is_private_ipv4(address)) | ((F.col("family") == 6) & urls.is_private_ipv6(address))
    good = F.coalesce(valid & ~private, F.lit(False))
    return dns.groupBy(F.lower("host").alias("host")).agg(F.every(good).alias("public")).withColumn("public", F.col("public") & ~urls.is_blocked_host(F.col("host")))


def doh_records(answers: DataFrame) -> DataFrame:
    """``dns`` rows from ``answers (host, payload)`` of a DNS-over-HTTPS resolver; a payload that says failure has none."""
    read = F.from_json("payload", "Status int, Answer array<struct<type:int,data:string>>")
    rows = answers.select("host", read.alias("r")).filter("r.Status = 0").select("host", F.explode("r.Answer").alias("a"))
    family = F.when(F.col("a.type") == 1, 4).when(F.col("a.type") == 28, 6)
    return rows.select("host", F.col("a.data").alias("address"), family.alias("family")).filter("address <> '' and family is not null")


def robots_lines(robots: DataFrame) -> DataFrame:
    """``(host, pos, field, value, grp)`` of the lines that count; consecutive user-agent lines share ``grp``."""
    lines = robots.select("host", F.posexplode(F.split(F.substring("body", 1, ROBOTS_MAX_CHARS), "\r?\n")).alias("pos", "raw"))
    line = trim(F.regexp_replace("raw", "#.*$", ""))
    parts = lines.filter(line.contains(":")).select("host", "pos", F.lower(trim(F.substring_index(line, ":", 1))).alias("field"), trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))
    kept = parts.filter("field in ('allow', 'crawl-delay', 'disallow') or (field = 'user-agent' and value <> '')")
    order = W.partitionBy("host").orderBy("pos")
    agent = F.col("field") == "user-agent"
    fresh = (agent & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")).cast("int")
    return kept.withColumn("grp", F.sum(fresh).over(order))


def rule_pattern(rule: Column) -> Column:
    """The regular expression that a robots rule stands for."""
    open_end = F.regexp_replace(rule, "[$]$", "")
    quoted = F.replace(F.regexp_replace(open_end, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit("[^\n\r]*"))
    return F.concat(F.lit("^"), quoted, F.when(rule.endswith("$"), F.lit("$")).otherwise(""))


def robots_verdicts(robots: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests (host, path, agent, ...)`` with ``policy``, ``reason`` and ``crawl_delay_ms`` by ``robots (host, body)``.

    ``agent`` is a token as of :func:`urls.user_agent_token`. The first named group that the token contains
    counts, else ``*``; the longest rule wins, Allow wins ties; of several delays the last counts.
    """
    lines = robots_lines(robots)
    agents = lines.filter("field = 'user-agent'").select("host", "grp", F.lower("value").alias("name"), "pos")
    names = agents.groupBy("host", "name").agg(F.min("pos").alias("first"))
    asked = requests.select("host", "agent").distinct()
    fits = asked.join(names, "host").filter((F.col("name") == "*") | F.col("agent").contains(F.col("name")))
    picked = fits.groupBy("host", "agent").agg(F.min_by("name", F.struct((F.col("name") == "*").alias("s"), "first")).alias("name"))
    rules = lines.filter("field <> 'user-agent'").join(agents.select("host", "grp", "name").distinct(), ["host", "grp"])
    secs = F.col("value").try_cast("double")
    delay = F.least(F.floor(secs * 1000 + 0.5), F.lit(MAX_CRAWL_DELAY_MS)).cast("long")
    delays = rules.filter((F.col("field") == "crawl-delay") & (secs > 0) & (secs < float("inf"))).groupBy("host", "name").agg(F.max_by(delay, "pos").alias("crawl_delay_ms"))
    paths = rules.filter("field <> 'crawl-delay' and value <> ''").select("host", "name", "field", "value").distinct()
    groups = picked.join(delays, ["host", "name"], "left")
    wanted = requests.select("host", "path", "agent").distinct().join(groups, ["host", "agent"])
    hit = F.length(F.regexp_replace("value", "[*$]", ""))
    matched = wanted.join(paths, ["host", "name"]).filter(F.rlike("path", rule_pattern(F.col("value"))))
    best = matched.groupBy("host", "path", "agent").agg(F.max(F.when(F.col("field") == "allow", hit)).alias("a"), F.max(F.when(F.col("field") == "disallow", hit)).alias("d"))
    a, d = F.coalesce("a", F.lit(-1)), F.coalesce("d", F.lit(-1))
    out = requests.join(groups, ["host", "agent"], "left").join(best, ["host", "path", "agent"], "left")
    reason = F.when(F.col("name").isNull(), "no_group").when(d < 0, "no_rule").when(a >= d, "allow_overrides").otherwise("disallowed")
    return out.withColumn("reason", reason).withColumn("policy", F.when(F.col("reason") == "disallowed", "disallow").otherwise("allow")).select(*requests.columns, "policy", "reason", "crawl_delay_ms")


def robots_fetch_policy(status: Column) -> Column:
    """What the status of a robots.txt fetch alone decides: null where the body has to be read."""
    return F.when(status.isNull(), "unknown").when((status >= 400) & (status < 500) & (status != 429), "allow").when((status < 200) | (status >= 300), "unknown")


RESERVED_HEADERS = ("accept-encoding", "content-length", "host", "user-agent")


def target_headers(headers: Column) -> Column:
    """Extra request headers with lower-case names, without those that the fetcher sets itself."""
    low = F.map_from_entries(F.filter(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: ~e["key"].isin(*RESERVED_HEADERS)))
    return low


def off_domain_refusal(detail: Column, url: Column) -> Column:
    """Whether a refusal tells of another registrable domain than ``url``'s: that of the first address in ``detail``."""
    told = urls.host_of(F.nullif(F.regexp_extract(detail, r"https?://[^\s)]+", 0), F.lit("")))
    return F.coalesce(urls.registrable_domain(told) != urls.registrable_domain(urls.host_of(url)), F.lit(False))


def with_origin_moved(served: DataFrame) -> DataFrame:
    """``served (url, ok, not_modified, refusal, served_by, ...)`` with ``origin_moved``: the refusal and who served the
    page nevertheless, where an earlier rung was sent to another domain; null for failures and 304s."""
    moved = F.col("ok") & ~F.coalesce("not_modified", F.lit(False)) & off_domain_refusal(F.col("refusal"), F.col("url"))
    return served.withColumn("origin_moved", F.when(moved, F.struct("refusal", "served_by")))


def archive_allowed(targets: DataFrame, opted_in: bool) -> DataFrame:
    """``targets (robots_policy, headers, ...)`` with ``archive``: an archived copy may stand in only where that is opted into,
    robots say allow outright and no credentials are sent."""
    plain = F.coalesce(F.size("headers"), F.lit(0)) <= 0
    return targets.withColumn("archive", F.lit(opted_in) & F.coalesce(F.col("robots_policy") == "allow", F.lit(False)) & plain)
