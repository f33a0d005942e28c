"""URL identity and host predicates.

Well-formed http(s) URLs, which are nearly all, are handled by SQL expressions inside codegen; only the
others reach the Arrow function that parses as browsers do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType, StringType

from . import whatwg

#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = ("_ga", "_gl", "dclid", "fbclid", "gbraid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "s_kwcid", "twclid", "twscroll", "vero_id", "wbraid", "yclid")
TRACKING_RE = "(?i)^(utm_[a-z_]+|" + "|".join(TRACKING) + ")$"
#: Scheme, host without port, port, path, query: of URLs that need no normalisation but case and default port.
PLAIN_RE = r"^(?![^?#]*/[.]{1,2}(?:[/?#]|$))([hH][tT][tT][pP][sS]?)://(?!(?i:[^/]*(?:xn--|0x)))([A-Za-z0-9_.\-]*[A-Za-z_\-])(?::([0-9]{1,4}))?(/[A-Za-z0-9_.~!$&()*+,;=:@/\-]*)?(?:[?]([A-Za-z0-9_.~!$&()*,;=:@/?\-]*))?(?:#[\x21-\x7E&&[^\"<>`]]*)?$"
#: What JavaScript's \s is; Java tests single characters under 256 at once and the rest only beyond them.
SPACE = r"[\t\n\x0B\f\r\x20\xA0[\x{1680}-\x{FEFF}&&[\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_parts(url: Column) -> Column:
    """``[scheme, host, port, path, query]`` of a URL that SQL expressions read as a browser would, else null.

    Scheme and host are in lower case; a port of its scheme's own and a path that isn't there are empty.
    """
    raw = F.split(F.regexp_replace(url, PLAIN_RE, "$1\t$2\t$3\t$4\t$5"), "\t")

    def tidy(p: Column) -> Column:
        scheme, port = F.lower(p[0]), F.regexp_replace(p[2], "^0+(?=[0-9])", "")
        own = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
        return F.array(scheme, F.lower(p[1]), F.when(own, "").otherwise(port), p[3], p[4])

    return F.when(url.rlike(PLAIN_RE), let(raw, tidy))


def is_plain(url: Column) -> Column:
    return F.coalesce(url.rlike(PLAIN_RE), F.lit(False))


def arrow_text(fn: Callable[[str], str | None], kind: str = "string"):
    """An Arrow function of one string column; nulls stay null, and equal values are worked out once a batch."""

    @F.arrow_udf(StringType() if kind == "string" else BooleanType())
    def apply(column: pa.Array) -> pa.Array:
        seen: dict[str | None, object] = {None: None}
        out = []
        for value in column.to_pylist():
            if value not in seen:
                seen[value] = fn(value)
            out.append(seen[value])
        return pa.array(out, pa.string() if kind == "string" else pa.bool_())

    return apply


def dedup_key(raw: str) -> str:
    """The key of one URL, any form."""
    text = raw.strip()
    if not text:
        return ""
    url = whatwg.parse(text)
    if url is None:
        return re.sub(r"/+$", "", re.sub(r"#.*$", "", text.lower()))
    pairs = sorted(((k, v) for k, v in whatwg.query_pairs(url.query) if not re.match(TRACKING_RE, k)), key=lambda x: x[0])
    return (url.netloc + re.sub(r"/+$", "", url.path) + ("?" + "&".join(f"{k}={v}" for k, v in pairs) if pairs else "")).lower()


_dedup_key_udf = arrow_text(dedup_key)


def url_dedup_key(url: Column) -> Column:
    """Key under which URLs of one resource meet: no scheme, fragment, tracking or trailing slash; query sorted by key."""
    text = F.regexp_replace(url, f"^{SPACE}+|{SPACE}+$", "")

    def key(p: Column) -> Column:
        pairs = F.transform(F.filter(F.split(p[4], "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=?", "").alias("v")))
        kept = F.filter(pairs, lambda x: ~x["k"].rlike(TRACKING_RE))
        ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
        query = F.array_join(F.transform(ranked, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
        shown = F.when(p[2] == "", "").otherwise(F.concat(F.lit(":"), p[2]))
        return let(query, lambda q: F.lower(F.concat(p[1], shown, F.regexp_replace(p[3], "/+$", ""), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))))

    return F.coalesce(let(plain_parts(text), key), _dedup_key_udf(F.when(~is_plain(text), text)), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host of a plain http(s) URL; of others as browsers parse them."""
    return F.coalesce(F.get(plain_parts(url), F.lit(1)), _host_udf(F.when(~is_plain(url), url)))


def _host_of(raw: str) -> str | None:
    url = whatwg.parse(raw)
    return url.host if url and url.host else None


_host_udf = arrow_text(_host_of)


def url_parts(url: Column) -> Column:
    """``struct(scheme, host, port, path, query)`` of a plain URL; null parts otherwise."""
    return let(plain_parts(url), lambda p: F.struct(p[0].alias("scheme"), p[1].alias("host"), F.nullif(p[2], F.lit("")).alias("port"), F.when(p[3] == "", "/").otherwise(p[3]).alias("path"), p[4].alias("query")))


def bare_host(host: Column) -> Column:
    """``host`` in lower case without one leading ``www.``."""
    return F.regexp_replace(F.lower(host), "^www[.]", "")


def hosts_match(a: Column, b: Column) -> Column:
    return bare_host(a) == bare_host(b)


def registrable_domain(host: Column) -> Column:
    """The last two labels."""
    return F.array_join(F.slice(F.split(host, "[.]"), F.greatest(F.lit(1), F.size(F.split(host, "[.]")) - 1), F.lit(2)), ".")


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|0?[0-9]{1,2}|00[0-9])"
IPV4_RE = rf"^{_OCTET}([.]{_OCTET}){{3}}$"
_HEX = "[0-9A-Fa-f]{1,4}"


def is_ipv4(host: Column) -> Column:
    return host.rlike(IPV4_RE)


def is_ipv6(host: Column) -> Column:
    """Full or once-compressed notation without an embedded dotted quad."""
    pieces = F.size(F.filter(F.split(host, ":"), lambda x: x != ""))
    halves = host.rlike(rf"^({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?$") & (pieces <= 7)
    return host.rlike(rf"^{_HEX}(:{_HEX}){{7}}$") | halves


def is_private_ipv4(host: Column) -> Column:
    octet = lambda k: F.try_element_at(F.split(host, "[.]"), F.lit(k)).try_cast("int")
    a, b = octet(1), octet(2)
    ranges = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19)) | ((a == 169) & (b == 254))
    return F.coalesce(ranges, F.lit(False))


def is_private_ipv6(host: Column) -> Column:
    low = F.lower(host)
    mapped = F.regexp_extract(low, "^::ffff:(.*)$", 1)
    return low.isin("::", "::1") | (is_ipv4(mapped) & is_private_ipv4(mapped)) | low.rlike("^(f[cd]|fe[89ab]|ff|2001:db8:)")


#: Names and endings that never leave a machine or its network.
BLOCKED_NAMES = ("0.0.0.0", "127.0.0.1", "::1", "localhost")
BLOCKED_ENDINGS = ("internal", "local", "localdomain", "localhost")


def is_blocked_host(host: Column) -> Column:
    """Whether requests to ``host`` are refused as not public; an empty or null one is."""
    low = F.lower(F.trim(host))

    def blocked(h: Column) -> Column:
        named = (h == "") | h.isin(*BLOCKED_NAMES) | h.rlike("[.](" + "|".join(BLOCKED_ENDINGS) + ")$|^[0-9]+$")
        return named | (is_ipv4(h) & is_private_ipv4(h)) | (is_ipv6(h) & is_private_ipv6(h))

    return F.coalesce(let(F.regexp_replace(low, r"^\[(.*)\]$", "$1"), blocked), F.lit(True))


def _is_safe(raw: str) -> bool:
    url = whatwg.parse(raw) if len(raw) <= 2048 else None
    return bool(url and url.scheme in ("http", "https") and url.host and not url.user and not url.password and not blocked_host(url.host))


def blocked_host(host: str) -> bool:
    """:func:`is_blocked_host` for one value."""
    import ipaddress

    bare = host.strip().lower()
    bare = bare[1:-1] if bare.startswith("[") and bare.endswith("]") else bare
    if not bare or bare in BLOCKED_NAMES or bare.isdigit() or bare.endswith(tuple(f".{x}" for x in BLOCKED_ENDINGS)):
        return True
    if re.match(IPV4_RE, bare):
        a, b = map(int, bare.split(".")[:2])
        return a in (0, 10, 127) or a >= 224 or a == 100 and 64 <= b <= 127 or a == 172 and 16 <= b <= 31 or (a, b) in ((192, 168), (198, 18), (198, 19), (169, 254))
    try:
        ipaddress.IPv6Address(bare)
    except ValueError:
        return False
    return "." not in bare and bool(bare in ("::", "::1") or re.match("f[cd]|fe[89ab]|ff|2001:db8:", bare))


_safe_udf = arrow_text(_is_safe, "boolean")


def is_safe_http_url(url: Column) -> Column:
    """http(s), at most 2048 characters, no credentials, a public host."""
    plain = is_plain(url) & (F.length(url) <= 2048)
    return F.coalesce(F.when(plain, ~is_blocked_host(F.get(plain_parts(url), F.lit(1)))).otherwise(_safe_udf(F.when(~plain, url))), F.lit(False))


def user_agent_token(agent: Column) -> Column:
    first = F.split_part(agent, F.lit("/"), F.lit(1))
    return F.lower(F.trim(F.when(first == "", agent).otherwise(first)))
