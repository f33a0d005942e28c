"""URL parsing and resolution as browsers do it, for what SQL expressions can't: relative references,
dot segments, percent-encoding, numeric and international hosts."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _encode_set(extra: str) -> frozenset[int]:
    return frozenset([*range(0x20), 0x20, *map(ord, extra), *range(0x7F, 0x100)])


_IN_PATH, _IN_QUERY = _encode_set('"#<>?^`{}'), _encode_set("\"#<>'")
_IN_FRAGMENT, _IN_USER = _encode_set('"<>`'), _encode_set('"#<>?^`{}/:;=@[\\]|')


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str
    password: str
    host: str
    port: str
    path: str
    query: str | None
    fragment: str | None
    opaque: bool = False

    @property
    def netloc(self) -> str:
        """Host with its port, if that isn't the scheme's own."""
        return f"{self.host}:{self.port}" if self.port else self.host

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.netloc}" if self.scheme in DEFAULT_PORTS else "null"

    def __str__(self) -> str:
        login = f"{self.user}{':' + self.password if self.password else ''}@" if self.user or self.password else ""
        front = f"{self.scheme}:" + ("" if self.opaque else f"//{login}{self.netloc}" if self.host or self.scheme in DEFAULT_PORTS or self.scheme == "file" else "")
        return front + self.path + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


def _quote(text: str, escape: frozenset[int]) -> str:
    return "".join(chr(b) if b not in escape else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def unquote(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)


def _ipv4_part(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8 if len(part) > 1 and part[0] == "0" else 10) if part.isascii() and part.isdigit() else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; None if it is no valid address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    numbers = [_ipv4_part(x) for x in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    text = unquote(raw).decode("utf-8", "replace")
    if text.isascii():
        text = text.lower()
    else:
        try:
            text = ".".join(x.encode("idna").decode() if not x.isascii() else x for x in re.split("[.。．｡]", text)).lower()
        except UnicodeError:
            return None
    if not text or _FORBIDDEN.search(text):
        return None
    last = text.rstrip(".").rpartition(".")[2] if text.endswith(".") else text.rpartition(".")[2]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        return _ipv4(text)
    return text


def _dots(segments: list[str]) -> str:
    out: list[str] = []
    for k, seg in enumerate(segments):
        plain, last = seg.lower().replace("%2e", "."), k == len(segments) - 1
        if plain == "..":
            out = out[:-1]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(seg)
    return "/" + "/".join(out)


def _path(raw: str, special: bool) -> str:
    raw = raw.replace("\\", "/") if special else raw
    return _dots(_quote(raw[1:] if raw.startswith("/") else raw, _IN_PATH).split("/"))


#: Absolute URLs up to this length are remembered, the last few of them: a page's own is asked for again and again.
#: Workers outlive tasks, so what they remember must not grow with the links they have read.
MOST_KNOWN, LONGEST_KNOWN = 256, 2048


def parse(raw: str, base: Url | None = None) -> Url | None:
    """The URL that ``raw`` names, resolved against ``base``; None if it isn't valid."""
    return _known(raw) if base is None and len(raw) <= LONGEST_KNOWN else _parse(raw, base)


@lru_cache(maxsize=MOST_KNOWN)
def _known(raw: str) -> Url | None:
    return _parse(raw, None)


def _parse(raw: str, base: Url | None) -> Url | None:
    raw = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    raw, mark, frag = raw.partition("#")
    fragment = _quote(frag, _IN_FRAGMENT) if mark else None
    m = _SCHEME.match(raw)
    scheme = m[1].lower() if m else ""
    if m and not (base and scheme == base.scheme and scheme in DEFAULT_PORTS and not re.match(r"[/\\]{2}", raw[m.end() :])):
        rest, special = raw[m.end() :], scheme in DEFAULT_PORTS
        if not special and not rest.startswith("//"):
            body, q, query = rest.partition("?")
            opaque = not body.startswith("/")
            return Url(scheme, "", "", "", "", _quote(body, _encode_set("") - {0x20}) if opaque else _path(body, False), _quote(query, _IN_QUERY) if q else None, fragment, opaque)
        return _authority(scheme, re.sub(r"^[/\\]+", "", rest) if special else rest[2:], fragment)
    if base is None or (base.opaque and (raw or not mark)):
        return None
    if m:
        raw = raw[m.end() :]
    special = base.scheme in DEFAULT_PORTS
    slash = raw.replace("\\", "/") if special else raw
    if slash.startswith("//"):
        return _authority(base.scheme, re.sub(r"^[/\\]+", "", raw) if special else raw[2:], fragment)
    if not raw:
        return replace(base, fragment=fragment)
    body, q, query = raw.partition("?")
    query = _quote(query, _IN_QUERY) if q else None
    if not body:
        return replace(base, query=query, fragment=fragment)
    if body[0] == "/" or special and body[0] == "\\":
        path = _path(body, special)
    else:
        path = _path(base.path.rpartition("/")[0] + "/" + body, special)
    return replace(base, path=path, query=query, fragment=fragment)


def _authority(scheme: str, rest: str, fragment: str | None) -> Url | None:
    special = scheme in DEFAULT_PORTS
    m = re.match(r"[^/?\\]*" if special else r"[^/?]*", rest)
    login, at, place = m[0].rpartition("@")
    user, _, password = login.partition(":")
    h = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    host = _host(h[1]) if h and (h[1] or special) else "" if h and not special else None
    if host is None:
        return None
    port = h[2] or ""
    if port and int(port) > 65535:
        return None
    port = "" if not port or int(port) == DEFAULT_PORTS.get(scheme) else str(int(port))
    body, q, query = rest[m.end() :].partition("?")
    return Url(scheme, _quote(user, _IN_USER), _quote(password, _IN_USER), host, port, _path(body, special) if body or special else "", _quote(query, _IN_QUERY) if q else None, fragment)


def query_pairs(query: str | None) -> list[tuple[str, str]]:
    """Decoded form fields in order."""
    out = []
    for part in (query or "").split("&"):
        if part:
            k, _, v = part.partition("=")
            out.append((unquote(k.replace("+", " ")).decode("utf-8", "replace"), unquote(v.replace("+", " ")).decode("utf-8", "replace")))
    return out


def form_encode(pairs: list[tuple[str, str]]) -> str:
    keep = set(b"*-._0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    enc = lambda s: "".join("+" if b == 32 else chr(b) if b in keep else f"%{b:02X}" for b in s.encode())
    return "&".join(f"{enc(k)}={enc(v)}" for k, v in pairs)
