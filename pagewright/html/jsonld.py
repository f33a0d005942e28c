"""Readers of JSON-LD scripts: a summary of types, events and addresses."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from ..functions.text import MONTHS
from ..functions.urls import _is_safe
from .markdown import strip

#: Types that describe the site rather than what a page is about.
FURNITURE = frozenset("aboutpage breadcrumblist collectionpage contactpage entrypoint imageobject itempage listitem organization profilepage searchaction searchresultspage sitenavigationelement webpage website wpfooter wpheader wpsidebar".split())


def _reject(name: str) -> float:
    raise ValueError(name)


def load(scripts: list[str]) -> list:
    """The scripts that are JSON, read."""
    out = []
    for raw in scripts:
        try:
            out.append(json.loads(raw.strip(" \t\n\r"), parse_constant=_reject))
        except (ValueError, RecursionError):
            continue
    return out


def _types(node: dict) -> list[str]:
    kind = node.get("@type")
    return [kind] if isinstance(kind, str) else [t for t in kind if isinstance(t, str)] if isinstance(kind, list) else []


def summarize(values: list) -> dict:
    """``types``, ``content_types`` (sorted, distinct), ``node_count`` and ``has_content_data``.

    Nodes deeper than eight levels and those after the first 501 aren't looked at.
    """
    nodes: list[dict] = []

    def visit(value: object, depth: int) -> None:
        if depth > 8 or len(nodes) > 500:
            return
        if isinstance(value, list):
            for item in value:
                visit(item, depth + 1)
        elif isinstance(value, dict):
            if _types(value):
                nodes.append(value)
            for key, child in value.items():
                if key not in ("@context", "@type") and isinstance(child, (dict, list)):
                    visit(child, depth + 1)

    for value in values:
        visit(value, 0)
    names = {re.split("[/#]", t)[-1] or t for node in nodes for t in _types(node)} - {""}
    order = lambda s: s.encode("utf-16-be", "surrogatepass")
    content = sorted((n for n in names if n.lower() not in FURNITURE), key=order)
    return {"types": sorted(names, key=order), "content_types": content, "node_count": len(nodes), "has_content_data": bool(content)}


def _text(value: object) -> str | None:
    return strip(value) or None if isinstance(value, str) else None


def _price(raw: object) -> float | None:
    if isinstance(raw, bool) or raw is None:
        return None
    if isinstance(raw, str):
        said = strip(raw)
        if re.fullmatch(r"0[xX][0-9a-fA-F]+", said):
            return float(int(said, 16))
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", said):
            return None
        raw = float(said)
    return float(raw) if isinstance(raw, (int, float)) and math.isfinite(raw) else None


def _money(value: float) -> str:
    return f"${int(value)}" if value == int(value) and abs(value) < 1e21 else f"${value!r}"


def price_text(offers: object) -> str | None:
    """``Free``, one price or a range; null without any."""
    each = offers if isinstance(offers, list) else [offers] if offers else []
    found = [p for o in each if isinstance(o, dict) and (p := _price(o.get("price"))) is not None]
    if not found:
        return None
    low, high = min(found), max(found)
    return "Free" if low == high == 0 else _money(low) if low == high else f"{_money(low)}-{_money(high)}"


def _named(value: object) -> str | None:
    """The name of a place: text, the first of a list, or an object's ``name``."""
    if isinstance(value, list):
        return _named(value[0]) if value else None
    return _text(value.get("name")) if isinstance(value, dict) else _text(value)


def _picture(value: object) -> str | None:
    while isinstance(value, (list, dict)):
        value = (value[0] if value else None) if isinstance(value, list) else value.get("url")
    return value if isinstance(value, str) and _is_safe(value) else None


def _performers(value: object) -> list[str] | None:
    each = value if isinstance(value, list) else [value] if value else []
    names = [p if isinstance(p, str) else _text(p.get("name")) if isinstance(p, dict) else None for p in each]
    return [n for n in names if n] or None


def spoken_date(iso: str | None) -> str | None:
    m = re.match(r"(\d{4})-(\d{2})-(\d{2})", iso or "", re.ASCII)
    return f"{MONTHS[int(m[2]) - 1]} {int(m[3])}, {m[1]}" if m and 1 <= int(m[2]) <= 12 else None


def _objects(value: object) -> Iterator[dict]:
    """All objects, parents first, in document order."""
    stack = [value]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            yield top
            stack.extend(reversed(list(top.values())))
        elif isinstance(top, list):
            stack.extend(reversed(top))


def events(values: list) -> list[dict]:
    """Fields of every node whose type says event."""
    nodes = [n for v in values for n in _objects(v) if any("event" in t.lower() for t in _types(n))]
    return [
        {"event_name": _text(n.get("name")), "date_text": spoken_date(_text(n.get("startDate"))), "venue_name": _named(n.get("location")), "price_text": price_text(n.get("offers")),
         "lineup": _performers(n.get("performer")), "description": _text(n.get("description")), "image_url": _picture(n.get("image"))} for n in nodes
    ]


def only_event(values: list) -> dict | None:
    found = events(values)
    return found[0] if len(found) == 1 else None


def address(values: list) -> dict | None:
    """The first object with a street address."""
    for value in values:
        for node in _objects(value):
            if street := _text(node.get("streetAddress")):
                return {"street_address": street, "city": _text(node.get("addressLocality")), "state": _text(node.get("addressRegion")), "postal_code": _text(node.get("postalCode"))}
    return None


def address_line(found: dict) -> str:
    return ", ".join(filter(None, (found[k] for k in ("street_address", "city", "state", "postal_code"))))
