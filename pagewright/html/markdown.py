"""Main region, Markdown and content images of a parsed page."""

from __future__ import annotations

import math
import re

from ..functions import whatwg
from .tree import Node

CHROME = frozenset(("aside", "footer", "form", "header", "nav", "noscript", "script", "style", "svg", "template"))
_JS_SPACE = " \t\n\r\x0b\x0c\xa0﻿                　"
_SPACES = re.compile(f"[{_JS_SPACE}]+")


def strip(text: str) -> str:
    return text.strip(_JS_SPACE)


def squeeze(text: str) -> str:
    """White space of any kind as single spaces, none at the ends."""
    return _SPACES.sub(" ", text).strip(" ")


def _escape(text: str) -> str:
    return re.sub(r"[\\`*_\[\]]", r"\\\g<0>", text)


def _collapse(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text)


def main_region(doc: Node) -> Node:
    """The first ``main``, else the first ``article``, else the parent that paragraphs vote for, else the body."""
    for name in ("main", "article"):
        if found := next(doc.elements(name), None):
            return found
    return _voted(doc) or next(doc.elements("body"))


def _voted(doc: Node) -> Node | None:
    votes: dict[Node, float] = {}
    total, voters = 0.0, 0
    for p in doc.elements("p"):
        if any(a.name in CHROME for a in p.ancestors()):
            continue
        text = strip(p.string())
        if len(text) < 25:
            continue
        linked = strip("".join(a.string() for a in p.elements("a")))
        vote = len(text) * (1 - len(linked) / len(text))
        if vote > 0:
            voters += 1
            total += vote
            votes[p.parent] = votes.get(p.parent, 0.0) + vote
    best = max(votes, key=votes.__getitem__, default=None)  # the first of equals
    return best if voters > 1 and best and votes[best] / total >= 0.4 else None


def _image(node: Node) -> str:
    alt, src = strip(node.attrs.get("alt", "")), strip(node.attrs.get("src", ""))
    inlined = lambda s: s[:5].lower() == "data:"
    if inlined(src):
        src = strip(node.attrs.get("data-src", ""))
    if not src or inlined(src):
        return _escape(alt)
    return f"![{_escape(alt)}]({src})"


def _linked(label: str, node: Node) -> str:
    href = node.attrs.get("href", "")
    return f"[{label}]({href})" if href else label


_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def inline(node: Node) -> str:
    """The text of ``node`` on one line, with its emphasis, code, links and images."""
    stack = [(node, iter(node.children), [])]
    while True:
        at, left, parts = stack[-1]
        for child in left:
            name = child.name
            if not name:
                parts.append(_escape(_collapse(child.text)))
            elif name in CHROME:
                continue
            elif name == "img":
                parts.append(_image(child))
            elif name == "br":
                parts.append(" ")
            elif name == "code":
                if text := strip(child.string(CHROME)):
                    parts.append(f"`{text}`")
            else:
                stack.append((child, iter(child.children), []))
                break
        else:
            stack.pop()
            text = strip(_collapse("".join(parts)))
            if not stack:
                return text
            mark = _MARKS.get(at.name, "")
            stack[-1][2].append(_linked(text, at) if text and at.name == "a" else mark + text + mark if text else "")


def _table(node: Node) -> str:
    rows = []
    for tr in node.elements("tr"):
        if _hidden(tr, node):
            continue
        cells = [inline(c).replace("|", "\\|") for c in tr.children if c.name in ("td", "th")]
        if any(map(strip, cells)):
            rows.append(cells)
    if len(rows) < 2:
        return " ".join(filter(None, rows[0])) if rows else ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _hidden(node: Node, top: Node) -> bool:
    for a in node.ancestors():
        if a is top:
            return False
        if a.name in CHROME:
            return True
    return False


_HEADING = re.compile("h[1-6]")


def _block(node: Node) -> str | None:
    """The Markdown of a block, None for an element whose children are blocks of their own."""
    name = node.name
    if not name:
        return _escape(strip(_collapse(node.text)))
    if name in CHROME or name == "br":
        return ""
    if name == "hr":
        return "---"
    if name in ("p", "blockquote") or _HEADING.fullmatch(name):
        text = inline(node)
        return text and ({"p": "", "blockquote": "> "}[name] if name in ("p", "blockquote") else "#" * int(name[1]) + " ") + text
    if name in ("ol", "ul"):
        items = [(k, inline(li)) for k, li in enumerate((c for c in node.children if c.name == "li"), 1)]
        return "\n".join(f"{f'{k}.' if name == 'ol' else '-'} {text}" for k, text in items if text)
    if name == "table":
        return _table(node)
    if name == "pre":
        code = node.string(CHROME).rstrip(_JS_SPACE)
        return f"```\n{code}\n```" if strip(code) else ""
    if name == "a":
        text = inline(node)
        return text and _linked(text, node)
    return _image(node) if name == "img" else None


def _blocks(node: Node) -> list[str]:
    out, stack = [], node.children[::-1]
    while stack:
        child = stack.pop()
        block = _block(child)
        if block:
            out.append(block)
        elif block is None:
            stack.extend(reversed(child.children))
    return out


def to_markdown(doc: Node, most: int | None = None) -> str:
    """The main region as Markdown, blocks a blank line apart, without chrome."""
    text = strip(re.sub(r"\n{3,}", "\n\n", "\n\n".join(_blocks(main_region(doc)))))
    return text[:most] + "\n[TRUNCATED]" if most and len(text) > most else text


#: Parts of image addresses that mean page furniture.
_FURNITURE = re.compile(r"(?:^|[/_-])(?:" + "|".join(sorted("logo icon favicon sprite avatar badge banner-ad advert pixel spacer placeholder thumb thumbnail arrow bullet divider social facebook twitter instagram".split())) + r")(?:[/_.-]|$)", re.I)
_DRAWN = re.compile(r"[.](?:gif|ico|svg)(?:[?#]|$)", re.I)
_NOTICE = re.compile("brochure|calendar|flyer|lineup|menu|poster|program|schedule", re.I)


def _number(raw: str | None) -> float:
    try:
        value = float(strip(raw or "") or 0)
    except ValueError:
        return 0
    return value if math.isfinite(value) else 0


def content_images(doc: Node, page_url: str, most: int = 3) -> list[tuple[str, str, int]]:
    """``(url, alt, score)`` of the images that are likely content, best first, the earlier of equals first."""
    base = whatwg.parse(page_url)
    inside = set(main_region(doc).elements("img"))
    seen: set[str] = set()
    out = []
    for img in doc.elements("img"):
        raw = strip(img.attrs.get("src") or img.attrs.get("data-src") or "")
        url = whatwg.parse(raw, base) if raw else None
        if url is None or url.scheme not in ("http", "https") or str(url) in seen:
            continue
        address = str(url)
        seen.add(address)
        w, h = _number(img.attrs.get("width")), _number(img.attrs.get("height"))
        if _FURNITURE.search(address) or _DRAWN.search(address) or 0 < w < 200 or 0 < h < 200:
            continue
        alt, side = strip(img.attrs.get("alt", "")), max(w, h)
        score = 10 * (img in inside) + (5 if side >= 600 else 2 if side >= 300 else 0) + 3 * (0 < w <= h)
        score += (3 if len(alt) >= 15 else 1 if alt else 0) + 4 * bool(_NOTICE.search(address))
        if score:
            out.append((address, alt, score))
    return sorted(out, key=lambda x: -x[2])[:most]
