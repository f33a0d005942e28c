"""A small HTML tree builder: tokens to a tree by the rules browsers follow for what pages really have.

Implied html, head and body; void and raw-text elements; paragraphs, list items and table parts that close
by themselves; formatting elements that are opened again after a block (three equal ones at most) and the
adoption agency for misnested ends. Content that can't be in a table goes before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
RCDATA = frozenset(("textarea", "title"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp listing plaintext".split())
SPECIAL = CLOSES_P | VOID | RAW | RCDATA | frozenset("applet body button caption col colgroup frameset head html marquee object select tbody td template tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_HEAD = frozenset("base link meta noframes script style template title".split())
_TABLE = frozenset("caption col colgroup table tbody td tfoot th thead tr".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""\s*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|\s*/""")


def _last_place(nodes: list, node) -> int:
    """Where ``node`` is in ``nodes``, looked for from the end."""
    at = len(nodes) - 1
    while nodes[at] is not node:
        at -= 1
    return at


def _kind(node) -> tuple | None:
    return node and (node.name, frozenset(node.attrs.items()))


class _Stack(list):
    """A list of nodes that knows what it holds, and how many by name (markers, None, have no name); with ``kinds``
    also how many by name and attributes."""

    def __init__(self, nodes=(), kinds: bool = False):
        super().__init__()
        self.kinds = kinds
        self.names: dict = {}
        self.ids: dict[int, int] = {}
        for node in nodes:
            self.append(node)

    def _count(self, node, n: int) -> None:
        for name in (node and node.name, _kind(node)) if self.kinds else (node and node.name,):
            self.names[name] = self.names.get(name, 0) + n
        left = self.ids.get(id(node), 0) + n
        if left:
            self.ids[id(node)] = left
        else:
            del self.ids[id(node)]

    def has(self, *names: str) -> bool:
        return any(self.names.get(n) for n in names)

    def __contains__(self, node) -> bool:
        return id(node) in self.ids

    def append(self, node) -> None:
        super().append(node)
        self._count(node, 1)

    def insert(self, at: int, node) -> None:
        super().insert(at, node)
        self._count(node, 1)

    def pop(self):
        node = super().pop()
        self._count(node, -1)
        return node

    def index(self, node) -> int:
        return _last_place(self, node)

    def remove(self, node) -> None:
        super().__delitem__(_last_place(self, node))
        self._count(node, -1)

    def __setitem__(self, at: int, node) -> None:
        self._count(self[at], -1)
        super().__setitem__(at, node)
        self._count(node, 1)

    def __delitem__(self, part: slice) -> None:
        for node in self[part]:
            self._count(node, -1)
        super().__delitem__(part)


#: Elements nested deeper become siblings at this depth, as in browsers; formatting opened again after so many isn't.
MOST_DEPTH, MOST_REOPENED = 512, 50_000


class Node:
    """An element, or with an empty name a run of text."""

    __slots__ = ("name", "attrs", "children", "parent", "text")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.name, self.attrs, self.text = name, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node, before: Node | None = None) -> None:
        if child.parent:
            child.parent.children.remove(child)
        child.parent = self
        self.children.insert(_last_place(self.children, before) if before else len(self.children), child)

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self, *names: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.name and (not names or n.name in names))

    def string(self, skip: frozenset[str] = frozenset()) -> str:
        """Text of all descendants, one after the other without anything between."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if not node.name:
                out.append(node.text)
            elif node.name not in skip or node is self:
                stack.extend(reversed(node.children))
        return "".join(out)

    def ancestors(self) -> Iterator[Node]:
        node: Node | None = self
        while node:
            yield node
            node = node.parent

    def cut(self) -> None:
        """Forget all parents, so that the nodes go with their last reference and don't wait for the garbage collector."""
        stack = [self]
        while stack:
            node = stack.pop()
            node.parent = None
            stack.extend(node.children)


def _attributes(raw: str, at: int) -> tuple[dict[str, str], int]:
    attrs: dict[str, str] = {}
    while at < len(raw):
        m = _ATTR.match(raw, at)
        if not m or m.end() == at:
            break
        at = m.end()
        if m[1]:
            attrs.setdefault(m[1].lower(), unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    end = raw.find(">", at)
    return attrs, len(raw) if end < 0 else end + 1


class Builder:
    def __init__(self):
        self.document = Node("#document")
        self.html = Node("html")
        self.document.append(self.html)
        self.head: Node | None = None
        self.body: Node | None = None
        self.after_head = False
        self.open = _Stack([self.html])
        self.active = _Stack(kinds=True)
        self.reopened = 0

    @property
    def current(self) -> Node:
        return self.open[-1]

    def _in_scope(self, names: frozenset[str] | set[str], stop: frozenset[str] = _SCOPE) -> bool:
        if not self.open.has(*names):
            return False
        for node in reversed(self.open):
            if node.name in names:
                return True
            if node.name in stop:
                return False
        return False

    def _pop_to(self, names: frozenset[str] | set[str]) -> None:
        while len(self.open) > 1 and self.open.pop().name not in names:
            pass

    def _place(self) -> tuple[Node, Node | None]:
        """Where the next node goes; what a table can't hold goes before it."""
        if self.current.name in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next(n for n in reversed(self.open) if n.name in ("table", "template", "html"))
            if table.name == "table" and table.parent:
                return table.parent, table
        return self.open[min(len(self.open), MOST_DEPTH) - 1], None

    def _insert(self, node: Node, foster: bool = True) -> Node:
        where, before = self._place() if foster else (self.open[min(len(self.open), MOST_DEPTH) - 1], None)
        where.append(node, before)
        return node

    def _want_body(self) -> None:
        if self.body is None:
            self._want_head()
            self.after_head = True
            self.open = _Stack([self.html])
            self.body = Node("body")
            self.html.append(self.body)
            self.open.append(self.body)

    def _want_head(self) -> None:
        if self.head is None:
            self.head = Node("head")
            self.html.append(self.head)

    def _reopen(self) -> None:
        """Open again what formatting was closed by a block's end."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.open:
            k -= 1
        self.reopened += len(self.active) - k
        if self.reopened > MOST_REOPENED:
            del self.active[k:]
        for i in range(k, len(self.active)):
            old = self.active[i]
            new = self._insert(Node(old.name, old.attrs))
            self.open.append(new)
            self.active[i] = new

    def _note(self, node: Node) -> None:
        same = []
        for old in reversed(self.active) if self.active.names.get(_kind(node), 0) > 2 else ():
            if old is None:
                break
            if old.name == node.name and old.attrs == node.attrs:
                same.append(old)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(node)

    def _close_p(self) -> None:
        if self._in_scope({"p"}, _SCOPE | {"button"}):
            self._pop_to({"p"})

    def chars(self, text: str) -> None:
        if self.body is None:
            if not text.strip():
                return
            self._want_body()
        if text.strip() or self.current.name not in ("table", "tbody", "tfoot", "thead", "tr"):
            self._reopen()
        where, before = self._place() if text.strip() else (self.current, None)
        spot = _last_place(where.children, before) if before else len(where.children)
        if spot and not where.children[spot - 1].name:
            where.children[spot - 1].text += text
        else:
            where.append(Node("", text=text), before)

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if name == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return None
        if name == "head":
            if self.head is None and self.body is None:
                self._want_head()
                self.head.attrs.update(attrs)
            return None
        if name == "body":
            self._want_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return None
        if self.body is None:
            if name in _HEAD or name == "noscript":
                self._want_head()
                node = Node(name, attrs)
                self.head.append(node)
                if name == "template":
                    self._want_body()
                return node if name in RAW | RCDATA else None
            self._want_body()
        if name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return self._table_part(name, attrs)
        if name in CLOSES_P and name not in ("li", "dd", "dt"):
            self._close_p()
        if name in HEADINGS and self.current.name in HEADINGS:
            self.open.pop()
        elif name in ("li", "dd", "dt"):
            same = {"li"} if name == "li" else {"dd", "dt"}
            for node in reversed(self.open):
                if node.name in same:
                    self._pop_to({node.name})
                    break
                if node.name in SPECIAL and node.name not in ("address", "div", "p"):
                    break
            self._close_p()
        elif name in ("option", "optgroup") and self.current.name == "option":
            self.open.pop()
        elif name == "a" and self.active.has("a") and (old := next((x for x in reversed(self.active) if x is None or x.name == "a"), None)):
            self.end("a")
            if old in self.active:
                self.active.remove(old)
            if old in self.open:
                self.open.remove(old)
        elif name == "nobr" and self._in_scope({"nobr"}):
            self.end("nobr")
        elif name == "button" and self._in_scope({"button"}):
            self._pop_to({"button"})
        elif name == "form" and self.open.has("form"):
            return None
        if name not in CLOSES_P and name not in ("base", "link", "meta", "param", "source", "track", "script", "style", "template", "title", "noscript"):
            self._reopen()
        node = self._insert(Node("img" if name == "image" else name, attrs))
        if node.name in VOID or closed and name in ("path", "circle", "rect", "line", "use", "g", "svg", "polygon"):
            return None
        self.open.append(node)
        if name in FORMATTING:
            self._note(node)
        elif name in ("applet", "marquee", "object", "template"):
            self.active.append(None)
        return node

    def _table_part(self, name: str, attrs: dict[str, str]) -> Node | None:
        if not self.open.has("table", "template"):
            return None
        inside = {"td": {"tr"}, "th": {"tr"}, "tr": {"tbody", "thead", "tfoot"}}.get(name, {"table"})
        base = inside | ({"tbody", "thead", "tfoot", "table"} if name in ("td", "th") else {"table"})
        while self.current.name not in base and self.current.name not in ("html", "template"):
            closed = self.open.pop()
            if closed.name in ("td", "th", "caption"):
                self._clear_active()
        if name in ("td", "th", "tr") and self.current.name == "table":
            self.open.append(self._insert(Node("tbody"), False))
        if name in ("td", "th") and self.current.name in ("tbody", "thead", "tfoot"):
            self.open.append(self._insert(Node("tr"), False))
        node = self._insert(Node(name, attrs), False)
        if name != "col":
            self.open.append(node)
        if name in ("td", "th", "caption"):
            self.active.append(None)
        return None

    def _clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def end(self, name: str) -> None:
        if name in ("html", "body", "head"):
            if name == "body" or name == "html":
                self._want_body()
            return
        if self.body is None:
            if name == "br":
                self.start("br", {}, False)
            return
        if name in FORMATTING:
            self._adopt(name)
        elif name == "p":
            if not self._in_scope({"p"}, _SCOPE | {"button"}):
                self.start("p", {}, False)
            self._close_p()
        elif name == "br":
            self.start("br", {}, False)
        elif name in HEADINGS:
            if self._in_scope(HEADINGS):
                self._pop_to(HEADINGS)
        elif name in _TABLE:
            if self._in_scope({name}, frozenset(("html", "template")) | ({"table"} if name != "table" else set())):
                while self.current.name != name:
                    if self.open.pop().name in ("td", "th", "caption"):
                        self._clear_active()
                self.open.pop()
                if name in ("td", "th", "caption"):
                    self._clear_active()
        elif name in SPECIAL:
            stop = _SCOPE | ({"ol", "ul"} if name == "li" else set())
            if self._in_scope({name}, stop):
                self._pop_to({name})
                if name in ("applet", "marquee", "object", "template"):
                    self._clear_active()
        elif self.open.has(name):
            for node in reversed(self.open):
                if node.name == name:
                    self._pop_to({name})
                    break
                if node.name in SPECIAL:
                    break

    def _adopt(self, name: str) -> None:
        if self.current.name == name and self.current not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            fmt = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == name:
                    fmt = x
                    break
            if fmt is None:
                for node in reversed(self.open) if self.open.has(name) else ():
                    if node.name == name:
                        self._pop_to({name})
                        return
                    if node.name in SPECIAL:
                        return
                return
            if fmt not in self.open:
                self.active.remove(fmt)
                return
            at = self.open.index(fmt)
            if any(n.name in _SCOPE for n in self.open[at + 1 :]):
                return
            block = next((n for n in self.open[at + 1 :] if n.name in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(fmt)
                return
            common, mark = self.open[at - 1], self.active.index(fmt)
            last, k = block, self.open.index(block)
            for turn in range(1, len(self.open) + 1):
                k -= 1
                node = self.open[k]
                if node is fmt:
                    break
                if turn > 3 and node in self.active:
                    mark -= self.active.index(node) < mark
                    self.active.remove(node)
                if node not in self.active:
                    self.open.remove(node)
                    continue
                new = Node(node.name, node.attrs)
                self.active[self.active.index(node)] = new
                self.open[k] = new
                if last is block:
                    mark = self.active.index(new) + 1
                new.append(last)
                last = new
            common.append(last)
            new = Node(fmt.name, fmt.attrs)
            for child in list(block.children):
                new.append(child)
            block.append(new)
            where = self.active.index(fmt)
            self.active.remove(fmt)
            self.active.insert(max(0, mark - (where < mark)), new)
            self.open.remove(fmt)
            self.open.insert(self.open.index(block) + 1, new)


def parse(html: str) -> Node:
    """The document of ``html``; it always has html, head and body."""
    b = Builder()
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            b.chars(unescape(html[at:]))
            break
        if lt > at:
            b.chars(unescape(html[at:lt]))
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif nxt == "/":
            m = _NAME.match(html, lt + 2)
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            if m:
                b.end(m[0].lower())
        elif m := _NAME.match(html, lt + 1):
            name = m[0].lower()
            attrs, at = _attributes(html, m.end())
            node = b.start(name, attrs, html[at - 2 : at] == "/>")
            if node and name in RAW | RCDATA:
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                body = html[at : close.start() if close else n]
                if name == "textarea" and body[:1] == "\n":
                    body = body[1:]
                if body:
                    node.append(Node("", text=unescape(body) if name in RCDATA else body))
                if b.body is not None and b.current is node:
                    b.open.pop()
                end = html.find(">", close.start()) if close else -1
                at = n if end < 0 else end + 1
        else:
            b.chars("<")
            at = lt + 1
    b._want_body()
    return b.document


@contextmanager
def parsed(html: str) -> Iterator[Node]:
    """The document of ``html``, cut at the end."""
    doc = parse(html)
    try:
        yield doc
    finally:
        doc.cut()
