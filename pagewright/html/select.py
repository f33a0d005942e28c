"""CSS selectors over the tree: types, classes, ids, attributes, ``:first-child``, ``:last-child``, ``:nth-child``,
``:not``, descendant, child and sibling combinators, and lists of them. Anything else is a ValueError."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .tree import Node

_PART = re.compile(r"""
    (?P<type>\*|[A-Za-z][\w-]*) | \#(?P<id>[\w-]+) | \.(?P<cls>[\w-]+)
  | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]
  | :(?P<pseudo>first-child|last-child|only-child|empty) | :nth-child\(\s*(?P<nth>odd|even|[+-]?\d*n?\s*(?:[+-]\s*\d+)?)\s*\) | :not\((?P<not>[^()]+)\)
""", re.X)  # fmt: skip
Test = Callable[[Node], bool]


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if c.name] if n.parent else [n]


def _attribute(m: re.Match) -> Test:
    name, op = m["attr"].lower(), m["op"]
    value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
    tests = {
        None: lambda x: True, "=": lambda x: x == value, "~=": lambda x: bool(value) and value in x.split(), "|=": lambda x: x == value or x.startswith(value + "-"),
        "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x,
    }
    return lambda n: name in n.attrs and tests[op](n.attrs[name])


def _nth(text: str) -> Test:
    text = {"odd": "2n+1", "even": "2n"}.get(text, text).replace(" ", "")
    if "n" in text:
        a, _, b = text.partition("n")
        step, first = int(a + "1" if a in ("", "+", "-") else a), int(b or 0)
    else:
        step, first = 0, int(text)

    def test(n: Node) -> bool:
        k = _siblings(n).index(n) + 1 - first
        return k == 0 if step == 0 else k % step == 0 and k // step >= 0

    return test


def _simple(text: str) -> tuple[Test, int]:
    """The compound selector at the start of ``text`` and its length."""
    tests: list[Test] = []
    at = 0
    while m := _PART.match(text, at):
        if m["type"]:
            if at:
                break
            tests.append(lambda n, t=m["type"].lower(): t == "*" or n.name == t)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(_attribute(m))
        elif m["nth"]:
            tests.append(_nth(m["nth"]))
        elif m["not"]:
            inner = compile_selector(m["not"])
            tests.append(lambda n, inner=inner: not inner(n))
        elif m["pseudo"] == "empty":
            tests.append(lambda n: not n.children)
        else:
            ends = {"first-child": (0,), "last-child": (-1,), "only-child": (0, -1)}[m["pseudo"]]
            tests.append(lambda n, ends=ends: all(_siblings(n)[e] is n for e in ends))
        at = m.end()
    if not tests:
        raise ValueError(f"selector not understood: {text!r}")
    return lambda n: all(t(n) for t in tests), at


@lru_cache(maxsize=1000)
def compile_selector(text: str) -> Test:
    """A test for elements."""
    choices = []
    for one in re.split(r",(?![^\[(]*[\])])", text):
        rest, steps = one.strip(), []
        link = ""
        while True:
            test, used = _simple(rest)
            steps.append((link, test))
            rest = rest[used:]
            if not rest.strip():
                break
            m = re.match(r"\s*([>+~])\s*|\s+", rest)
            if not m:
                raise ValueError(f"selector not understood: {text!r}")
            link, rest = m[1] or " ", rest[m.end() :]
        choices.append(steps)

    def matches(node: Node, steps: list, k: int) -> bool:
        link, test = steps[k]
        if not node.name or node.name.startswith("#") or not test(node):
            return False
        if k == 0:
            return True
        if link == ">":
            return bool(node.parent) and matches(node.parent, steps, k - 1)
        if link == " ":
            return any(matches(a, steps, k - 1) for a in node.ancestors() if a is not node)
        before = _siblings(node)[: _siblings(node).index(node)]
        return any(matches(s, steps, k - 1) for s in (before[-1:] if link == "+" else before))

    return lambda node: any(matches(node, steps, len(steps) - 1) for steps in choices)


def select(root: Node, selector: str) -> list[Node]:
    """Descendants of ``root`` that match, in document order."""
    test = compile_selector(selector)
    return [n for n in root.elements() if test(n)]
