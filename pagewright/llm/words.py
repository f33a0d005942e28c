"""Word hashes and word n-gram sets of texts, vectorised over the bytes of many texts at once.

A word is a run of a-z, 0-9 and bytes from 128 on in lower-case text; everything else separates.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mix

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[k] = np.cumprod(t)
    return _tables[0][:n], _tables[1][:n]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and the bounds of each text's words.

    Prefix sums of byte times power give every word's polynomial hash without a loop.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    w = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * power[:n], out=prefix[1:])
    h = (prefix[e] - prefix[s]) * inverse[s]
    return mix(h ^ ((e - s).astype(np.uint64) << U64(56))), np.searchsorted(s, offs)


_PLACE = [U64(x | 1) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def ngram_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct word n-grams of each text as sorted 64-bit hashes.

    A text of fewer than ``n`` words, but one at least, has a single gram of all its words.
    """
    h, bounds = word_hashes(data, offs)
    grams = np.zeros(0, np.uint64)
    if len(h) >= n:
        m = len(h) - n + 1
        grams = h[:m] * _PLACE[0]
        for j in range(1, n):
            grams += h[j : j + m] * _PLACE[j]
        grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(g), bool)
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif b > a:
            out.append(mix((h[a:b] * np.array(_PLACE[: b - a])).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
