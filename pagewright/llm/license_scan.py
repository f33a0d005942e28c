"""Operator 2, license scans by conditional compression.

A license word and the words around it, as far as the longest stretch of any template that has none, make a
candidate block; lines and sentences don't matter. In a block, the words of it and of each template are
aligned, and what is missing, put in or in a wrong version counts. What is found is compressed by itself and
with its template as zstandard raw-content dictionary: the fewer bytes it takes given a template, the more of
the template's wording it holds, and the template that saves most wins. What lies before and after a notice
is scanned again, so a block may hold several.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

_WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
#: A block has one of these; every template has one.
ANCHORS = r"licen[cs]|copyright|warrant|redistribut|permission[\W_]+is|public[\W_]+domain|\bcc[\W_]+by|\bcc0|\bmpl\b|\bgpl"
_ANCHOR = re.compile(ANCHORS)

_NOTICE = "the above copyright notice and this permission notice"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_GRANTS = ("Released under the {}", "Licensed under the {}", "This work is licensed under the {}", "Distributed under the {}")
_NAMES = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"), "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",),
    "EPL-2.0": ("Eclipse Public License, Version 2.0",),
}
_CC = {f"CC-{k.replace(' ', '-')}-{v}": (f"CC {k} {v}", f"Creative Commons {name} {v} International License") for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("4.0", "3.0")}
_CC_GRANTS = ("Licensed under {}", "This work is licensed under {}", "This work is licensed under a {}", "Released under {}")

#: ``(license, wording)``, whole notices first.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: {_NOTICE} shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that {_NOTICE} appear in all copies."),
    ("GPL-3.0", _GNU.format(name="General Public License", v=3)), ("GPL-2.0", _GNU.format(name="General Public License", v=2)),
    ("LGPL-3.0", _GNU.format(name="Lesser General Public License", v=3)), ("AGPL-3.0", _GNU.format(name="Affero General Public License", v=3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((k, grant.format(name)) for k, names in _NAMES.items() for name in names for grant in _GRANTS),
    *((k, grant.format(name)) for k, names in _CC.items() for name in names for grant in (_CC_GRANTS if name.startswith("CC ") else _CC_GRANTS[2:3])),
)


@dataclass(frozen=True)
class LicenseParams:
    """``least_share`` of a template's own compressed size must be saved to be tried; ``tolerance`` is the share of
    its words that may differ."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    least_share: float = 0.35
    tolerance: float = 0.1
    level: int = 19


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places in ``text``."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _anchors(own: list[str]) -> list[tuple[int, int]]:
    """Where license words stand in a row of words, as ranges of it."""
    starts = [0, *accumulate(len(w) + 1 for w in own)]
    return [(bisect_right(starts, m.start()) - 1, bisect_left(starts, m.end())) for m in _ANCHOR.finditer(" ".join(own))]


def blocks(own: list[str], reach: int) -> list[tuple[int, int]]:
    """Candidate blocks as ranges of words: license words with ``reach`` others around each, joined where these meet."""
    out: list[tuple[int, int]] = []
    for a, b in _anchors(own):
        lo, hi = max(0, a - reach), min(len(own), b + reach)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _reach(own: list[str]) -> int:
    """The longest stretch of a template before, between or after its license words."""
    at = _anchors(own)
    return max(lo - hi for hi, lo in zip([0, *(b for _, b in at)], [*(a for a, _ in at), len(own)]))


#: Words that tell licenses apart: one that is missing or put in makes another license.
_TELLING = frozenset("mit apache gnu gpl lesser affero mozilla bsd isc eclipse neither endorse attribution noncommercial noderivatives sharealike".split())


def _telling(word: str) -> bool:
    return word in _TELLING or any(c.isdigit() for c in word) or word.startswith(("attribution-", "by-"))


def differences(template: list[str], block: list[str], most: int) -> tuple[int, int, int, int, bool]:
    """``(first, end, missing, extra, same license)``: where in ``block`` the template's wording lies, how many
    of its words are missing there and how many others were put in. No more than ``most`` put in are looked past."""
    match = SequenceMatcher(None, template, block, autojunk=False).find_longest_match()
    if not match.size:
        return 0, 0, len(template), 0, False
    skip = max(0, match.b - match.a - most)
    block = block[skip : match.b + len(template) - match.a + most]
    runs = [r for r in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if r.size]
    core = lo = hi = max(range(len(runs)), key=lambda i: runs[i].size)
    while lo > 0 and runs[lo].b - runs[lo - 1].b - runs[lo - 1].size <= max(2, 2 * runs[lo - 1].size):
        lo -= 1
    while hi + 1 < len(runs) and runs[hi + 1].b - runs[hi].b - runs[hi].size <= max(2, 2 * runs[hi + 1].size):
        hi += 1
    assert lo <= core <= hi
    first, end = runs[lo].b, runs[hi].b + runs[hi].size
    found = runs[lo : hi + 1]
    met = sum(r.size for r in found)
    in_template = {i for r in found for i in range(r.a, r.a + r.size)}
    in_block = {i for r in found for i in range(r.b, r.b + r.size)}
    lost = [w for i, w in enumerate(template) if i not in in_template]
    put = [block[i] for i in range(first, end) if i not in in_block]
    return skip + first, skip + end, len(template) - met, len(put), not any(map(_telling, lost + put))


class Scanner:
    """Templates ready for use: their words, a dictionary compressor each, and their own compressed sizes."""

    def __init__(self, params: LicenseParams):
        self.params = params
        flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(level=params.level, **flags)
        self.reach, self.templates = 0, []
        for name, text in params.templates:
            own = [w for w, _, _ in words(text)]
            self.reach = max(self.reach, _reach(own) + int(params.tolerance * len(own)))
            raw = " ".join(own).encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=params.level)
            self.templates.append((name, own, zstandard.ZstdCompressor(dict_data=d, level=params.level, **flags), len(self.plain.compress(raw))))
        self.scan = lru_cache(maxsize=20_000)(self._scan)

    def likely(self, block: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``(template, first, end, missing, extra)`` of the templates whose wording the block holds within the tolerance."""
        held, out = set(block), []
        for k, (_, own, _, _) in enumerate(self.templates):
            most = int(self.params.tolerance * len(own))
            if sum(w not in held for w in own) <= most:
                first, end, missing, extra, same = differences(own, block, most)
                if same and missing + extra <= most:
                    out.append((k, first, end, missing, extra))
        return out

    def reduction(self, k: int, notice: list[str]) -> tuple[int, int]:
        """The size of a notice by itself, and the bytes that template ``k`` saves."""
        raw = " ".join(notice).encode()
        alone = len(self.plain.compress(raw))
        return alone, alone - len(self.templates[k][2].compress(raw))

    def _scan(self, block: tuple[str, ...]) -> tuple[tuple[int, int, str, int, int, int, int], ...]:
        """Confirmed notices ``(first word, end word, license, size alone, bytes saved, missing, extra)``."""
        todo, found = [(0, len(block))], []
        while todo:
            lo, hi = todo.pop()
            part = list(block[lo:hi])
            if hi - lo < 2 or not _anchors(part):
                continue
            best = None
            for k, first, end, missing, extra in self.likely(part):
                name, own, _, size = self.templates[k]
                alone, saved = self.reduction(k, part[first:end])
                key = (saved, len(own), -(missing + extra), -k)
                if saved >= self.params.least_share * size and (best is None or key > best[:4]):
                    best = (*key, first, end, name, alone, missing, extra)
            if best:
                first, end, name, alone, missing, extra = best[4:]
                found.append((lo + first, lo + end, name, alone, best[0], missing, extra))
                todo += [(lo, lo + first), (lo + end, hi)]
        return tuple(sorted(found))

    def text(self, text: str) -> list[tuple[int, int, str, int, int, int, int]]:
        """Notices of a text, with places in characters."""
        out = []
        every = words(text)
        for a, b in blocks([x for x, _, _ in every], self.reach):
            w = every[a:b]
            for first, end, *rest in self.scan(tuple(x for x, _, _ in w)):
                out.append((w[first][1], w[end - 1][2], *rest))
        return out


_SCHEMA = "doc_id long, license string, start int, end int, size_alone int, saved int, missing int, extra int"


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """``(doc_id, license, start, end, size_alone, saved, missing, extra)``, a row for each notice found.

    ``start`` and ``end`` are characters of ``text``, ``missing`` and ``extra`` count words that differ from
    the template; both are 0 for exact wording. Defined results: null and empty texts and texts without a
    license word have no row; templates that save as many bytes go by the longer wording, then the fewer
    differences, then their order; a notice that stands twice, repeated rows and null doc_ids give a row
    each; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(params)
        for batch in batches:
            rows = [(i, *hit) for i, t in enumerate(batch.column(1)) for hit in scanner.text(t.as_py())]
            cols = list(zip(*rows)) if rows else [()] * 8
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4)
            start, end, name, *rest = [pa.array(c, k) for c, k in zip(cols[1:], kinds)]
            yield pa.RecordBatch.from_arrays([ids, name, start, end, *rest], [x.split()[0] for x in _SCHEMA.split(", ")])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.lower("text").rlike(ANCHORS))
    return base.mapInArrow(releasing(run), _SCHEMA)
