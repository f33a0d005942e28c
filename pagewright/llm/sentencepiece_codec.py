"""Operator 5, SentencePiece encoding and decoding with the bytes each piece came from.

The model file is read here: pieces, scores, flags and the compiled character map of its normaliser. The
map is a double-array trie whose values point into a pool of replacements; a text is normalised by taking,
at each place, the longest key of the map that is a prefix of what follows, and each byte of the result
remembers the source bytes it stands for. Segmentation runs on the normalised text; every piece is then
projected to a span of bytes of the original text.

Pieces never reach over a boundary that no piece of the vocabulary contains, so the text is cut into units
there (a word with the spaces before it, or a lone character that no longer piece has), and each distinct
unit is segmented once a task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

SPACE = "▁"
_WORDS = re.compile(" |[^ ]+")


@dataclass(frozen=True)
class PieceParams:
    """``model_file`` must be readable at the same path on every executor."""

    model_file: str = "/opt/tokenizers/piece_bpe_32k.model"
    cache: int = 200_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[i : i + n]
            i += n


def _message(number: int, body: bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out + bytes([n]))

    return varint(number << 3 | 2) + varint(len(body)) + body


class CharacterMap:
    """The compiled map: ``<trie bytes (u32)><trie><pool of zero-ended replacements>``."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + n :]
        self.first, self.inner = self._bytes()

    def _bytes(self) -> tuple[frozenset[int], frozenset[int]]:
        """The bytes that keys start with, and those that they go on with."""
        if not self.units:
            return frozenset(), frozenset()
        units = np.array(self.units, np.uint64)
        offset = (units >> np.uint64(10)) << ((units & np.uint64(1 << 9)) >> np.uint64(6))
        first: set[int] = set()
        inner: set[int] = set()
        level, seen = np.array([offset[0]], np.uint64), np.zeros(0, np.int64)
        into = first
        while len(level):
            at = (level[:, None] ^ np.arange(256, dtype=np.uint64)).astype(np.int64)
            ok = at < len(units)
            label = units[np.where(ok, at, 0)] & np.uint64(1 << 31 | 0xFF)
            ok &= (label == np.arange(256, dtype=np.uint64)) & (np.arange(256) > 0)
            into.update(np.flatnonzero(ok.any(0)).tolist())
            node = np.setdiff1d(at[ok], seen)
            seen = np.union1d(seen, node)
            level, into = offset[node] ^ node.astype(np.uint64), inner
        return frozenset(first), frozenset(inner)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``raw`` has at ``at``."""
        units = self.units
        if not units:
            return None
        found, unit = None, units[0]
        node = unit >> 10 << ((unit & 1 << 9) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & (1 << 31 | 0xFF) != raw[i]:
                break
            node ^= unit >> 10 << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                value = units[node] & (1 << 31) - 1
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        rest, spec, trainer = b"", {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1])
                self.kinds.append(piece.get(3, 1))
            elif number == 3:
                spec = dict(_fields(value))
                continue
            elif number == 2:
                trainer = dict(_fields(value))
            rest += _message(number, value) if isinstance(value, bytes) else b""
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.fallback = bool(trainer.get(35, 0))
        # the library segments; normalisation has been done by then, so its own is switched off
        plain = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
        self.library = sentencepiece.SentencePieceProcessor(model_proto=rest + _message(3, plain))
        self.unknown = self.library.unk_id()
        self.lengths = np.array([1 if k == 6 else len(p) for p, k in zip(self.pieces, self.kinds)], np.int32)
        texts = [p.decode() for p, k in zip(self.pieces, self.kinds) if k in (1, 4, 5) and len(p.decode(errors="ignore")) > 1]
        inner = any(SPACE in t.lstrip(SPACE) for t in texts)
        joined = set("".join(texts))
        self.lone = [c for c in "\n\t\r" if c not in joined]
        lone = "".join(map(re.escape, self.lone))
        self.units = None if inner or not self.escape or 4 in self.kinds else re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, np.ndarray, np.ndarray, int]] = {}
        self.splits = 32 not in self.map.first and 32 not in self.map.inner  # no key reaches over a space

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read())

    def normalise(self, text: str) -> tuple[bytes, np.ndarray | None]:
        """Normalised bytes and, for each and the end, the source byte it starts at.

        None for the places stands for a text that only had its spaces escaped and a space put before it.
        """
        raw = text.encode()
        if not self.map.units and not self.squeeze:
            if not raw:
                return b"", np.zeros(1, np.int64)
            if self.escape:
                return ((SPACE if self.dummy else "") + text.replace(" ", SPACE)).encode(), None
        words = [self._mapped(w) for w in (_WORDS.findall(text) if self.splits else [text])]
        out = np.frombuffer(b"".join([w[0] for w in words]), np.uint8)
        lens = np.array([len(w[0]) for w in words], np.int64)
        source = np.array([w[3] for w in words], np.int64)
        places = np.concatenate([np.zeros(0, np.int64), *[w[1] for w in words]]) + np.repeat(np.cumsum(source) - source, lens)
        end, space = len(raw), out == 32
        if self.squeeze:  # spaces at the head of what a key became go where a space or the start comes before
            keep = ~(space & np.concatenate([np.zeros(0, bool), *[w[2] for w in words]]) & np.concatenate([[True], space[:-1]])[: len(out)])
            out, places, space = out[keep], places[keep], space[keep]
        if self.escape:
            wide = np.where(space, 3, 1)
            at = np.cumsum(wide) - wide
            full = np.zeros(int(wide.sum()), np.uint8)
            full[at] = out
            for k, byte in enumerate(SPACE.encode()):
                full[at[space] + k] = byte
            out, places = full, np.repeat(places, wide)
        mark = SPACE.encode() if self.escape else b" "
        norm = out.tobytes()
        if self.squeeze:
            while norm.endswith(mark):
                norm = norm[: -len(mark)]
                end = int(places[len(norm)])
        places = places[: len(norm)]
        if self.dummy and (norm or raw and not self.squeeze):
            if self.suffix:
                norm, places = norm + mark, np.concatenate([places, [end] * len(mark)])
            else:
                norm, places = mark + norm, np.concatenate([[self._heading(raw)] * len(mark), places])
        return norm, np.append(places, end)

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes at ``at`` are replaced together, and by what."""
        hit = self.map.longest(raw, at) if raw[at] in self.map.first else None
        if hit:
            return hit
        lead = raw[at]
        n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        return n, raw[at : at + n]

    def _heading(self, raw: bytes) -> int:
        """Where the text starts, after spaces that are squeezed."""
        at = 0
        while self.squeeze and at < len(raw):
            n, new = self._step(raw, at)
            if new != b" ":
                break
            at += n
        return at

    def _mapped(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, int]:
        """A word by the map: its bytes, the source byte of each, whether only spaces precede it in what its key became,
        and the source's length."""
        known = self.words.get(text)
        if known is not None:
            return known
        raw, out, places, head = text.encode(), bytearray(), [], []
        at = 0
        while at < len(raw):
            n, new = self._step(raw, at)
            spaces = len(new) - len(new.lstrip(b" "))
            out += new
            places += [at] * len(new)
            head += [k < spaces for k in range(len(new))]
            at += n
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[text] = made = (bytes(out), np.array(places, np.int64), np.array(head, bool), len(raw))
        return made

    def _segment(self, units: list[str]) -> None:
        """Put ``units`` in the cache: ids and how many normalised bytes each piece covers."""
        got = self.library.encode(units, num_threads=1)
        flat = np.fromiter(chain.from_iterable(got), np.int32)
        ids, lens = flat.tobytes(), self.lengths[flat].tobytes()
        at = 0
        for unit, own in zip(units, got):
            end = at + 4 * len(own)
            self.cache[unit] = (ids[at:end], lens[at:end])
            at = end
        if not self.fallback:  # an unknown piece covers as much as it stands for
            for unit, own in zip(units, got):
                if self.unknown in own:
                    proto = self.library.encode(unit, return_type="proto")
                    self.cache[unit] = (np.array(own, np.int32).tobytes(), np.array([len(p.surface.encode()) for p in proto.pieces], np.int32).tobytes())

    def encode_batch(self, texts: list[str], most: int = 200_000) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(ids, starts, ends)`` of each text; the spans are bytes of the original."""
        normal = [self.normalise(t) for t in texts]
        strings = [n.decode() for n, _ in normal]
        cut = [self.units.findall(s) if self.units else ([s] if s else []) for s in strings]
        if len(self.cache) > most:
            self.cache.clear()
        new = set().union(*cut) - self.cache.keys() if cut else set()
        if new:
            self._segment(list(new))
        out = []
        cache = self.cache
        for (norm, places), units in zip(normal, cut):
            got = [cache[u] for u in units]
            ids = np.frombuffer(b"".join([g[0] for g in got]), np.int32)
            ends = np.cumsum(np.frombuffer(b"".join([g[1] for g in got]), np.int32), dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            if places is None:
                # escaped spaces hold three bytes for one, the one put in front holds none
                raw = np.frombuffer(norm, np.uint8)
                mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, np.int64)
                own = None
                if "▁" in texts[len(out)]:  # the text has the mark itself: those keep their bytes
                    own = np.array([c == " " for c in (" " if self.dummy else "") + texts[len(out)] if c in " ▁"], bool)
                width = np.full(len(mark), 2) if own is None else np.where(own, 2, 0)
                lost = np.concatenate([[0], np.cumsum(width)])
                if self.dummy:
                    lost[1:] += 1
                shift = lambda x: np.maximum(x - lost[np.searchsorted(mark, x)], 0)
                starts, ends = shift(starts), shift(ends)
            else:
                starts, ends = places[starts], places[ends] if len(ends) else ends
            out.append((ids, starts, ends))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids stand for: normalised, marks as spaces, the one put in front taken off."""
        ids = [i if i is not None and 0 <= i < len(self.pieces) else self.unknown for i in ids]
        raw = b"".join([bytes([int(self.pieces[i][3:5], 16)]) if self.kinds[i] == 6 else b" \xe2\x81\x87 " if self.kinds[i] == 2 else b"" if self.kinds[i] == 3 else self.pieces[i] for i in ids])
        text = raw.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.dummy and raw.startswith(SPACE.encode()) else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def _ints(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))


def encode(docs: DataFrame, params: PieceParams = PieceParams()) -> DataFrame:
    """``(doc_id, ids, starts, ends)`` for every row of ``docs``; spans are byte ranges of ``text``'s UTF-8.

    Defined results: an empty or null text has empty lists; repeated rows and null doc_ids have a row
    each; several pieces of one source character (a byte fallback, a character that normalises to more)
    share or split its span; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(params.model_file)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            lo = 0
            while lo < len(texts):
                part, size = [], 0
                while lo + len(part) < len(texts) and size < 1 << 20:
                    part.append(texts[lo + len(part)].as_py())
                    size += len(part[-1])
                got = c.encode_batch(part, params.cache)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), *(_ints([g[k] for g in got]) for k in range(3))], ["doc_id", "ids", "starts", "ends"])
                lo += len(part)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(releasing(run), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, params: PieceParams = PieceParams()) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``.

    Defined results: null ids give a null text, empty ones an empty text; the unknown piece is written as the library
    does, control pieces as nothing, an id that is null or outside the vocabulary as the unknown piece; bytes that
    are no UTF-8 as replacement characters; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(params.model_file)
        for batch in batches:
            text = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(releasing(run), "doc_id long, text string")
