"""Operator 4, media columns: chroma audio fingerprints and the alignment of recordings by them.

Audio becomes frames of twelve pitch classes (windowed FFT, bins added up by semitone). Over an integral image
of these frames, sixteen filters compare sums of rectangles; each response is quantised to two bits, so every
frame has a packed integer of 32 bits. Two recordings are aligned by the offset at which most of the integers
that they share meet (a histogram of offsets), and judged by the share of wrong bits where they overlap there.

Recordings that share too few of their integers to match never meet: an index of each recording's rarest integers
(:mod:`setjoin`) finds all pairs whose sets of integers reach Jaccard ``shared``, and those are aligned.

A recording is the bytes of a WAV file, or, as the tables here hold no audio, a text played note by note: words
up to one whose hash ends a note make a chord of pitch classes, so equal passages sound alike wherever they stand.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast_small, cut, list_column, mix, releasing, text_steps
from .graph import forest
from .setjoin import PART_ROWS, by_product, components_of, index_of, overlaps, placed, products, set_keys, with_classes
from .words import word_hashes

#: ``(kind, first pitch class, pitch classes, frames)`` of each filter.
FILTERS = (
    (1, 0, 6, 1), (1, 3, 8, 1), (1, 6, 6, 2), (4, 0, 6, 1), (4, 3, 9, 2), (4, 1, 9, 1), (2, 0, 4, 2), (2, 4, 4, 2),
    (2, 8, 4, 2), (2, 2, 8, 4), (3, 0, 6, 2), (3, 6, 6, 2), (3, 2, 8, 2), (5, 0, 7, 3), (5, 5, 5, 3), (1, 0, 12, 1),
)
SPAN = max(w for _, _, _, w in FILTERS)
_SCALE = 4095
_GRAY = np.array([0, 1, 3, 2], np.uint32)


@dataclass(frozen=True)
class ChromaParams:
    """``frame`` is a multiple of ``hop``. Recordings match if their sets of integers reach Jaccard ``shared``, and at
    their best offset they overlap by ``cover`` of the longer one and at most ``errors`` of the bits differ; so a
    clip within a longer recording doesn't match it. ``block`` recordings are compared with as many at a time."""

    rate: int = 8000
    frame: int = 512
    hop: int = 256
    low: float = 1700.0
    high: float = 3420.0
    cover: float = 0.6
    errors: float = 0.1
    shared: float = 0.3
    block: int = 2048


Decoder = Callable[[pa.Array, ChromaParams], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def wav_samples(raw: bytes | None, rate: int) -> np.ndarray:
    """Mono samples of a PCM (8, 16, 32 bit) or float WAV at ``rate``; none for anything else."""
    none = np.zeros(0)
    if not raw or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return none
    at, head, data = 12, None, None
    while at + 8 <= len(raw):
        name, n = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and n >= 16 and at + 24 <= len(raw):
            head = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = raw[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    kind = head and {(1, 8): np.uint8, (1, 16): np.int16, (1, 32): np.int32, (3, 32): np.float32}.get((head[0], head[5]))
    if not kind or data is None or not head[1] or not head[2]:
        return none
    width = np.dtype(kind).itemsize * head[1]
    x = np.frombuffer(data[: len(data) // width * width], np.dtype(kind).newbyteorder("<")).reshape(-1, head[1]).astype(np.float64).mean(1)
    x = (x - 128) / 128 if kind is np.uint8 else x if kind is np.float32 else x / np.iinfo(kind).max
    if head[2] != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / head[2])) * (head[2] / rate), np.arange(len(x)), x)
    return np.nan_to_num(x, posinf=0, neginf=0)


def wav_decoder(column: pa.Array, p: ChromaParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A binary column of WAV files, a row at a time."""
    for i, raw in enumerate(column):
        x = wav_samples(raw.as_py(), p.rate)
        yield i, i + 1, x, np.array([0, len(x)])


def notes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loudness of the pitch classes in each note of lower-cased texts, and the bounds of each text's notes."""
    h, bounds = word_hashes(data, offs)
    if not len(h):
        return np.zeros((0, 12)), np.zeros(len(bounds), np.int64)
    ends = h >> U64(61) == 0
    ends[bounds[1:][bounds[1:] > 0] - 1] = True
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    chord = mix(np.add.reduceat(mix(h + place.astype(np.uint64)), first))
    loud = ((chord[:, None] >> (U64(2) * np.arange(12, dtype=np.uint64))) & U64(3)).astype(np.float64)
    loud[loud.sum(1) == 0, 0] = 1
    return loud, np.searchsorted(first, bounds)


def text_decoder(column: pa.Array, p: ChromaParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A column of lower-cased texts played note by note, each note as long as a hop."""
    t = np.arange(p.hop) / p.rate
    waves = np.sin(2 * np.pi * 1760 * 2 ** (np.arange(12)[:, None] / 12) * t)
    for lo, hi, data, offs in text_steps(column, 1 << 16):
        loud, bounds = notes(data, offs)
        yield lo, hi, (loud @ waves).ravel(), bounds * p.hop


def chroma(samples: np.ndarray, bounds: np.ndarray, p: ChromaParams) -> tuple[np.ndarray, np.ndarray]:
    """Frames of pitch classes in whole numbers (each adds up to about 4095, silence to 0), and their bounds."""
    r = p.frame // p.hop
    n = -(-np.diff(bounds) // p.hop)
    ends = np.concatenate([[0], np.cumsum(n)])
    blocks = np.zeros((int(ends[-1]) + len(n) * (r - 1), p.hop))
    flat = blocks.ravel()
    starts = ends[:-1] + np.arange(len(n)) * (r - 1)
    for a, b, at in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (starts * p.hop).tolist()):
        flat[at : at + b - a] = samples[a:b]
    freq = np.fft.rfftfreq(p.frame, 1 / p.rate)
    used = np.flatnonzero((freq >= p.low) & (freq <= p.high))
    fold = np.zeros((len(used), 12))
    fold[np.arange(len(used)), np.rint(12 * np.log2(freq[used] / 1760)).astype(int) % 12] = 1
    window = np.hanning(p.frame)
    at = np.arange(ends[-1]) + np.repeat(np.arange(len(n)), n) * (r - 1)
    out = np.zeros((len(at), 12), np.int64)
    for lo in range(0, len(at), 512):
        part = at[lo : lo + 512]
        f = np.fft.rfft(blocks[part[:, None] + np.arange(r)].reshape(len(part), -1) * window, axis=1)[:, used]
        power = (f.real**2 + f.imag**2) @ fold
        total = power.sum(1, keepdims=True)
        out[lo : lo + 512] = np.rint(np.where(total > 1e-6, power / np.maximum(total, 1e-6), 0) * _SCALE)
    return out, ends


def responses(frames: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What each filter says at each frame; past a recording's end there is silence."""
    n = np.diff(bounds)
    image = np.zeros((len(frames) + len(n) * (SPAN - 1) + 1, 13), np.int64)
    at = np.arange(len(frames)) + np.repeat(np.arange(len(n)), n) * (SPAN - 1)
    image[at + 1, 1:] = frames
    np.cumsum(image, axis=0, out=image)
    np.cumsum(image, axis=1, out=image)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        top, low = image[at + t + w], image[at + t]
        return top[:, y + h] - low[:, y + h] - top[:, y] + low[:, y]

    out = np.zeros((len(frames), len(FILTERS)))
    for k, (kind, y, h, w) in enumerate(FILTERS):
        whole = area(0, w, y, h)
        if kind == 1:
            part = area(0, w, y, h // 2)
        elif kind == 2:
            part = area(0, w // 2, y, h)
        elif kind == 3:
            part = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
        elif kind == 4:
            part = area(0, w, y + h // 3, h // 3)
        else:
            part = area(w // 3, w // 3, y, h)
        out[:, k] = np.log((_SCALE / 8 + part) / (_SCALE / 8 + whole - part))
    return out


def thresholds(p: ChromaParams, seed: int = 3) -> np.ndarray:
    """Quartiles of each filter over a made-up recording of chords."""
    rng = np.random.default_rng(seed)
    text = " ".join(map(str, rng.integers(0, 10**9, 20_000).tolist())).encode()
    _, _, samples, bounds = next(text_decoder(pa.array([text.decode()]), p))
    return np.round(np.quantile(responses(*chroma(samples, bounds, p)), (0.25, 0.5, 0.75), axis=0).T, 4) + 3.3e-5


def prints(samples: np.ndarray, bounds: np.ndarray, p: ChromaParams, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed integer of every frame, whether the frame is silent, and the bounds of each recording."""
    frames, ends = chroma(samples, bounds, p)
    out = np.zeros(len(frames), np.uint32)
    for k, column in enumerate(responses(frames, ends).T):
        out |= _GRAY[np.searchsorted(marks[k], column)] << np.uint32(2 * k)
    return out, frames.sum(1) == 0, ends


def _first_places(own: np.ndarray, silent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints that aren't silence and where each comes first."""
    at = np.flatnonzero(~silent)
    values, first = np.unique(own[at], return_index=True)
    return values, at[first]


def fingerprints(media: DataFrame, decoder: Decoder, params: ChromaParams = ChromaParams()) -> DataFrame:
    """``(id, ref, k, prints, silent)`` of every recording in ``media (id, audio)`` with sound.

    ``prints`` has an integer for each frame, ``silent`` the frames without sound, and ``k`` is equal for equal
    sequences. Rows whose audio is null, empty, silent or can't be decoded have no fingerprint.
    """
    p, marks = params, thresholds(params)
    schema = "id long, ref long, k long, prints array<int>, silent array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, samples, bounds in decoder(batch.column(1), p):
                flat, silent, ends = prints(samples, bounds, p, marks)
                frames = np.diff(ends)
                place = np.arange(len(flat)) - np.repeat(ends[:-1], frames)
                sound = np.concatenate([[0], np.cumsum(~silent)])
                mute = np.concatenate([[0], np.cumsum(silent)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.zeros(hi - lo, np.int64)), pa.array(set_keys(flat.astype(np.uint64) + (place.astype(np.uint64) << U64(32)), frames)), list_column(flat.view(np.int32), frames, pa.int32()), list_column(place[silent], np.diff(mute), pa.int32())],
                    [x.split()[0] for x in schema.split(", ")],
                ).filter(pa.array(np.diff(sound[ends]) > 0))

    return media.select(F.col("id").cast("long").alias("id"), "audio").filter("id is not null and audio is not null").mapInArrow(releasing(run), schema)


def print_sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]]:
    """The distinct prints of sound of the rows of :func:`fingerprints`, hashed."""
    for lo in range(0, batch.num_rows, PART_ROWS):
        part = batch.slice(lo, PART_ROWS)
        sets = []
        for own, mute in zip(part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False)):
            sets.append(mix(np.unique(np.delete(own.view(np.uint32), mute)).astype(np.uint64) + U64(0x1F3D5B79)))
        yield part.column(0), part.column(1), sets, part.column(2).to_numpy()


#: Prints and frames that a step of :func:`align` looks at.
_STRIP = 1 << 18


def align(x: np.ndarray, y: np.ndarray, own: list[np.ndarray], mute: list[np.ndarray], p: ChromaParams) -> list[np.ndarray]:
    """``[x, y, offset, overlap, errors]`` of those pairs of recordings that match at their most frequent offset."""
    lens = np.array([len(v) for v in own], np.int64)
    fit = np.minimum(lens[x], lens[y]) >= p.cover * np.maximum(lens[x], lens[y]) - 1e-9
    x, y = x[fit], y[fit]
    starts, flat = np.cumsum(lens) - lens, np.concatenate(own)
    silent = np.zeros(len(flat), bool)
    silent[np.concatenate([s + m for s, m in zip(starts, mute)]).astype(np.int64)] = True
    firsts = [_first_places(v, silent[s : s + len(v)]) for v, s in zip(own, starts.tolist())]
    n = np.array([len(v) for v, _ in firsts], np.int64)
    named = np.concatenate([v for v, _ in firsts]).astype(np.int64) + (np.repeat(np.arange(len(own)), n) << 32)
    place = np.concatenate([f for _, f in firsts])
    first = np.cumsum(n) - n
    work = np.concatenate([[0], np.cumsum(n[x])])
    out = [[np.zeros(0, np.int64)] * 5]
    lo = 0
    while lo < len(x):  # a strip of pairs: the prints of ``x`` looked up among those of ``y``
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + _STRIP, side="right")) - 1)
        pair = np.repeat(np.arange(lo, hi), n[x[lo:hi]])
        at = first[x[pair]] + np.arange(len(pair)) - (work[pair] - work[lo])
        want = (named[at] & 0xFFFFFFFF) + (y[pair] << 32)
        to = np.minimum(np.searchsorted(named, want), len(named) - 1)
        hit = named[to] == want
        out.append(_judged(x, y, pair[hit], (place[to] - place[at])[hit], lens, starts, flat, p))
        lo = hi
    return [np.concatenate(c) for c in zip(*out)]


def _judged(x: np.ndarray, y: np.ndarray, pair: np.ndarray, off: np.ndarray, lens: np.ndarray, starts: np.ndarray, flat: np.ndarray, p: ChromaParams) -> list[np.ndarray]:
    """Those of the pairs that match at the most frequent of their offsets ``off``."""
    if not len(pair):
        return [np.zeros(0, np.int64)] * 5
    far = int(lens.max()) + 1
    key, n = np.unique(pair * (2 * far) + off + far, return_counts=True)
    pair, off = key // (2 * far), key % (2 * far) - far
    by = np.lexsort((off, np.abs(off), -n, pair))
    by = by[np.concatenate([[True], pair[by][1:] != pair[by][:-1]])]
    x, y, off = x[pair[by]], y[pair[by]], off[by]
    a0 = np.maximum(0, -off)
    overlap = np.minimum(lens[x], lens[y] - off) - a0
    ok = overlap >= p.cover * np.maximum(lens[x], lens[y]) - 1e-9
    x, y, off, a0, overlap = x[ok], y[ok], off[ok], a0[ok], overlap[ok]
    errors = np.zeros(len(x), np.int64)
    sums = np.concatenate([[0], np.cumsum(overlap)])
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + _STRIP, side="right")) - 1)
        part = overlap[lo:hi]
        step = np.arange(sums[hi] - sums[lo]) - np.repeat(sums[lo:hi] - sums[lo], part)
        i = np.repeat(starts[x[lo:hi]] + a0[lo:hi], part) + step
        j = np.repeat(starts[y[lo:hi]] + a0[lo:hi] + off[lo:hi], part) + step
        errors[lo:hi] = np.add.reduceat(np.bitwise_count(flat[i] ^ flat[j]).astype(np.int64), sums[lo:hi] - sums[lo])
        lo = hi
    ok = errors <= p.errors * 32 * overlap
    return [x[ok], y[ok], off[ok], overlap[ok], errors[ok]]


_MET = "k long, up long, links long, partner long, offset long, overlap long, errors long"


def matched(rows: DataFrame, p: ChromaParams) -> DataFrame:
    """For each recording in each product its links, a recording it is connected with, and its best partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, (k, size, lead, w, sig, own, mute) in products(batches):
            if not len(x) or not len(y):
                continue
            sets = [np.asarray(s, np.int64).view(np.uint64) for s in sig]
            own = [np.asarray(s, np.int32).view(np.uint32) for s in own]
            mute = [np.asarray(s, np.int32) for s in mute]
            order = np.empty(len(k), np.int64)  # pairs go from the lower lead to the higher
            order[np.lexsort((k, lead))] = np.arange(len(k))
            out = [[np.zeros(0, np.int64)] * 5]
            one = x[0] == y[0]
            for a, b, _ in overlaps(x, y, sets, size, p.shared):
                turned = order[a] > order[b]
                a, b = (a[~turned], b[~turned]) if one else (np.where(turned, b, a), np.where(turned, a, b))
                if len(a):
                    out.append(align(a, b, own, mute, p))
            a, b, off, overlap, errors = (np.concatenate(c) for c in zip(*out))
            if not len(a):
                continue
            root, node = forest(k[a], k[b])
            at = np.argsort(k)
            up = k.copy()
            up[at[np.searchsorted(k[at], node)]] = root
            a, b, off, overlap, errors = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([off, -off]), np.concatenate([overlap] * 2), np.concatenate([errors] * 2)
            links = np.bincount(a, w[b], len(k)).astype(np.int64)
            by = np.lexsort((order[b], errors, -overlap, a))
            by = by[np.concatenate([[True], a[by][1:] != a[by][:-1]])]
            a, b, off, overlap, errors = a[by], b[by], off[by], overlap[by], errors[by]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k[a], up[a], links[a], lead[b], off, overlap, errors)], [c.split()[0] for c in _MET.split(", ")])

    return by_product(rows).mapInArrow(releasing(run), _MET)


def match_recordings(media: DataFrame, decoder: Decoder, params: ChromaParams = ChromaParams()) -> DataFrame:
    """``(doc_id, class_id, links, partner, offset, overlap, errors)`` for every recording in ``media (id, audio)`` with sound.

    Two recordings match if their sets of prints reach Jaccard ``shared`` and at their most frequent offset they
    overlap by ``cover`` of the longer with at most ``errors`` wrong bits. ``links`` counts the recordings that
    match, ``class_id`` is the lowest id that chains of matches lead to. ``partner`` is, of the recordings with
    other fingerprints that match, the one with the longest overlap (in frames), then the fewest errors (in
    bits), then the lowest id; ``offset`` frames into it lies the recording's start; without any the four are null.
    Defined results: null ids, null, empty, silent or undecodable audio and texts without a word have no row; a
    recording is an id with its fingerprints, so repeated rows are one and other audio of the same id is another;
    recordings of equal fingerprints match, and their lowest id stands for them as partner; a print that
    comes again in a recording counts at its first place; offsets that are as frequent go by the least shift, then
    the lower, seen from the recording of the lower id; an empty table gives no rows; other columns are not read. An
    id that is no whole number is an error.
    """
    p = params
    rows = cut(fingerprints(media, decoder, p))
    index = index_of(rows, print_sets, p.shared)
    docs = cut(index.groupBy("id", "k").agg(F.count("*").alias("rows")))
    sets = cut(docs.groupBy("k").agg(F.min("id").alias("lead"), F.count("*").alias("w")))
    comp = components_of(index, p.shared)
    place = placed(index, comp, sets, p.block)
    members = broadcast_small(comp.select(F.col("id").alias("k")))
    sound = rows.join(members, "k", "left_semi").groupBy("k").agg(F.first("prints").alias("prints"), F.first("silent").alias("silent"))
    met = cut(matched(place.join(sound, "k").select("comp", "i", "j", "block", "k", "size", "lead", "w", "sig", "prints", "silent"), p))
    best = met.groupBy("k").agg(F.max(F.struct("overlap", (-F.col("errors")).alias("errors"), (-F.col("partner")).alias("partner"), "offset")).alias("b"))
    best = broadcast_small(cut(best.select("k", (-F.col("b.partner")).alias("partner"), "b.offset", "b.overlap", (-F.col("b.errors")).alias("errors"))))
    known = with_classes(sets, met.select("k", "up", "links")).join(best, "k", "left")
    return docs.join(known, "k").select(F.col("id").alias("doc_id"), "class_id", "links", "partner", "offset", "overlap", "errors")
