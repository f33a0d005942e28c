"""Joins of similar documents (3, 4, 9) against brute force, and connected components."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.llm import chroma, ngram_join, queries, setjoin, spotsigs
from pagewright.llm.common import read
from pagewright.llm.graph import components
from pyspark.sql import functions as F

from ..conftest import normal
from .fixtures import edited, no_docs, odd_docs, odd_rows, prose


def words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())


def grams(text: str, n: int = 3) -> frozenset:
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[k:] for k in range(n))))


def spots(text: str) -> frozenset:
    w = words(text)
    content = [i for i, x in enumerate(w) if x not in spotsigs.COMMON]
    out = set()
    for i, x in enumerate(w):
        after = [c for c in content if c > i][:2] if x in spotsigs.ANCHORS else []
        if len(after) == 2:
            out.add((x, w[after[0]], w[after[1]]))
    return frozenset(out)


def brute(rows: list[tuple], alike) -> list[tuple[int, int, int]]:
    """``(doc_id, class_id, links)`` of the documents ``(doc_id, what)`` by comparing all of them."""
    rows = sorted(set(rows), key=lambda r: r[0])
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(rows[i][1], rows[j][1]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted((r[0], rows[find(i)][0], links[i]) for i, r in enumerate(rows))


def jaccard(t: float):
    return lambda x, y: len(x & y) >= t * len(x | y) - 1e-9


def brute_texts(rows: list[tuple], sets, t: float) -> list[tuple[int, int, int]]:
    return brute([(i, sets(x)) for i, x in rows if i is not None and x and sets(x)], jaccard(t))


JOINS = [(ngram_join.join_documents, grams, 0.6, ngram_join.JoinParams), (spotsigs.similar_documents, spots, 0.5, spotsigs.SpotParams)]


def corpus(spark):
    rows, k = [], 0
    for g in range(12):
        base = prose(100 + g, 60 + 40 * g, 900)
        for c in range(1 + g % 4):
            rows.append((k, edited(base, k, 0.02 * c)))
            k += 1
    rows += [(k + i, prose(7, 120)) for i in range(3)]  # exact copies
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def found(df) -> list[tuple[int, int, int]]:
    return sorted((r.doc_id, r.class_id, r.links) for r in df.collect())


@pytest.mark.parametrize("join, sets, t, params", JOINS)
def test_joins_match_brute_force(spark, join, sets, t, params):
    rows, docs = corpus(spark)
    want = brute_texts(rows, sets, t)
    assert sum(n for *_, n in want) > 16
    assert found(join(docs)) == want


@pytest.mark.parametrize("join, sets, t, params", JOINS)
def test_crowds_of_near_copies_are_all_found(spark, monkeypatch, join, sets, t, params):
    """Components of many blocks, columns linked as chains, columns sent as numbers, copies in several batches."""
    base, shared = prose(55, 150, 900), prose(56, 60, 900)
    rows = [(k, edited(base, 1000 + k, 0.01)) for k in range(350)] + [(400 + k, prose(900 + k, 90, 3000) + " " + shared) for k in range(60)]
    rows += [(500 + k, rows[k % 7][1]) for k in range(40)] + [(3, prose(77, 80)), (3, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_texts(rows, sets, t)
    assert max(n for *_, n in want) > 300
    assert found(join(docs, params(block=64))) == want


def test_a_crowd_of_near_copies_at_once(spark):
    rows = [(k, f"w{k % 7} " + " ".join(f"v{i}" for i in range(30)) + f" x{k} y{k}") for k in range(20_000)]
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.min("links"), F.max("links"), F.max("class_id"), F.count("*")).first()
    assert tuple(got) == (19_999, 19_999, 0, 20_000)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 12), min_size=1, max_size=9)), min_size=2, max_size=40), st.sampled_from([0.3, 0.5, 0.6, 0.8, 1.0]))
def test_index_and_products_lose_nothing(rows, t):
    """The numpy parts of the join on small sets with many ties."""
    sets = list({tuple(sorted(set(x))) for _, x in rows})
    size = np.array([len(s) for s in sets])
    df = {v: sum(v in s for s in sets) for s in sets for v in s}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(t)(set(sets[i]), set(sets[j]))}
    arrays = [np.array(s, np.uint64) for s in sets]
    every = np.arange(len(sets))
    got = {(int(a), int(b)) for x, y, _ in setjoin.overlaps(every, every, arrays, size, t) for a, b in zip(x, y)}
    assert got == want | {(j, i) for i, j in want}
    posts = sorted((v, len(s), k, p) for k, s in enumerate(sets) for p, v in enumerate(sorted(s, key=lambda v: (df[v], v))) if p < len(s) - int(np.ceil(len(s) * t - 1e-9)) + 1 and df[v] > 1)
    if posts:
        h, n, k, place = (np.array(c) for c in zip(*posts))
        root, node = setjoin.meetings(h, k, n, place, t)
        top = dict(zip(node.tolist(), root.tolist()))
        assert all(top.get(i, i) == top.get(j, j) for i, j in want)
    else:
        assert not want


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        values = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) // np.uint64(rng.integers(1, 1 << 40)))
        cols = rng.integers(0, 1 << 16, n).astype(np.uint16), rng.integers(0, 256, n).astype(np.uint8)
        back = setjoin.unpack(setjoin.pack(values, *cols), np.uint16, np.uint8)
        assert all(np.array_equal(a, b) for a, b in zip(back, (values, *cols)))


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op9_spotsigs", "op7_url_filter", "op8_sharding"])
def test_queries_match_sql(spark, sf, duck, name):
    assert normal(queries.QUERIES[name](spark, sf).toPandas()) == normal(duck.execute(queries.ORACLE_SQL[name]).df())


def test_keep_one_keeps_one_of_each_group(spark):
    rows, docs = corpus(spark)
    wide = docs.withColumn("comp", F.lit("x")).withColumn("id", F.lit(1))
    kept = sorted(r.doc_id for r in ngram_join.keep_one(wide).collect())
    assert kept == sorted({c for _, c, _ in brute_texts(rows, grams, 0.6)})
    assert ngram_join.keep_one(wide).columns == wide.columns


def test_keep_one_of_rows_without_or_with_the_same_id(spark):
    base, other = prose(41, 90), prose(42, 90)
    rows = [(1, base), (1, base), (1, base), (None, base), (None, base), (2, other), (1, other), (None, prose(43, 50)), (None, prose(43, 50)), (4, ""), (4, ""), (5, None), (5, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([(1, base), (1, other), (None, prose(43, 50)), (4, ""), (4, ""), (5, None), (5, None)], "doc_id long, text string").collect()))


@pytest.mark.parametrize("join, sets, t, params", JOINS)
def test_odd_rows(spark, join, sets, t, params):
    assert found(join(odd_docs(spark))) == brute_texts([r[:2] for r in odd_rows()], sets, t)
    assert join(no_docs(spark)).count() == 0


def test_keep_one_odd_rows(spark):
    kept = [r.doc_id for r in ngram_join.keep_one(odd_docs(spark)).collect()]
    assert kept.count(None) == 1 and {1, 5, 6, 7, 14} <= set(kept) and not {2, 3, 8, 15} & set(kept)
    assert ngram_join.keep_one(no_docs(spark)).count() == 0


@pytest.mark.parametrize("few", [10**6, 20, 0])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(100)] + [(200 + i * 7 % 90, 200 + i * 13 % 90) for i in range(80)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), few).collect()}
    assert got == {x: find(x) for x in got} and len(got) > 150
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


# --- chroma fingerprints -----------------------------------------------------------------------------------------


def brute_chroma(rows: list[tuple], p: chroma.ChromaParams) -> tuple[list[tuple[int, int, int]], dict[int, tuple]]:
    """Every pair, every offset: plain loops over the definition; classes and best partners."""
    marks = chroma.thresholds(p)
    own = []
    for i, t in rows:
        for _, _, samples, bounds in chroma.text_decoder(pa.array([t.lower()]), p):
            flat, silent, _ = chroma.prints(samples, bounds, p, marks)
            if not silent.all():
                own.append((i, (tuple(flat.tolist()), tuple(silent.tolist()))))
    known = {}

    def match(a, b):
        if a == b:
            return 0, len(a[0]), 0
        (x, sx), (y, sy) = a, b
        xs, ys = ({v for v, s in zip(*z) if not s} for z in (a, b))
        if not jaccard(p.shared)(xs, ys) or min(len(x), len(y)) < p.cover * max(len(x), len(y)):
            return None
        first = {}
        for j in reversed(range(len(y))):
            if not sy[j]:
                first[y[j]] = j
        seen, offsets = set(), {}
        for i, v in enumerate(x):
            if v not in seen and not sx[i] and v in first:
                offsets[first[v] - i] = offsets.get(first[v] - i, 0) + 1
            seen.add(v)
        off = min(offsets, key=lambda o: (-offsets[o], abs(o), o))
        span = [(i, i + off) for i in range(len(x)) if 0 <= i + off < len(y)]
        errors = sum((x[i] ^ y[j]).bit_count() for i, j in span)
        return (off, len(span), errors) if len(span) >= p.cover * max(len(x), len(y)) and errors <= p.errors * 32 * len(span) else None

    def alike(a, b):
        m = match(a, b)
        if m and a != b:
            known[a, b] = m
        return bool(m)

    lead: dict = {}
    for i, a in sorted(own, key=lambda r: r[0]):
        lead.setdefault(a, i)
    got = brute(own, alike)
    best: dict = {}
    for (a, b), (off, overlap, errors) in known.items():
        if lead[a] > lead[b]:
            off, overlap, errors = [-match(b, a)[0], *match(b, a)[1:]]
        for x, y, o in ((a, b, off), (b, a, -off)):
            best[x] = min(best.get(x, (1,)), (-overlap, errors, lead[y], o))
    return got, {(i, a): best.get(a) for i, a in own}


def partners(rows) -> list[tuple]:
    return list((r.doc_id, None if r.partner is None else (-r.overlap, r.errors, r.partner, r.offset)) for r in rows)


def test_chroma_matches_brute_force(spark):
    rows = []
    for g in range(8):
        base = prose(300 + g, 260, 900)
        rows += [(10 * g, base), (10 * g + 1, edited(base, g, 0.004)), (10 * g + 2, prose(500 + g, 25) + " " + base), (10 * g + 3, base)]
    media = spark.createDataFrame(rows, "id long, audio string").select("id", F.lower("audio").alias("audio"))
    for p in (chroma.ChromaParams(), chroma.ChromaParams(block=3)):
        got = chroma.match_recordings(media, chroma.text_decoder, p).collect()
        want, best = brute_chroma(rows, p)
        assert sorted((r.doc_id, r.class_id, r.links) for r in got) == want and sum(n for *_, n in want) >= 24
        assert sorted(partners(got), key=str) == sorted(((i, b) for (i, _), b in best.items()), key=str)


def wav(x: np.ndarray, rate: int, bits: int = 16, channels: int = 1) -> bytes:
    import struct

    data = (x * (2 ** (bits - 1) - 1)).astype({16: "<i2", 32: "<i4"}[bits]) if bits > 8 else ((x * 127) + 128).astype("u1")
    raw = np.repeat(data[:, None], channels, 1).tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(raw)) + raw


def test_wav_recordings_align(spark):
    p = chroma.ChromaParams()
    _, _, x, _ = next(chroma.text_decoder(pa.array([prose(1, 900, 5000)]), p))
    _, _, y, _ = next(chroma.text_decoder(pa.array([prose(2, 900, 5000)]), p))
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    rows = [(1, wav(x, 8000)), (2, wav(x[20 * p.hop :], 8000, 32, 2)), (3, wav(y, 8000)), (4, wav(x * 0.3, 8000)), (5, b"RIFFnothing"), (6, None), (7, b""), (8, wav(np.zeros(4000), 8000)), (None, wav(x, 8000))]
    got = {r.doc_id: r for r in chroma.match_recordings(spark.createDataFrame(rows, "id long, audio binary"), chroma.wav_decoder).collect()}
    assert got.keys() == {1, 2, 3, 4} and [got[i].class_id for i in (1, 2, 3, 4)] == [1, 1, 3, 1] and [got[i].links for i in (1, 2, 3, 4)] == [2, 2, 0, 2]
    assert got[2].partner == 1 and got[2].offset == 20 and got[2].errors < 0.05 * 32 * got[2].overlap


def test_wav_reader():
    x = np.sin(np.arange(800) / 5)
    for bits in (8, 16, 32):
        assert np.abs(chroma.wav_samples(wav(x, 8000, bits), 8000) - x).max() < 0.02
    assert len(chroma.wav_samples(wav(x, 4000), 8000)) == 1600
    assert not len(chroma.wav_samples(b"RIFF\0\0\0\0WAVEfmt ", 8000))


def test_chroma_odd_rows(spark):
    media = lambda d: d.select(F.col("doc_id").alias("id"), F.lower("text").alias("audio"), "size", "comp")
    got = {r.doc_id: r for r in chroma.match_recordings(media(odd_docs(spark)), chroma.text_decoder).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[7].class_id == got[8].class_id == 7 and got[8].partner == 7 and not {5, 6, 13, None} & got.keys()
    assert chroma.match_recordings(media(no_docs(spark)), chroma.text_decoder).count() == 0


def test_all_documents_against_brute_force(spark, sf):
    """The whole query on the small tables."""
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op4_chroma_fingerprints"](spark, sf).collect()
    want, best = brute_chroma(rows, chroma.ChromaParams())
    assert sorted((r.doc_id, r.class_id, r.links) for r in got) == want and any(n for *_, n in want)
    assert sorted(partners(got), key=str) == sorted(((i, b) for (i, _), b in best.items()), key=str)
