"""License scans (2), SentencePiece (5), packing (6), URL filters (7), sharding (8) and the pipeline."""

from __future__ import annotations

import heapq
import random
import textwrap

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.llm import language_id, license_scan, packing, quality, queries, sentencepiece_codec, sharding, url_filter
from pagewright.llm.common import read
from pyspark.sql import functions as F

from ..conftest import normal
from .fixtures import no_docs, odd_docs, odd_rows, prose
from .test_similar import brute_texts, grams

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# --- licenses ----------------------------------------------------------------------------------------------------


def test_every_template_is_found_as_itself():
    s = license_scan.Scanner(license_scan.LicenseParams())
    for name, wording in license_scan.TEMPLATES:
        hits = s.text(f"Some words before.\n{wording}\nAnd some after it.")
        assert [h[2] for h in hits] == [name] and hits[0][5] + hits[0][6] == 0


@pytest.mark.parametrize("text, want", [
    ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]), ("Licensed under CC BY-NC 3.0.", ["CC-BY-NC-3.0"]), ("This work is licensed under the GNU General Public License, version 7.", []),
    ("Released under the Foo License.", []), ("my driving license has expired. no warranty on the car", []), ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", ["Apache-2.0"]), (license_scan.TEMPLATES[0][1].replace("persons", "people"), ["MIT"]),
])
def test_license_wording(text, want):
    assert [h[2] for h in license_scan.Scanner(license_scan.LicenseParams()).text(text)] == want


@pytest.mark.parametrize("width", [40, 72, 80])
@pytest.mark.parametrize("lead", ["", " * "])
def test_every_wrapped_template_is_found(width, lead):
    s = license_scan.Scanner(license_scan.LicenseParams())
    for name, wording in license_scan.TEMPLATES:
        lines = "\n".join(lead + x for x in textwrap.wrap(wording, width, break_on_hyphens=False, break_long_words=False))
        hits = s.text(f"Some words before.\n{lines}\nAnd some after it.")
        assert [h[2] for h in hits] == [name] and hits[0][5] + hits[0][6] == 0, (name, wording)


@pytest.mark.parametrize("text, want", [("Released under the GNU General Public\nLicense, version 3", "GPL-3.0"), ("Distributed under the\nMIT License", "MIT"), ("released into the public\ndomain", None), ("Released under CC\nBY 4.0.", "CC-BY-4.0")])
def test_wrapped_license_query(spark, text, want):
    got = license_scan.scan(spark.createDataFrame([(1, f"{prose(4, 200)}\n{text}\n{prose(5, 200)}")], "doc_id long, text string")).collect()
    assert [r.license for r in got] == [want] * (want is not None)


def test_license_query_against_brute_force(spark, sf):
    """Brute force looks for every short wording in every document, word by word."""
    rows = read(spark, sf, "documents").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        own = [w for w, _, _ in license_scan.words(r.text)]
        for name, wording in license_scan.TEMPLATES:
            t = [w for w, _, _ in license_scan.words(wording)]
            if any(own[i : i + len(t)] == t for i in range(len(own) - len(t) + 1)):
                want.add((r.doc_id, name))
    got = {(r.doc_id, r.license) for r in queries.QUERIES["op2_license_scan"](spark, sf).collect()}
    assert got == want and want


def test_license_odd_rows(spark):
    extra = spark.createDataFrame([(50, "Released under the MIT License. " * 2), (None, "Released under the MIT License."), (51, "word " * 20_000 + "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    docs = odd_docs(spark).unionByName(extra, allowMissingColumns=True)
    got = sorted(((r.doc_id, r.license, r.missing + r.extra) for r in license_scan.scan(docs).collect()), key=str)
    assert got == sorted([(50, "MIT", 0)] * 2 + [(None, "MIT", 0), (51, "CC-BY-NC-4.0", 0)], key=str)
    assert license_scan.scan(no_docs(spark)).count() == 0


# --- SentencePiece -----------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["the", " ", "  ", "▁", "é", "漢字", "\n", "\t", "<s>", "😀", "don't"]), max_size=12).map("".join))
def test_pieces_are_the_library_s_and_spans_are_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    codec = sentencepiece_codec.codec(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, starts, ends = codec.encode_batch([text])[0]
    assert ids.tolist() == library.encode(text)
    raw = text.encode()
    assert (starts <= ends).all() and (np.diff(starts) >= 0).all()
    if len(ids):
        assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all()
    assert codec.decode(ids) == library.decode(ids.tolist())
    if "▁" not in text:
        assert codec.decode(ids) == text


def test_sentencepiece_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    encoded = queries.QUERIES["op5_sentencepiece"](spark, sf)
    got = encoded.collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.ids == library.encode(docs[r.doc_id])
        raw = docs[r.doc_id].encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded).collect()} == docs


def double_array(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map of ``keys``, as the library stores one: a double-array trie and a pool of replacements."""
    pool, at = b"", {}
    for key, new in keys.items():
        at[key] = len(pool)
        pool += new + b"\0"
    trie: dict = {}
    for key in keys:
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[0] = at[key]
    units, taken, bases = [0] * (1 << 14), {0}, set()

    def place(node: dict, pos: int) -> None:
        base = next(b for b in range(1, len(units)) if b not in bases and all((b ^ c) not in taken and b ^ c < len(units) for c in node) and (pos ^ b) < 1 << 21)
        bases.add(base)
        units[pos] |= (pos ^ base) << 10 | (0 in node) << 8
        taken.update(base ^ c for c in node)
        for c, child in node.items():
            if c:
                units[base ^ c] = c
                place(child, base ^ c)
            else:
                units[base] = child | 1 << 31

    place(trie, 0)
    blob = np.array(units[: max(taken) // 256 * 256 + 256], np.uint32).tobytes()
    return len(blob).to_bytes(4, "little") + blob + pool


KEYS = {"ﬁ": "fi", "É": "é", "e\u0301": "é", "a\u0308\u0301": "ä", "a\u0308": "ae", "\u00a0": " ", "\u3000": " ", "\t": " ", "\n": " ", "\u200b": "", "…": "...", "½": " 1/2", "¨": " \u0308", "ABC": "x", "AB": "yy", "Ａ": "A", "㎞": "km", "\u0007": "", "㍿": "株式会社"}


@pytest.fixture(scope="module", params=[(1, 1, 1), (1, 0, 1), (0, 1, 1), (0, 0, 1)], ids=str)
def mapped_model(request, tmp_path_factory):
    """The public model with a character map of its own: (space in front, squeeze, escape)."""
    raw, out = open(MODEL, "rb").read(), b""
    for number, value in sentencepiece_codec._fields(raw):
        if number != 3:
            out += sentencepiece_codec._message(number, value)
    blob = double_array({k.encode(): v.encode() for k, v in KEYS.items()})
    spec = sentencepiece_codec._message(1, b"own") + sentencepiece_codec._message(2, blob) + b"".join(bytes([k << 3, v]) for k, v in zip((3, 4, 5), request.param))
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(out + sentencepiece_codec._message(3, spec))
    return str(path)


@settings(max_examples=250, deadline=None)
@given(text=st.lists(st.sampled_from([*KEYS, "the", " ", "  ", "e", "a", "A", "B", "ABC", "\u0301", "\u0308", "▁", "漢", "😀", "don't", "x y"]), max_size=14).map("".join) | st.text(st.characters(min_codepoint=1, exclude_categories=["Cs"]), max_size=40))
def test_a_character_map_gives_the_library_s_pieces_and_spans(mapped_model, text):
    text = text.encode("utf-8", "ignore").decode()
    codec, library = sentencepiece_codec.codec(mapped_model), sentencepiece.SentencePieceProcessor(model_file=mapped_model)
    assert codec.map.units and codec.splits
    ids, starts, ends = codec.encode_batch([text])[0]
    want = library.encode(text, return_type="proto")
    assert ids.tolist() == [p.id for p in want.pieces]
    raw = text.encode()
    assert [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends)] == [p.surface for p in want.pieces]


def test_a_character_map_without_safe_places_to_split(tmp_path):
    raw, out = open(MODEL, "rb").read(), b""
    for number, value in sentencepiece_codec._fields(raw):
        if number != 3:
            out += sentencepiece_codec._message(number, value)
    blob = double_array({b" \xcc\x88": b"o", "a b".encode(): b"z", b"q": b""})
    model = out + sentencepiece_codec._message(3, sentencepiece_codec._message(1, b"own") + sentencepiece_codec._message(2, blob))
    codec, library = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert not codec.splits
    for text in ("", "q", "qq  q", "the \u0308 a b  a b", " a bq c ", "x  \u0308y"):
        assert codec.encode_batch([text])[0][0].tolist() == library.encode(text)


def test_a_character_map_is_fast():
    import time

    codec = sentencepiece_codec.Codec(open(MODEL, "rb").read())
    codec.map = sentencepiece_codec.CharacterMap(double_array({k.encode(): v.encode() for k, v in KEYS.items()}))
    codec.splits = True
    text = prose(3, 100_000)
    began = time.process_time()
    codec.normalise(text)
    assert time.process_time() - began < 2


def test_sentencepiece_odd_rows(spark):
    got = sentencepiece_codec.encode(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows()) and all(not r.ids for r in got if r.doc_id in (5, 6))
    assert sentencepiece_codec.encode(no_docs(spark)).count() == 0
    assert [r.text for r in sentencepiece_codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == [None, ""]
    odd = spark.createDataFrame([(1, [None, -5, 10**6]), (None, [0])], "doc_id long, ids array<int>")
    unknown = sentencepiece.SentencePieceProcessor(model_file=MODEL).decode([0])
    assert sorted(r.text for r in sentencepiece_codec.decode(odd).collect()) == sorted([unknown * 3, unknown])


# --- packing -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_patterns_use_every_piece_once(counts):
    out = packing.pack_counts(counts, 64)
    used: dict[int, int] = {}
    for lens, n in out:
        assert sum(lens) <= 64 and n > 0
        for x in lens:
            used[x] = used.get(x, 0) + n
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(n for _, n in out) <= max(-(-total * 2 // 64), sum(counts.values()) if total < 64 else 0) + 1


def test_exact_complements_are_taken():
    out = dict(packing.pack_counts({60: 4, 4: 4, 30: 2, 20: 2, 14: 2, 33: 1, 31: 1}, 64))
    assert out[(60, 4)] == 4 and out[(33, 31)] == 1 and out[(30, 20, 14)] == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_packing_of_few_pieces_against_the_best(lengths):
    """All ways to pack up to seven pieces: never more than one sequence over the fewest."""
    def least(left: tuple, rooms: tuple) -> int:
        if not left:
            return len(rooms)
        ways = [least(left[1:], tuple(sorted((*rooms[:k], r - left[0], *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= left[0]]
        return min([*ways, least(left[1:], tuple(sorted((*rooms, 12 - left[0]))))])

    counts = {x: lengths.count(x) for x in lengths}
    assert sum(n for _, n in packing.pack_counts(counts, 12)) <= least(tuple(sorted(lengths, reverse=True)), ()) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=8), st.integers(1, 30))
def test_complements_are_found_wherever_there_are_any(counts, gap):
    have = np.zeros(32, np.int64)
    for k, n in counts.items():
        have[k] = n
    pool = [k for k, n in counts.items() for _ in range(n)]
    want = any(sum(c) == gap for r in (1, 2, 3) for c in __import__("itertools").combinations(pool, r))
    got = packing.SumIndex(have).complement(gap)
    assert (got is not None) == want and (got is None or (sum(got) == gap and all(got.count(x) <= counts[x] for x in got)))


def check_packing(got, lengths: list[int], cap: int) -> None:
    pieces = [(n, k) for n in lengths for k in range(-(-n // cap))]
    assert len(got) == len(pieces) and sum(r.tokens for r in got) == sum(lengths)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == np.cumsum([0, *(r.tokens for r in rows[:-1])]).tolist()
        assert sum(r.tokens for r in rows) <= cap
    assert sorted(by) == list(range(len(by)))


def test_packing_of_documents(spark, sf):
    docs = read(spark, sf, "documents")
    lengths = [len(r.text.split()) for r in docs.collect()]
    got = packing.pack(docs, packing.PackParams(256)).collect()
    check_packing(got, [n for n in lengths if n], 256)
    room: list[int] = []  # plain best fit decreasing, piece by piece
    for n in sorted((min(256, n - k) for n in lengths for k in range(0, n, 256)), reverse=True):
        k = min((k for k in range(len(room)) if room[k] >= n), key=room.__getitem__, default=None)
        if k is None:
            room.append(256 - n)
        else:
            room[k] -= n
    assert len({r.sequence for r in got}) <= 1.02 * len(room)


def test_packing_odd_rows(spark):
    got = packing.pack(odd_docs(spark), packing.PackParams(128)).collect()
    check_packing(got, [n for r in odd_rows() if r[1] and (n := len([w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", r[1]) if w]))], 128)
    assert packing.pack(no_docs(spark)).count() == 0


# --- sharding ----------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=120), st.integers(1, 9))
def test_schedule_is_the_heap_s(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    want: dict[int, list[int]] = {}
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        want.setdefault(size, []).append(s)
        heapq.heappush(heap, (load + size, s))
    counts: dict[int, int] = {}
    for x in sizes:
        counts[x] = counts.get(x, 0) + 1
    for size, starts, turns in sharding.schedule(list(counts.items()), shards):
        part = [sum(s <= k for s in starts) - 1 for k in range(counts[size])]
        assert [turns[p][(k - starts[p]) % len(turns[p])] for k, p in enumerate(part)] == want[size]


def test_schedule_of_very_many_groups_stays_small():
    plan = sharding.schedule([(10**10, 1), (7, 10**9), (5, 10**9)], 64)
    assert sum(len(t) for _, _, turns in plan for t in turns) < 500


def test_ranks_of_a_hot_key_come_from_many_tasks(spark):
    from pagewright.llm.common import ranked

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("key"), (F.col("id") * 7919 % 5003).alias("x"))
    got = ranked(rows, "key", [F.col("x").asc()]).collect()
    want: dict = {}
    for r in sorted(got, key=lambda r: (r.key, r.x)):
        assert r["rank"] == want.setdefault(r.key, 0)
        want[r.key] += 1
    assert sum(want.values()) == 5000


def test_sharding_odd_rows(spark):
    got = sharding.shard(odd_docs(spark), F.md5("text"), F.octet_length("text"), sharding.ShardParams(3)).collect()
    assert len(got) == len(odd_rows())
    groups: dict[str | None, set] = {}
    for r in got:
        groups.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values()) and None in groups
    assert sharding.shard(no_docs(spark), F.md5("text"), F.octet_length("text")).count() == 0


# --- URL filters -------------------------------------------------------------------------------------------------


def bad_host(spark):
    rows = [(k, f"https://a.example/{'spam' if k % 2 else 'news'}/{k}{'.html' if k % 3 else ''}?utm_x=1") for k in range(200)]
    rows += [(1000 + k, f"https://b.example/p/{chr(97 + k % 26) * 3}{k}x") for k in range(60)]
    labels = [(k, 0 if k % 2 else 1, 0) for k in range(0, 200, 3)] + [(1000, 1, None), (1001, 1, 1)]
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_bad_templates_are_rejected(spark, duck):
    pages, labels = bad_host(spark)
    got = url_filter.filter_urls(pages, labels).toPandas()
    spam = got[got.page_id.between(0, 199) & (got.page_id % 2 == 1)]
    news = got[got.page_id.between(0, 199) & (got.page_id % 2 == 0)]
    assert not spam.kept.any() and news.kept.all() and spam.template.str.startswith("/spam/").all()
    assert set(got[got.host == "b.example"].template) == {"/p/*/?"}
    con = duck.cursor()
    con.register("pg", pages.toPandas())
    con.register("lb", labels.toPandas())
    sql = url_filter.oracle_sql().replace("FROM pages", "FROM pg").replace("FROM labels", "FROM lb")
    assert normal(got) == normal(con.execute(sql).df())


def test_a_small_section_of_a_large_host_is_judged_by_itself(spark):
    rows = [(k, f"https://a.example/s{'abcdefghijklmnopqrstuvwxyz'[k % 25]}/{k}") for k in range(2500)]  # 25 sections of 4 %
    rows += [(3000 + k, f"https://b.example/hot/{k}") for k in range(3000)] + [(10_000 + k, f"https://b.example/m{'nopq'[k % 4]}/{k}") for k in range(400)]  # one large section, four of 3 %
    bad = lambda i: (i < 2500 and i % 25 == 7) or (i >= 10_000 and i % 4 == 2)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad(i) else 1, 0) for i, _ in rows if i % 3 == 0], "doc_id long, quality int, toxic int")
    got = url_filter.filter_urls(pages, labels).toPandas()
    assert (got.kept == ~got.page_id.map(bad)).all()
    # many alike branches share a short name
    pages = spark.createDataFrame([(k, f"https://c.example/w{chr(97 + k % 26)}{chr(97 + k // 26 % 10)}z/{k}") for k in range(1040)], "page_id long, url string")
    assert set(url_filter.filter_urls(pages, labels.limit(0)).toPandas().template) == {"/{*}/<num>/?"}


def test_url_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "nonsense"), (None, "https://a.example/x"), (4, "https://a.example/" + "/".join(map(str, range(3000)))), (4, "https://a.example/"), (5, "HTTPS://U:p@A.example:443/é/%20?b=1&a=2#f"), (6, "https://a.example/?" + "q" * 100_000)]
    pages = spark.createDataFrame([(i, u, "z", 1, 2) for i, u in rows], "page_id long, url string, host string, n int, good int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.kept, r.host) for r in url_filter.filter_urls(pages, labels).collect()}
    assert {(1, False, None), (2, False, None), (3, False, None)} <= got and {h for i, _, h in got if i not in (1, 2, 3)} == {"a.example"}
    assert url_filter.filter_urls(pages, labels).count() == len(rows)
    assert url_filter.filter_urls(pages, labels.limit(0)).filter("purity is null and kept").count() == 5
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages_do_as_their_operators_say(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = corpus_pipeline.stage_language(spark, docs, sf).cache()
    assert ids(one) == ids(language_id.identify(docs).filter("accepted")) and one.columns == docs.columns
    two = corpus_pipeline.stage_quality(spark, one, sf).cache()
    assert ids(two) == ids(quality.classify(one, labels).filter("accepted")) and two.columns == docs.columns
    three = corpus_pipeline.stage_near_duplicates(spark, two, sf).cache()
    texts = [(r.doc_id, r.text) for r in two.select("doc_id", "text").collect()]
    assert ids(three) == sorted({c for _, c, _ in brute_texts(texts, grams, 0.6)}) and three.columns == docs.columns
    packed = corpus_pipeline.stage_packing(spark, three, sf).collect()
    check_packing(packed, [len(r.text.split()) for r in three.collect()], 2048)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(whole) == sorted(packed)


def test_pipeline_runs_over_odd_and_empty_tables(spark, sf, tmp_path):
    import os

    for name, docs in (("odd", odd_docs(spark)), ("empty", no_docs(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        read(spark, sf, "labels").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    odd = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert odd and {r.doc_id for r in odd} <= {r[0] for r in odd_rows()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert all(os.listdir(f"{shared}/{x}") == ["3-best_fit_packing"] for x in os.listdir(shared) if x.startswith("pipeline-"))


def test_pipeline_takes_odd_rows(spark, sf):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
    empty = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
