"""Language ID (1) and quality classifier (10): held-out accuracy, rejection, odd rows."""

from __future__ import annotations

import random

import numpy as np
from pagewright.llm import language_id, quality
from pagewright.llm.common import read

from .fixtures import no_docs, odd_docs, odd_rows

MEDIUM = "/root/testdata/sf0.01"


def test_language_on_unseen_documents(spark):
    docs = read(spark, MEDIUM, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter("doc_id < 600"))
    got = language_id.identify(docs.filter("doc_id >= 600"), model=model).join(docs.select("doc_id", docs.lang.alias("own")), "doc_id").toPandas()
    assert (got.lang == got.own).mean() > 0.97
    assert got.accepted.mean() > 0.97


def test_language_rejects_what_is_no_language(spark):
    docs = read(spark, MEDIUM, "documents")
    noise = spark.createDataFrame([(k, "".join(chr(0x4E00 + (k * 7919 + i * 104729) % 5000) for i in range(300))) for k in range(20)], "doc_id long, text string")
    model = language_id.fit(docs)
    assert language_id.identify(noise, model=model).filter("accepted").count() < 12
    assert language_id.identify(spark.createDataFrame([(1, "... 123 !!!")], "doc_id long, text string"), model=model).first().lang == "und"


def test_language_rejects_languages_it_never_saw(spark):
    rng = random.Random(2)
    nl = "de het een van en in is dat op te zijn met voor niet aan er maar ook als bij door huis stad leven dag mensen tijd nieuwe oude grote".split()
    sv = "och att det som en på är av för med den till inte om ett han men var jag sig från vi så kan när år hus stad liv dag tid".split()
    rows = [(k, " ".join(rng.choice((nl, sv)[k % 2]) for _ in range(40))) for k in range(200)]
    model = language_id.fit(read(spark, MEDIUM, "documents"))
    assert language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model=model).filter("accepted").count() <= 4


def test_language_odd_rows(spark):
    got = language_id.identify(odd_docs(spark)).toPandas()
    assert len(got) == len(odd_rows())
    blank = got[got.doc_id.isin([5, 6, 13])]
    assert (blank.lang == "und").all() and not blank.accepted.any() and (blank.prob == 0).all()
    assert language_id.identify(no_docs(spark)).count() == 0
    unlabelled = odd_docs(spark).drop("lang").selectExpr("*", "cast(null as string) lang")
    assert language_id.identify(unlabelled).filter("accepted").count() == len(odd_rows())
    kept = language_id.keep_identified(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(None if i != i else int(i)) for i in got[got.accepted].doc_id)


def test_language_model_is_the_same_for_any_order():
    texts, labels = ["das ist ein haus und", "the house is a home", "das auto ist da", "the car is there"] * 8, ["de", "en"] * 16
    a = language_id.train(texts, labels)
    b = language_id.train(texts[::-1], labels[::-1])
    assert np.array_equal(a.table, b.table) and a.bar == b.bar


def test_quality_on_unseen_documents(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    model = quality.fit(docs, labels.filter("doc_id < 7000"))
    got = quality.classify(docs.filter("doc_id >= 7000"), labels, model=model).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    ranks = got.prob.rank()
    auc = (ranks[got.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.97
    assert good.accepted.mean() > 0.98 and bad.accepted.mean() < 0.25


def test_quality_reads_the_whole_document():
    good, bad = "a plain and simple sentence. " * 20, "zz## qq%% " * 60
    m = quality.train([good + f"{k}" for k in range(40)] + [bad + f"{k}" for k in range(40)], [1] * 40 + [0] * 40)
    data, offs = quality._packed([good * 30, good * 30 + bad * 10])
    p = quality.probabilities(m, data, offs)
    assert p[0] > 0.5 and p[1] < p[0]


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, None), (9, 0, 0), (None, 1, 0), (14, None, 0), (16, 0, 1), (14, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs(spark), labels).toPandas()
    assert len(got) == len(odd_rows())
    blank = got[got.doc_id.isin([5, 6])]
    assert (blank.prob == 0).all() and not blank.accepted.any()
    assert quality.classify(no_docs(spark), labels).count() == 0
    assert quality.classify(odd_docs(spark), labels.limit(0)).filter("accepted and prob is null").count() == len(odd_rows())
    assert quality.keep_good(odd_docs(spark), labels).columns == odd_docs(spark).columns


def test_language_scores_are_those_of_plain_loops():
    texts = ["das ist ein haus und", "the house is a home", "", "Ünder 12 le chat!", "x", "a b", "das auto ist da" * 40]
    model = language_id.train(["das ist ein haus und", "the house is a home", "le chat est la"] * 8, ["de", "en", "fr"] * 8)
    data, offs = language_id._packed(texts)
    got, count = language_id.scores(model, data, offs)
    for k, text in enumerate(texts):
        raw = [c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
        sums, n = [0.0] * 3, 0
        for order, width in enumerate(language_id.ORDERS):
            for i in range(len(raw) - width + 1):
                gram = raw[i : i + width]
                if 32 in gram[1:-1] or (width == 2 and gram == [32, 32]):
                    continue
                bucket = (int.from_bytes(bytes(gram)) * 2654435761 % (1 << 32)) >> (32 - model.bits)
                sums = [s + float(w) for s, w in zip(sums, model.table[order][bucket])]
                n += 1
        z = [(s / max(n, 1) + float(b)) / model.temperature for s, b in zip(sums, model.bias)]
        e = [np.exp(v - max(z)) for v in z]
        assert count[k] == n and np.allclose(got[k], [v / sum(e) for v in e], atol=1e-6)


def test_quality_is_that_of_plain_loops():
    texts = ["a plain sentence. " * 40, "zz## qq%%", "x" * 255, "y" * 256, "z" * 257, "mixed text 123 " * 200]
    m = quality.train([t + str(k) for k in range(12) for t in texts[:1]] + [texts[1] * 9 + str(k) for k in range(12)], [1] * 12 + [0] * 12)
    got = quality.probabilities(m, *quality._packed(texts))
    f = len(m.bias)
    for text, p in zip(texts, got):
        raw = text.encode()
        raw += bytes(-(-(len(raw) + quality.STRIDE) // quality.HALF) * quality.HALF - len(raw))
        steps = [m.emb[list(raw[i : i + quality.STRIDE])].ravel().astype(np.float64) for i in range(0, len(raw), quality.STRIDE)]
        conv = m.conv.astype(np.float64)
        answers = [steps[i] @ conv[:, :f] + (steps[i + 1] @ conv[:, f:] if i + 1 < len(steps) else 0) for i in range(len(steps))]
        per = quality.HALF // quality.STRIDE
        halves = [np.max(answers[i : i + per], axis=0) for i in range(0, len(answers), per)]
        chunks = [np.maximum(np.maximum(halves[i], halves[min(i + 1, len(halves) - 1)]) + m.bias, 0) for i in range(max(1, len(halves) - 1))]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ m.unit + m.unit_bias
        assert abs(1 / (1 + np.exp(-z)) - p) < 1e-5
