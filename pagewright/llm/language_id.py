"""Operator 1, language ID: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams inside words (lower case, the
word's ends marked), hashed into a fixed number of buckets; a linear softmax names the language.
Embeddings and weights are learned by stochastic gradient descent in numpy from a bounded sample of
labelled rows. As mean and weights are both linear, scoring folds them into one table of bucket by
language, so a document costs one lookup a gram over its whole text.

Rejection is calibrated on held-out rows: a temperature is fitted to their likelihood, and the bar is
the confidence that all but ``alpha`` of the rightly named held-out documents reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, release, releasing, text_steps

ORDERS = (2, 3, 4)
_K = np.uint32(2654435761)
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageParams:
    """``rows_per_language`` bounds the labelled rows that training takes, and ``pieces`` how many parts of random place
    and of 12 to 800 characters it takes of each, so that short texts are met too; scoring reads whole texts. The
    rest is SGD."""

    rows_per_language: int = 600
    pieces: int = 3
    bits: int = 15
    dim: int = 16
    epochs: int = 4
    rate: float = 2.0
    batch: int = 64
    held_out: float = 0.25
    alpha: float = 0.001
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # (orders, buckets, languages), embeddings times weights
    bias: np.ndarray
    temperature: float
    bar: float
    bits: int


def _buckets(data: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of each byte position's gram, and whether the gram counts.

    A gram counts if it lies in one text and only its ends may be outside a word.
    """
    x = _CLASS[data]
    space = x == 32
    ends = offs[1:][offs[1:] > offs[:-1]]
    v = x.astype(np.uint32)
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            yield np.zeros(0, np.uint32), np.zeros(0, bool)
            continue
        g, ok = v[:m].copy(), np.ones(m, bool)
        for j in range(1, n):
            g = (g << np.uint32(8)) | v[j : j + m]
            if j < n - 1:
                ok &= ~space[j : j + m]
        if n == 2:
            ok &= ~(space[:m] & space[1 : 1 + m])
        for j in range(1, n):
            bad = ends - j
            ok[bad[(bad >= 0) & (bad < m)]] = False
        yield (g * _K) >> np.uint32(32 - bits), ok


def scores(model: LanguageModel, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities (texts by languages) and the number of grams of each text."""
    texts, c = len(offs) - 1, len(model.languages)
    total, count = np.zeros((texts, c)), np.zeros(texts, np.int64)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    for table, (bucket, ok) in zip(model.table, _buckets(data, offs, model.bits)):
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        bounds = np.searchsorted(at, offs)
        rows = full[bounds[full + 1] > bounds[full]]
        total[rows] += np.add.reduceat(table[bucket[at]], bounds[rows], axis=0)
        count += np.diff(bounds)
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True), count


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def train(texts: list[str], labels: list[str], params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """Fit on labelled texts; None where there is no label at all. The order of rows doesn't matter."""
    rows = sorted((str(a), t or "") for a, t in zip(labels, texts) if a is not None)
    languages = tuple(sorted({a for a, _ in rows}))
    if not languages:
        return None
    rng = np.random.default_rng(params.seed)
    size, c = 1 << params.bits, len(languages)
    order = rng.permutation(len(rows))
    held = set(order[: int(len(rows) * params.held_out)].tolist())
    pieces: list[tuple[str, int]] = []
    for i, (a, t) in enumerate(rows):
        if i in held or not t:
            continue
        y = languages.index(a)
        for _ in range(params.pieces):
            n = int(np.exp(rng.uniform(np.log(12), np.log(800))))
            at = int(rng.integers(0, max(1, len(t) - n)))
            pieces.append((t[at : at + n], y))
    emb = rng.normal(0, 0.1, (len(ORDERS) * size, params.dim)).astype(np.float32)
    w, bias = np.zeros((params.dim, c), np.float32), np.zeros(c, np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    feats = []
    for t, _ in pieces:
        data, offs = _packed([t])
        feats.append(np.concatenate([b[ok].astype(np.int64) + k * size for k, (b, ok) in enumerate(_buckets(data, offs, params.bits))]))
    ys = np.array([y for _, y in pieces], np.int64)
    use = np.array([i for i, f in enumerate(feats) if len(f)], np.int64)
    steps, step = max(1, params.epochs * -(-len(use) // params.batch)), 0
    for _ in range(params.epochs):
        rng.shuffle(use)
        for lo in range(0, len(use), params.batch):
            part = use[lo : lo + params.batch]
            rate = params.rate * (1 - step / steps)
            step += 1
            lens = np.array([len(feats[i]) for i in part])
            ids = np.concatenate([feats[i] for i in part])
            h = np.add.reduceat(emb[ids], np.cumsum(lens) - lens, axis=0) / lens[:, None]
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), ys[part]] -= 1
            p /= len(part)
            dh = (p @ w.T) / lens[:, None]
            w -= rate * h.T @ p
            bias -= rate * p.sum(0)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[by], prepend=-1))
            emb[ids[by][first]] -= rate * 30 * np.add.reduceat(np.repeat(dh, lens, axis=0)[by], first, axis=0)
    table = (emb @ w).reshape(len(ORDERS), size, c).astype(np.float32)
    raw = LanguageModel(languages, table, bias, 1.0, 0.0, params.bits)
    held_rows = [rows[i] for i in sorted(held) if rows[i][1]] or [r for r in rows if r[1]]
    if not held_rows or c == 1:
        return raw

    def scored(parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        data, offs = _packed([t for _, t in parts])
        p, count = scores(raw, data, offs)
        return np.log(np.maximum(p[count > 0], 1e-30)), np.array([languages.index(a) for a, _ in parts])[count > 0]

    parts = []  # short parts as well: there the confidences differ
    for a, t in held_rows:
        for n in np.exp(rng.uniform(np.log(3), np.log(800), 4)).astype(int).tolist():
            at = int(rng.integers(0, max(1, len(t) - n)))
            parts.append((a, t[at : at + n]))
    z, y = scored(parts)
    if not len(y):
        return raw

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]))

    temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    z, y = scored(held_rows)
    q = np.exp((z - z.max(1, keepdims=True)) / temperature)
    q /= q.sum(1, keepdims=True)
    right = q.max(1)[q.argmax(1) == y]
    bar = float(np.quantile(right, params.alpha)) if len(right) else 0.0
    return LanguageModel(languages, table, bias, temperature, bar, params.bits)


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """Train on at most about ``rows_per_language`` labelled rows a language of ``docs``."""
    rows = hashed_sample(docs.select("doc_id", "text", "lang"), "doc_id", "lang", params.rows_per_language).toPandas()
    return train(rows["text"].tolist(), rows["lang"].tolist(), params)


def identify(docs: DataFrame, params: LanguageParams = LanguageParams(), model: LanguageModel | None = None) -> DataFrame:
    """``(doc_id, lang, prob, accepted)`` for every row of ``docs``.

    Defined results: a text without a letter, an empty or a null one has lang ``und``, prob 0 and is
    rejected; a text whose calibrated confidence is under the bar keeps the best language's name and
    is rejected; repeated rows and null doc_ids give a row each; an equal confidence goes to the first
    language by name; where no row has a language there is nothing to judge by, so lang and prob are
    null and all rows are accepted; an empty table gives an empty result. Other columns of ``docs`` are
    not read.
    """
    model = model or fit(docs, params)
    schema = "doc_id long, lang string, prob double, accepted boolean"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"), F.lit(True).alias("accepted"))
    names = np.array([*model.languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, prob = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi, data, offs in text_steps(batch.column(1)):
                p, count = scores(model, data, offs)
                best[lo:hi] = np.where(count > 0, p.argmax(1), len(model.languages))
                prob[lo:hi] = np.where(count > 0, p.max(1), 0.0)
            taken = (best < len(model.languages)) & (prob >= model.bar)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best]), pa.array(np.round(prob, 6)), pa.array(taken)], ["doc_id", "lang", "prob", "accepted"])

    return base.mapInArrow(releasing(run), schema)


def keep_identified(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns as they were.

    The verdict is made in the same pass over the rows, so no join is needed and rows with null or
    repeated doc_ids are judged one by one.
    """
    model = fit(docs, params)
    if model is None:
        return docs
    verdict = accept_udf(model)
    return docs.filter(verdict(F.lower("text")))


def accept_udf(model: LanguageModel):
    """A vectorised predicate over lower-cased text: false for null, empty and letterless ones, as in :func:`identify`."""

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for lo, hi, data, offs in text_steps(text):
            p, count = scores(model, data, offs)
            out[lo:hi] = (count > 0) & (np.round(p.max(1), 6) >= model.bar)
        release()
        return pa.array(out)

    return accepted
