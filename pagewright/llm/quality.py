"""Operator 10, quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters eight bytes wide move in steps of four over the whole document; rectified
responses are max-pooled over overlapping chunks (512 bytes, every 256); the mean and the maximum of the
chunks' pooled features enter one logistic unit, which gives the document's probability of being good.
Embedding, filters and unit are learned together by Adam from a bounded sample of ``labels``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, cut, hashed_sample, release, releasing, text_steps

STRIDE, WIDTH, HALF = 4, 8, 256


@dataclass(frozen=True)
class QualityParams:
    """``rows_per_class`` bounds the labelled rows that training takes; ``alpha`` is the share of good
    held-out documents that may fall under the bar."""

    rows_per_class: int = 1200
    dim: int = 8
    filters: int = 24
    epochs: int = 6
    batch: int = 16
    rate: float = 4e-3
    held_out: float = 0.25
    alpha: float = 0.003
    seed: int = 5


@dataclass(frozen=True)
class QualityModel:
    emb: np.ndarray  # (256, dim)
    conv: np.ndarray  # (STRIDE * dim, 2 * filters): the first and the second half of each filter
    bias: np.ndarray
    unit: np.ndarray  # (2 * filters): for the mean, for the maximum
    unit_bias: float
    bar: float


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text in zeros up to whole half-chunks, with a step of zeros at least; and their bounds."""
    lens = np.diff(offs)
    halves = (lens + STRIDE + HALF - 1) // HALF
    bounds = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(bounds[-1]) * HALF, np.uint8)
    for a, b, at in zip(offs[:-1].tolist(), offs[1:].tolist(), (bounds[:-1] * HALF).tolist()):
        out[at : at + b - a] = data[a:b]
    return out, bounds


def _responses(m: QualityModel, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses (half-chunks, places, filters) and the embedded steps."""
    f = len(m.bias)
    steps = m.emb[data].reshape(-1, STRIDE * m.emb.shape[1])
    both = steps @ m.conv
    h = both[:, :f]
    h[:-1] += both[1:, f:]
    per = HALF // STRIDE
    last = bounds[1:] * per - 1
    h[last[:-1]] -= both[last[:-1] + 1, f:]  # a filter ends with its document
    return h.reshape(-1, per, f), steps


def _chunks(m: QualityModel, halves: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled features of the chunks, each two half-chunks or a document's only one, and their bounds."""
    n = np.maximum(np.diff(bounds) - 1, 1)
    cb = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(cb[-1]) - np.repeat(cb[:-1], n) + np.repeat(bounds[:-1], n)
    second = np.minimum(first + 1, np.repeat(bounds[1:], n) - 1)
    pick = np.where(halves[second] > halves[first], second[:, None], first[:, None])
    return pick, cb


def probabilities(m: QualityModel, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    data, bounds = padded(data, offs)
    h, _ = _responses(m, data, bounds)
    halves = h.max(1)
    pick, cb = _chunks(m, halves, bounds)
    feats = np.maximum(np.take_along_axis(halves, pick, 0) + m.bias, 0)
    mean = np.add.reduceat(feats, cb[:-1], axis=0) / np.diff(cb)[:, None]
    top = np.maximum.reduceat(feats, cb[:-1], axis=0)
    z = np.concatenate([mean, top], 1).astype(np.float64) @ m.unit + m.unit_bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def train(texts: list[str], labels: list[int], params: QualityParams = QualityParams()) -> QualityModel | None:
    """Fit on labelled texts; None unless both classes are there. The order of rows doesn't matter."""
    rows = sorted({(t, int(y)) for t, y in zip(texts, labels) if t and y is not None and y == y})
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(params.seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    cut = int(len(rows) * params.held_out)
    held, rows = rows[:cut], rows[cut:]
    if len({y for _, y in rows}) < 2:
        held, rows = held + rows, held + rows
    d, f = params.dim, params.filters
    p = {
        "emb": rng.normal(0, 0.3, (256, d)), "conv": rng.normal(0, 1 / np.sqrt(WIDTH * d), (STRIDE * d, 2 * f)), "bias": np.zeros(f),
        "unit": rng.normal(0, 0.1, 2 * f), "unit_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    ys = np.array([y for _, y in rows], np.float32)
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
    t, steps = 0, params.epochs * -(-len(rows) // params.batch)
    for _ in range(params.epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), params.batch):
            part = order[lo : lo + params.batch]
            data, bounds = padded(*_packed([rows[i][0] for i in part]))
            m = QualityModel(p["emb"], p["conv"], p["bias"], p["unit"], 0.0, 0.0)
            h, emb = _responses(m, data, bounds)
            place = h.argmax(1)
            halves = np.take_along_axis(h, place[:, None], 1)[:, 0]
            pick, cb = _chunks(m, halves, bounds)
            raw = np.take_along_axis(halves, pick, 0) + m.bias
            feats, n = np.maximum(raw, 0), np.diff(cb)
            mean = np.add.reduceat(feats, cb[:-1], axis=0) / n[:, None]
            top = np.maximum.reduceat(feats, cb[:-1], axis=0)
            both = np.concatenate([mean, top], 1)
            z = both @ p["unit"] + p["unit_bias"][0]
            dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - ys[part]) * weight[part] / len(part)).astype(np.float32)
            dboth = dz[:, None] * p["unit"]
            doc = np.repeat(np.arange(len(part)), n)
            is_top = feats == top[doc]
            dfeat = (dboth[doc, :f] / n[doc, None] + dboth[doc, f:] * is_top) * (raw > 0)
            chunk, filt = np.nonzero(dfeat)
            g, half = dfeat[chunk, filt], pick[chunk, filt]
            at = half * (HALF // STRIDE) + place[half, filt]
            grad = {"unit": dz @ both, "unit_bias": dz.sum(keepdims=True), "bias": dfeat.sum(0)}
            nxt = np.minimum(at + 1, len(emb) - 1)
            inside = ((half + 1) * (HALF // STRIDE) - 1 != at) | ~np.isin(half + 1, bounds)
            conv, demb = np.zeros_like(p["conv"]), np.zeros_like(p["emb"])
            for pos, gg, off in ((at, g, 0), (nxt, g * inside, f)):
                order_f = np.argsort(filt, kind="stable")
                ff, first = np.unique(filt[order_f], return_index=True)
                conv[:, off + ff] += np.add.reduceat(emb[pos[order_f]] * gg[order_f, None], first, axis=0).T
                back = (p["conv"][:, off + filt].T * gg[:, None]).reshape(-1, d)
                byte = data.reshape(-1, STRIDE)[pos].ravel()
                for j in range(d):
                    demb[:, j] += np.bincount(byte, back[:, j], 256)
            grad |= {"conv": conv, "emb": demb}
            t += 1
            rate = params.rate * (1 - t / (steps + 1))
            for k, v in p.items():
                a, b = mom[k]
                a += 0.1 * (grad[k] - a)
                b += 0.001 * (grad[k] ** 2 - b)
                v -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    m = QualityModel(p["emb"], p["conv"], p["bias"], p["unit"].astype(np.float64), float(p["unit_bias"][0]), 0.0)
    good = [x for x, y in held or rows if y == 1] or [x for x, y in rows if y == 1]
    bar = float(np.quantile(np.round(probabilities(m, *_packed(good)), 6), params.alpha, method="lower"))
    return QualityModel(m.emb, m.conv, m.bias, m.unit, m.unit_bias, bar)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel | None:
    """Train on about ``rows_per_class`` labelled documents of each class."""
    picked = hashed_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id", "quality", params.rows_per_class)
    picked = cut(picked)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_small(picked), "doc_id").select("text", "quality").toPandas()
    return train(rows["text"].tolist(), rows["quality"].tolist(), params)


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), model: QualityModel | None = None) -> DataFrame:
    """``(doc_id, prob, accepted)`` for every row of ``docs``; ``prob`` is that of being good.

    Defined results: an empty or a null text has prob 0 and is rejected; repeated rows and null doc_ids
    give a row each; a prob equal to the bar is accepted; where the labels don't show both classes there
    is nothing to judge by, so prob is null and all rows are accepted; an empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    model = model or fit(docs, labels, params)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return base.select("doc_id", F.lit(None).cast("double").alias("prob"), F.lit(True).alias("accepted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prob = _column(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prob), pa.array((prob >= model.bar) & (prob > 0))], ["doc_id", "prob", "accepted"])

    return base.mapInArrow(releasing(run), "doc_id long, prob double, accepted boolean")


def _column(model: QualityModel, text: pa.Array) -> np.ndarray:
    prob = np.zeros(len(text))
    for lo, hi, data, offs in text_steps(text):
        prob[lo:hi] = np.where(np.diff(offs) > 0, np.round(probabilities(model, data, offs), 6), 0.0)
    return prob


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were, judged in one pass.

    Which rows those are, odd ones included, :func:`classify` says; repeated rows stay or go together.
    """
    model = fit(docs, labels, params)
    if model is None:
        return docs

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        prob = _column(model, text)
        release()
        return pa.array((prob >= model.bar) & (prob > 0))

    return docs.filter(accepted(F.col("text")))
