"""Operator 1: a quality classifier by positive-unlabelled learning.

The classifier is logistic over a fixed piecewise-linear basis of dense text
features.  It minimises the non-negative unbiased risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

from trusted positives P (a bounded sample of labelled rows) and all unlabelled
training text U; labelled negatives are never read.  The class prior is
estimated from the same two sets: the share of U above a score, over the share of
P above it, is at least the prior, and comes close to it where few negatives
score as high; the smallest such ratio, with a margin for its error, is taken.

Features are computed once and written, a hundred numbers' worth of bytes a
document, so each gradient over all of U is a pass over a small table.

Defined results: a null or empty text has its own features (all counts zero) and a
score like any other; texts are read whole; a null id is held out and scored;
repeated rows are scored alike; extra columns are not read; with no positive to
learn from every score is the prior 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, byte_buffer, map_whole_rows, text_chunks, texts

#: Knots of the hat functions of each feature.
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.0)
KNOTS = {
    "log_chars": (0.0, 2.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 11.0),
    "word_length": (0.0, 2.0, 4.0, 5.0, 6.0, 8.0, 12.0, 30.0),
    "upper": SHARES,
    "symbols": SHARES,
    "marks": SHARES,
    "digits": SHARES,
    "spaces": SHARES,
    "distinct": SHARES,
    "growth": (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0),
    "top_word": SHARES,
    "repeated_lines": SHARES,
    "same_start": SHARES,
}
FEATURES = tuple(KNOTS)
WIDTH = 1 + sum(map(len, KNOTS.values()))
CLASSES = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 mark, 6 symbol, 0 the rest
CLASSES[ord("A") : ord("Z") + 1] = 1
CLASSES[ord("a") : ord("z") + 1] = 2
CLASSES[ord("0") : ord("9") + 1] = 3
CLASSES[[9, 10, 11, 12, 13, 32]] = 4
CLASSES[[ord(c) for c in ".,;:'\"-()?"]] = 5
CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def features(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    """One row of dense features for each text."""
    data, offsets = byte_buffer(batch, column)
    n = batch.num_rows
    sizes = np.diff(offsets)
    kinds = CLASSES[data]
    counts = np.zeros((7, n))
    full = np.flatnonzero(sizes)
    for k in range(1, 7):
        if len(full):
            counts[k, full] = np.add.reduceat(kinds == k, offsets[:-1][full], dtype=np.int64)
    letters = np.maximum(1, counts[1] + counts[2])
    size = np.maximum(1, sizes)
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    out[:, 0] = np.log1p(sizes)
    out[:, 2] = counts[1] / letters
    out[:, 3], out[:, 4], out[:, 5], out[:, 6] = counts[6] / size, counts[5] / size, counts[3] / size, counts[4] / size
    for i, text in enumerate(texts(batch, column)):
        words = text.split()
        if not words:
            continue
        count = Counter(words)
        lines = [x for x in text.split("\n") if x]
        out[i, 1] = (len(text) - len(words) + 1) / len(words)
        out[i, 7] = len(count) / len(words)
        out[i, 8] = np.log1p(len(count)) / np.log1p(len(words))
        out[i, 9] = max(count.values()) / len(words)
        out[i, 10] = 1 - len(set(lines)) / len(lines) if lines else 0.0
        out[i, 11] = sum(map(str.isalpha, words)) / len(words)
    return out


def basis(x: np.ndarray) -> np.ndarray:
    """Hat functions of the features, and a constant."""
    cols = [np.ones((len(x), 1))]
    for j, knots in enumerate(KNOTS.values()):
        k = np.array(knots)
        v = np.clip(x[:, j].astype(float), k[0], k[-1])
        at = np.clip(np.searchsorted(k, v, side="right") - 1, 0, len(k) - 2)
        part = (v - k[at]) / (k[at + 1] - k[at])
        hats = np.zeros((len(x), len(k)))
        rows = np.arange(len(x))
        hats[rows, at] = 1 - part
        hats[rows, at + 1] = part
        cols.append(hats)
    return np.hstack(cols)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Settings:
    #: Most labelled positives that are fitted on; those of smallest id hash.
    positives: int = 20_000
    ridge: float = 1e-3
    #: Newton's steps end when no part of the gradient is above ``flat``, or after so many.
    steps: int = 12
    flat: float = 1e-7
    bins: int = 200
    #: Least share of the positives above a score at which the prior is read off.
    least_share: float = 0.5


class Model:
    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(basis(x) @ self.weights)


def feature_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``held_out`` and ``x`` (little-endian 32-bit floats)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_chunks(whole):
                x = features(b)
                raw = x.astype("<f4").tobytes()
                w = x.shape[1] * 4
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary()), b.column(2)], names=["id", "x", "held_out"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out")).mapInArrow(run, f"id {kind}, x binary, held_out boolean")


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<f4").reshape(-1, len(FEATURES))


def _sums(table: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float, np.ndarray]:
    """Over all rows: the sum of sigmoid(f) * basis, its curvature, the count, the sum of
    loss(-f), and a histogram of sigmoid(f).  Each task gives one small matrix."""
    bins = Settings.bins
    upper = np.triu_indices(WIDTH)
    cuts = np.cumsum([WIDTH, len(upper[0]), 1, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve, count, loss, histogram = np.zeros(WIDTH), np.zeros((WIDTH, WIDTH)), 0, 0.0, np.zeros(bins)
        for b in batches:
            x = basis(_matrix(b.column(0))) if b.num_rows else np.zeros((0, WIDTH))
            z = x @ weights
            p = sigmoid(z)
            slope += p @ x
            curve += (x.T * (p * (1 - p))) @ x
            count += len(p)
            loss += np.logaddexp(0, z).sum()
            histogram += np.bincount(np.minimum((p * bins).astype(int), bins - 1), minlength=bins)
        total = np.r_[slope, curve[upper], count, loss, histogram]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    rows = table.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(cuts[-1] + bins)
    total[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    slope, half, count, loss, histogram = np.split(total, cuts)
    curve = np.zeros((WIDTH, WIDTH))
    curve[upper] = half
    return slope, curve + np.triu(curve, 1).T, int(count[0]), float(loss[0]), histogram


def estimate_prior(positive_scores: np.ndarray, histogram: np.ndarray, least_share: float) -> float:
    """The smallest upper bound that the tails of the two score distributions give."""
    bins = len(histogram)
    p = np.bincount(np.minimum((positive_scores * bins).astype(int), bins - 1), minlength=bins)
    above_p = np.cumsum(p[::-1]) / max(1, p.sum())
    above_u = np.cumsum(histogram[::-1]) / max(1, histogram.sum())
    ok = above_p >= least_share
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(max(1, p.sum())) + 1 / np.sqrt(max(1, histogram.sum())))
    at = np.argmin((above_u[ok] + margin) / above_p[ok])
    return float(np.clip(above_u[ok][at] / above_p[ok][at], 0.02, 0.98))


def fit(spark: SparkSession, table: DataFrame, labels: DataFrame, label_id: str = "doc_id", quality: str = "quality", settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``table`` (see :func:`feature_table`) that are not held out."""
    trusted = labels.where(F.col(quality) == 1).select(F.col(label_id).alias("id")).distinct()
    train = table.where(~F.col("held_out"))
    order = F.xxhash64(F.col("id").cast("string"))
    found = train.join(trusted, "id", "left_semi").select("x", order.alias("h"), "id").orderBy("h", "id", "x").limit(settings.positives).select("x").toArrow()
    if not found.num_rows:
        return Model(np.zeros(WIDTH), 0.5)
    pos = basis(_matrix(found.column("x").combine_chunks()))
    ridge = settings.ridge * np.eye(WIDTH)

    def descend(w: np.ndarray, prior: float | None, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """With a prior: the non-negative risk.  Without: plain logistic regression of
        P against U, whose score orders by the ratio of their densities."""
        last, last_risk, hist, scale = w, np.inf, np.zeros(settings.bins), 1.0
        for _ in range(steps):
            g, curve, n, loss, hist = _sums(train, w)
            n = max(1, n)
            z = pos @ w
            p_pos = sigmoid(z)
            u_grad, u_risk = g / n, loss / n
            if prior is None:
                risk = u_risk + np.logaddexp(0, -z).mean()
                grad = u_grad - ((1 - p_pos) @ pos) / len(pos)
                curve = curve / n + (pos.T * (p_pos * (1 - p_pos))) @ pos / len(pos)
            else:
                negative = u_risk - prior * np.logaddexp(0, z).mean()
                risk = prior * np.logaddexp(0, -z).mean() + max(0.0, negative)
                plus = -prior * ((1 - p_pos) @ pos) / len(pos)
                minus = u_grad - prior * (p_pos @ pos) / len(pos)
                # a negative part below zero is overfitting: it is raised again
                grad = plus + minus if negative >= 0 else -minus
                curve = curve / n  # the positives' two losses differ by a straight line
            risk += 0.5 * settings.ridge * w @ w
            if risk > last_risk + 1e-9 and scale > 0.1:
                w, scale = (w + last) / 2, scale / 2
                continue
            last, last_risk = w, risk
            grad = grad + settings.ridge * w
            if np.abs(grad).max() <= settings.flat:
                break
            step = np.linalg.solve(ridge + curve, grad)
            w = w - scale * step * min(1.0, 20.0 / max(1e-9, np.abs(step).max()))
            scale = min(1.0, scale * 2)
        return w, hist

    w, _ = descend(np.zeros(WIDTH), None, settings.steps)
    *_, hist = _sums(train, w)
    prior = estimate_prior(sigmoid(pos @ w), hist, settings.least_share)
    w = w.copy()
    w[0] += np.log(prior)
    w, _ = descend(w, prior, settings.steps)
    return Model(w, prior)


def score(table: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return table.select("id", "held_out", "x").mapInArrow(run, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labels' training fold and score every document."""
    table = Scratch(spark, "quality").table(feature_table(docs, id_col, text_col), "features")
    return score(table, fit(spark, table, labels, settings=settings), id_col, threshold)


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.
    The fitted model scores the texts where they lie, so no text is shuffled."""
    table = Scratch(spark, "quality").table(feature_table(docs, id_col, text_col), "features")
    model = fit(spark, table, labels, settings=settings)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_chunks(whole, column):
                yield b.filter(pa.array(model.score(features(b, column)) >= threshold))

    return map_whole_rows(docs, run)
