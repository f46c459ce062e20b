"""Quality classifier from trusted positives and unlabelled web text: non-negative PU learning.

A linear model on text statistics minimises pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)]) with
the logistic loss: the positives' share of the unlabelled negative risk is taken out, and that risk may
not go below zero (where it does, the step goes the other way). The class prior pi is estimated first:
a plain positive-against-unlabelled classifier orders the texts, and pi is the least ratio, over score
thresholds, of the unlabelled share above the threshold to the positive share, with a margin for
chance (best-bin estimation).

Labels of 1 in the rows to learn from are the trusted positives; unlabelled text is any document of
those rows. At most ``POSITIVE_ROWS`` and ``UNLABELLED_ROWS`` of them are fitted on the driver, those
with the smallest hashes; that bound is the only sampling. Scoring reads every whole text.

Defined cases: null and empty text get the score of a text without characters; without a trusted
positive every score is 0.5; a document labelled both ways is not trusted; repeated rows are scored
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, slices, table
from .features import ngram_counts, utf8_histogram
from .language_id import fold

POSITIVE_ROWS = 4_000
UNLABELLED_ROWS = 8_000
THRESHOLD = 0.3
BITS = 9
#: Share of the positives above a threshold that it must have to count for the prior, and the error rate of its margin.
LEAST_SHARE, ERROR_RATE = 0.05, 0.1
_SPACE = np.array([0x20, *range(0x09, 0x0E)])
_BASIC = 12


def text_features(text: str | None) -> np.ndarray:
    """Shares of character classes, of distinct words and lines, of byte values and of hashed character pairs."""
    text = text or ""
    h = utf8_histogram(text)
    n = max(1, int(h.sum()))
    words = [w for w in re.split(GAP, text) if w]
    lines = [x for x in text.split("\n") if x.strip()]
    nw = max(1, len(words))
    upper, lower, digit = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    basic = [
        1.0 * (not words), np.log1p(len(words)) / 10, len(set(words)) / nw if words else 1.0, same / nw, len(set(lines)) / max(1, len(lines)) if lines else 1.0,
        sum(map(len, words)) / nw / 10, upper / max(1, upper + lower), digit / n, h[_SPACE].sum() / n, (h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / n,
        h[128:].sum() / n, h[10] / n,
    ]
    pairs = ngram_counts(text.lower(), BITS, 2)
    return np.concatenate([basic, np.sqrt(h / n), np.sqrt(pairs / max(1, pairs.sum()))]).astype(np.float32)


DIMS = _BASIC + 256 + (1 << BITS)


@dataclass
class LinearModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def _descend(grad, dims: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on (weights, bias); ``grad(w, b)`` gives their gradients."""
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        g = grad(w[:-1], w[-1])
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from classifier scores of both (best-bin estimation)."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(4 / ERROR_RATE) / 2)
    usable = p >= LEAST_SHARE
    best = np.argmin(np.where(usable, (u + margin / np.sqrt(len(unlabelled)) + margin / np.sqrt(len(positive))) / np.maximum(p, 1e-9), np.inf))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 500, rate: float = 0.02, decay: float = 1e-3, prior: float | None = None) -> tuple[LinearModel, float]:
    """The nnPU model and the prior used."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    dims = both.shape[1]
    if prior is None:
        half_p, half_u = len(p) // 2, len(u) // 2

        def against(w, b):
            gp, gu = -_sigmoid(-(p[half_p:] @ w + b)) / max(1, len(p) - half_p), _sigmoid(u[half_u:] @ w + b) / max(1, len(u) - half_u)
            return np.append(gp @ p[half_p:] + gu @ u[half_u:], gp.sum() + gu.sum())

        w, b = _descend(against, dims, steps // 2, rate, decay)
        prior = estimate_prior(p[:half_p] @ w + b, u[:half_u] @ w + b) if half_p and half_u else 0.5

    def non_negative(w, b):
        fp, fu = p @ w + b, u @ w + b
        gain = -_sigmoid(-fp) * prior / len(p)
        minus_u, minus_p = _sigmoid(fu) / max(1, len(u)), _sigmoid(fp) * prior / len(p)
        risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() if len(u) else 0.0
        sign = 1.0 if risk >= 0 else -1.0
        g_neg = sign * np.append(minus_u @ u - minus_p @ p, minus_u.sum() - minus_p.sum())
        return g_neg if risk < 0 else g_neg + np.append(gain @ p, gain.sum())

    w, b = _descend(non_negative, dims, steps, rate, decay)
    return LinearModel(mean, scale, w, b), prior


def _features_of(docs: DataFrame, rows: int) -> np.ndarray:
    """Features of at most ``rows`` rows of ``docs(doc_id, text)``, those with the smallest hashes of their id."""
    h = F.xxhash64("doc_id")
    last = docs.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((0, DIMS), dtype=np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_features(t).tobytes() for t in b.column(1).to_pylist()])], names=["doc_id", "x"])

    got = docs.filter(h <= last).limit(rows).mapInArrow(features, "doc_id long, x binary").collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, bytes(r["x"])))])


def train_on_folds(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> tuple[LinearModel | None, float]:
    """The model of the rows outside fold ``held`` and its prior; None without a trusted positive."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.coalesce(fold("doc_id", folds), F.lit(-1)) != held)
    h = F.xxhash64("doc_id")
    trusted = labels.filter(fold("doc_id", folds) != held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("top")).filter("q = 1 and top = 1")
    chosen = F.broadcast(trusted.select("doc_id").orderBy(h, "doc_id").limit(positives))  # bounded by its limit
    p = _features_of(learn.join(chosen, "doc_id", "left_semi"), positives)
    if not len(p):
        return None, 0.5
    return fit(p, _features_of(learn, unlabelled))


def score(docs: DataFrame, model: LinearModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            s = np.full(len(texts), 0.5) if sent.value is None else sent.value.score(np.array([text_features(t) for t in texts]).reshape(-1, DIMS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s.astype(np.float64))], names=[*b.schema.names[:-1], "score"])

    return docs.select(*keep, docs[text_col].cast("string").alias("__text")).mapInArrow(scores, schema)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = train_on_folds(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
