"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties (per-coordinate FTRL-proximal, so
weights that don't earn their L1 penalty are exactly zero), then calibrated by a temperature on rows
kept out of the training.

Inverse document frequencies come from all rows to learn from, added up on the executors. The model is
fitted on the driver on at most ``TRAIN_ROWS`` labelled rows, dealt out evenly over the languages, those
with the smallest hash of their id; that bound is the only sampling. Scoring reads every whole text.

Defined cases: a null text, or one without a letter, gets ``und`` with score 0; without any row to learn
from every text is ``und``; null languages are not learned from; repeated rows are scored each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import give_back, slices, small, table
from .features import ngram_counts

BITS = 14
LONGEST = 3
TRAIN_ROWS = 4_000
CALIBRATION_SHARE = 0.2
EPOCHS = 3
UND = "und"


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Ftrl:
    """FTRL-proximal for a multinomial logistic model with L1 and L2 penalties."""

    def __init__(self, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros((classes, dims)), np.zeros((classes, dims))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = softmax(w @ x)
        g[label] -= 1
        g = g[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss; searched by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(text, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UND, 0.0
        at, x = self.vector(text)
        p = softmax(self.weights[:, at] @ x / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the unit-length vector of (1 + log count) * idf."""
    counts = ngram_counts(text.lower(), BITS, LONGEST)
    at = np.nonzero(counts)[0]
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed idf of each place over all rows of ``texts(text)``; each task sends one total a place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        n, df = 0, np.zeros(1 << BITS, dtype=np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                n += 1
                df += ngram_counts(t.lower(), BITS, LONGEST) > 0
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["place", "n"])

    totals = texts.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << BITS), 0
    for r in totals:
        if r.place < 0:
            n = r.n
        else:
            df[r.place] = r.n
    return np.log((1 + n) / (1 + df)) + 1


def training_rows(rows: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """At most ``most`` of ``rows(doc_id, text, lang)``, as many of each language as there are or as its share.

    Those with the smallest hash of their id. A bound on the hash that twice as many rows keep comes
    first, so that what is put in order is as little for a very frequent language as for others.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    share = max(1, most // max(1, langs))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    near = rows.select("lang", "doc_id", place.alias("place")).join(small(counts, langs), "lang").filter(F.col("place") * F.col("n") < 2 * share + 50)
    cut = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("k") <= share)
    last = cut.groupBy("lang").agg(F.max("place").alias("last"))
    # ids that repeat can add rows, which the limit takes back
    return rows.join(small(last, langs), "lang").filter(place <= F.col("last")).drop("last").limit(most)


def train(rows: DataFrame, most: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on ``rows(doc_id, text, lang)``, all with text and language."""
    idf = inverse_frequencies(rows.select("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [tf_idf(t, idf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([at.astype(np.uint16).tobytes() for at, _ in out]), pa.array([x.astype(np.float32).tobytes() for _, x in out])], names=["doc_id", "lang", "at", "x"])

    got = training_rows(rows, most).select("doc_id", "text", "lang").mapInArrow(vectors, "doc_id long, lang string, at binary, x binary").collect()
    langs = sorted({r.lang for r in got})
    data = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64), langs.index(r.lang)) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.lang))]
    order = np.random.default_rng(7).permutation(len(data))
    cut = int(len(data) * CALIBRATION_SHARE)
    held, fit = order[:cut], order[cut:]
    model = Ftrl(len(langs), 1 << BITS)
    for _ in range(EPOCHS):
        for i in np.random.default_rng(11).permutation(fit):
            model.learn(*data[i])
    w = model.weights()
    logits = np.array([w[:, data[i][0]] @ data[i][1] for i in held])
    temperature = best_temperature(logits, np.array([data[i][2] for i in held])) if len(held) >= 20 else 1.0
    return LanguageModel(langs, idf, w, temperature)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the predicted language and its score. Workers get the text only and send these two."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        give_back()
        out = [sent.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], type=pa.string()), pa.array([p for _, p in out], type=pa.float64())], names=["pred", "score"])

    # a name that no column of ``docs`` has
    found = "found" + "_" * max(map(len, docs.columns))
    scored = docs.select(*[docs[c] for c in keep], predict(docs[text_col].cast("string")).alias(found))
    return scored.select(*[scored[c] for c in keep], scored[found]["pred"].alias(pred_col), scored[found]["score"].alias(score_col))


def train_on_folds(docs: DataFrame, held: int = 1, folds: int = 3) -> LanguageModel:
    """A model of the documents outside fold ``held``; text and language are all it learns from."""
    rows = docs.filter((fold("doc_id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train_on_folds(docs), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
