"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: one to three characters of the lower-cased text, hashed into ``BUCKETS``; term frequency is the
share of a text's n-grams of that length, inverse document frequency comes from all training documents. The
weights are learned by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of the
training documents (``MAX_TRAIN``, in which every language has its rows: ``common.quotas``), a fifth of each language
kept apart to set the temperature of the scores. Small samples are read in as many epochs as give ``UPDATES`` steps.
The executors make the features of the sample, so no text goes to the driver. A text then costs one table look-up
per n-gram: the weights are multiplied by the frequencies beforehand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, sample_by_class, slices

BUCKETS = 1 << 16
#: Documents from which weights are learned; document frequencies count all.
MAX_TRAIN = 4_000
EPOCHS = 2
#: Steps of the learner at least: a small sample is read more often.
UPDATES = 6_000
UNDETERMINED = "und"
#: Below this share of the calibrated probability a prediction is rejected.
LEAST_SCORE = 0.5
_ORDERS = (1, 2, 3)
_STEP = 1 << 18


def grams(text: str) -> list[np.ndarray]:
    """For each order the buckets of all n-grams of the text, in order."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, mixed = [], np.zeros(len(code), np.uint32)
    for n in _ORDERS:
        if len(code) < n:
            out.append(np.empty(0, np.uint32))
            continue
        mixed = (mixed[: len(code) - n + 1] * np.uint32(0x01000193)) ^ code[n - 1 :]
        spread = (mixed + np.uint32(n)) * np.uint32(0x9E3779B1)
        out.append(spread >> np.uint32(16))
    return out


def _frequency_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition: (bucket, n); bucket -1 counts the documents."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            seen = np.zeros(BUCKETS, bool)
            for g in grams(text or ""):
                seen[g] = True
            total += seen
            n += 1
    at = np.flatnonzero(total)
    yield pa.record_batch(
        [np.concatenate(([-1], at)).astype(np.int32), np.concatenate(([n], total[at]))], names=["bucket", "n"]
    )
    give_back()


@dataclass
class Model:
    languages: list[str]
    #: bucket x language; already times idf and temperature
    weights: np.ndarray
    bias: np.ndarray

    def logits(self, text: str) -> np.ndarray:
        out = self.bias.astype(np.float64)
        for g in grams(text):
            if len(g):
                parts = [self.weights[g[a : a + _STEP]].sum(axis=0, dtype=np.float64) for a in range(0, len(g), _STEP)]
                out = out + sum(parts) / len(g)
        return out


def _sparse(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text in order, with their TF-IDF."""
    keys, values = [], []
    for g in grams(text):
        if len(g):
            k, c = np.unique(g, return_counts=True)
            keys.append(k)
            values.append(c / len(g))
    if not keys:
        return np.empty(0, np.int64), np.empty(0)
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k.astype(np.int64), np.bincount(where, np.concatenate(values)) * idf[k]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, *, size: int = BUCKETS,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = EPOCHS,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal with L1 and L2, one row at a time, every class at once.

    ``labels`` are classes, or one row of class probabilities for each row.
    """
    z, n = np.zeros((size + 1, n_classes)), np.zeros((size + 1, n_classes))
    wanted = labels if labels.ndim == 2 else np.eye(n_classes)[labels]

    def current(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        shrunk = np.sign(za) * l1 - za
        return np.where(np.abs(za) <= l1, 0.0, shrunk / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for (k, v), y in zip(rows, wanted):
            at, x = np.append(k, size), np.append(v, 1.0)
            w = current(at)
            error = _softmax(x @ w) - y
            g = x[:, None] * error[None, :]
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    all_w = current(np.arange(size + 1))
    return all_w[:-1], all_w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows kept apart (golden-section search)."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


#: Buckets as 16-bit and values as 32-bit numbers, packed: lists of numbers would take the driver ten times the memory.
_FEATURES = T.StructType([T.StructField("k", T.BinaryType()), T.StructField("v", T.BinaryType())])


def fit(train: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from ``train(doc_id, text, lang)``; rows with a null lang are ignored. No rows: no languages.

    Every lang of ``train`` is learned, however rare. Null texts count as empty. The driver holds about 1 MB of weights
    and 1 MB of gradients a language, and ``max_train`` sparse rows of at most ``BUCKETS`` entries.
    """
    train = train.where("lang is not null").select("doc_id", "text", "lang")
    counts = train.select("text").mapInArrow(_frequency_rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    found = dict(map(tuple, counts.collect()))  # at most BUCKETS + 1 rows
    n_docs = found.pop(-1, 0)
    if not n_docs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    shared = train.sparkSession.sparkContext.broadcast(idf)

    def featured(text: pa.Array) -> pa.Array:
        found = [_sparse(x.as_py() or "", shared.value) for x in text]
        parts = [pa.array([x.astype(kind).tobytes() for x in part], pa.binary()) for part, kind in zip(zip(*found), (np.uint16, np.float32))]
        return pa.StructArray.from_arrays(parts or [pa.array([], pa.binary())] * 2, names=["k", "v"])

    made = {"x": F.arrow_udf(featured, _FEATURES)("text")}
    sample, known = sample_by_class(train.select("doc_id", "lang", "text"), "lang", max_train, "langid", made)
    languages = sorted(known)
    rows = [(np.frombuffer(r["x"]["k"], np.uint16).astype(np.int32), np.frombuffer(r["x"]["v"], np.float32)) for r in sample]
    labels = np.array([languages.index(r["lang"]) for r in sample])
    places, seen = np.zeros(len(rows), np.int64), Counter()
    for i, r in enumerate(sample):
        places[i] = seen[r["lang"]]
        seen[r["lang"]] += 1
    apart = places % 5 == 4
    fitting = np.flatnonzero(~apart)
    epochs = max(EPOCHS, -(-UPDATES // max(len(fitting), 1)))
    weights, bias = fit_ftrl([rows[i] for i in fitting], labels[fitting], len(languages), epochs=epochs)
    logits = np.array([v @ weights[k] + bias for (k, v), a in zip(rows, apart) if a]).reshape(-1, len(languages))
    t = temperature(logits, labels[apart])
    return Model(languages, (weights * idf[:, None] / t).astype(np.float32), bias / t)


_PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: Model) -> Column:
    """A column with ``lang`` and ``score`` (the calibrated probability) of ``docs.text``, whole texts.

    Null texts, texts without a letter and everything under a model without languages: ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(text: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for x in text:
            x = x.as_py()
            if x is None or not m.languages or not any(map(str.isalpha, x)):
                out.append((UNDETERMINED, 0.0))
                continue
            p = _softmax(m.logits(x))
            best = int(p.argmax())
            out.append((m.languages[best], float(p[best])))
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64())],
            names=["lang", "score"],
        )

    return F.arrow_udf(scored, _PREDICTION)("text")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is determined with a score of ``LEAST_SCORE`` or more, unchanged.

    Rows with a null text, or one without a letter, go; repeated rows share one fate; columns of any name stay.
    """
    mark = fresh("_lang", docs)
    found = docs.withColumn(mark, predict(docs, model))
    return found.where((F.col(f"{mark}.lang") != UNDETERMINED) & (F.col(f"{mark}.score") >= LEAST_SCORE)).select(docs.columns)
