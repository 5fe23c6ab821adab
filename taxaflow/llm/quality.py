"""Quality by a generalised additive model with pairwise interactions.

Each text becomes a few dozen surface statistics, cut into bins at quantiles of the training rows. Shallow
trees over one feature at a time are boosted in cycles; as every tree is a step function of one binned
feature, the ensemble is one look-up table per feature. The strongest pairs of features by remaining gain get
tables of their own in the same way. A score is the logistic of the sum of a text's table entries: vectorised
gathers and additions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, first_by_hash, raw, slices
from .training import held_out, labelled

#: Labelled rows from which the model is fitted, by hash order of the id.
MAX_TRAIN = 50_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
CUT = 0.3

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_END = b".,;:?'\""
_ALNUM = _LETTERS + _DIGITS
FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "spaces", "end_marks", "symbols",
    "symbol_words", "upper_words", "single_words", "distinct_words", "top_word", "repeats", "top_pair",
    "log_lines", "line_length", "distinct_lines", "top_line", "short_lines", "longest_word", "pipes", "braces",
)


def features(text: bytes | None) -> list[float]:
    """The statistics of one whole text; a null text counts as empty."""
    text = text or b""
    size, words = len(text), text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)

    def share(kept: bytes) -> float:
        return (size - len(text.translate(None, kept))) / max(size, 1)

    counts, rows = Counter(words), Counter(lines)
    pairs = Counter(zip(words, words[1:]))
    spaces, letters, digits, marks = share(_SPACE), share(_LETTERS), share(_DIGITS), share(_END)
    odd = sum(c for w, c in counts.items() if not w.rstrip(_END).isalnum() and w.translate(None, _ALNUM + _END))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(size), np.log1p(len(words)), size / n, letters, share(_UPPER), digits, spaces, marks,
        1 - spaces - letters - digits - marks,
        odd / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        sum(c for w, c in counts.items() if len(w) == 1) / n, len(counts) / n,
        max(counts.values(), default=0) / n, repeats / n, max(pairs.values(), default=0) / n,
        np.log1p(len(lines)), size / m, len(rows) / m, max(rows.values(), default=0) / m,
        sum(c for x, c in rows.items() if len(x) < 20) / m, np.log1p(max(map(len, counts), default=0)),
        text.count(b"|") / n, sum(map(text.count, (b"{", b"}", b"<", b">"))) / n,
    ]


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([features(x) for x in batch.column(1).to_pylist()], np.float32).reshape(-1, len(FEATURES))
        x = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
        yield pa.record_batch([batch.column(0), x], names=["doc_id", "x"])


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features by adding up bins."""
        if not len(x):
            return np.zeros(0)
        bins = _binned(x, self.edges)
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[_coarse(bins[:, i]), _coarse(bins[:, j])]
        return 1 / (1 + np.exp(-total))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _step(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> tuple[np.ndarray, float]:
    """A tree of up to ``leaves`` leaves over ordered bins with these gradient sums: its values and its gain."""
    parts, total = [(0, len(g))], 0.0
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            if not len(gl):
                continue
            gs, hs = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (a, a + at + 1, b))
        if best[1] is None:
            break
        a, m, b = best[1]
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
        total += best[0]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return values, total


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best four quadrants over two binned features (sums g, h): values and gain."""
    G, H = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best = (0.0, np.zeros_like(g))
    for a in range(1, len(g)):
        for b in range(1, g.shape[1]):
            quads = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            sums = [
                (G[a, b], H[a, b]), (G[a, -1] - G[a, b], H[a, -1] - H[a, b]), (G[-1, b] - G[a, b], H[-1, b] - H[a, b]),
                (G[-1, -1] - G[a, -1] - G[-1, b] + G[a, b], H[-1, -1] - H[a, -1] - H[-1, b] + H[a, b]),
            ]
            gain = sum(s * s / (t + ridge) for s, t in sums) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
            if gain > best[0]:
                values = np.zeros_like(g)
                for at, (s, t) in zip(quads, sums):
                    values[at] = -s / (t + ridge)
                best = (gain, values)
    return best[1], best[0]


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 2.0) -> Model:
    """Cyclic boosting of main effects, then of the ``PAIRS`` strongest pairs. No rows: the score is one half."""
    width = len(FEATURES)
    empty = Model([np.empty(0)] * width, np.zeros((width, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)), 0.0)
    if not len(y):
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    bins = _binned(x, edges)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    tables, total = np.zeros((width, BINS)), np.full(len(y), bias)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = gradients()
            values, _ = _step(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS), ridge)
            tables[j] += rate * values
            total += rate * values[bins[:, j]]
    coarse = _coarse(bins)

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        at, shape = coarse[:, i] * PAIR_BINS + coarse[:, j], (PAIR_BINS, PAIR_BINS)
        return tuple(np.bincount(at, v, PAIR_BINS**2).reshape(shape) for v in (g, h))

    gains = {p: _cross(*sums(*p), ridge)[1] for p in combinations(range(width), 2)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(pairs):
            values, _ = _cross(*sums(i, j), ridge)
            pair_tables[k] += rate * values
            total += rate * values[coarse[:, i], coarse[:, j]]
    return Model(edges, tables, pairs, pair_tables, bias)


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, work: Workspace | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs(doc_id, text)``.

    Labels (``labels.quality``) are learned from ids that are not held out, at most ``max_train`` of them by
    hash order. Null texts are scored as empty ones; repeated rows each get their row; without any labels
    every score is one half. Other columns are ignored.
    """
    work = work or Workspace(docs.sparkSession, "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = work.cut(docs.select("doc_id", raw().alias("text")).mapInArrow(_feature_rows, f"doc_id {kind}, x array<float>"))
    train = labelled(found.where(~held_out()), labels, "quality")
    train = train.select("doc_id", "x", "y")
    rows = first_by_hash(train, "doc_id", max_train, train.count(), "quality").select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(fit_gam(x, rows["y"].to_numpy(np.float64)))

    def scored(v: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)))

    out = found.select("doc_id", held_out().alias("held_out"), F.arrow_udf(scored, T.DoubleType())("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
