"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end token. All training tokens
are counted in Spark. The model's outcomes are the ``WORDS`` most frequent tokens and ``CLASSES`` classes that
share out all other tokens by their last two bytes; a token of a class has the class's probability times its
smoothed share of the class's training tokens, so probabilities add up to one over all tokens.

The model is log-bilinear in the two tokens before: every partition of the training documents trains on all of
its tokens by noise-contrastive estimation in numpy, from one common start, and the parameters are averaged by
tokens in a tree. The normalising constants of all contexts are one matrix product, after which a token's
normalised log-probability is four look-ups. Counts of frequent tokens (``HEAD``, a bounded broadcast) are
added up while texts are read; those of all others by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, raw, slices

WORDS = 1024
CLASSES = 256
SIZE = WORDS + CLASSES
WIDTH = 16
NOISE = 32
BATCH = 4096
RATE = 0.1
#: Tokens at most whose counts are broadcast, by falling count.
HEAD = 200_000
#: Tokens that one task counts before it hands them on.
FLUSH = 600_000
END = b""


def class_of(token: bytes) -> int:
    return WORDS + zlib.crc32(token[-2:]) % CLASSES


def _count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "n"])

    for batch in slices(batches, 128):
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(text.lower().split())
        seen[END] += batch.num_rows
        if len(seen) > FLUSH:
            yield out()
            seen.clear()
    yield out()


@dataclass
class Head:
    """Counts of the most frequent tokens, and what the classes hold."""

    rank: dict[bytes, int]
    count: np.ndarray
    outcome: np.ndarray
    #: of each class: training tokens and distinct ones outside the ``WORDS`` most frequent
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return self.rank[END]

    def noise(self) -> np.ndarray:
        """Unigram distribution over the outcomes, a little smoothed."""
        n = np.zeros(SIZE)
        top = min(WORDS, len(self.count))
        n[:top] = self.count[:top]
        n[WORDS:] = self.class_tokens
        n += 0.1
        return n / n.sum()


def _least_count(counts: DataFrame) -> int:
    """The least count, in steps of an eighth of an octave, that at most ``HEAD`` tokens reach."""
    step = F.floor(F.log2("c") * 8 + 1e-9)
    sizes = counts.groupBy(step.alias("step")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect()  # some hundred rows
    least, n = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        n += r["n"]
        if n > HEAD:
            break
        least = r["least"]
    return least


def head_of(counts: DataFrame) -> Head:
    top = counts.where(F.col("c") >= _least_count(counts)).collect()  # at most HEAD rows
    # the end token must be an outcome of its own, however few documents there are
    top.sort(key=lambda r: (bytes(r["token"]) != END, -r["c"], bytes(r["token"])))
    if not top or bytes(top[0]["token"]) != END:
        found = counts.where(F.length("token") == 0).collect()
        top = [(END, found[0]["c"] if found else 0), *top[: HEAD - 1]]
    tokens = [bytes(r[0]) for r in top]
    count = np.array([r[1] for r in top], np.int64)
    outcome = np.array([k if k < WORDS else class_of(t) for k, t in enumerate(tokens)], np.int64)
    words = set(tokens[:WORDS])
    parts = F.pmod(F.crc32(F.expr("substring(token, -2, 2)")), F.lit(CLASSES))
    by_class = counts.groupBy(parts.alias("k")).agg(F.sum("c"), F.count("*")).collect()
    class_tokens, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, c, n in by_class:
        class_tokens[k], class_distinct[k] = c, n
    for t, c in zip(tokens[:WORDS], count[:WORDS]):
        if c:
            class_tokens[class_of(t) - WORDS] -= c
            class_distinct[class_of(t) - WORDS] -= 1
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Head({t: k for k, t in enumerate(tokens)}, count, outcome, class_tokens, class_distinct, total, distinct)


class Stream:
    """Documents as outcome ids with their contexts."""

    def __init__(self, head: Head) -> None:
        self.head, self.get, self.end = head, head.rank.get, head.end

    def read(self, text: bytes | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, their ranks (-1: not in the head), and outcomes of all tokens behind two end ids."""
        words = text.lower().split() if text else []
        rank = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        ids = np.full(len(words) + 3, self.end)
        ids[2:-1] = self.head.outcome[rank]
        for i in np.flatnonzero(rank < 0).tolist():
            ids[i + 2] = class_of(words[i])
        return words, rank, ids


# ---------------------------------------------------------------- training


def start(head: Head, seed: int = 5) -> np.ndarray:
    """Parameters, flat: two context tables and an outcome table of ``SIZE x WIDTH``, then the biases."""
    rng = np.random.default_rng(seed)
    tables = rng.standard_normal((3, SIZE, WIDTH)).astype(np.float32) * np.float32(0.3)
    tables[:2] *= np.float32(0.1)
    return np.concatenate([tables.ravel(), np.log(head.noise()).astype(np.float32)])


def views(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[: 3 * SIZE * WIDTH].reshape(3, SIZE, WIDTH), flat[3 * SIZE * WIDTH :]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with AdaGrad; noise is shared by the tokens of a batch."""

    def __init__(self, flat: np.ndarray, noise: np.ndarray, seed: int) -> None:
        self.flat = flat.copy()
        self.tables, self.bias = views(self.flat)
        self.squares = np.full_like(self.flat, 1.0)
        self.table_squares, self.bias_squares = views(self.squares)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cdf, self.rng = np.cumsum(noise), np.random.default_rng(seed)

    def _update(self, table: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_at[1:] != sorted_at[:-1])))
        total, rows = np.add.reduceat(grad[order], first, axis=0), sorted_at[first]
        squares[rows] += total * total
        table[rows] -= RATE * total / np.sqrt(squares[rows])

    def batch(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        a, b, q = self.tables
        h, target = a[far] + b[near], q[word]
        drawn = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), SIZE - 1).astype(word.dtype)
        right = _sigmoid((h * target).sum(axis=1) + self.bias[word] - self.log_noise[word]) - 1
        wrong = _sigmoid(h @ q[drawn].T + self.bias[drawn] - self.log_noise[drawn])
        back = right[:, None] * target + wrong @ q[drawn]
        at = np.concatenate((word, drawn))
        out = np.concatenate((right[:, None] * h, wrong.T @ h))
        bias = np.concatenate((right, wrong.sum(axis=0)))
        self._update(a, self.table_squares[0], far, back)
        self._update(b, self.table_squares[1], near, back)
        self._update(q, self.table_squares[2], at, out)
        self._update(self.bias, self.bias_squares, at, bias)


def _train_rows(shared):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, flat = shared.value
        stream = Stream(head)
        context = TaskContext.get()
        trainer = Trainer(flat, head.noise(), context.partitionId() if context else 0)
        n = 0
        held: list[np.ndarray] = []
        waiting = 0

        def learn() -> int:
            ids = np.concatenate(held).astype(np.int16)
            target = np.ones(len(ids), bool)
            at = 0
            for x in held:
                target[at : at + 2] = False
                at += len(x)
            spots = np.flatnonzero(target)
            for a in range(0, len(spots), BATCH):
                part = spots[a : a + BATCH]
                trainer.batch(ids[part - 2], ids[part - 1], ids[part])
            return len(spots)

        for batch in slices(batches, 128):
            for text in batch.column(0).to_pylist():
                held.append(stream.read(text)[2])
                waiting += len(held[-1])
                if waiting >= 32 * BATCH:
                    n += learn()
                    held, waiting = [], 0
        if held:
            n += learn()
        if n:
            yield _packed(trainer.flat.astype(np.float64) * n, n)

    return rows


def _packed(weighted: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([weighted.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])


def _sum_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for sums, k in zip(batch.column(0), batch.column(1)):
            x = np.frombuffer(sums.as_py(), np.float64)
            total, n = x if total is None else total + x, n + k.as_py()
    if n:
        yield _packed(total, n)


def train(docs: DataFrame, head: Head, work: Workspace) -> np.ndarray:
    """Average of the partitions' parameters, weighted by tokens; no tokens: the start."""
    flat = start(head)
    schema = "sums binary, n long"
    shared = docs.sparkSession.sparkContext.broadcast((head, flat))
    parts = work.cut(docs.select(raw().alias("text")).mapInArrow(_train_rows(shared), schema))
    n = parts.count()
    while n > 64:
        n = -(-n // 32)
        parts = work.cut(parts.repartition(n).mapInArrow(_sum_rows, schema))
    rows = parts.collect()  # at most 64
    if not rows:
        return flat
    total = sum(np.frombuffer(bytes(r["sums"]), np.float64) for r in rows)
    return (total / sum(r["n"] for r in rows)).astype(np.float32)


# ---------------------------------------------------------------- scoring


@dataclass
class Scorer:
    """Tables of ln p: far[c, w] + near[c, w] - log_z[far, near], the bias being part of ``near``."""

    head: Head
    far: np.ndarray
    near: np.ndarray
    log_z: np.ndarray

    @classmethod
    def of(cls, head: Head, flat: np.ndarray) -> Scorer:
        (a, b, q), bias = views(flat.astype(np.float64))
        far, near = a @ q.T, b @ q.T + bias
        top_far, top_near = far.max(axis=1), near.max(axis=1)
        z = np.exp(far - top_far[:, None]) @ np.exp(near - top_near[:, None]).T
        log_z = np.log(z) + top_far[:, None] + top_near[None, :]
        return cls(head, *(x.astype(np.float32) for x in (far, near, log_z)))

    def ln(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.far[far, word] + self.near[near, word] - self.log_z[far, near]


_PARTS = "key long, doc_id {id}, n_tokens long, known long, base double, model double, token binary, n long"


def _score_rows(shared, id_type: pa.DataType):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        head, stream = scorer.head, Stream(scorer.head)
        log_count = np.log10(head.count + 1.0)
        counted = (head.count > 0).astype(np.int64)
        room = np.concatenate((np.zeros(WORDS), np.log10(head.class_tokens + head.class_distinct + 1)))
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 33
        for batch in slices(batches, 256):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, rank, ids = stream.read(text)
                inside = np.append(rank[rank >= 0], head.end)
                base = float(log_count[inside].sum())
                other = float(log_count[inside[inside >= WORDS]].sum())
                word = ids[2:]
                ln = scorer.ln(ids[:-2], ids[1:-1], word).sum(dtype=np.float64)
                model = ln / np.log(10) - float(room[word].sum()) + other
                out.append((key, doc_id, len(word), int(counted[inside].sum()), base, model, None, None))
                tail = Counter(words[i] for i in np.flatnonzero(rank < 0).tolist())
                out.extend((key, None, None, None, None, None, t, n) for t, n in tail.items())
                key += 1
            kinds = (pa.int64(), id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())
            names = [x.split()[0] for x in _PARTS.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows


def score(docs: DataFrame, train_docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10), one row per row of ``docs``.

    ``docs(doc_id, text)`` and ``train_docs(text)``; null texts are empty (the end token alone), repeated rows
    count as often as they stand there, other columns are ignored. Without training documents the counts are
    zero and the model is its start. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    work = work or Workspace(spark, "lm")
    counted = train_docs.select(raw().alias("text")).mapInArrow(_count_rows, "token binary, n long").where("n > 0")
    counts = work.cut(counted.groupBy("token").agg(F.sum("n").alias("c")))
    head = head_of(counts)
    shared = spark.sparkContext.broadcast(Scorer.of(head, train(train_docs, head, work)))
    kind = docs.schema["doc_id"].dataType
    parts = docs.select("doc_id", raw().alias("text")).mapInArrow(
        _score_rows(shared, to_arrow_type(kind)), _PARTS.format(id=kind.simpleString())
    )
    parts = work.cut(parts)
    tail = parts.where("token is not null").select("key", "token", "n").join(counts, "token", "left")
    value = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    tail = tail.groupBy("key").agg(F.sum(value).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("tail_known"))
    rows = parts.where("n_tokens is not null").join(tail, "key", "left")
    share = float(np.log10(head.tokens + head.distinct + 1))
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        (F.col("model") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )
