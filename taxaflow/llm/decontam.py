"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words: the text with A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton holds the
word sequences of all items. Training words stream through it; at each word it knows the longest suffix that
occurs in some item. A window is 13 consecutive item words (an item of fewer words, but not none, is one
window); wherever the tracked length reaches a window, its words are hit. A document whose hit words reach a
twentieth of its words is contaminated; spans of hit words can be cut out of the others.

The automaton is broadcast, so its size is checked: long items are cut into pieces that overlap by a window
less one word (so every window stands whole in one piece), pieces are dealt by hash into shards of at most
``MAX_WORDS`` words, counted after dealing, and each shard is a pass of its own over the documents; results of several shards are put together per document. Streams are first cut to stretches
whose neighbouring words all follow each other in some item: no match can cross the ends of a stretch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, fresh, raw, slices

WINDOW = 13
#: Hit words times this reach the words of the document: contaminated.
COVERAGE = 20
#: Words of items in one broadcast automaton.
MAX_WORDS = 400_000

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids: states with transitions, suffix links and longest lengths."""

    def __init__(self) -> None:
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.pairs = np.zeros(0, np.int64)

    def add(self, words: list[bytes]) -> list[int]:
        """Word ids of a sequence whose every stretch is known from now on."""
        ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
        last = 0
        for c in ids:
            last = self._extend(last, c)
        return ids

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that reach it from p and shorter states."""
        copy = self._add(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._add(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def follow(self, sequences: Iterable[list[int]]) -> None:
        """Note which words follow each other, once all sequences are added."""
        pairs = {a * len(self.vocab) + b for ids in sequences for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def stretches(self, ids: np.ndarray, least: int) -> Iterable[tuple[int, int]]:
        """Stretches of at least ``least`` words, known (not -1) and each known to follow the one before: no match
        crosses their ends."""
        known = ids >= 0
        if known.sum() < least:
            return
        follows = known[:-1] & known[1:]
        at = np.flatnonzero(follows)
        if len(at) and len(self.pairs):
            code = ids[at] * np.int64(len(self.vocab)) + ids[at + 1]
            found = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            follows[at] = self.pairs[found] == code
        else:
            follows[:] = False
        breaks = np.flatnonzero(~follows) + 1
        first, stop = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(ids)]))
        good = (stop - first >= least) & known[first]
        yield from zip(first[good].tolist(), stop[good].tolist())


class Automaton(SuffixAutomaton):
    """Generalised suffix automaton over word ids, with the items of every window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        super().__init__()
        self.window = window
        coded = [(k, self.add(words)) for k, words in items if words]
        self.follow(ids for _, ids in coded)
        self.least = min((min(window, len(ids)) for _, ids in coded), default=window)
        #: state -> items whose windows of full length end there
        self.full: dict[int, set[str]] = {}
        #: state -> (words, item) of shorter items, and the nearest such state from each state upwards
        self.short: dict[int, list[tuple[int, str]]] = {}
        for key, ids in coded:
            state = 0
            for at, c in enumerate(ids, 1):
                state = self.next[state][c]
                if at >= window:
                    self.full.setdefault(self._at_window(state), set()).add(key)
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), key))
        self.nearest = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.short else (self.nearest[self.link[s]] if s else -1)

    def _at_window(self, state: int) -> int:
        """The state of the last ``window`` words, from a state of at least as many."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as (first, stop) spans in order without overlaps, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not words or not self.vocab:
            return spans, items
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        for first, stop in self.stretches(ids, self.least):
            state = length = 0
            for at in range(first, stop):
                c = int(ids[at])
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state, length = self.next[state][c], length + 1
                longest = 0
                if length >= self.window:
                    items |= self.full[self._at_window(state)]
                    longest = self.window
                up = self.nearest[state]
                while up >= 0:
                    for size, key in self.short[up]:
                        if size <= length:
                            items.add(key)
                            longest = max(longest, size)
                    up = self.nearest[self.link[up]] if up else -1
                if longest:
                    begin = at + 1 - longest
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        return spans, items


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)


def _piece_rows(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as pieces of at most ``size`` words, none without a window of its item."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            items, texts, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), size - WINDOW + 1):
                    items.append(item)
                    texts.append(b" ".join(words[at : at + size]))
                    sizes.append(min(size, len(words) - at))
            yield pa.record_batch(
                [pa.array(items, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())],
                names=["item", "text", "n"],
            )

    return cut


def _automata(benchmark: DataFrame, max_words: int) -> Iterator[Automaton]:
    """One automaton per shard of the benchmark, one at a time; words are counted before anything is fetched."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"), raw().alias("text")
    )
    size = max(WINDOW, max_words // 8)
    pieces = items.mapInArrow(_piece_rows(size), "item string, text binary, n long").distinct()
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = 1 if total <= max_words else -(-2 * total // max_words)
    dealt = F.xxhash64("item", "text")
    while n > 1 and pieces.groupBy(F.pmod(dealt, F.lit(n))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(size, max_words):
        n *= 2
    for k in range(n):
        part = pieces.where(F.pmod(dealt, F.lit(n)) == k) if n > 1 else pieces
        yield Automaton((r["item"], words_of(bytes(r["text"]))) for r in part.collect())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _matcher(automaton: Automaton, spark: SparkSession) -> Callable[[pa.Array, pa.Array | None], pa.Array]:
    shared = spark.sparkContext.broadcast(automaton)

    def found(text: pa.Array, before: pa.Array | None = None) -> pa.Array:
        rows = []
        for k, x in enumerate(text):
            words = words_of(x.as_py())
            spans, items = shared.value.scan(words)
            if before is not None:
                old = before[k].as_py()
                spans = _merged(spans + list(zip(old["spans"][::2], old["spans"][1::2])))
                items |= set(old["items"])
            rows.append({"n_words": len(words), "spans": [y for span in spans for y in span], "items": sorted(items)})
        return pa.array(rows, _ARROW)

    return found


def matches(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, into: str = "_found") -> DataFrame:
    """``docs`` with a column ``into``: n_words, spans (first, stop, first, stop... in words) and items.

    A null or empty text has no words and no hits. Items without words or with null id or text have no
    windows; item ids that repeat count once. An empty benchmark hits nothing. Rows and other columns stay.
    Beyond one shard each pass is written to the shared folder, so one automaton is in memory at a time.
    """
    spark, work, kept = docs.sparkSession, None, docs.columns
    for automaton in _automata(benchmark, max_words):
        found = _matcher(automaton, spark)
        if docs.columns == kept:
            docs = docs.withColumn(into, F.arrow_udf(_unary(found), _FOUND)(raw()))
            continue
        work = work or Workspace(spark, "decontam")
        docs = work.cut(docs).withColumn(into, F.arrow_udf(_binary(found), _FOUND)(raw(), into))
    return docs


def _unary(found) -> Callable[[pa.Array], pa.Array]:
    def first(text: pa.Array) -> pa.Array:
        return found(text)

    return first


def _binary(found) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def later(text: pa.Array, before: pa.Array) -> pa.Array:
        return found(text, before)

    return later


def _n_hit(spans: Column) -> Column:
    """Sum of stop - first over the flat list."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per row of ``docs``."""
    found = matches(docs.select("doc_id", "text"), benchmark, max_words).select("doc_id", "_found")
    found = found.select("doc_id", "_found.n_words", _n_hit(F.col("_found.spans")).alias("n_hit"), "_found.items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE >= F.col("n_words"))).alias("contaminated"),
    )


def _cut_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(text.to_pylist(), spans.to_pylist()):
        if y:
            places = [m.span() for m in _WORD.finditer(x)]
            kept, at = [], 0
            for first, stop in zip(y[::2], y[1::2]):
                kept.append(x[at : places[first][0]])
                at = places[stop - 1][1]
            x = "".join(kept) + x[at:]
        out.append(x)
    return pa.array(out, pa.string())


def clean(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without contaminated rows, and without the hit spans of the others; clean rows are untouched.

    Null and empty texts stay; very long ones are read whole; repeated rows share one fate; columns of any name stay.
    ``n_chars``, where there is such a column, is counted anew for texts that lost a span.
    """
    mark, hits = fresh("_found", docs), fresh("_n_hit", docs)
    found = matches(docs, benchmark, max_words, mark).withColumn(hits, _n_hit(F.col(f"{mark}.spans")))
    found = found.where((F.col(hits) == 0) | (F.col(hits) * COVERAGE < F.col(f"{mark}.n_words")))
    cut = F.arrow_udf(_cut_spans, T.StringType())
    found = found.withColumn("text", F.when(F.col(hits) > 0, cut("text", f"{mark}.spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col(hits) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


_SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: DuckDB twin of ``report``: every window of every item, joined to every stretch of document words of its length.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item, ws, len(ws) AS n, least({WINDOW}, len(ws)) AS k FROM i WHERE len(ws) > 0),
p AS (SELECT item, ws, k, unnest(range(1, n - k + 2)) AS p FROM k),
win AS (SELECT DISTINCT item, k, array_to_string(ws[p:p + k - 1], ' ') AS s FROM p),
sizes AS (SELECT DISTINCT k FROM win),
q AS (SELECT row, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes),
hits AS (SELECT q.row, q.p, q.k, win.item FROM q JOIN win ON win.k = q.k AND win.s = array_to_string(q.ws[q.p:q.p + q.k - 1], ' ')),
places AS (SELECT DISTINCT row, unnest(range(p, p + k)) AS place FROM (SELECT DISTINCT row, p, k FROM hits)),
n AS (SELECT row, count(*) AS n_hit FROM places GROUP BY 1),
m AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {COVERAGE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN m USING (row)"""
