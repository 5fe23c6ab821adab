"""Licence scans by a generalised suffix automaton of licence texts.

Words are those of ``decontam``: the text with A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. One
automaton holds the words of all templates (whole licence texts and short notices) and of the base phrases. A text
streams through it; at each word it gives the matching statistic, the length of the longest stretch that ends there and
stands in some template, and the places in templates where that stretch ends. Stretches that the next word does not go
on with and that are long (``LEAST`` words, or the whole of a shorter template) are chained for each template, in the
order of text and template alike, over gaps of up to ``GAP`` words of the text: filled-in names and years, changed or
missing words do not break a chain. A chain that covers at least ``COVERAGE`` of its template's words is a span with
its label; where spans of several templates overlap, the one that covers more words stands.

Base phrases are found in the same stream, at every place where their words stand consecutively.

The automaton is made of a parameter that is on the driver as code, a few thousand words, and broadcast once; rows are
scanned where they lie, without a shuffle.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, raw
from .decontam import SuffixAutomaton, words_of
from .licence_texts import PHRASES, TEMPLATES

#: Words of a match that is chained (a shorter template must stand whole).
LEAST = 5
#: Words of the text between two matches of a chain.
GAP = 24
#: Share of a template's words that a span covers.
COVERAGE = 0.75


class Templates(SuffixAutomaton):
    """The automaton of templates and phrases, with the places in templates where the stretches of each state end."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = LEAST) -> None:
        super().__init__()
        self.labels, self.sizes, self.floor = [], [], []
        coded = []
        for label, text in templates:
            if words := words_of(text.encode()):
                coded.append(self.add(words))
                self.labels.append(label)
                self.sizes.append(len(words))
                self.floor.append(min(least, len(words)))
        self.least = min(self.floor, default=least)
        short = [(label, self.add(words_of(text.encode()))) for label, text in phrases]
        self.follow([*coded, *(ids for _, ids in short)])
        #: state -> (template, words of it up to there) for every place where the state's stretches end
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(coded):
            state = 0
            for at, c in enumerate(ids, 1):
                state = self.next[state][c]
                self.ends.setdefault(state, []).append((t, at))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:  # longer stretches end where their endings do
            up = self.link[s]
            if up > 0 and self.length[up] >= self.least and s in self.ends:
                self.ends.setdefault(up, []).extend(self.ends[s])
        self.phrase: dict[int, list[tuple[int, str]]] = {}
        for label, ids in short:
            state = 0
            for c in ids:
                state = self.next[state][c]
            if ids:
                self.phrase.setdefault(state, []).append((len(ids), label))
        self.shortest = min([self.least, *(len(ids) for _, ids in short if ids)])
        #: the nearest state upwards, itself included, where a phrase ends
        self.nearest = [-1] * len(self.link)
        for s in reversed(order):
            self.nearest[s] = s if s in self.phrase else self.nearest[self.link[s]] if s else -1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]], float]:
        """Base phrases as (label, first word), spans as (label, first, stop, share covered) and the best share."""
        base: list[tuple[str, int]] = []
        matches: dict[int, list[tuple[int, int, int, int]]] = {}
        if not words or not self.vocab:
            return base, [], 0.0
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        for first, stop in self.stretches(ids, self.shortest):
            state = length = 0
            for at in range(first, stop):
                c = int(ids[at])
                if c not in self.next[state]:
                    self._note(matches, state, length, at)
                    while state and c not in self.next[state]:
                        state = self.link[state]
                        length = self.length[state]
                if c in self.next[state]:
                    state, length = self.next[state][c], length + 1
                up = self.nearest[state]
                while up >= 0:
                    base += [(label, at + 1 - size) for size, label in self.phrase[up] if size <= length]
                    up = self.nearest[self.link[up]] if up else -1
            self._note(matches, state, length, stop)
        spans, best = self._spans(matches)
        return sorted(base, key=lambda b: (b[1], b[0])), spans, 1.0 if base else best

    def _note(self, matches: dict, state: int, length: int, at: int) -> None:
        """A match of ``length`` words before word ``at`` that does not go on: kept for every place it has in a template."""
        if length >= self.least:
            for t, end in self.ends.get(state, ()):
                if length >= self.floor[t]:
                    matches.setdefault(t, []).append((at - length, at, end - length, end))

    def _spans(self, matches: dict) -> tuple[list[tuple[str, int, int, float]], float]:
        found: list[tuple[int, float, str, int, int]] = []
        best = 0.0
        for t, rows in matches.items():
            for covered, first, stop in chains(rows):
                share = covered / self.sizes[t]
                best = max(best, share)
                if share >= COVERAGE:
                    found.append((covered, share, self.labels[t], first, stop))
        kept: list[tuple[int, int, str, float]] = []
        for _, share, label, first, stop in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            at = bisect.bisect_left(kept, (first,))
            if (at == len(kept) or kept[at][0] >= stop) and (at == 0 or kept[at - 1][1] <= first):
                kept.insert(at, (first, stop, label, share))
        return [(label, first, stop, share) for first, stop, label, share in kept], best


def chains(matches: Iterable[tuple[int, int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """Matches (text from, to, template from, to) of one template -> the best chain from each first match:
    (words covered, first word, stop). A link goes on in text and template, over at most ``gap`` words of the text;
    where two matches overlap the words are counted once."""
    rows = sorted(matches, key=lambda m: (m[1], m[3], m[0]))
    covered, root = [0] * len(rows), [0] * len(rows)
    low = 0
    longest = max((m[1] - m[0] for m in rows), default=0)
    best: dict[int, int] = {}
    for k, (first, stop, begin, end) in enumerate(rows):
        while rows[low][1] < stop - longest - gap:
            low += 1
        covered[k], root[k] = stop - first, k
        for j in range(low, k):
            _, stop_j, _, end_j = rows[j]
            if stop_j >= first - gap and end_j < end and stop_j < stop:
                gain = min(stop - max(first, stop_j), end - max(begin, end_j))
                if covered[j] + gain > covered[k]:
                    covered[k], root[k] = covered[j] + gain, root[j]
        r = root[k]
        if r not in best or covered[k] > covered[best[r]]:
            best[r] = k
    return [(covered[k], rows[r][0], rows[k][1]) for r, k in sorted(best.items())]


_BASE = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
_SPAN = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("coverage", T.DoubleType())]
)
_SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base", T.ArrayType(_BASE)),
        T.StructField("spans", T.ArrayType(_SPAN)),
        T.StructField("score", T.DoubleType()),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())]))),
        ("score", pa.float64()),
    ]
)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, into: str = "scan") -> DataFrame:
    """``docs`` with a column ``into``: n_words, base phrases (label, word), spans (label, first, stop, coverage), score.

    Words are numbered from 0. ``score`` is 1 where a base phrase stands, else the largest share of a template that one
    chain covers. Null and empty texts have no words, no spans and score 0; very long ones are read whole; repeated rows
    give equal results; no templates or phrases find nothing. Rows and other columns stay, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, phrases))
    if clash := [c for c in docs.columns if c.lower() == into.lower()]:
        raise ValueError(f"column there already: {clash}")

    def found(text: pa.Array) -> pa.Array:
        rows = []
        for x in text:
            words = words_of(x.as_py())
            base, spans, score = shared.value.scan(words)
            rows.append(
                {
                    "n_words": len(words),
                    "base": [{"label": label, "word": at} for label, at in base],
                    "spans": [{"label": label, "first": a, "stop": b, "coverage": c} for label, a, b, c in spans],
                    "score": score,
                }
            )
        return pa.array(rows, _ARROW)

    return docs.withColumn(into, F.arrow_udf(found, _SCAN)(raw()))


def digest(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: one row per row of ``docs``.

    First and last are the smallest and largest place of a base phrase, null where there is none; labels are distinct,
    sorted and joined by commas, those of base phrases among them. Odd rows: see ``scan``.
    """
    name = fresh("scan", docs.select("doc_id", "text"))
    s = scan(docs.select("doc_id", "text"), templates, phrases, name).select("doc_id", F.col(name).alias("s"))
    own = F.array_sort(F.array_distinct(F.col("s.base.label")))
    every = F.array_sort(F.array_union(F.col("s.base.label"), F.col("s.spans.label")))
    return s.select(
        "doc_id",
        "s.n_words",
        F.size("s.base").cast("long").alias("n_base"),
        F.array_min("s.base.word").alias("first_word"),
        F.array_max("s.base.word").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        "s.score",
    )
