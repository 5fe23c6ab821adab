"""Toxicity by weak supervision.

Voters are lexicons (fixed ones by theme, and words and word beginnings induced from labelled training rows),
and patterns. A generative label model estimates each voter's firing rate for toxic and other texts by
expectation maximisation, and the correlations of voters given the class; correlated voters share their
weight. The posterior labels of the training texts then train a sparse linear classifier over the voters and
the words of the texts, which scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sample_by_class
from .langid import _softmax, fit_ftrl
from .training import held_out, labelled

#: Labelled rows from which voters are induced and the models are fitted; both labels have their rows (``common.quotas``).
MAX_TRAIN = 8_000
#: A voter is induced with so many toxic texts, and such a share of toxic ones among its texts.
SUPPORT, PRECISION = 3, 0.6
#: Different voters sought for each toxic text.
COVER = 3
WORD_BUCKETS = 1 << 14
CUT = 0.5

# Words by theme.
LEXICONS = {
    "insults": "idiot moron imbecile stupid dumb fool loser clown jerk cretin dimwit halfwit",
    "contempt": "worthless pathetic disgusting trash garbage scum filth vermin useless despicable subhuman",
    "profanity": "damn crap shit fuck fucking bitch bastard asshole bullshit",
    "hate": "hate hates hateful racist bigot inferior degenerate",
    "violence": "kill murder stab shoot strangle hang beat",
}
PATTERNS = {
    "you are": r"\byou(?:'re| are)\s+(?:an?\s+|such\s+an?\s+|so\s+)?(?:idiot|moron|stupid|pathetic|worthless|disgusting|trash|scum|loser|clown|dumb)",
    "go away": r"\b(?:shut up|go to hell|drop dead|get lost)\b",
    "threat": r"\b(?:i will|i'll|gonna|going to)\s+(?:kill|hurt|destroy|beat)\s+you\b",
    "should die": r"\b(?:should|deserve to|hope you)\s+(?:die|suffer|rot)\b",
}

#: Each pattern needs one of these words.
_OPENERS = frozenset("you you're shut go drop get should deserve".split())
_STRIP = ".,;:!?*#$%&|()[]{}<>\"'`~^+=/\\-_…«»“”’¿¡"
_STEMS = range(3, 9)


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without marks around them."""
    return {w.strip(_STRIP) for w in set(text.lower().split())} - {""}


def terms_of(said: set[str]) -> set[str]:
    """The words, their proper beginnings (``abc-``), and beginnings of at least two words (``abc-2``)."""
    stems = Counter(f"{w[:k]}-" for w in said for k in _STEMS if k < len(w))
    return said | stems.keys() | {f"{t}2" for t, n in stems.items() if n > 1}


@dataclass
class Voters:
    """Names of the voters; a term fires one voter, a pattern another."""

    terms: dict[str, int] = field(default_factory=dict)
    patterns: list[tuple[int, re.Pattern]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    stems: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for name, listed in LEXICONS.items():
            self._add(name, listed.split())
        for name, pattern in PATTERNS.items():
            self.names.append(name)
            self.patterns.append((len(self.names) - 1, re.compile(pattern)))

    def _add(self, name: str, terms: list[str]) -> None:
        self.names.append(name)
        for t in terms:
            self.terms[t] = len(self.names) - 1

    def induce(self, said: list[set[str]], y: np.ndarray, odds: float = 1.0) -> None:
        """Terms of toxic texts with enough support and precision, ``COVER`` of them for each text if possible.

        A clean text counts ``odds`` times a toxic one, as many rows as it stands for.
        """
        # counted first, so that places are kept of terms with support only: most terms stand in one text
        seen: Counter = Counter()
        for i in np.flatnonzero(y):
            seen.update(terms_of(said[i]))
        where: dict[str, list[int]] = {t: [] for t, n in seen.items() if n >= SUPPORT}
        del seen
        for i in np.flatnonzero(y).tolist():
            for t in filter(where.__contains__, terms_of(said[i])):
                where[t].append(i)
        other: Counter = Counter()
        for i in np.flatnonzero(y == 0):
            other.update(filter(where.__contains__, terms_of(said[i])))
        precise = {t: len(r) / (len(r) + odds * other[t] + 0.5) for t, r in where.items()}
        good = [t for t in where if precise[t] >= PRECISION]
        short: Counter = Counter()
        for t in sorted(good, key=lambda t: (4 * odds * other[t] - len(where[t]), len(t), t)):
            if sum(short[i] < COVER for i in where[t]) >= SUPPORT:
                short.update(where[t])
                self._add(f"induced {t}", [t])
        self.stems = {t.rstrip("2") for t in self.terms if t.endswith(("-", "-2"))}

    def matched(self, text: str, said: set[str]) -> list[int]:
        """Patterns that fire on the whole text."""
        if said.isdisjoint(_OPENERS):
            return []
        low = text.lower()
        return [k for k, p in self.patterns if p.search(low)]

    def votes(self, said: set[str], matched: list[int]) -> list[int]:
        """Voters that fire, sorted. Every word and beginning is looked up."""
        terms = self.terms
        fired = {terms[w] for w in said if w in terms}
        if self.stems:
            stems = Counter(t for w in said for k in _STEMS if k < len(w) and (t := w[:k] + "-") in self.stems)
            fired.update(terms[t] for t in stems if t in terms)
            fired.update(terms[t + "2"] for t, n in stems.items() if n > 1 and t + "2" in terms)
        fired.update(matched)
        return sorted(fired)


@dataclass
class LabelModel:
    """Firing rates by class, the prior, and the weight left to each voter by its correlations.

    A voter that does not fire abstains: lexicons of one language say nothing of texts in another. That no
    voter fires is a vote of its own (``silent``, for the other class).
    """

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    silent: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.toxic / self.clean) * self.weight)
        z += np.where(votes.any(axis=1), 0.0, self.silent)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_labels(votes: np.ndarray, accuracy: np.ndarray, stands: np.ndarray | None = None, rounds: int = 25) -> LabelModel:
    """Expectation maximisation, started from the voters' accuracies as lexicons (a noisy-or of those that fire).

    ``stands``: how many rows each row stands for, 1 where not given.
    """
    if stands is None:
        stands = np.ones(len(votes))
    n = stands.sum()
    quiet = ~votes.any(axis=1)
    p = np.where(quiet, 0.02, 1 - np.exp(votes @ np.log(1 - accuracy)))
    together = votes.T @ (votes * stands[:, None])
    for _ in range(rounds):
        # rows of both classes' shares: all sums of a round are products of them with the votes
        both = np.stack([p, 1 - p], axis=1)
        heavy = both * stands[:, None]
        fired, mass = votes.T @ heavy, heavy[:, 0].sum()
        toxic = np.clip((fired[:, 0] + 0.1) / (mass + 1.0), 1e-6, 1 - 1e-3)
        clean = np.clip((fired[:, 1] + 0.1) / (n - mass + 1.0), 1e-7, 1 - 1e-3)
        calm = quiet @ heavy
        silent = np.log((calm[0] + 0.1) / (mass + 1.0)) - np.log((calm[1] + 0.1) / (n - mass + 1.0))
        # covariance of what the classes leave of the votes, without that matrix of rows
        rates = np.stack([toxic, clean])
        cross = fired @ rates
        cov = (together - cross - cross.T + rates.T @ (both.T @ heavy) @ rates) / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        rho[rho < 0.3] = 0
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + (rho * rho).sum(axis=1))
        model = LabelModel(float(np.clip(mass / max(n, 1), 1e-3, 0.5)), toxic, clean, weight, float(silent))
        p = model.posterior(votes)
    return model


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: np.ndarray

    def score(self, text: str) -> float:
        said = words_of(text)
        at, x = _row(self.voters, said, self.voters.matched(text, said))
        return float(_softmax(x @ self.weights[at] + self.bias)[1])


def _row(voters: Voters, said: set[str], matched: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: one per fired voter, one small one per hashed word."""
    fired = voters.votes(said, matched)
    words = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in said}
    at = np.array(fired + [len(voters.names) + h for h in sorted(words)], np.int64)
    x = np.concatenate((np.ones(len(fired)), np.full(len(words), 1 / np.sqrt(max(len(words), 1)))))
    return at, x


def fit(said: list[set[str]], matched: list[list[int]], y: np.ndarray, odds: float = 1.0) -> Model:
    """Induce voters, estimate posterior labels, train the classifier on them (not on ``y``).

    Each training text is its distinct words and the patterns that fire on it. ``odds``: rows that a clean text stands
    for, over those of a toxic one; voters' precisions and the label model count by them. The classifier's targets
    depend on the text alone and need no such weight.
    """
    voters = Voters()
    if not said:
        return Model(voters, np.zeros((len(voters.names) + WORD_BUCKETS, 2), np.float32), np.array([4.0, 0.0]))
    voters.induce(said, y, odds)
    votes = np.zeros((len(said), len(voters.names)))
    for i, (w, m) in enumerate(zip(said, matched)):
        votes[i, voters.votes(w, m)] = 1
    hits, misses = votes[y == 1].sum(axis=0), votes[y == 0].sum(axis=0)
    right = (hits + 0.5) / (hits + odds * misses + 1.0)
    stands = np.where(y == 1, 1.0, odds)
    posterior = fit_labels(votes, np.minimum(right, 0.99), stands / stands.min()).posterior(votes)
    rows = [_row(voters, w, m) for w, m in zip(said, matched)]
    size = len(voters.names) + WORD_BUCKETS
    targets = np.stack([1 - posterior, posterior], axis=1)
    weights, bias = fit_ftrl(rows, targets, 2, size=size, alpha=2.0, beta=0.1, l1=0.05, l2=0.001, epochs=6)
    return Model(voters, weights.astype(np.float32), bias)


#: Words joined by spaces (none holds one).
_SEEN = T.StructType([T.StructField("words", T.StringType()), T.StructField("patterns", T.ArrayType(T.IntegerType()))])


def _seen(text: pa.Array) -> pa.Array:
    """What training needs of a text: its distinct words in order, and the patterns that fire on the whole of it."""
    voters, words, patterns = Voters(), [], []
    for x in text:
        x = x.as_py() or ""
        said = words_of(x)
        words.append(" ".join(sorted(said)))
        patterns.append(voters.matched(x, said))
    return pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(patterns, pa.list_(pa.int32()))], names=["words", "patterns"])


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs(doc_id, text)``.

    Voters are induced from ``labels.toxic`` of ids that are not held out, at most ``max_train`` rows by hash
    order within each label; the driver gets their distinct words, not their texts. Null texts are scored as empty ones; repeated rows each get their row; without labels nothing is
    trained and no text is called toxic (every score is 0.018). Other columns are ignored.
    """
    known = labelled(docs.where(~held_out()).select("doc_id"), labels, "toxic").distinct()
    known = known.select("doc_id", "y")
    ids, all_of = sample_by_class(known, "y", max_train, "toxicity")
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in ids], known.schema)
    train = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    made = {"doc_id": F.col("doc_id"), "seen": F.arrow_udf(_seen, _SEEN)("text")}
    rows, _ = sample_by_class(train, "y", max_train, "texts", made)  # of ids in many rows
    rows.sort(key=lambda r: (r["doc_id"], r["seen"]["words"]))
    taken = Counter(r["y"] for r in rows)
    odds = all_of[0] / taken[0] / (all_of[1] / taken[1]) if len(taken) == 2 else 1.0
    names: dict[str, str] = {}  # one object for each different word
    said = [{names.setdefault(w, w) for w in r["seen"]["words"].split()} for r in rows]
    model = fit(said, [r["seen"]["patterns"] for r in rows], np.array([r["y"] for r in rows], np.int64), odds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(text: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(x.as_py() or "") for x in text], pa.float64())

    out = docs.select("doc_id", held_out().alias("held_out"), F.arrow_udf(scored, T.DoubleType())("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
