"""Canonical k-mer profiles and nearest species by them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .embeddings import normalised, top_k


def _codes(digit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes of the k-mers of a row of digits (A < C < G < T) and their places; those with another letter are left out."""
    n = len(digit) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    forward, backward, bad = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        part = digit[i : i + n]
        forward = forward * 4 + part
        backward += (3 - part) << (2 * i)
        bad |= part > 3
    at = np.flatnonzero(~bad)
    return np.minimum(forward, backward)[at], at


_DIGITS = np.full(256, 4, np.int64)
_DIGITS[np.frombuffer(b"ACGT", np.uint8)] = range(4)


#: Letters whose k-mers are counted at once; longer texts are still counted whole.
_LETTERS = 1 << 19


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_LETTERS`` letters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _LETTERS or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def kmer_counts(df: DataFrame, keys: Sequence[str], text: str, k: int = 6) -> DataFrame:
    """``keys, kmer, n``: each k-mer with its reverse complement counted as the smaller; those with N are left out.

    Rolling codes in numpy over the joined texts of Arrow batches (an N stands between two), counted for each key before
    the shuffle as integers and spelled after the sum. Long sequences come in blocks that overlap by ``k - 1``.
    """
    kinds = dict(df.dtypes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch[text]]
            groups = batch.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
            for a, b in _runs(texts):
                letters = np.frombuffer("N".join(texts[a:b]).encode("ascii", "replace"), np.uint8)
                codes, at = _codes(_DIGITS[letters], k)
                ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
                owner = groups[a:b][np.searchsorted(ends, at, side="right")]
                both, n = np.unique((owner.astype(np.int64) << (2 * k)) | codes, return_counts=True)
                first = pd.Series(np.arange(len(groups))).groupby(groups).first()
                own = batch.iloc[first.loc[both >> (2 * k)].to_numpy()][list(keys)].reset_index(drop=True)
                yield own.assign(code=both & ((1 << (2 * k)) - 1), n=n)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", code long, n long"
    counted = df.select(*keys, text).mapInPandas(rows, schema).groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    letter = lambda i: F.substring(F.lit("ACGT"), (F.shiftright("code", 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return counted.select(*keys, F.concat(*(letter(i) for i in range(k - 1, -1, -1))).alias("kmer"), "n")


def kmer_profile(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of each key's k-mers. Counts are written once, so that sequences are not read again by each later step."""
    counts = Workspace(counts.sparkSession, "kmers").cut(counts)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(total, list(keys)).select(*keys, "kmer", (F.col("n") / F.col("_t")).alias("share"))


def scaled_vectors(profile: DataFrame, key: str) -> DataFrame:
    """``key, vector``: normalised z-scores of each key's k-mers over all keys, in k-mer order.

    Population sd + 1e-12; absent k-mers count as zero. The moments come from the sparse rows alone (a sum, a
    sum of squares and the number of keys) and are one row of at most 4^k entries, laid beside every key.
    """
    n = profile.select(key).distinct().count()
    moments = profile.groupBy("kmer").agg((F.sum("share") / n).alias("mean"), (F.sum(F.col("share") * F.col("share")) / n).alias("_square"))
    sd = F.sqrt(F.greatest(F.col("_square") - F.col("mean") * F.col("mean"), F.lit(0.0))) + 1e-12
    bins = moments.agg(F.array_sort(F.collect_list(F.struct("kmer", "mean", sd.alias("sd")))).alias("_bins"))
    shares = profile.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "share"))).alias("_shares"))
    z = F.transform("_bins", lambda b: (F.coalesce(F.try_element_at("_shares", b["kmer"]), F.lit(0.0)) - b["mean"]) / b["sd"])
    out = shares.crossJoin(F.broadcast(bins)).select(key, z.alias("vector"))  # bins: one row
    return out.withColumn("vector", normalised(F.col("vector")))


def nearest(vectors: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """``query, key, sim``: the most similar training species, never itself."""
    queries = vectors.select(F.col(key).alias("query"), "vector")
    return top_k(queries, train, query="query", key=key, vector="vector", k=1, exclude_self=True).drop("rank")
