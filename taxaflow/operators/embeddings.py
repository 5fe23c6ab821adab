"""Embedding retrieval: centroids, top-k search, rank scores, chance, and ridge regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import small

#: Rows of a gallery that are broadcast as one matrix; a larger one is searched in blocks of this many.
GALLERY_ROWS = 20_000
#: Queries that meet one block of a larger gallery in one task.
QUERY_ROWS = 50_000
#: Products that a task holds at once (32 MB); they take about three times that while the best are picked.
PRODUCTS = 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector over its length (a zero vector stays)."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), x.cast("double")))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """The mean vector of each key: summed by position before the shuffle, put together after it."""
    flat = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    listed = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(*keys).agg(F.transform(listed, lambda p: p["_m"]).alias(vector))


def centroids(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Normalised mean vectors."""
    return mean_vectors(df, keys, vector).withColumn(vector, normalised(F.col(vector)))


def top_k(queries: DataFrame, gallery: DataFrame, *, query: str, key: str, vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """``query, key, sim, rank``: the ``k`` most similar gallery rows by dot product, ties by key.

    A gallery counted as small is broadcast as one matrix. A larger one is dealt to blocks by hash of its keys and the
    queries to blocks of their own; every pair of blocks is one task, so neither side passes through the driver. Products
    run in numpy, only the k best of a block leave a task, and a window merges blocks.
    """
    kinds = dict(queries.dtypes)[query], dict(gallery.dtypes)[key]
    schema = f"{query} {kinds[0]}, {key} {kinds[1]}, sim double"
    asked, held = queries.select(query, vector), gallery.select(key, vector)
    blocks = -(-gallery.count() // GALLERY_ROWS)
    best = _search(query, key, vector, k, exclude_self)
    if blocks <= 1:
        rows = held.collect()  # at most GALLERY_ROWS rows
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def against_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from best(batch, *shared.value)

        found = asked.mapInPandas(against_all, schema)
    else:
        groups = max(1, -(-queries.count() // QUERY_ROWS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = asked.select("*", deal(query, groups).alias("_q")).withColumn("_g", every(blocks))
        right = held.select("*", deal(key, blocks).alias("_g")).withColumn("_q", every(groups))

        def against_block(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            matrix = np.array(block[vector].tolist(), np.float64)
            none = pd.DataFrame({query: part[query].iloc[:0].to_numpy(), key: block[key].iloc[:0].to_numpy(), "sim": np.empty(0)})
            return pd.concat([none, *best(part, block[key].to_numpy(), matrix)])

        found = left.groupBy("_q", "_g").cogroup(right.groupBy("_q", "_g")).applyInPandas(against_block, schema)
    order = Window.partitionBy(query).orderBy(F.desc("sim"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(query: str, key: str, vector: str, k: int, exclude_self: bool) -> Callable:
    """The k best rows (and all ties of the kth, which the window breaks) of a matrix for each query of a frame."""

    def best(batch: pd.DataFrame, keys: np.ndarray, matrix: np.ndarray) -> Iterator[pd.DataFrame]:
        step = max(1, PRODUCTS // max(1, len(keys)))
        for at in range(0, len(batch) if len(keys) else 0, step):
            part = batch.iloc[at : at + step]
            far = np.array(part[vector].tolist(), np.float64).reshape(len(part), -1) @ matrix.T
            np.negative(far, out=far)
            if exclude_self:
                far[part[query].to_numpy()[:, None] == keys[None, :]] = np.inf
            n = min(k, len(keys))
            kth = np.partition(far, n - 1, axis=1)[:, n - 1 : n].copy()
            q, g = np.nonzero((far <= kth) & (far < np.inf))
            yield pd.DataFrame({query: part[query].to_numpy()[q], key: keys[g], "sim": -far[q, g]})

    return best


def rank_scores(hits: DataFrame, ranks: DataFrame, *, query: str, key: str, levels: Sequence[str]) -> DataFrame:
    """``level, top1, topk, n``: share of queries whose first or any hit agrees with the target at each rank.

    ``hits(query, target, key, rank)``; ``ranks(key, *levels)``. Empty and null ranks never agree.
    """
    own = ranks.select(F.col(key).alias("target"), *(F.col(c).alias(f"t_{c}") for c in levels))
    theirs = ranks.select(key, *(F.col(c).alias(f"h_{c}") for c in levels))
    joined = hits.join(small(own), "target").join(small(theirs), key)
    same = [F.struct(F.lit(c).alias("level"), F.coalesce((F.col(f"t_{c}") == F.col(f"h_{c}")) & (F.col(f"t_{c}").cast("string") != ""), F.lit(False)).cast("int").alias("same")) for c in levels]
    flat = joined.select(query, "rank", F.explode(F.array(*same)).alias("_s")).select(query, "rank", "_s.*")
    each = flat.groupBy("level", query).agg(F.max(F.when(F.col("rank") == 1, F.col("same"))).alias("first"), F.max("same").alias("any"))
    return each.groupBy("level").agg(F.avg("first").alias("top1"), F.avg("any").alias("topk"), F.count("*").alias("n"))


def chance(targets: DataFrame, candidates: DataFrame, *, key: str, levels: Sequence[str], k: int) -> DataFrame:
    """``level, top1, topk``: expected scores of a random ranking of the candidates (without replacement)."""
    total = candidates.count()
    kk = min(k, total)
    parts = None
    for level in levels:
        sizes = candidates.where(F.col(level).cast("string") != "").groupBy(level).agg(F.count("*").alias("_m"))
        own = targets.join(small(sizes), level, "left").select(F.coalesce("_m", F.lit(0)).alias("m"))
        miss = F.aggregate(
            F.sequence(F.lit(0), F.lit(kk - 1)),
            F.lit(1.0),
            lambda p, i: p * F.greatest(F.lit(0.0), (F.lit(total) - F.col("m") - i) / (F.lit(total) - i)),
        )
        row = own.agg(F.avg(F.col("m") / total).alias("top1"), F.avg(1 - miss).alias("topk")).select(F.lit(level).alias("level"), "top1", "topk")
        parts = row if parts is None else parts.unionByName(row)
    return parts


def mean_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return pairs.agg(F.avg(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))).alias("mean_cosine"), F.count("*").alias("n"))


# ---------------------------------------------------------------- ridge


def gram(df: DataFrame, x: str, y: str) -> dict[str, np.ndarray]:
    """Sums over all rows of x, y, x xᵀ and x yᵀ: each task adds up its rows; d² numbers per task reach the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                a, b = (np.array(batch[c].tolist(), np.float64) for c in (x, y))
                own = [np.array([len(batch)]), a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel()]
                total = own if total is None else [s + t for s, t in zip(total, own)]
        if total is not None:
            flat = np.concatenate(total)
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat, "d": len(total[1]), "e": len(total[2])})

    rows = df.select(x, y).mapInPandas(partial, "i int, v double, d int, e int")
    found = rows.groupBy("i").agg(F.sum("v").alias("v"), F.max("d").alias("d"), F.max("e").alias("e")).toPandas().sort_values("i")
    if not len(found):
        raise ValueError("no rows to fit")
    d, e, v = int(found["d"].iloc[0]), int(found["e"].iloc[0]), found["v"].to_numpy()
    cuts = np.split(v, np.cumsum([1, d, e, d * d]))
    return {"n": cuts[0][0], "x": cuts[1], "y": cuts[2], "xx": cuts[3].reshape(d, d), "xy": cuts[4].reshape(d, e)}


def ridge(df: DataFrame, x: str, y: str, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``mean, scale, weights`` of multi-output ridge on standardised x (sample sd + 1e-6): (XᵀX + alpha n I) W = XᵀY."""
    s = gram(df, x, y)
    n, mean = s["n"], s["x"] / s["n"]
    centred = s["xx"] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred), 0) / max(n - 1, 1)) + 1e-6
    a = centred / np.outer(scale, scale) + alpha * n * np.eye(len(mean))
    b = (s["xy"] - np.outer(mean, s["y"])) / scale[:, None]
    return mean, scale, np.linalg.solve(a, b)


def predict_ridge(df: DataFrame, x: str, fitted: tuple[np.ndarray, np.ndarray, np.ndarray], out: str = "pred") -> DataFrame:
    """``df`` with the fitted outputs: one native sum of products per output."""
    mean, scale, weights = fitted
    standard = F.zip_with(F.zip_with(F.col(x), F.lit(mean.tolist()), lambda a, m: a.cast("double") - m), F.lit(scale.tolist()), lambda a, s: a / s)
    df = df.withColumn("_z", standard)
    return df.withColumn(out, F.array(*(dot(F.col("_z"), F.lit(w.tolist())) for w in weights.T))).drop("_z")


def encode_distinct(df: DataFrame, key: str, encode: Callable[[list], list], batch: int = 256) -> DataFrame:
    """``df`` with ``vector``: each distinct key is encoded once, in batches, and joined back."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                keys = part[key].iloc[at : at + batch].tolist()
                yield pd.DataFrame({key: keys, "vector": encode(keys)})

    kind = dict(df.dtypes)[key]
    known = df.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(rows, f"{key} {kind}, vector array<double>")
    return df.join(known, key, "left")
