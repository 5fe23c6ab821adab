"""Connected components of a link table by alternating large and small stars, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest node around it to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges(u, v)`` longs -> ``(u, v)``: every node but the smallest of its component, with that smallest.

    Nulls and self-links are ignored; repeated links do no harm; an empty table gives an empty table.
    Rounds go on until one changes nothing; their number grows with the logarithm of the size.
    """
    state = work.cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(state)
    while before[0]:
        after_state = work.cut(_small_star(_large_star(state).distinct()).distinct())
        work.drop(state)
        state, after = after_state, mark(after_state)
        if after == before:
            return state
        before = after
    return state
