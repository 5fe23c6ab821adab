"""Bounded, repeatable training samples for the two document classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` whose doc_id has a label, with it as ``y``; several labels of an id: the most frequent, ties 0."""
    mean = F.avg((F.col(column) > 0).cast("double"))
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(mean.alias("_m"))
    return rows.join(known, "doc_id").withColumn("y", (F.col("_m") > 0.5).cast("int")).drop("_m")


def held_out() -> Column:
    """crc32 of doc_id as text divisible by 5; null ids are not held out (they carry no labels)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
