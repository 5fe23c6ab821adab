"""Splits, controls and samples that are fixed by a seed and never straddle a group.

All orders are by the md5 of seed and key, so they depend neither on rows nor on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seeded_key, seeded_unit
from .order import numbered, sized
from .selection import small


def group_split(species: DataFrame, *, group: str, test: float, val: float, unknown: str = "NA", seed: int = 0) -> DataFrame:
    """``species`` with ``split``: whole groups held out over all species; those without a group are one of their own."""
    filled = species.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit(unknown)))
    return family_split(filled, family="_group", strata=[], test=test, val=val, min_species=0, seed=seed).drop("_group")


def family_split(species: DataFrame, *, family: str, strata: list[str], test: float, val: float, min_species: int = 10, seed: int = 0) -> DataFrame:
    """``species`` with ``split``: whole families held out, in each stratum by itself.

    Families in seeded order fill the test share, then the validation share; the rest trains, and so do
    strata with fewer than ``min_species`` species and species without a family. Sizes are aggregated first;
    only the family table is ordered.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]
    sized = species.groupBy(*strata).agg(F.count("*").alias("_stratum"))
    families = species.where(F.col(family).isNotNull()).groupBy(*strata, family).agg(F.count("*").alias("_size"))
    same = [families[c].eqNullSafe(sized[c]) for c in strata] or [F.lit(True)]
    families = families.join(sized, same).select(*(families[c] for c in strata), family, "_size", "_stratum")
    order = Window.partitionBy(*strata).orderBy(seeded_key(seed, F.concat_ws(":", *key, F.col(family).cast("string"))), family)
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    families = families.withColumn("_before", before).withColumn("_test", F.col("_before") < test * F.col("_stratum"))
    held = F.sum(F.when(F.col("_test"), F.col("_size")).otherwise(0)).over(Window.partitionBy(*strata))
    families = families.withColumn("_held", held)
    split = (
        F.when(F.col("_stratum") < min_species, "train")
        .when(F.col("_test"), "test")
        .when(F.col("_before") - F.col("_held") < val * F.col("_stratum"), "val")
        .otherwise("train")
    )
    named = families.select(*(F.col(c).alias(f"_{c}") for c in [*strata, family]), split.alias("split"))
    on = [species[c].eqNullSafe(named[f"_{c}"]) for c in strata] + [species[family] == named[f"_{family}"]]
    out = species.join(small(named), on, "left")
    return out.select(*(species[c] for c in species.columns), F.coalesce("split", F.lit("train")).alias("split"))


def record_split(records: DataFrame, *, group: str, key: str, share: float, unseen: Column | None = None, seed: int = 0) -> DataFrame:
    """``split``: rows of unseen groups ``val_unseen``; of others the first ``round(n * share)`` ``val``, the rest ``train``."""
    placed = sized(numbered(records, [group], [seeded_key(seed, F.col(key)), key], "_at"), [group], "_size")
    val = F.col("_at") <= F.bround(F.col("_size") * share, 0)
    split = F.when(F.coalesce(unseen, F.lit(False)) if unseen is not None else F.lit(False), "val_unseen").when(val, "val").otherwise("train")
    return placed.withColumn("split", split).drop("_at", "_size")


def permuted_genomes(species: DataFrame, key: str, genome: str, seed: int = 0) -> DataFrame:
    """A control: species in one seeded cycle, each with the next one's genome (``permuted``).

    Numbers of a distributed order are joined to the next number, and the last row to the first.
    """
    placed = numbered(species, [], [seeded_key(seed, F.col(key)), key], "_at")
    total = placed.agg(F.max("_at")).first()[0] or 0
    following = placed.select(F.when(F.col("_at") == 1, total).otherwise(F.col("_at") - 1).alias("_at"), F.col(genome).alias("permuted"))
    return placed.join(following, "_at", "left").drop("_at")


def held_out_groups(species: DataFrame, unseen: DataFrame, key: str, n_seen: int = 60, seed: int = 0) -> DataFrame:
    """``key, group``: species named unseen, and a seeded sample of at most ``n_seen`` others."""
    named = species.join(small(unseen.select(key).distinct()), key, "left_semi").select(key, F.lit("unseen").alias("group"))
    rest = species.join(small(unseen.select(key).distinct()), key, "left_anti").select(key)
    seen = rest.orderBy(seeded_key(seed, F.col(key)), key).limit(n_seen)
    return named.unionByName(seen.select(key, F.lit("seen").alias("group")))


def apply_split(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """A split of the rows' own stands; others take that of ``splits(key, split)``; null if neither."""
    listed = splits.select(key, F.col("split").alias("_listed"))
    own = F.col("split") if "split" in rows.columns else F.lit(None).cast("string")
    return rows.join(small(listed), key, "left").withColumn("split", F.coalesce(own, F.col("_listed"))).drop("_listed")


def epoch_draws(records: DataFrame, genomes: DataFrame, *, record: str, genome: str, total: str, epoch: int, seed: int = 0) -> DataFrame:
    """A fresh uniform position in ``[0, total)`` of its genome for every record, fixed by seed, epoch and record.

    ``records(record, genome)``, ``genomes(genome, total)``; genomes without a valid start have none.
    """
    known = records.select(record, genome).join(small(genomes.where(F.col(total) > 0).select(genome, total)), genome)
    unit = seeded_unit(seed, F.lit(epoch), F.col(record))
    return known.withColumn("position", F.floor(unit * F.col(total)))


def uniform_draws(genomes: DataFrame, key: str, total: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` seeded uniform positions in ``[0, total)`` of each genome, with replacement: ``key, draw, position``."""
    draws = genomes.where(F.col(total) > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    unit = seeded_unit(seed, F.col(key), F.col("draw"))
    return draws.withColumn("position", F.floor(unit * F.col(total)))
