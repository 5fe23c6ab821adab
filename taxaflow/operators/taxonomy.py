"""Taxon names, lineages and the best assembly of a species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from .selection import one_per_key, small


def resolve_names(queries: DataFrame, names: DataFrame, taxa: DataFrame) -> DataFrame:
    """Each query name with its taxon, lifted to species rank.

    ``queries(query)``, ``names(name, taxid)`` of accepted names and synonyms, ``taxa(taxid, rank, lineage)``
    with lineage entries ``taxid, name, rank``. Names match in any case after trimming. Homonyms give a row
    each; ``n_matches`` counts them, 0 for an unknown name.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    known = names.select(key("name").alias("_key"), "taxid").distinct()
    found = queries.withColumn("_key", key("query")).join(known, "_key", "left").join(taxa, "taxid", "left")
    species = F.when(F.col("rank") == "species", F.col("taxid")).otherwise(scalars.ancestor(F.col("lineage"), "species")["taxid"])
    matches = F.count("taxid").over(Window.partitionBy("query"))
    return found.select("query", "taxid", species.alias("species_taxid"), matches.alias("n_matches"))


def shared_taxids(resolved: DataFrame) -> DataFrame:
    """Species that several query names lead to, with those names; must be empty."""
    by = resolved.where(F.col("species_taxid").isNotNull()).groupBy("species_taxid")
    return by.agg(F.sort_array(F.collect_set("query")).alias("queries")).where(F.size("queries") > 1)


def position(value: Column, listed: list[str]) -> Column:
    """Place in a list from 0; its length for anything else."""
    at = F.array_position(F.array(*map(F.lit, listed)), F.coalesce(value, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(len(listed))


def best_assembly(assemblies: DataFrame, group: str = "species_taxid") -> DataFrame:
    """Reference before representative before other; then level; then newest, undated last; then accession."""
    order = [
        position(F.col("refseq_category"), fixed.CATEGORIES),
        position(F.col("assembly_level"), fixed.LEVELS),
        F.col("seq_rel_date").desc_nulls_last(),
        F.col("assembly_accession"),
    ]
    return one_per_key(assemblies, [group], order)


def plausible_assembly(assemblies: DataFrame, sizes: DataFrame, group: str = "species_taxid") -> DataFrame:
    """One assembly per species by the stricter policy: a plausible size for its class, RefSeq before GenBank, no alternate
    haplotype, no reason for exclusion, the very taxon that was named; then as ``best_assembly``.

    ``assemblies`` has ``source, asm_name, excluded_from_refseq, taxid, named_taxid, class, genome_size`` besides;
    ``sizes(class, least, most)``. An unknown class or size is not plausible.
    """
    known = assemblies.join(small(sizes.select("class", "least", "most")), "class", "left")
    plausible = F.coalesce(F.col("genome_size").between(F.col("least"), F.col("most")), F.lit(False))
    order = [
        plausible.desc(),
        (F.col("source") == "ncbi_refseq").desc_nulls_last(),
        F.coalesce(F.lower("asm_name").contains("alternate"), F.lit(False)),
        F.coalesce(scalars.present(F.col("excluded_from_refseq")), F.lit(False)),
        F.col("taxid").eqNullSafe(F.col("named_taxid")).desc(),
        position(F.col("refseq_category"), fixed.CATEGORIES),
        position(F.col("assembly_level"), fixed.LEVELS),
        F.col("seq_rel_date").desc_nulls_last(),
        F.col("assembly_accession"),
    ]
    return one_per_key(known, [group], order).drop("least", "most")


def snapshot_differences(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The best assembly now against that of a snapshot, per species of ``live``, with a message."""
    now, then = (best_assembly(d).select("species_taxid", F.col("assembly_accession").alias(n)) for d, n in ((live, "live"), (snapshot, "snapshot")))
    message = (
        F.when(F.col("snapshot").isNull(), "not in the snapshot")
        .when(F.col("live") != F.col("snapshot"), "another assembly is best in the snapshot")
        .otherwise("same")
    )
    return now.join(then, "species_taxid", "left").withColumn("message", message)


def primary_rows(traits: DataFrame, group: str, exact: Column, key: str) -> DataFrame:
    """One trait row per species: an exact name match first, then the lowest key."""
    return one_per_key(traits, [group], [F.coalesce(exact, F.lit(False)).desc(), F.col(key)])


def longest_isoforms(proteins: DataFrame, gene: str, length: str, order: str) -> DataFrame:
    """The longest protein of each gene; the first on ties."""
    return one_per_key(proteins, [gene], [F.col(length).desc(), F.col(order)])


def recover_licences(images: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Licences by the photo id in the URL; ``recovered`` is false where the snapshot has none."""
    photo = F.nullif(F.regexp_extract("source_url", "/photos/([0-9]+)/", 1), F.lit(""))
    found = images.withColumn("photo_id", photo).join(small(snapshot), "photo_id", "left")
    return found.withColumn("recovered", F.col("license").isNotNull())
