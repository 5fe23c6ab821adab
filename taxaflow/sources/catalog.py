"""A large image catalog with a provenance table, as a source of candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import selection as S
from .registry import register

CATALOG_COLUMNS = ["uuid", "source_url", "scientific_name", "data_source", "publisher", "basis_of_record", "img_type", "source_id"]
PROVENANCE_COLUMNS = ["license_name", "license_link", "copyright_owner", "title"]


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the columns that are used; everything else stays unread."""
    return spark.read.parquet(path).select(*columns)


def class_subset(spark: SparkSession, catalog: str, provenance: str, target: str, class_: str) -> None:
    """One class of the catalog and its provenance rows, written beside each other for repeated queries."""
    rows = spark.read.parquet(catalog).where(F.col("class") == class_)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/catalog.parquet")
    kept = spark.read.parquet(f"{target}/catalog.parquet").select("uuid")
    spark.read.parquet(provenance).join(kept, "uuid", "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/provenance.parquet")


def _matched(spark: SparkSession, catalog: str, species: Sequence[str], aliases: Mapping[str, Sequence[str]] | None) -> tuple[DataFrame, DataFrame]:
    names = list(dict.fromkeys(species))
    if isinstance(species, str) or not names:
        raise ValueError("species must be a list of names")
    queries = spark.createDataFrame([(n,) for n in names], "species_query string")
    listed = [(q, a) for q, others in (aliases or {}).items() for a in others]
    extra = spark.createDataFrame(listed, "species_query string, alias string") if listed else None
    keys = S.query_keys(queries, extra)
    if clash := S.colliding_keys(keys).limit(1).collect():
        raise ValueError(f"{clash[0]['match_key']!r} is claimed by {clash[0]['queries']}")
    return queries, S.match_catalog(scan(spark, catalog, CATALOG_COLUMNS), keys)


def _own(image_types, exclude_basis, exclude_hosts) -> Column:
    return (
        scalars.present(F.col("source_url"))
        & S.one_of(F.col("img_type"), image_types)
        & S.none_of(F.col("basis_of_record"), exclude_basis)
        & S.not_hosted_at(F.col("source_url"), exclude_hosts)
    )


def _ranked(spark, matched, provenance, image_types, exclude_basis, exclude_hosts, license_policy, seed) -> DataFrame:
    """Filters on the catalog's own columns come before the join, the licence after it."""
    own = matched.where(_own(image_types, exclude_basis, exclude_hosts))
    own = own.withColumn("_occurrence", F.coalesce("source_id", F.concat(F.lit("uuid:"), F.col("uuid"))))
    return S.ranked_candidates(
        own, scan(spark, provenance, ["uuid", *PROVENANCE_COLUMNS]), group="species_query", observation="_occurrence", uuid="uuid",
        provenance_order=PROVENANCE_COLUMNS, eligible=scalars.licence_allowed(F.col("license_name"), license_policy), seed=seed,
    )


@register("catalog")
def candidates(
    spark: SparkSession,
    catalog: str,
    provenance: str,
    species: Sequence[str],
    aliases: Mapping[str, Sequence[str]] | None = None,
    per_species: int | None = None,
    per_observation: int | None = 1,
    image_types: Sequence[str | None] | None = None,
    exclude_basis: Sequence[str] | None = None,
    exclude_hosts: Sequence[str] | None = tuple(fixed.EXCLUDED_HOSTS),
    license_policy: str = "cc_only",
    size_variant: str = "medium",
    seed: int = 0,
    revision: str | None = None,
) -> DataFrame:
    """Candidates of each species with their rank, in the seeded order."""
    _, matched = _matched(spark, catalog, species, aliases)
    ranked = _ranked(spark, matched, provenance, image_types, exclude_basis, exclude_hosts, license_policy, seed)
    inside = ranked if per_observation is None else ranked.where(F.col("observation_rank") <= per_observation)
    chosen = S.capped(inside, ["species_query"], [F.col("order_key"), F.col("uuid")], per_species, "rank")
    return S.candidate_columns(chosen, size_variant, "catalog", revision, keep=["rank"])


def summary(
    spark: SparkSession, catalog: str, provenance: str, species: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None, per_observation: int | None = 1,
    image_types=None, exclude_basis=None, exclude_hosts=tuple(fixed.EXCLUDED_HOSTS), license_policy: str = "cc_only",
) -> DataFrame:
    """Per query: rows, image types, rows without URL, eligible rows, observations, selectable rows; zeros without a match."""
    queries, matched = _matched(spark, catalog, species, aliases)
    ranked = _ranked(spark, matched, provenance, image_types, exclude_basis, exclude_hosts, license_policy, 0)
    return S.species_summary(
        matched, ranked, queries, group="species_query", kind="img_type", observation="_occurrence",
        has_url=scalars.present(F.col("source_url")), per_observation=per_observation,
    )
