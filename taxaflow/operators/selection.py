"""Seeded selection of candidates from a large catalog with a licence (provenance) table."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from .order import numbered, sized

#: A side is broadcast explicitly only if the optimiser puts its whole plan below so many bytes.
BROADCAST_BYTES = 16 << 20
#: Rows of a partition in which groups are capped. Up to ``FEW_PARTS`` partitions Spark writes a shuffle without holding
#: rows; larger tables fill that many first, with up to ``MOST_ROWS`` rows each.
PART_ROWS, MOST_ROWS, FEW_PARTS = 200_000, 2_000_000, 200
#: Groups are counted in so many buckets, so that counts stay small however many groups there are.
BUCKETS = 1 << 16


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is at most ``limit`` bytes; else as it is, for a shuffled join
    that adaptive execution may still turn into a broadcast by measured sizes. No job is run."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a full order (a top-1 window, which Spark limits before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int | None, rank: str) -> DataFrame:
    """Rows ranked inside each key, those beyond ``cap`` left out."""
    df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return df if cap is None else df.where(F.col(rank) <= cap)


# ---------------------------------------------------------------- predicates


def one_of(value: Column, listed: Sequence[str | None] | None) -> Column:
    """Membership; a None in the list admits nulls, an empty list admits nothing, no list everything."""
    if listed is None:
        return F.lit(True)
    names = [x for x in listed if x is not None]
    known = F.coalesce(value.isin(names), F.lit(False)) if names else F.lit(False)
    return known | value.isNull() if None in listed else known


def none_of(value: Column, listed: Sequence[str] | None) -> Column:
    """Exclusion that keeps nulls."""
    return value.isNull() | ~value.isin(list(listed)) if listed else F.lit(True)


def not_hosted_at(url: Column, hosts: Sequence[str] | None = tuple(fixed.EXCLUDED_HOSTS)) -> Column:
    """URLs elsewhere than at these hosts; a missing host passes."""
    return none_of(scalars.url_host(url), [h.lower() for h in hosts] if hosts else None)


# ---------------------------------------------------------------- names


def query_keys(queries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``species_query, match_key`` of the queries and their aliases (``species_query, alias``)."""
    names = queries.select("species_query", F.col("species_query").alias("name"))
    if aliases is not None:
        listed = aliases.join(queries.select("species_query"), "species_query", "left_semi")
        names = names.union(listed.select("species_query", F.col("alias").alias("name")))
    return names.select("species_query", scalars.match_key(F.col("name")).alias("match_key")).distinct()


def colliding_keys(keys: DataFrame) -> DataFrame:
    """Keys that several queries claim, with those queries; must be empty before a join."""
    claimed = keys.groupBy("match_key").agg(F.sort_array(F.collect_set("species_query")).alias("queries"))
    return claimed.where(F.size("queries") > 1)


def match_catalog(catalog: DataFrame, keys: DataFrame, name: str = "scientific_name") -> DataFrame:
    """Catalog rows whose name has the key of a query, which is added."""
    keyed = catalog.withColumn("match_key", scalars.match_key(F.col(name)))
    return keyed.join(small(keys), "match_key").drop("match_key")


# ---------------------------------------------------------------- selection


def ranked_candidates(
    matched: DataFrame,
    provenance: DataFrame,
    *,
    group: str,
    observation: str,
    uuid: str,
    provenance_order: Sequence[str],
    eligible: Column,
    seed: int = 0,
) -> DataFrame:
    """Eligible rows, one per (group, uuid), ranked inside each observation in the seeded order.

    The left join keeps rows without provenance. Of several provenance rows of a uuid the first by
    ``provenance_order`` (nulls last) stands.
    """
    joined = matched.join(provenance, uuid, "left").where(eligible)
    single = one_per_key(joined, [group, uuid], [F.col(c).asc_nulls_last() for c in provenance_order])
    keyed = single.withColumn("order_key", scalars.seeded_key(seed, F.col(uuid)))
    return capped(keyed, [group, observation], [F.col("order_key"), F.col(uuid)], None, "observation_rank")


def select_candidates(
    matched: DataFrame, provenance: DataFrame, *, per_observation: int | None, per_group: int | None, group: str, uuid: str, **how
) -> DataFrame:
    """At most ``per_group`` rows of each group and ``per_observation`` of each observation, in a seeded order."""
    ranked = ranked_candidates(matched, provenance, group=group, uuid=uuid, **how)
    inside = ranked if per_observation is None else ranked.where(F.col("observation_rank") <= per_observation)
    return capped(inside, [group], [F.col("order_key"), F.col(uuid)], per_group, "rank")


def candidate_columns(ranked: DataFrame, variant: str = "medium", dataset: str = "catalog", revision: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The candidate record of each ranked catalog row, and columns to ``keep``."""
    urls = scalars.candidate_urls(F.col("source_url"), variant)
    return ranked.select(
        F.col("uuid").alias("candidate_id"),
        "species_query",
        F.col("scientific_name").alias("original_label"),
        F.lit(dataset).alias("source_dataset"),
        F.lit(revision).cast("string").alias("source_dataset_revision"),
        scalars.provider(F.col("publisher"), F.col("data_source")).alias("source_provider"),
        "source_id",
        F.when(F.col("data_source") == "gbif", F.col("source_id")).alias("observation_id"),
        F.get(urls, F.lit(0)).alias("source_url"),
        F.slice(urls, 2, 10).alias("fallback_urls"),
        scalars.image_type(F.col("img_type")).alias("image_type"),
        F.col("img_type").alias("source_image_type"),
        "publisher",
        scalars.missing_to_null(F.col("license_name")).alias("license"),
        scalars.missing_to_null(F.col("license_link")).alias("license_url"),
        scalars.missing_to_null(F.col("copyright_owner")).alias("rights_holder"),
        *keep,
    )


def species_summary(
    matched: DataFrame, ranked: DataFrame, queries: DataFrame, *, group: str, kind: str, observation: str, has_url: Column, per_observation: int | None
) -> DataFrame:
    """Per query: rows, a map of kinds (null under ``null``), rows without URL, eligible rows, observations, selectable rows."""
    kinds = matched.groupBy(group, F.coalesce(kind, F.lit("null")).alias("_k")).agg(
        F.count("*").alias("_n"), F.count_if(~has_url).alias("_u")
    )
    rows = kinds.groupBy(group).agg(
        F.sum("_n").alias("n_rows"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_n")))).alias("image_types"),
        F.sum("_u").alias("n_no_url"),
    )
    allowed = F.lit(True) if per_observation is None else F.col("observation_rank") <= per_observation
    chosen = ranked.groupBy(group).agg(
        F.count("*").alias("n_eligible"),
        F.count_distinct(observation).alias("n_observations"),
        F.count_if(allowed).alias("n_selectable"),
    )
    zero = {c: 0 for c in ("n_rows", "n_no_url", "n_eligible", "n_observations", "n_selectable")}
    empty = F.expr("cast(map() as map<string, bigint>)")
    out = queries.select(group).distinct().join(rows, group, "left").join(chosen, group, "left").fillna(zero)
    return out.withColumn("image_types", F.coalesce("image_types", empty))


def in_order(candidates: DataFrame) -> DataFrame:
    """Candidates by query and rank, as they are handed over."""
    return candidates.orderBy("species_query", "rank")


def merge_candidates(candidates: DataFrame, names: DataFrame, per_group: int | None) -> DataFrame:
    """Candidates found under several names of a species: the first name's row stands; ``names(species, species_query, name_rank)``."""
    joined = candidates.join(small(names), "species_query")
    single = one_per_key(joined, ["species", "candidate_id"], [F.col("name_rank"), F.col("rank")])
    return capped(single, ["species"], [F.col("name_rank"), F.col("rank"), F.col("candidate_id")], per_group, "merged_rank")


def top_up(candidates: DataFrame, outcomes: DataFrame, n: int, margin: float = 1.3) -> DataFrame:
    """The first ``n`` candidates of each species any of whose URLs succeeded, of the first ``ceil(margin * n)``.

    ``outcomes(candidate_id, url, url_pos, ok)``; candidates whose file is ``present`` go first; the result
    keeps the candidates' order and has the URL that succeeded first.
    """
    tried = candidates.where(F.col("rank") <= F.ceil(F.lit(margin * n)))
    worked = outcomes.where("ok").groupBy("candidate_id").agg(F.min_by("url", "url_pos").alias("used_url"))
    order = [F.col("present").desc(), F.col("rank"), F.col("candidate_id")]
    return capped(tried.join(worked, "candidate_id"), ["species_query"], order, n, "taken")


def shortfall(candidates: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """Species with fewer than ``n`` taken candidates, and how many are missing."""
    got = taken.groupBy("species_query").agg(F.count("*").alias("n_taken"))
    every = candidates.select("species_query").distinct().join(got, "species_query", "left").fillna({"n_taken": 0})
    return every.where(F.col("n_taken") < n).withColumn("missing", F.lit(n) - F.col("n_taken"))


def reuse_status(candidates: DataFrame, previous: DataFrame, inventory: DataFrame, min_side: int) -> DataFrame:
    """What becomes of each candidate's file of an earlier build.

    ``previous(candidate_id, used_url, file)``, ``inventory(file, width, height)``: absent, unverified (no URL
    recorded), stale (the URL is no longer listed), rejected (too small) or reused.
    """
    held = candidates.join(previous, "candidate_id", "left").join(inventory, "file", "left")
    status = (
        F.when(F.col("width").isNull(), "absent")
        .when(F.col("used_url").isNull(), "unverified")
        .when(~F.array_contains(F.col("urls"), F.col("used_url")), "stale")
        .when(F.least("width", "height") < min_side, "rejected")
        .otherwise("reused")
    )
    return held.withColumn("status", status)


def unreferenced(inventory: DataFrame, records: DataFrame) -> DataFrame:
    """Files that no record names."""
    return inventory.join(records.select("file"), "file", "left_anti")


def image_policy(images: DataFrame, formats: Sequence[str], min_side: int, max_pixels: int) -> DataFrame:
    """Each image with ``problem``: format, too small, too large, or null."""
    problem = (
        F.when(~F.coalesce(F.col("format").isin(list(formats)), F.lit(False)), "format")
        .when(F.least("width", "height") < min_side, "too small")
        .when(F.col("width").cast("long") * F.col("height") > max_pixels, "too large")
    )
    return images.withColumn("problem", problem)


def with_filled(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or blank."""
    return functools.reduce(DataFrame.where, [F.coalesce(scalars.present(F.col(c)), F.lit(False)) for c in columns], df)


# ---------------------------------------------------------------- plain samples


def _dealt(df: DataFrame, group: str, key: str) -> tuple[DataFrame, bool]:
    """``df`` in partitions of bounded size, rows of a group together; whether groups were cut into cells (``_cell``).

    Rows go to their partition as they are read, so no task gathers what its split holds. Buckets of groups that would be
    over a quarter of a partition are cut into cells, by the key and by the task that read the row: a large group lies in
    many partitions, and of copies of one row only those that one task read are sure to stay together.
    """
    spark, bucket = df.sparkSession, F.pmod(F.xxhash64(group), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows")).collect()  # BUCKETS rows at most
    total = sum(r["_rows"] for r in counts)
    parts = min(-(-total // PART_ROWS), max(FEW_PARTS, -(-total // MOST_ROWS)))
    parts = max(parts, min(spark.sparkContext.defaultParallelism, -(-total // 10_000)), 1)
    share = max(total // (4 * parts), 1)
    large = [(r["_bucket"], -(-r["_rows"] // share)) for r in counts if r["_rows"] > share] if parts > 1 else []
    if not large:
        return df.repartition(parts, group), False
    cells = F.broadcast(spark.createDataFrame(large, "_bucket long, _cells long"))  # 4 * parts rows at most
    known = df.withColumn("_bucket", bucket).join(cells, "_bucket", "left")
    cell = F.pmod(F.xxhash64(key, F.spark_partition_id()), F.coalesce("_cells", F.lit(1)))
    return known.withColumn("_cell", cell).select(*df.columns, "_cell").repartition(parts, group, "_cell"), True


def cap_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0, different: bool = False) -> DataFrame:
    """At most ``n`` rows of each group, fixed by the seed; ``different``: rows that are equal count once and are one row.

    Rows are cut to the first ``n`` (``different``: of the first ``n`` keys) before equal ones are sought.
    """
    order = [scalars.seeded_key(seed, F.col(key)), F.col(key)]
    rows, cut = _dealt(df, group, key)
    by = [group, "_cell"] if cut else [group]
    if different:
        rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank").distinct()
    if cut:
        rows = capped(rows, by, order, n, "_rank").drop("_rank", "_cell").repartition(group)
        rows = rows.distinct() if different else rows
    return capped(rows, [group], order, n, "_rank").drop("_rank")


def round_robin(df: DataFrame, group: str, key: str, done: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows: those done first, then one of each group in turn; ``pick`` numbers them."""
    order = [scalars.seeded_key(seed, F.col(key)), F.col(key)]
    turned = df.withColumn("_done", F.coalesce(done, F.lit(False)))
    turned = turned.withColumn("_turn", F.row_number().over(Window.partitionBy(group, "_done").orderBy(*order)))
    turned = turned.where(F.col("_turn") <= n)  # no more of a group are ever taken, and Spark limits before the shuffle
    return turned.orderBy(F.col("_done").desc(), "_turn", F.col(group).asc_nulls_last(), key).limit(n).drop("_done", "_turn")


def systematic(df: DataFrame, group: str, key: str, step: int) -> DataFrame:
    """Every ``step``-th row of each group in the order of the key."""
    return numbered(df, [group], [key], "_at").where((F.col("_at") - 1) % step == 0).drop("_at")


def block_sample(df: DataFrame, group: str, order: Sequence[str], n: int, blocks: int) -> DataFrame:
    """``n`` rows of each group as ``blocks`` disjoint runs spread evenly over its order (all rows if fewer)."""
    at = sized(numbered(df, [group], list(order), "_at"), [group], "_size").withColumn("_at", F.col("_at") - 1)
    run = -(-n // blocks)
    block = F.least(F.floor(F.col("_at") * blocks / F.col("_size")), F.lit(blocks - 1))
    starts = F.ceil(block * F.col("_size") / blocks)
    inside = (F.col("_at") - starts >= 0) & (F.col("_at") - starts < F.least(F.lit(run), n - block * run))
    return at.where((F.col("_size") <= n) | inside).drop("_at", "_size")
