"""Checks of a relational dataset; each returns problems ``table, check, key, message``.

A check never raises for broken data. A whole report is the union of its checks, each cut to
``fixed.MESSAGES`` rows and one row that counts the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed, scalars
from .tables import dataset_counts


def problems(df: DataFrame, table: str, check: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(check).alias("check"), key.cast("string").alias("key"), message.alias("message"))


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws(", ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns))


def conforming(df: DataFrame, table: str, schema: T.StructType, key: Sequence[str], allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Missing, extra and wrongly typed columns (once each), nulls where none may be, values outside lists."""
    have = dict(df.dtypes)
    wrong = [f"no column {f.name}" for f in schema if f.name not in have]
    wrong += [f"extra column {c}" for c in have if c not in schema.names]
    wrong += [
        f"{f.name} is {have[f.name]}, not {f.dataType.simpleString()}"
        for f in schema
        if f.name in have and have[f.name] != f.dataType.simpleString()
    ]
    checks = [
        F.when(F.col(f"`{f.name}`").isNull(), F.lit(f"{f.name} is null"))
        for f in schema
        if not f.nullable and f.name in have
    ]
    for name, values in (allowed or {}).items():
        if name in have:
            c = F.col(f"`{name}`")
            checks.append(F.when(~c.isin(list(values)), F.concat(F.lit(f"{name} is not allowed: "), c)))
    spark = df.sparkSession
    out = spark.createDataFrame([(table, "schema", None, w) for w in wrong], "table string, check string, key string, message string")
    if checks and all(c in have for c in key):
        bad = df.select("*", F.explode(F.array_compact(F.array(*checks))).alias("_m"))
        out = out.unionByName(problems(bad, table, "row", _key(key), F.col("_m")))
    return out


def unique(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    again = df.groupBy(*(f"`{c}`" for c in key)).count().where("count > 1")
    message = F.concat(F.lit(f"duplicate ({', '.join(key)}): "), F.col("count").cast("string"), F.lit(" rows"))
    return problems(again, table, "unique", _key(key), message)


def references(child: DataFrame, table: str, column: str, parent: DataFrame, parent_table: str, parent_column: str, key: Sequence[str]) -> DataFrame:
    """Rows whose value has no row in the parent table (nulls count as without)."""
    known = parent.select(F.col(parent_column).alias("_p")).distinct()
    orphan = child.join(known, child[column] == known["_p"], "left_anti")
    message = F.concat(F.lit(f"{column} "), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(f" not in {parent_table}"))
    return problems(orphan, table, "reference", _key(key), message)


def agreement(child: DataFrame, table: str, column: str, value: str, parent: DataFrame, parent_table: str, parent_value: str, key: Sequence[str]) -> DataFrame:
    """Rows whose value differs from that of the parent row they name."""
    of = parent.select(F.col(column).alias("_p"), F.col(parent_value).alias("_v")).dropDuplicates(["_p"])
    joined = child.join(of, child[column] == of["_p"]).where(~F.col(value).eqNullSafe(F.col("_v")))
    message = F.concat(F.lit(f"{value} "), F.col(value).cast("string"), F.lit(f" != {parent_table} {parent_value} "), F.col("_v").cast("string"))
    return problems(joined, table, "agreement", _key(key), message)


def counts_agree(species: DataFrame, table: str, key: str, recorded: str, rows: DataFrame, row_key: str) -> DataFrame:
    """Species whose recorded count differs from the rows there are."""
    found = rows.groupBy(F.col(row_key).alias("_k")).agg(F.count("*").alias("_n"))
    joined = species.join(found, species[key] == found["_k"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    bad = joined.where(~F.col(recorded).eqNullSafe(F.col("_n")))
    message = F.concat(F.lit(f"{recorded} is "), F.coalesce(F.col(recorded).cast("string"), F.lit("null")), F.lit(", there are "), F.col("_n").cast("string"))
    return problems(bad, table, "count", _key([key]), message)


def files(records: DataFrame, table: str, key: str, path: str, size: str, inventory: DataFrame, digest: str | None = None, kind: str = "sha256") -> DataFrame:
    """Unsafe paths, missing files, other sizes, other digests; ``inventory(path, size, md5, sha256)``."""
    seen = inventory.select(F.col("path").alias("_p"), F.col("size").alias("_size"), F.col(kind).alias("_digest"))
    joined = records.join(seen, records[path] == seen["_p"], "left")
    message = (
        F.when(~scalars.safe_path(F.col(path)), "path is not relative to the dataset")
        .when(F.col("_p").isNull(), "file is missing")
        .when(F.col("_size") != F.col(size), F.concat(F.lit("file has "), F.col("_size").cast("string"), F.lit(" bytes")))
    )
    if digest:
        message = message.when(F.lower(digest) != F.col("_digest"), F.concat(F.lit(f"{kind} is "), F.col("_digest")))
    return problems(joined.withColumn("_m", message).where("_m is not null"), table, "file", _key([key]), F.col("_m"))


def leftovers(inventory: DataFrame) -> DataFrame:
    """Files of an interrupted write."""
    return problems(inventory.where(F.col("path").rlike(r"\.part$")), "files", "leftover", F.col("path"), F.lit("leftover from an interrupted write"))


def manifest(document: Mapping, counts: DataFrame) -> DataFrame:
    """Schema version, tables (listed, at their paths, with their rows) and counts of the manifest against
    ``dataset_counts``; keys it lacks are problems."""
    spark = counts.sparkSession
    said = document.get("counts") or {}
    rows = [(k, said.get(k)) for k in counts.columns]
    version = document.get("schema_version")
    table = spark.createDataFrame(rows, "name string, recorded long")
    actual = counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counts.columns)), F.array(*counts.columns))).alias("name", "actual"))
    joined = table.join(actual, "name").where(~F.col("recorded").eqNullSafe(F.col("actual")))
    message = F.concat(F.lit("recorded "), F.coalesce(F.col("recorded").cast("string"), F.lit("nothing")), F.lit(", actual "), F.col("actual").cast("string"))
    out = problems(joined, "manifest", "counts", F.col("name"), message)
    listed = document.get("tables") or {}
    wrong = [(name, "is not listed") for name in schemas.TABLES if f"n_{name}" in counts.columns and name not in listed]
    wrong += [(name, f"path is {info.get('path')}") for name, info in listed.items() if info.get("path") != f"{name}.parquet"]
    out = out.unionByName(spark.createDataFrame([("manifest", "tables", n, m) for n, m in wrong], out.schema))
    told = spark.createDataFrame([(f"n_{name}", info.get("n_rows")) for name, info in listed.items()], "name string, said long")
    off = told.join(actual, "name").where(~F.col("said").eqNullSafe(F.col("actual")))
    rows_message = F.concat(F.lit("n_rows is "), F.coalesce(F.col("said").cast("string"), F.lit("nothing")), F.lit(", the table has "), F.col("actual").cast("string"))
    out = out.unionByName(problems(off, "manifest", "rows", F.col("name"), rows_message))
    if version != schemas.VERSION:
        out = out.unionByName(spark.createDataFrame([("manifest", "version", str(version), f"schema version is not {schemas.VERSION}")], out.schema))
    return out


def capped(found: DataFrame, n: int = fixed.MESSAGES) -> DataFrame:
    """The first ``n`` messages of each (table, check), and one that counts the rest.

    Two phases, neither of which brings a check's messages together: the first ``n`` are kept by a window that Spark
    limits before the shuffle, and totals are summed before it.
    """
    group = ["table", "check"]
    order = Window.partitionBy(*group).orderBy("key", "message")
    shown = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(*group, "key", "message")
    totals = found.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > n)
    rest = F.concat(F.lit("... and "), (F.col("_n") - n).cast("string"), F.lit(" more like this"))
    return shown.unionByName(totals.select(*group, F.lit(None).cast("string").alias("key"), rest.alias("message")))


def dataset(tables: Mapping[str, DataFrame | None], inventory: DataFrame | None = None, document: Mapping | None = None) -> DataFrame:
    """All checks of the dataset tables that are there; a missing table is a problem and its checks are left out, and so
    are those that need a column that is missing or of another type (itself a problem)."""

    def whole(name: str, *columns: str) -> bool:
        kinds = dict(have[name].dtypes) if name in have else {}
        return all(kinds.get(c) == schemas.TABLES[name][c].dataType.simpleString() for c in columns)

    have = {k: v for k, v in tables.items() if v is not None}
    spark = next(iter(have.values())).sparkSession
    missing = [(k, "table", None, "missing table") for k in schemas.TABLES if k not in have]
    parts = [spark.createDataFrame(missing, "table string, check string, key string, message string")]
    for name, df in have.items():
        first = schemas.KEYS[name][0]
        parts.append(conforming(df, name, schemas.TABLES[name], first, schemas.ALLOWED[name]))
        parts += [unique(df, name, key) for key in schemas.KEYS[name] if whole(name, *key)]
    for child, column, parent, parent_column in schemas.REFERENCES:
        if whole(child, column, *schemas.KEYS[child][0]) and whole(parent, parent_column):
            parts.append(references(have[child], child, column, have[parent], parent, parent_column, schemas.KEYS[child][0]))
    for child, column, value, parent, parent_value in schemas.AGREEMENTS:
        if whole(child, column, value, *schemas.KEYS[child][0]) and whole(parent, column, parent_value):
            parts.append(agreement(have[child], child, column, value, have[parent], parent, parent_value, schemas.KEYS[child][0]))
    if whole("species", "ncbi_taxid"):
        for rows, key, recorded in (("images", "ncbi_taxid", "n_images"), ("genomes", "species_taxid", "n_genomes")):
            if whole("species", recorded) and whole(rows, key):
                parts.append(counts_agree(have["species"], "species", "ncbi_taxid", recorded, have[rows], key))
    if document is not None and all(whole(n, c) for n, c in (("genomes", "sequence_bytes"), ("images", "bytes")) if n in have):
        parts.append(manifest(document, dataset_counts(dict(tables))))
    if inventory is not None:
        parts.append(leftovers(inventory))
        if whole("images", "image_id", "file", "bytes", "sha256"):
            parts.append(files(have["images"], "images", "image_id", "file", "bytes", inventory, "sha256"))
        if whole("genomes", "assembly_accession", "sequence_file", "sequence_bytes", "sequence_md5"):
            parts.append(files(have["genomes"], "genomes", "assembly_accession", "sequence_file", "sequence_bytes", inventory, "sequence_md5", "md5"))
    return capped(reduce(DataFrame.unionByName, parts))


def on_disk(spark: SparkSession, root: str, inventory: DataFrame | None = None, document: Mapping | None = None) -> DataFrame:
    """``dataset`` of the tables under ``root``: those that are not there are missing, those that cannot be read are
    reported as unreadable, and nothing raises."""
    found: dict[str, DataFrame | None] = {}
    unreadable = []
    for name, schema in schemas.TABLES.items():
        try:
            found[name] = spark.read.parquet(f"{root}/{name}.parquet")
        except AnalysisException as e:
            found[name] = None
            if e.getCondition() != "PATH_NOT_FOUND":
                unreadable.append(name)
        except (PySparkException, Py4JJavaError):
            found[name] = None
            unreadable.append(name)
    empty = spark.createDataFrame([], "table string, check string, key string, message string")
    have = any(df is not None for df in found.values())
    checked = dataset(found, inventory, document) if have else empty.union(spark.createDataFrame([(n, "table", None, "missing table") for n in schemas.TABLES], empty.schema))
    # a table that is there but cannot be read is not a missing one
    checked = checked.where(~((F.col("check") == "table") & F.col("table").isin(unreadable))) if unreadable else checked
    return checked.unionByName(spark.createDataFrame([(n, "table", None, "unreadable table") for n in unreadable], empty.schema))


def labels(rows: DataFrame, species: str = "ncbi_taxid", years: str = "max_longevity_yrs", log: str = "log10_longevity") -> DataFrame:
    """Labels that are not finite and positive or not the logarithm of the years; species with several labels."""
    c, y = F.col(log), F.col(years)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | y.isNull() | (y <= 0)
    message = F.when(bad, "label is not finite and positive").when(F.abs(c - F.log10(F.when(y > 0, y))) > 1e-7, "label is not log10 of the years")
    one = problems(rows.withColumn("_m", message).where("_m is not null"), "labels", "value", _key([species]), F.col("_m"))
    many = rows.groupBy(species).agg(F.count_distinct(log).alias("_n")).where("_n > 1")
    return one.unionByName(problems(many, "labels", "single", _key([species]), F.lit("species has several labels")))


def split_overlap(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    many = rows.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1)
    return problems(many, "splits", "overlap", _key([key]), F.concat_ws(" and ", "_s"))


def protocol(
    rows: DataFrame, splits: DataFrame, chain: DataFrame, said: Mapping[str, float], *, species: str = "species", split: str = "split", label: str = "log10_longevity",
    train: str = "train", val: str = "val", subset: str = "val_sub", tolerance: float = 1e-6,
) -> DataFrame:
    """All problems of a comparison in one table.

    ``rows(species, split, label)`` are those that were used, ``splits(species, split)`` the frozen list,
    ``chain(fingerprint, parent)`` the frozen documents and ``said`` the recorded ``mean`` and ``sd`` of the labels.
    Checks: species in several splits; species of each split that only one side has; ``subset`` inside ``val``;
    labels (``labels``); normalisation against mean and sd of one label per training species; parents that are unknown
    or go round in a cycle. Null species take no part.
    """
    from .drift import parent_chains
    from .metrics import target_normalisation

    used, frozen = (df.where(F.col(species).isNotNull()).select(species, split).distinct() for df in (rows, splits))
    whole = lambda df: df.where(F.col(split) != subset)
    parts = [split_overlap(whole(used), species, split)]
    a = used.select(species, split, F.lit(True).alias("_used"))
    b = frozen.select(species, split, F.lit(True).alias("_listed"))
    both = a.join(b, [species, split], "full_outer").where("_used is null or _listed is null")
    message = F.concat(F.when(F.col("_used").isNull(), "listed but not used in ").otherwise("used but not listed in "), F.col(split))
    parts.append(problems(both, "splits", "species", _key([species]), message))
    inside = used.where(F.col(split) == val).select(species)
    stray = used.where(F.col(split) == subset).join(inside, species, "left_anti")
    parts.append(problems(stray, "splits", "subset", _key([species]), F.lit(f"in {subset} but not in {val}")))
    many = rows.where(F.col(species).isNotNull()).groupBy(species).agg(F.count_distinct(label).alias("_n")).where("_n > 1")
    parts.append(problems(many, "labels", "single", _key([species]), F.lit("species has several labels")))
    found = target_normalisation(rows.where((F.col(split) == train) & F.col(species).isNotNull()), species, label)
    named = found.select(F.explode(F.create_map(F.lit("mean"), "mean", F.lit("sd"), "sd")).alias("name", "value"))
    told = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in said.items()], "name string, said double")
    off = told.join(named, "name", "left").where(F.col("value").isNull() | ~(F.abs(F.col("said") - F.col("value")) <= tolerance))
    parts.append(problems(off, "normalisation", "value", F.col("name"), F.lit("recorded value is not that of the training species")))
    broken = parent_chains(chain).where("problem is not null")
    parts.append(problems(broken, "documents", "parent", F.col("fingerprint"), F.col("problem")))
    return reduce(DataFrame.unionByName, parts)


def chunks(rows: DataFrame) -> DataFrame:
    """Token chunks of another length, first or last token, or tokens outside the vocabulary; labels (where there are
    such columns) that are not finite or not the logarithm of the years; repeated chunks."""
    ids = F.col("input_ids")
    message = (
        F.when(F.size(ids) != fixed.CHUNK_TOKENS, "length")
        .when((F.get(ids, F.lit(0)) != fixed.FIRST_TOKEN) | (F.element_at(ids, -1) != fixed.LAST_TOKEN), "special tokens")
        .when((F.array_min(ids) < 0) | (F.array_max(ids) >= fixed.VOCABULARY), "token outside the vocabulary")
    )
    if {"log10_longevity", "max_longevity_yrs"} <= set(rows.columns):
        label, years = F.col("log10_longevity"), F.col("max_longevity_yrs")
        unknown = label.isNull() | F.isnan(label) | (F.abs(label) == float("inf")) | years.isNull() | ~(years > 0)
        message = F.coalesce(
            message, F.when(unknown, "label is not finite").when(F.abs(label - F.log10(F.when(years > 0, years))) > 1e-7, "label is not log10 of the years")
        )
    key = ["assembly_accession", "chunk_id"]
    bad = problems(rows.withColumn("_m", message).where("_m is not null"), "chunks", "tokens", _key(key), F.col("_m"))
    return bad.unionByName(unique(rows, "chunks", key))
