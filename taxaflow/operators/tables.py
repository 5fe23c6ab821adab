"""Dataset tables: pairs, records, counts, the gene-trait table, and writing them."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed, scalars
from ..workspace import Workspace
from .drift import reduced, unit_drift, unit_fingerprints
from .order import matched, medians
from .selection import small

#: Bytes of images that a task holds at once to put them by species, and rows in a batch of them.
STRETCH_BYTES, STRETCH_ROWS = 32 << 20, 10_000


def _clustered(key: str):
    """Rows of a partition by ``key``, in stretches of ``STRETCH_BYTES`` (and less than a batch), so that nothing spills."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= STRETCH_BYTES:
                yield from pa.Table.from_batches(held).sort_by(key).to_batches(STRETCH_ROWS)
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).sort_by(key).to_batches(STRETCH_ROWS)

    return walk


def image_pairs(images: DataFrame, genomes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every image with the assembly of its species, and columns of the image to ``keep``.

    There are as many rows as images times genomes of a species. So images are dealt over all cores, whatever their
    species, and small genomes are broadcast. Each task takes images by species: its pairs then repeat one list of
    assemblies for a long time, which files hold in few bytes, where lists of mixed species outgrow a dictionary. (Spark
    drops a sort below a join.) That step also makes the columns of an image once, where the generated code of a join
    would make them again for each of its pairs.
    """
    by = genomes.select("assembly_accession", F.col("species_taxid").alias("ncbi_taxid"))
    dealt = images.select("image_id", "ncbi_taxid", *keep).repartition(4 * images.sparkSession.sparkContext.defaultParallelism, "image_id")
    lying = dealt.mapInArrow(_clustered("ncbi_taxid"), dealt.schema)
    return lying.join(small(by), "ncbi_taxid").select("image_id", "assembly_accession", "ncbi_taxid", F.lit("species_reference").alias("pairing"), *keep)


def join_many_to_one(left: DataFrame, right: DataFrame, key: str, *, complete: bool = False) -> DataFrame:
    """An inner join on ``key`` that refuses a repeated right key and, if ``complete``, an unmatched left one."""
    if repeated := right.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{key} {repeated[0][0]!r} occurs more than once on the right")
    if complete and (orphan := left.join(right, key, "left_anti").limit(1).collect()):
        raise ValueError(f"{key} {orphan[0][key]!r} has no match")
    return left.join(right, key)


def gene_traits(hits: DataFrame, proteins: DataFrame, genomes: DataFrame, traits: DataFrame, species: DataFrame, *, identity: float = 0.3, coverage: float = 0.5, min_genes: int = 1) -> DataFrame:
    """Hits with protein, genome, primary trait and species, of enough identity and coverage and species with enough genes."""
    good = hits.where(F.col("identity") >= identity).join(small(proteins), "protein")
    good = good.withColumn("coverage", scalars.coverage(F.col("q_start"), F.col("q_end"), F.col("protein_len")))
    good = good.where(F.col("coverage") >= coverage).join(small(genomes), "assembly_accession")
    good = good.join(small(traits.where("is_primary")), "ncbi_taxid").join(small(species), "ncbi_taxid")
    return min_rows(good.withColumn("log10_longevity", scalars.log_years(F.col("max_longevity_yrs"))), "ncbi_taxid", min_genes)


def genome_scope(genomes: DataFrame, species: DataFrame, *, listed: DataFrame | None = None, without_classes: Sequence[str] = (), max_bases: int | None = None) -> DataFrame:
    """Genomes that are listed (``assembly_accession``; None: all), of no class to leave out, and not too large.

    Genomes of unknown species, class or size stay.
    """
    out = genomes
    if listed is not None:
        out = out.join(small(listed.select("assembly_accession").distinct()), "assembly_accession", "left_semi")
    if without_classes:
        gone = species.where(F.col("class").isin(list(without_classes))).select(F.col("ncbi_taxid").alias("species_taxid"))
        out = out.join(small(gone.distinct()), "species_taxid", "left_anti")
    return out if max_bases is None else out.where(F.col("genome_size").isNull() | (F.col("genome_size") <= max_bases))


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the excluded ones; null keys stay."""
    return df.join(small(excluded.select(key).distinct()), key, "left_anti")


def united(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All rows of several frames under the name of their own in ``tag``; columns that a frame lacks are null."""
    named = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def decoder_rows(records: DataFrame, known: DataFrame, include_unseen: bool = False) -> DataFrame:
    """Records with an embedding (``known(processid)``); those of unseen species only if asked for."""
    seen = records if include_unseen else records.where(~F.col("split").eqNullSafe("val_unseen"))
    return seen.join(known.select("processid").distinct(), "processid", "left_semi")


def pairs_report(pairs: DataFrame, species: str, tokens: str, bases: str, limit: int = fixed.BODY_TOKENS) -> DataFrame:
    """One row: pairs, species, the share of pairs over ``limit`` tokens, and bases for each token."""
    return pairs.agg(
        F.count("*").alias("n_pairs"),
        F.count_distinct(species).alias("n_species"),
        F.avg((F.col(tokens) > limit).cast("double")).alias("share_over_limit"),
        F.try_divide(F.sum(bases).cast("double"), F.sum(tokens).cast("double")).alias("bases_per_token"),
    )


def split_table(pairs: DataFrame, split: str, species: str, family: str, label: str, k: int = 3) -> DataFrame:
    """Per split: species, pairs, families, the ``k`` families with most species, and least, median and greatest label."""
    one = pairs.groupBy(split, species).agg(F.min(family).alias("_f"), F.min(label).alias("_y"), F.count("*").alias("_n"))
    out = one.groupBy(split).agg(
        F.count("*").alias("n_species"), F.sum("_n").alias("n_pairs"), F.count_distinct("_f").alias("n_families"),
        F.min("_y").alias("min_label"), F.max("_y").alias("max_label"),
    )
    out = matched(out, medians(one, [split], "_y", "median_label"), [split], "left")
    return out.join(small(top_listed(one, [split], "_f", k).withColumnRenamed("top", "top_families")), split, "left")


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of the keys, nulls last: range-partitioned, so files follow each other."""
    return df.orderBy(*(F.col(k).asc_nulls_last() for k in keys))


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one text file with a header."""
    csv_cells(df).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def min_rows(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows: counted on the group only, then joined back."""
    enough = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= n)
    return df.join(enough.select(group), group, "left_semi")


def model_records(pairs: DataFrame, images: DataFrame, species: DataFrame, genomes: DataFrame) -> DataFrame:
    """One record per pair: image path, genome (by accession) and ranks in caption vocabulary."""
    ranks = scalars.caption_ranks(F.col("kingdom"), F.col("phylum"), F.col("class"), F.col("lineage_taxids"))
    named = species.withColumn("_r", ranks).drop("kingdom", "phylum", "class").select("*", "_r.*").drop("_r")
    out = pairs.join(images.select("image_id", F.col("file").alias("image_path")), "image_id")
    out = out.join(named, "ncbi_taxid").join(genomes.select("assembly_accession", F.col("sequence_file").alias("genome")), "assembly_accession")
    return out.withColumn("processid", F.col("image_id"))


def dataset_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row: rows of each table (0 if missing) and the byte sums of genomes and images."""
    out = None
    for name, df in tables.items():
        aggregates: list[Column] = [F.count("*").alias(f"n_{name}")]
        if name in ("genomes", "images"):
            size = "sequence_bytes" if name == "genomes" else "bytes"
            total = F.coalesce(F.sum(size), F.lit(0)) if df is not None else F.lit(0)
            aggregates.append(total.cast("long").alias(f"{name.rstrip('s')}_bytes"))
        row = df.agg(*aggregates) if df is not None else next(d for d in tables.values() if d is not None).limit(0).agg(*aggregates)
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


def histogram(df: DataFrame, column: str, missing: str = "(none recorded)") -> DataFrame:
    """Counts of a column's values, most frequent first."""
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def source_names(images: DataFrame, configured: DataFrame) -> DataFrame:
    """Per species the configured name, then the different labels in order."""
    labels = images.groupBy("ncbi_taxid").agg(F.sort_array(F.collect_set("original_label")).alias("_l"))
    out = configured.join(labels, "ncbi_taxid", "left")
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("_l", F.expr("cast(array() as array<string>)"))))
    return out.select("ncbi_taxid", names.alias("source_names"))


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as text: nulls empty, lists joined by ``|``, timestamps in ISO 8601 (UTC)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.concat_ws("|", c.cast("array<string>"))
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, csv: bool = True) -> None:
    """Zstandard Parquet at ``path.parquet`` and its text twin at ``path.csv``; an empty table keeps its schema.

    Both are written whole beside their places first, and only then renamed, one after the other; a job that fails
    before that leaves the former table as it was, and a crash between renames leaves it beside as ``.former``.
    """
    names = [f"{path}.parquet"] + [f"{path}.csv"] * csv
    staged = {n: f"{n}.staged" for n in names}
    df.write.mode("overwrite").option("compression", "zstd").parquet(staged[names[0]])
    if csv:
        cells = csv_cells(df.sparkSession.read.schema(df.schema).parquet(staged[names[0]]))
        cells.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(staged[names[1]])
    for name in names:
        _rename(df.sparkSession, staged[name], name)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """The former target is set aside first and deleted last; a failed rename puts it back."""
    a, b, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target, f"{target}.former"))
    files = a.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.exists(a):
        raise OSError(f"{source} is not there")
    held, moved = files.exists(b) and files.rename(b, old), False
    try:
        moved = files.rename(a, b)
    finally:
        if held and not moved:
            files.rename(old, b)
    if not moved:
        raise OSError(f"cannot rename {source} to {target}")
    files.delete(old, True)


def write_units(df: DataFrame, path: str, unit: str = "assembly_accession") -> None:
    """One folder per unit; units in ``df`` replace their folders, all others stay (a resumed job)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)


#: What every unit of a chunk table must have.
CHUNK_COLUMNS = {"chunk_id": "int", "input_ids": "array<int>", "log10_longevity": "double", "max_longevity_yrs": "double", "ncbi_taxid": "bigint"}


def read_units(spark: SparkSession, path: str, unit: str = "assembly_accession", wanted: DataFrame | None = None) -> DataFrame:
    """The chunk table of all units, or of the ``wanted`` ones; raises if a column is missing or of another type.

    Token arrays stay on disk until they are asked for. ``validation.chunks`` checks the rows.
    """
    rows = spark.read.parquet(path)
    have = dict(rows.dtypes)
    wrong = [f"{c} is {have.get(c, 'missing')}, not {kind}" for c, kind in CHUNK_COLUMNS.items() if have.get(c) != kind]
    if unit not in have:
        wrong.append(f"{unit} is missing")
    if wrong:
        raise ValueError("not a chunk table: " + "; ".join(wrong))
    rows = rows.withColumn(unit, F.col(unit).cast("string"))
    return rows if wanted is None else rows.join(small(wanted.select(unit).distinct()), unit, "left_semi")


def unfinished(units: DataFrame, done: DataFrame, unit: str = "assembly_accession") -> DataFrame:
    """Units still to do."""
    return units.join(done.select(unit), unit, "left_anti")


def top_listed(df: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group as one string ``value (n), ...``; ties by name."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.col(value).asc_nulls_last())
    top = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    text = F.concat(F.coalesce(value, F.lit("null")), F.lit(" ("), F.col("n"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("_r", text.alias("t"))))
    return top.groupBy(*group).agg(F.array_join(F.transform(listed, lambda x: x.t), ", ").alias("top"))


def build_totals(images: DataFrame) -> DataFrame:
    """Download counters per species from an outcome table ``ok, reused, bytes``."""
    return images.groupBy("species_query").agg(
        F.count("*").alias("n_tried"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.count_if("reused").alias("n_reused"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def failures(outcomes: DataFrame, path: str, batch: str | None = None) -> None:
    """Append the failed outcomes to a log of JSON lines.

    With a ``batch`` name the log is a folder for each batch, which a job that is tried again replaces as a whole, so its
    lines are there once however often it is written; other batches stay. Without one, lines are simply added.
    """
    failed = outcomes.where(~F.col("ok"))
    if batch is None:
        failed.write.mode("append").json(path)
        return
    if not batch or "/" in batch or "=" in batch:
        raise ValueError(f"not a batch name: {batch!r}")
    place = f"{path}/batch={batch}"
    failed.write.mode("overwrite").json(f"{path}/_staged-{batch}")
    _rename(outcomes.sparkSession, f"{path}/_staged-{batch}", place)


def read_failures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log of ``failures`` by batches, with the column ``batch``."""
    return spark.read.schema(f"{schema}, batch string").json(path)




# ---------------------------------------------------------------- datasets on disk


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One dataset table by name, with its explicit schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}.parquet")


def write_manifest(spark: SparkSession, root: str, counts: DataFrame, *, name: str, version: str, sources: Sequence[dict] = (), selection: dict | None = None) -> dict:
    """``dataset.json`` of a dataset: schema version, tables with their rows, counts, sources and selection."""
    found = counts.first().asDict()
    document = {
        "name": name,
        "version": version,
        "schema_version": schemas.VERSION,
        "tables": {t: {"path": f"{t}.parquet", "n_rows": found[f"n_{t}"]} for t in schemas.TABLES},
        "counts": found,
        "sources": list(sources),
        "selection": selection or {},
    }
    text = spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{root}/dataset.json")
    return document


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/dataset.json").collect()))


def commit_dataset(tables: Mapping[str, DataFrame], root: str, document: Mapping | None = None, csv: bool = True) -> dict:
    """Write all tables of a dataset as one new version, and then point to it by one rename.

    Tables go to ``versions/<id>`` under ``root``, Parquet and text side by side; the real file ``dataset.json`` is
    written beside its place and renamed over the former one last. A job that fails at any step before that leaves the
    former version, whole and named; readers that hold it keep it. Versions that nothing points to are left to
    ``prune_versions``. ``document``: more keys of ``dataset.json``. Missing tables are simply not in the version.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    counted = {}
    for name, df in tables.items():
        path = f"{root}/versions/{version}/{name}"
        df.write.option("compression", "zstd").parquet(f"{path}.parquet")
        kept = spark.read.schema(df.schema).parquet(f"{path}.parquet")
        if csv:
            csv_cells(kept).write.option("header", True).option("emptyValue", "").csv(f"{path}.csv")
        counted[name] = {"path": f"versions/{version}/{name}.parquet", "n_rows": kept.count()}
    body = dict(document or {}) | {"schema_version": schemas.VERSION, "data_version": version, "tables": counted}
    _publish(spark, json.dumps(body, sort_keys=True, indent=1), f"{root}/dataset.json")
    return body


def _publish(spark: SparkSession, text: str, path: str) -> None:
    """A small file written beside its place and renamed over the former one in a single step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    staged, target = hadoop.Path(f"{path}.{uuid.uuid4().hex}.staged"), hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    out = staged.getFileSystem(conf).create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, options)


def open_dataset(spark: SparkSession, root: str) -> tuple[dict, dict[str, DataFrame]]:
    """The document of the version that ``dataset.json`` points to, and its tables."""
    document = json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/dataset.json").collect()))
    return document, {name: spark.read.parquet(f"{root}/{info['path']}") for name, info in document["tables"].items()}


def prune_versions(spark: SparkSession, root: str) -> list[str]:
    """Delete the versions that ``dataset.json`` does not point to, when no reader holds them; returns their names."""
    kept = open_dataset(spark, root)[0]["data_version"]
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in files.listStatus(place) if s.getPath().getName() != kept]
    for p in old:
        files.delete(p, True)
    return sorted(p.getName() for p in old)


def copy_prefix(pool: DataFrame, stored: DataFrame, path: str, n: int, unit: str = "assembly_accession") -> DataFrame:
    """The first ``n`` chunks of each unit of a pool written to ``path``, verified before and after; returns the units
    to redo.

    ``stored(unit, n_rows, digest)`` are the pool's fingerprints when it was made. Units that are missing from the pool,
    or differ, are left out of the copy and returned as ``unit, message``; the copy of all others is read again and must
    have the fingerprints of the prefix. ``write_units`` puts redone units beside them.
    """
    spoiled = unit_drift(stored, unit_fingerprints(pool, unit), unit)
    spoiled = Workspace(pool.sparkSession, "prefix").cut(spoiled)
    sound = pool.join(small(spoiled.select(unit)), unit, "left_anti")
    write_units(reduced(sound, n).select(*pool.columns), path, unit)
    copied = pool.sparkSession.read.schema(pool.schema).parquet(path).select(*pool.columns)
    wrong = unit_drift(unit_fingerprints(sound, unit, n), unit_fingerprints(copied.join(small(sound.select(unit).distinct()), unit, "left_semi"), unit), unit)
    if found := wrong.orderBy(unit).limit(fixed.MESSAGES).collect():
        raise OSError(f"the copy differs from its pool: {[tuple(r) for r in found]}")
    return spoiled


def audit_matrix(rows: DataFrame, group: str, category: str, categories: Sequence[str], living: Sequence[str]) -> DataFrame:
    """Per group the rows of each category (0 where there are none), and the share of those that are ``living``."""
    counts = rows.groupBy(group).agg(
        *(F.count_if(F.col(category) == c).alias(c) for c in categories),
        F.avg(F.coalesce(F.col(category).isin(list(living)), F.lit(False)).cast("double")).alias("living_share"),
    )
    return counts


def dataset_overlap(images: DataFrame, reference: DataFrame, *, source: str, name: str, many: Sequence[int] = (100, 1000)) -> DataFrame:
    """Per source: species (by their species-level names), images, species and images that the reference has too, and
    species with at least each number of images. ``reference(name)``; names that are no species are left out."""
    named = images.select(source, scalars.species_level(F.col(name)).alias("_s")).where("_s is not null")
    n = named.groupBy(source, "_s").agg(F.count("*").alias("_n"))
    known = reference.select(scalars.species_level(F.col(name)).alias("_s"), F.lit(True).alias("_k")).where("_s is not null").distinct()
    both = n.join(known, "_s", "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    return both.groupBy(source).agg(
        F.count("*").alias("n_species"), F.sum("_n").alias("n_images"), F.count_if("_k").alias("n_shared"),
        F.coalesce(F.sum(F.when(F.col("_k"), F.col("_n"))), F.lit(0)).alias("n_shared_images"),
        *(F.count_if(F.col("_n") >= k).alias(f"n_{k}") for k in many),
    )


def chunk_rows(windows: DataFrame, traits: DataFrame, *, unit: str = "assembly_accession", seed: int = 0, block_bases: int | None = None) -> DataFrame:
    """Token windows as rows of a chunk table: with the labels of their unit, and the seed and block size they came from.

    ``traits(unit, ncbi_taxid, max_longevity_yrs, ...)``; units without a positive label are left out.
    """
    labelled = traits.withColumn("log10_longevity", scalars.log_years(F.col("max_longevity_yrs"))).where("log10_longevity is not null")
    return windows.join(small(labelled), unit).withColumns({"seed": F.lit(seed), "block_bases": F.lit(block_bases).cast("int")})


def coverage(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row: different keys of each set as ``n_<name>``, those in all of them (``n_all``), and in any (``n_any``)."""
    tagged = united({name: df.select(key).where(F.col(key).isNotNull()).distinct() for name, df in sets.items()}, "_set")
    each = tagged.groupBy(key).agg(F.count("*").alias("_n"), *(F.count_if(F.col("_set") == name).alias(f"_{name}") for name in sets))
    return each.agg(*(F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias(f"n_{name}") for name in sets), F.count_if(F.col("_n") == len(sets)).alias("n_all"), F.count("*").alias("n_any"))


def licence_shares(rows: DataFrame, group: str, licence: str) -> DataFrame:
    """Per group the rows and the shares of open licences: CC0 or public domain, BY, BY-SA, any other CC, none."""
    slug = F.lower(F.coalesce(licence, F.lit("")))
    kind = (
        F.when(slug.rlike("^cc-(0|publicdomain)"), "cc0")
        .when(slug.rlike("^cc-by(-[0-9.]+)?$"), "by")
        .when(slug.rlike("^cc-by-sa(-[0-9.]+)?$"), "by_sa")
        .when(slug.startswith("cc-"), "other_cc")
        .otherwise("none")
    )
    kinds = ["cc0", "by", "by_sa", "other_cc", "none"]
    return rows.groupBy(group).agg(F.count("*").alias("n_rows"), *(F.avg((kind == k).cast("double")).alias(f"{k}_share") for k in kinds))


def url_siblings(images: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per occurrence: rows whose catalogued URL differs from the provenance one, how many of those equal a
    sibling's URL under the same occurrence, and whether the occurrence has several licences.

    ``images(uuid, occurrence, url)``, ``provenance(uuid, prov_url, license)``; urls are compared within an
    occurrence by a join on (occurrence, url), never all pairs.
    """
    both = images.join(provenance, "uuid")
    known = images.select("occurrence", F.col("url").alias("prov_url"), F.lit(True).alias("_known")).distinct()
    differs = ~F.col("url").eqNullSafe(F.col("prov_url"))
    marked = both.join(known, ["occurrence", "prov_url"], "left")
    return marked.groupBy("occurrence").agg(
        F.count("*").alias("n_rows"),
        F.count_if(differs).alias("n_differ"),
        F.count_if(differs & F.coalesce("_known", F.lit(False))).alias("n_sibling"),
        (F.count_distinct("license") > 1).alias("several_licences"),
    )
