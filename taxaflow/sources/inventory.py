"""Files on disk as rows: sizes and digests, finished genomes, and records tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listings import parse_checksums

#: Larger files are hashed in pieces from their path, as a binary cell ends at 2 GB.
CELL_BYTES = 1 << 30


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, size, md5, sha256`` of the files under ``root``, paths relative to it (Spark lists no empty files).

    Files up to ``CELL_BYTES`` are read whole by Spark; the filter on the length is pushed to the listing, so larger ones
    are only listed there, and hashed piece by piece in tasks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    named = [F.substr(at, F.lit(len(base) + 2)).alias("path"), F.col("length").alias("size")]
    small = files.where(F.col("length") <= CELL_BYTES).select(*named, F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > CELL_BYTES).select(*named, F.col("path").alias("at"))
    return small.unionByName(large.mapInPandas(_digests, "path string, size long, md5 string, sha256 string"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, size, at in batch[["path", "size", "at"]].itertuples(index=False):
            md5, sha = hashlib.md5(), hashlib.sha256()
            files, place = pafs.FileSystem.from_uri(at)
            with files.open_input_stream(place, compression=None) as f:
                while piece := f.read(1 << 20):
                    md5.update(piece)
                    sha.update(piece)
            yield pd.DataFrame({"path": [path], "size": [size], "md5": [md5.hexdigest()], "sha256": [sha.hexdigest()]})


def finished_genomes(spark: SparkSession, root: str, listed: DataFrame, traits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Listed genomes whose file is there with the digest of its checksum list, and those whose digest differs.

    Files lie at ``<accession>/..._genomic.fna.gz`` beside ``md5checksums.txt``; ``listed(assembly_accession)``. With
    ``traits(assembly_accession, ...)`` the good ones are those that have a trait, with its columns.
    """
    files = inventory(spark, root, "*_genomic.fna.gz").withColumn("assembly_accession", F.regexp_extract("path", "^([^/]+)/", 1))
    files = files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).join(listed, "assembly_accession", "left_semi")
    sums = spark.read.option("pathGlobFilter", "md5checksums.txt").option("recursiveFileLookup", "true").text(root)
    known = parse_checksums(sums).withColumnRenamed("md5", "published").distinct()
    both = files.join(known, "name", "left")
    good = F.col("published").isNull() | (F.col("published") == F.col("md5"))
    kept = both.where(good)
    return kept if traits is None else kept.join(traits, "assembly_accession"), both.where(~good)


def read_records(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.where(F.col("split") == split) if split else rows
