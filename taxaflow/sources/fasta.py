"""FASTA files as bounded blocks: ``spark.read.format("fasta")``.

Plain files are read in byte ranges that find their place by a survey job, packed ones (gzip cannot be split) in one
partition each; the blocks are written once to Parquet and every later step scales out over them.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions import fixed
from ..operators.sequences import normal_bases, offsets

SCHEMA = "file string, record int, header string, contig string, block_start long, seq string"


def fasta_blocks(lines: Iterator[str], size: int) -> Iterator[tuple[int, str, int, str]]:
    """``record, header, block_start, seq`` of upper-case blocks that never join records; memory of one block.

    An empty record gives one empty block. Sequence before the first header is an error.
    """
    record, header, start, held, n = -1, "", 0, [], 0

    def cut(final: bool) -> Iterator[tuple[int, str, int, str]]:
        nonlocal start, held, n
        text = "".join(held)
        while len(text) >= size:
            yield record, header, start, text[:size]
            text, start = text[size:], start + size
        if final and (text or not start):
            yield record, header, start, text
            text = ""
        held, n = [text] if text else [], len(text)

    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if record >= 0:
                yield from cut(True)
            record, header, start, held, n = record + 1, line[1:], 0, [], 0
        elif line:
            if record < 0:
                raise ValueError("sequence before the first header")
            held.append(line.upper())
            n += len(line)
            if n >= size:
                yield from cut(False)
    if record >= 0:
        yield from cut(True)


def split_blocks(lines: Iterable[tuple[int, str]], stop: int, record: int, header: str, letters: int, size: int, wanted: frozenset | None = None) -> Iterator[tuple[int, str, int, str]]:
    """The blocks of ``fasta_blocks`` that begin in one split of a file: in the lines that start before byte ``stop``.

    ``lines``: (byte, text) from the split's first line on. ``record, header, letters``: where the file stands there.
    Letters before the next block's start belong to the split before; the last block is filled from lines beyond the
    split. Records whose contig is not ``wanted`` are passed over.
    """
    start = -(-letters // size) * size
    skip, held, fresh = start - letters, "", False
    keep = wanted is None or contig_of(header) in wanted
    for at, line in lines:
        line = line.strip()
        if line.startswith(">"):
            if keep and (held or fresh):
                yield record, header, start, held
            if at >= stop:
                return
            record, header, start, skip, held, fresh = record + 1, line[1:], 0, 0, "", True
            keep = wanted is None or contig_of(header) in wanted
        elif line:
            if record < 0:
                raise ValueError("sequence before the first header")
            if at >= stop:
                if not held:
                    return
                held += line[: size - len(held)].upper()
                if len(held) == size:
                    yield record, header, start, held
                    return
                continue
            fresh = False
            if keep:
                held += line[skip:].upper()
                skip = max(0, skip - len(line))
                while len(held) >= size:
                    yield record, header, start, held[:size]
                    held, start = held[size:], start + size
    if keep and (held or fresh):
        yield record, header, start, held


def contig_of(header: str) -> str:
    return header.split(" ")[0]


def _lines(path: str, first: int) -> Iterator[tuple[int, str]]:
    """(byte, line) of a plain file from the first line that starts at ``first`` or later."""
    files, at = _store(path)
    with files.open_input_file(at) as raw:
        place = max(first - 1, 0)
        raw.seek(place)
        reader = io.BufferedReader(raw, 1 << 20)
        if first:
            place += len(reader.readline())
        for line in reader:
            yield place, line.decode()
            place += len(line)


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers, the last header, and the letters after it (or all) of each split."""
    for batch in batches:
        out = []
        for path, first, stop in zip(*(c.to_pylist() for c in batch.columns)):
            n, header, letters = 0, "", 0
            for at, line in _lines(path, first):
                if at >= stop:
                    break
                line = line.strip()
                if line.startswith(">"):
                    n, header, letters = n + 1, line[1:], 0
                else:
                    letters += len(line)
            out.append((path, first, stop, n, header, letters))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        names = ["path", "first", "stop", "n", "header", "letters"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=names)


def planned(spark: SparkSession, path: str, split: int) -> list[tuple[str, int, int, int, str, int]]:
    """Splits of at most ``split`` bytes with the record, header and letters at their beginning.

    Packed files and files of one split need no look; the others are surveyed by a job, and one row for each split is
    added up here.
    """
    whole, cuts = [], []
    for name in _listed(path):
        files, at = _store(name)
        size = files.get_file_info(at).size
        if name.endswith(".gz") or size <= split:
            whole.append((name, 0, -1, -1, "", 0))
        else:
            cuts += [(name, k, min(k + split, size)) for k in range(0, size, split)]
    if not cuts:
        return whole
    rows = spark.createDataFrame(cuts, "path string, first long, stop long").repartition(min(len(cuts), 10_000))
    seen = rows.mapInArrow(_survey, "path string, first long, stop long, n long, header string, letters long").collect()
    last, record, header, letters = None, -1, "", 0
    for r in sorted(seen):
        if r["path"] != last:
            last, record, header, letters = r["path"], -1, "", 0
        whole.append((r["path"], r["first"], r["stop"], record, header, letters))
        record, header, letters = (record + r["n"], r["header"], r["letters"]) if r["n"] else (record, header, letters + r["letters"])
    return whole


class _Split(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.size = int(options.get("block", 1 << 20))
        plan = options.get("plan")
        self.splits = json.loads(plan) if plan else [(p, 0, -1, -1, "", 0) for p in _listed(options["path"])]
        self.wanted: frozenset | None = None

    def pushFilters(self, filters):
        """Conditions on ``contig`` alone are taken: other contigs are passed over as they are read."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("contig",):
                names = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self):
        return [_Split(tuple(s)) for s in self.splits]

    def read(self, partition):
        path, first, stop, record, header, letters = partition.value
        if stop >= 0:
            found = split_blocks(_lines(path, first), stop, record, header, letters, self.size, self.wanted)
        else:
            found = self._whole(path)
        for number, head, start, seq in found:
            yield path, number, head, contig_of(head), start, seq

    def _whole(self, path: str):
        files, at = _store(path)
        with files.open_input_stream(at, compression=None) as raw, io.TextIOWrapper(gzip.open(raw) if path.endswith(".gz") else raw) as lines:
            yield from split_blocks(((0, line) for line in lines), 1, -1, "", 0, self.size, self.wanted)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address (local, or any store that Arrow opens by its address), and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _listed(path: str) -> list[str]:
    files, at = _store(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    if files.get_file_info(at).type == pafs.FileType.File:
        return [path]
    whole = files.get_file_info(at).type == pafs.FileType.Directory
    folder, pattern = (at, "*") if whole else at.rsplit("/", 1)
    found = files.get_file_info(pafs.FileSelector(folder, recursive=True))
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


class FastaSource(DataSource):
    """Options: ``path`` (a file, a folder or a pattern in one), ``block`` (bases) and ``plan`` (splits, see ``planned``)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_fasta(spark: SparkSession, path: str, block: int = 1 << 20, split: int = 1 << 27) -> DataFrame:
    """Blocks of all files, plain ones in splits of at most ``split`` bytes, so a chromosome is read by many tasks.

    Blocks are the same whatever the split. ``where`` conditions that name contigs reach the reader. Lines are never cut:
    a file whose sequences are single lines has as many useful splits as lines.
    """
    spark.dataSource.register(FastaSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    plan = json.dumps(planned(spark, path, split))
    return spark.read.format("fasta").option("block", block).option("plan", plan).load(path)


def from_text(lines: DataFrame, key: str, text: str, block: int) -> DataFrame:
    """The same blocks of FASTA documents held as rows (``key, text``), in Arrow batches."""

    def rows(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(k, *r) for r in fasta_blocks(iter((t or "").split("\n")), block)]
            columns = list(zip(*out)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "record", "header", "block_start", "seq"])

    kind = dict(lines.dtypes)[key]
    return lines.select(key, text).mapInArrow(rows, f"{key} {kind}, record int, header string, block_start long, seq string")


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """Header lines per file; 0 for a file without any (files of no lines at all are not listed)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").startswith(">").alias("_head"))
    return lines.groupBy("file").agg(F.count_if("_head").alias("n_sequences"))


def packed_index(blocks: DataFrame, excluded: DataFrame, unit: str = "file") -> DataFrame:
    """Kept records of each genome with length and offset; excluded accessions and mitochondria are left out."""
    size = blocks.groupBy(unit, "record", "header", "contig").agg(F.sum(F.length("seq")).alias("length"))
    kept = size.join(excluded, size.contig == excluded.accession, "left_anti").where(~F.lower("header").contains("mitochondrion"))
    return offsets(kept, unit, "record", "length")


def pack_summary(blocks: DataFrame, excluded: DataFrame, unit: str = "file") -> DataFrame:
    """``unit, n_kept, total_bp, excluded``: what ``packed_index`` keeps of each genome, and the contigs it leaves out."""
    size = blocks.groupBy(unit, "record", "header", "contig").agg(F.sum(F.length("seq")).alias("length"))
    named = size.join(excluded.select(F.col("accession").alias("contig"), F.lit(True).alias("_x")).distinct(), "contig", "left")
    out = F.coalesce("_x", F.lit(False)) | F.lower("header").contains("mitochondrion")
    return named.groupBy(unit).agg(
        F.count_if(~out).alias("n_kept"),
        F.coalesce(F.sum(F.when(~out, F.col("length"))), F.lit(0)).alias("total_bp"),
        F.sort_array(F.collect_list(F.when(out, F.col("contig")))).alias("excluded"),
    )


def normal_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("seq", normal_bases(F.col("seq")))


def excluded_accessions(report: DataFrame) -> DataFrame:
    """``accession`` of organelles, alternate loci and patches in assembly reports given as lines ``value``."""
    f = F.split("value", "\t")
    c = lambda i: F.get(f, F.lit(i))
    lines = report.where(~F.col("value").startswith("#") & (F.size(f) >= 8))
    out = lines.where((c(7) == "non-nuclear") | c(3).isin(fixed.ORGANELLES) | c(1).isin(fixed.NON_PRIMARY_ROLES))
    return out.select(F.explode(F.array(c(4), c(6))).alias("accession")).where("accession <> 'na'").distinct()
