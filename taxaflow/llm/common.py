"""What the operators of this subpackage share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores before it as no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def raw(column: str = "text") -> Column:
    """A text column as UTF-8 bytes: free in the JVM, and Python gets bytes without decoding."""
    return F.col(column).cast("binary")


def id_mod(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo m (null ids: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def first_by_hash(rows: DataFrame, key: str, n: int, total: int, salt: str = "") -> DataFrame:
    """At most ``n`` of ``total`` rows by a hash of ``key``: those under a threshold that leaves little more than ``n``.

    Only these are sorted and limited, so what meets in one task grows with ``n``, not with the table. Ties of
    the hash (one key in many rows) are broken by all other columns.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 40))
    spread = max(total, 1)
    if total > 2 * n:
        rows = rows.where(h < int((1 << 40) * min(1.0, (n + 6 * n**0.5) / spread)))
    return rows.orderBy(h, *rows.columns).limit(n)


#: Rows that every class has in a sample by class, or all of its rows.
LEAST = 20
_BITS = 10


def quotas(counts: dict, n: int) -> dict:
    """Rows of each class in a sample of ``n``: all if there are no more, else a quarter of ``n`` dealt evenly and the
    rest by share. No class has under ``LEAST`` rows (or all of its own), so very many classes take more than ``n``."""
    total = sum(counts.values())
    if total <= n:
        return dict(counts)
    least = max(LEAST, n // (4 * len(counts)))
    rest = max(0, n - least * len(counts))
    return {k: min(c, least + rest * c // total) for k, c in counts.items()}


def sample_by_class(rows: DataFrame, by: str, n: int, salt: str = "", carry: dict[str, Column] | None = None) -> tuple[list[Row], dict]:
    """A sample by hash of the whole row with the ``quotas`` of each value of ``by`` (no nulls), and the rows of each class.

    A histogram of the hash by class gives the counts and a threshold for each class, so that little more than
    the sample is fetched; copies of a row travel once with their number. Classes are interleaved evenly.
    ``carry``: columns made of the sampled rows by the executors and fetched in place of the rows' own.
    """
    h = F.pmod(F.xxhash64(*rows.columns, F.lit(salt)), F.lit(1 << 40))
    top = F.shiftright(h, 40 - _BITS).cast("int")
    bins = sorted(map(tuple, rows.groupBy(by, top.alias("_bin")).count().collect()))
    counts: Counter = Counter()
    for k, _, c in bins:
        counts[k] += c
    if not counts:
        return [], {}
    take, below, last = quotas(counts, n), Counter(), {}
    for k, b, c in bins:
        if below[k] < take[k]:
            last[k] = b
        below[k] += c
    schema = T.StructType([rows.schema[by], T.StructField("_last", T.IntegerType())])
    limits = rows.sparkSession.createDataFrame(list(last.items()), schema)
    near = rows.withColumn("_h", h).join(F.broadcast(limits), by).where(F.shiftright("_h", 40 - _BITS) <= F.col("_last"))
    single = near.groupBy("_h", *rows.columns).agg(F.count("*").alias("_copies"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_h", *rows.columns))
    found = single.withColumn("_place", place).where(F.col("_place") <= max(take.values()))
    if carry is not None:
        found = found.select(by, "_place", "_copies", *(c.alias(name) for name, c in carry.items()))
    found = found.collect()
    out, taken = [], Counter()
    for r in sorted(found, key=lambda r: (r[by], r["_place"])):
        k = r[by]
        for _ in range(min(r["_copies"], take[k] - taken[k])):
            taken[k] += 1
            out.append(((taken[k] - 0.5) / take[k], k, len(out), r))
    return [x[-1] for x in sorted(out, key=lambda x: x[:3])], dict(counts)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects for one slice only are alive."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, as Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
