"""Numbers and running sums over an order of many rows, without a task that holds a whole group.

A window with an order sorts each of its groups in one task. Here rows are range-sorted instead, so that a large group
lies in many partitions; each partition numbers its own stretch, and only the borders between partitions are put
together: one small row for each partition tells where its first group stood at the end of the one before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

#: Keys that may be broadcast as hot ones: each has more than a ``HOT``-th of all rows, so there are no more.
HOT = 10_000


def _changes(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """True where a row's key differs from that of the row before; nulls are equal to each other."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for k, c in enumerate(columns):
        other = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        void = pc.is_null(c).to_numpy(zero_copy_only=False)
        out[1:] |= other | (void[1:] != void[:-1])
        out[0] |= last is None or c[0].as_py() != last[k]
    return out


def _stretches(by: Sequence[str], number: str, sums: Sequence[str], marks: Sequence[str]):
    """Each partition's rows, already sorted, with numbers and running sums that begin at nought in the partition."""
    part, place, first = marks

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        last, at, opening, carried = None, 0, True, np.zeros(1 + len(sums), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
            new = _changes(keys, last) if keys else np.zeros(n, bool)
            if last is None:
                new[0] = False  # the partition's first group may go on from the one before
            group = np.cumsum(new)
            starts = np.flatnonzero(new)
            values = [np.ones(n, np.int64)] + [
                pc.fill_null(batch.column(batch.schema.get_field_index(c)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in sums
            ]
            made = []
            for k, v in enumerate(values):
                run = np.cumsum(v) + carried[k]
                base = np.concatenate(([0], run[starts] - v[starts]))
                made.append(run - base[group])
            last, carried = [c[n - 1].as_py() for c in keys], np.array([m[-1] for m in made])
            if not keys:
                last = []
            plain = [batch.column(k) for k, f in enumerate(batch.schema) if f.name not in sums]
            names = [f.name for f in batch.schema if f.name not in sums]
            extra = [np.full(n, here), np.arange(at, at + n), (group == 0) & opening]
            opening, at = opening and not len(starts), at + n
            yield pa.record_batch(plain + [pa.array(x) for x in made + extra], names=[*names, number, *sums, part, place, first])

    return walk


def numbered(
    rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], into: str = "n", sums: dict[str, Column] | None = None, work: Workspace | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """``rows`` with ``into``, numbers from 1 in each group of ``by`` in that order, and with running sums.

    ``sums``: new columns, each the running sum, its own row included, of an integer column expression (null: nothing).
    Without ``by`` the whole table is one group. ``order`` must tell rows of a group apart where their numbers matter:
    rows that are equal in it are numbered in any order, and all lie in one partition. ``drop``: columns that only the
    order needs; they go once rows are sorted. Null keys are one group; floats as keys are not supported. An empty table
    gives none.
    """
    spark, sums, by = rows.sparkSession, dict(sums or {}), list(by)
    work = work or Workspace(spark, "order")
    kept = [c for c in rows.columns if c not in drop]
    taken = {c.lower() for c in rows.columns}
    if clash := [c for c in [into, *sums] if c.lower() in taken]:
        raise ValueError(f"columns there already: {clash}")
    marks = ["_part", "_place", "_opens"]
    prepared = rows.withColumns({k: v.cast("long") for k, v in sums.items()}) if sums else rows
    lie = [*by, *order]
    # Range bounds by the group and then the order; the sort inside partitions is by both.
    sorted_rows = prepared.repartitionByRange(*lie).sortWithinPartitions(*lie).drop(*drop)
    added = [T.StructField(c, T.LongType()) for c in (into, *sums, *marks[:2])] + [T.StructField(marks[2], T.BooleanType())]
    schema = T.StructType([rows.schema[c] for c in kept] + added)
    walked = work.cut(sorted_rows.mapInArrow(_stretches(by, into, list(sums), marks), schema))
    counted = [into, *sums]
    tail = F.max_by(F.struct(*(F.col(c).alias(f"v{k}") for k, c in enumerate(counted)), *(F.col(c).alias(f"k{k}") for k, c in enumerate(by))), "_place")
    head = F.min_by(F.struct(F.lit(0).alias("v0"), *(F.col(c).alias(f"k{k}") for k, c in enumerate(by))), "_place")
    edges = walked.groupBy("_part").agg(head.alias("head"), tail.alias("tail"), F.min("_opens").alias("whole"))
    edges = edges.orderBy("_part").collect()  # one row for each partition
    shifts, before, held = [], None, [0] * len(counted)
    key = lambda r: tuple(r[f"k{k}"] for k in range(len(by)))
    for e in edges:
        goes_on = before is not None and key(e["head"]) == before
        shift = held if goes_on else [0] * len(counted)
        shifts.append((e["_part"], *shift))
        own = [e["tail"][f"v{k}"] for k in range(len(counted))]
        held = [a + b for a, b in zip(own, shift)] if e["whole"] else own
        before = key(e["tail"])
    names = [f"_shift{k}" for k in range(len(counted))]
    table = spark.createDataFrame(shifts, "_part long" + "".join(f", {n} long" for n in names))
    out = walked.join(F.broadcast(table), "_part")
    shifted = {c: F.col(c) + F.when(F.col("_opens"), F.col(n)).otherwise(0) for c, n in zip(counted, names)}
    return out.withColumns(shifted).select(*kept, *counted)


def _joined(rows: DataFrame, table: DataFrame, on: list[str], how: str, nulls: bool) -> DataFrame:
    if not nulls:
        return rows.join(table, on, how)
    theirs = table.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return rows.join(theirs, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], how).drop(*(f"_on_{c}" for c in on))


def matched(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Tables of one row a key each, joined; null keys match each other."""
    return _joined(rows, table, list(on), how, True)


def hot_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", nulls: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key), where one key may have a large share of ``rows``.

    Keys with more than a ``HOT``-th of all rows are counted first; there can be no more than ``HOT``, so their part of
    the table is broadcast, and only the other keys are shuffled. Without such a key it is a plain join. ``how``: inner or
    left. Null keys match nothing, or each other with ``nulls``. ``counts``: rows of each key (``_rows``), where known.
    """
    on = list(on)
    counts = rows.groupBy(*on).agg(F.count("*").alias("_rows")) if counts is None else counts
    total, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    return _hot_joined(rows, table, on, how, nulls, counts, total, most)


def _hot_joined(rows: DataFrame, table: DataFrame, on: list[str], how: str, nulls: bool, counts: DataFrame, total: int | None, most: int | None) -> DataFrame:
    """``hot_join`` with the numbers of all rows and of those of the most frequent key."""
    least = max((total or 0) // HOT, 1000)
    if (most or 0) <= least:
        return _joined(rows, table, on, how, nulls)
    hot = F.broadcast(counts.where(F.col("_rows") > least).select(*on))
    theirs = F.broadcast(_joined(table, hot, on, "left_semi", nulls))
    known = _joined(_joined(rows, hot, on, "left_semi", nulls), theirs, on, how, nulls)
    return known.unionByName(_joined(_joined(rows, hot, on, "left_anti", nulls), table, on, how, nulls))


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, into: str, work: Workspace | None = None) -> DataFrame:
    """``rows`` with the rank of ``value`` in its group, ties averaged; null values have none.

    Equal values are counted before anything is sorted, so ties of any size are one row of the order.
    """
    return ranked_by(rows, by, {value: into}, work)


def _alike(rows: DataFrame, values: Iterable[str]) -> list[list[str]]:
    """The columns in lists of one type each: values of one type can share one order."""
    kinds: dict[str, list[str]] = {}
    for v in values:
        kinds.setdefault(rows.schema[v].dataType.simpleString(), []).append(v)
    return list(kinds.values())


def _running_counts(rows: DataFrame, by: Sequence[str], values: Sequence[str], work: Workspace | None) -> DataFrame:
    """``by, _no, _value, _ties, _upto``: the different values of each column (``_no``: its place in ``values``) with their
    numbers of rows and the running sum of these, all columns in one distributed order. Nulls are left out."""
    each = [F.struct(F.lit(k).alias("_no"), F.col(v).alias("_value")) for k, v in enumerate(values)]
    known = rows.select(*by, F.explode(F.array(*each)).alias("_e")).select(*by, "_e.*").where(F.col("_value").isNotNull())
    known = known.groupBy(*by, "_no", "_value").agg(F.count("*").alias("_ties"))
    return numbered(known, [*by, "_no"], ["_value"], "_at", {"_upto": F.col("_ties")}, work).drop("_at")


def ranked_by(rows: DataFrame, by: Sequence[str], values: dict[str, str], work: Workspace | None = None) -> DataFrame:
    """``average_ranks`` of several columns: value -> new column. Columns of one type share one order."""
    by, out = list(by), rows
    for alike in _alike(rows, values):
        counts = _running_counts(rows, by, alike, work)
        sizes = {r[0]: r[1:] for r in counts.groupBy("_no").agg(F.sum("_ties"), F.max("_ties")).collect()}  # one row a column
        for k, value in enumerate(alike):
            one = counts.where(F.col("_no") == k).withColumnRenamed("_value", value)
            ranks = one.select(*by, value, (F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias(values[value]))
            ties = one.select(*by, value, F.col("_ties").alias("_rows"))
            out = _hot_joined(out, ranks, [*by, value], "left", bool(by), ties, *sizes.get(k, (0, 0)))
    return out


def sized(rows: DataFrame, by: Sequence[str], into: str) -> DataFrame:
    """``rows`` with the number of rows of their group; null keys are a group."""
    return hot_join(rows, rows.groupBy(*by).agg(F.count("*").alias(into)), by, "left", nulls=True)


def medians(rows: DataFrame, by: Sequence[str], value: str, into: str = "median", work: Workspace | None = None) -> DataFrame:
    """``by, into``: the exact median of each group's values as a double, the mean of the middle two of an even number.

    Equal values are counted first, running counts are distributed, and only the rows of the middle ranks are kept: no
    task holds a group's values. Null values are left out; a group without any has no row.
    """
    return medians_of(rows, by, {value: into}, work)


def medians_of(rows: DataFrame, by: Sequence[str], values: dict[str, str], work: Workspace | None = None) -> DataFrame:
    """``medians`` of several columns: value -> new column. Columns of one type share one order.

    A group with values in some columns only has nulls for the others; one without any has no row.
    """
    by, out = list(by), None
    for alike in _alike(rows, values):
        counts = _running_counts(rows, by, alike, work)
        keys = [*by, "_no"]
        both = hot_join(counts, counts.groupBy(*keys).agg(F.max("_upto").alias("_total")), keys, nulls=True)
        low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
        holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_ties") < rank)  # noqa: B023, E731
        middle = both.where(holds(low) | holds(high))
        of = [F.when(F.col("_no") == k, F.col("_value")) for k in range(len(alike))]
        found = middle.groupBy(*by).agg(*(((F.min(c) + F.max(c)) / 2.0).cast("double").alias(values[v]) for c, v in zip(of, alike)))
        if out is None:
            out = found
        else:
            theirs = found.withColumnsRenamed({c: f"_on_{c}" for c in by})
            both_sides = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by]
            merged = out.join(theirs, both_sides, "full_outer") if by else out.crossJoin(F.broadcast(theirs))  # one row
            out = merged.select(*(F.coalesce(c, f"_on_{c}").alias(c) for c in by), *(c for c in [*out.columns, *found.columns] if c not in by))
    return out
