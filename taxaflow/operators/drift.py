"""Frozen cohorts and what has changed since: fingerprints, drift of rows, taxonomy, settings and predictions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .order import hot_join

TOLERANCE = 1e-7


def _same(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    if kind in ("double", "float"):
        return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    return a.eqNullSafe(b)


def row_drift(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``key, column, expected, actual`` for differing cells; column ``(missing)`` or ``(extra)`` for whole rows."""
    kinds = dict(expected.dtypes)
    a = expected.select(F.col(key).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = actual.select(F.col(key).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")

    def cell(name: str, x: Column, y: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), x.cast("string").alias("expected"), y.cast("string").alias("actual"))

    null = F.lit(None).cast("string")
    cells = [
        F.when(~_same(F.col(f"a_{c}"), F.col(f"b_{c}"), kinds[c], tolerance), cell(c, F.col(f"a_{c}"), F.col(f"b_{c}")))
        for c in columns
    ]
    found = (
        F.when(F.col("_b").isNull(), F.array(cell("(missing)", null, null)))
        .when(F.col("_a").isNull(), F.array(cell("(extra)", null, null)))
        .otherwise(F.array_compact(F.array(*cells)))
    )
    return both.select(F.coalesce("_a", "_b").alias(key), F.explode(found).alias("_c")).select(key, "_c.*")


def count_drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Units whose number of rows is not the one in ``expected(key, n)``."""
    have = actual.groupBy(key).agg(F.count("*").alias("actual"))
    both = expected.withColumnRenamed("n", "expected").join(have, key, "full_outer")
    return both.fillna({"expected": 0, "actual": 0}).where("expected <> actual")


def leaves(document: Mapping, path: str = "") -> list[tuple[str, str]]:
    """The leaves of nested settings as ``path, JSON value``; lists are leaves."""
    out = []
    for name, value in document.items():
        at = f"{path}.{name}" if path else name
        out += leaves(value, at) if isinstance(value, Mapping) and value else [(at, json.dumps(value, sort_keys=True))]
    return out


def settings_drift(old: DataFrame, new: DataFrame, key: str, unset: str = "(unset)") -> DataFrame:
    """Changed leaves of settings given as ``key, path, value`` on both sides."""
    a, b = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "new")
    both = a.join(b, [key, "path"], "full_outer").fillna({"old": unset, "new": unset})
    return both.where("old <> new")


def json_leaves(df: DataFrame, key: str, column: str, depth: int = 64) -> DataFrame:
    """``key, path, value`` of the leaves of JSON objects in a column, with paths joined by dots.

    Objects are opened level by level until only leaves are left; lists and empty objects are leaves, as JSON. Strings
    stand without quotes, other values as JSON, a JSON null is a null. Texts that are no JSON object, and nulls, have no
    leaves. Names that repeat in one object: the last. Documents deeper than ``depth`` raise an error. The fields of each
    level are written, so that no level opens those above it again.
    """
    spark, done, work = df.sparkSession, None, Workspace(df.sparkSession, "leaves")
    doc = F.try_parse_json(F.col(column))
    level = df.select(key, F.lit("").alias("path"), doc.alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT<"))
    for _ in range(depth):
        fields = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("key").alias("_name"), F.col("value").alias("_x")))
        path = F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), "_name")
        fields = work.cut(fields.select(key, path.alias("path"), F.col("_x").alias("_v"), F.schema_of_variant("_x").alias("_kind")))
        inner = F.col("_kind").startswith("OBJECT<") & (F.col("_kind") != "OBJECT<>")
        text = F.when(F.col("_kind") == "STRING", F.try_variant_get("_v", "$", "string")).when(F.col("_kind") != "VOID", F.to_json("_v"))
        found = fields.where(~inner).select(key, "path", text.alias("value"))
        done = found if done is None else done.unionByName(found)
        level = fields.where(inner).select(key, "path", "_v")
        if not level.limit(1).count():
            return done
    raise ValueError(f"documents deeper than {depth} levels")


def prediction_drift(saved: DataFrame, again: DataFrame, keys: Sequence[str], label: str, pred: str, limit: float = 0.002) -> DataFrame:
    """One row: rows on each side, keys or labels that differ, mean and largest change, and whether it holds.

    Rows are matched by ``keys`` (unique on each side).
    """
    a = saved.select(*keys, F.col(label).alias("_l"), F.col(pred).alias("_p"))
    b = again.select(*keys, F.col(label).alias("_m"), F.col(pred).alias("_q"))
    both = a.join(b, list(keys), "full_outer")
    change = F.abs(F.col("_p") - F.col("_q"))
    out = both.agg(
        F.count("_p").alias("n_saved"),
        F.count("_q").alias("n_again"),
        F.count_if(F.col("_p").isNull() | F.col("_q").isNull()).alias("n_unmatched"),
        F.count_if(F.abs(F.col("_l") - F.col("_m")) > 1e-10).alias("n_labels"),
        F.avg(change).alias("mean_change"),
        F.max(change).alias("max_change"),
    )
    return out.withColumn("holds", (F.col("n_unmatched") == 0) & (F.col("n_labels") == 0) & (F.col("max_change") <= limit))


def positional_drift(saved: DataFrame, again: DataFrame, at: str, keys: Sequence[str], label: str, pred: str, limit: float = 0.002) -> DataFrame:
    """``prediction_drift`` of two runs in the same order: rows are matched by their number ``at``, and rows whose keys
    differ at that number count as unmatched."""
    same = F.lit(True)
    renamed = again.select(F.col(at), *(F.col(k).alias(f"_{k}") for k in keys), F.col(label).alias("_m"), F.col(pred).alias("_q"))
    both = saved.select(at, *keys, F.col(label).alias("_l"), F.col(pred).alias("_p")).join(renamed, at, "full_outer")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    change = F.when(same, F.abs(F.col("_p") - F.col("_q")))
    out = both.agg(
        F.count("_p").alias("n_saved"), F.count("_q").alias("n_again"),
        F.count_if(~same | F.col("_p").isNull() | F.col("_q").isNull()).alias("n_unmatched"),
        F.count_if(same & (F.abs(F.col("_l") - F.col("_m")) > 1e-10)).alias("n_labels"),
        F.avg(change).alias("mean_change"), F.max(change).alias("max_change"),
    )
    return out.withColumn("holds", (F.col("n_unmatched") == 0) & (F.col("n_labels") == 0) & (F.col("max_change") <= limit))


def cohort(rows: DataFrame, key: str, columns: Sequence[str], single: bool = False) -> DataFrame:
    """Distinct ``columns``; with ``single`` a key with several rows is an error (else ``ambiguous`` finds it)."""
    out = rows.select(key, *columns).distinct()
    if single and (several := ambiguous(out, key).limit(1).collect()):
        raise ValueError(f"{key} {several[0][key]!r} has {several[0]['n']} different rows")
    return out


def snapshot(genomes: DataFrame, traits: DataFrame, species: DataFrame, former: DataFrame, ranks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What is frozen of verified genomes: their rows with labels and taxonomy, and the drift of that taxonomy from the
    former one. ``genomes(assembly_accession, ncbi_taxid, ...)``, ``traits`` and ``species`` by ncbi_taxid."""
    rows = genomes.join(traits, "ncbi_taxid").join(species.select("ncbi_taxid", *ranks), "ncbi_taxid")
    kept = species.join(rows.select("ncbi_taxid").distinct(), "ncbi_taxid", "left_semi")
    before = former.join(rows.select("ncbi_taxid").distinct(), "ncbi_taxid", "left_semi")
    return rows, row_drift(before, kept, "ncbi_taxid", ranks)


def ambiguous(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest: the sum and the exclusive or of a 64-bit hash of every row."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def fingerprint(document: Mapping) -> str:
    """sha256 of canonical JSON, without the document's own fingerprint."""
    body = {k: v for k, v in document.items() if k != "fingerprint"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def freeze(document: Mapping, parent: str | None = None) -> dict:
    """The document with its parent's fingerprint and its own."""
    body = dict(document) | ({"parent": parent} if parent else {})
    return body | {"fingerprint": fingerprint(body)}


def verified(document: Mapping) -> dict:
    """The frozen document; raises if its fingerprint is not that of its contents."""
    if document.get("fingerprint") != fingerprint(document):
        raise ValueError("the document does not match its fingerprint")
    return dict(document)


def parent_chains(documents: DataFrame) -> DataFrame:
    """``fingerprint, root, depth, problem``: each document of ``documents(fingerprint, parent)`` walked up to its root.

    ``problem``: ``unknown parent`` where the chain leaves the documents (the root is the last known one), ``cycle`` where
    it never ends (no root), else null. All chains are walked at once by pointer doubling, so rounds grow with the
    logarithm of the number of documents. A fingerprint with several parents counts with the least.
    """
    work = Workspace(documents.sparkSession, "chains")
    known = work.cut(documents.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("parent").alias("parent")))
    of = known.select(F.col("fingerprint").alias("_f"))
    state = known.join(of, known.parent == F.col("_f"), "left").select(
        "fingerprint", F.coalesce("_f", "fingerprint").alias("up"), F.col("_f").isNotNull().cast("long").alias("depth"),
        (F.col("parent").isNotNull() & F.col("_f").isNull()).alias("lost"),
    )
    total, length = known.count(), 1
    while length <= total:
        above = state.select(F.col("fingerprint").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("lost").alias("_lost"))
        moved = hot_join(state, above, ["up"], "left")
        state = work.cut(moved.select("fingerprint", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("lost") | F.col("_lost")).alias("lost")))
        length *= 2
    # whoever still stands below a document with a parent of its own goes round for ever
    ends = state.select(F.col("fingerprint").alias("up"), (F.col("depth") > 0).alias("_goes_on"))
    out = hot_join(state, ends, ["up"], "left")
    problem = F.when(F.col("_goes_on"), "cycle").when(F.col("lost"), "unknown parent")
    ended = lambda c: F.when(~F.col("_goes_on"), F.col(c))
    return out.select("fingerprint", ended("up").alias("root"), ended("depth").alias("depth"), problem.alias("problem"))


def unit_fingerprints(rows: DataFrame, unit: str, n: int | None = None) -> DataFrame:
    """``unit, n_rows, digest``: an order-free fingerprint of each unit's rows, or of its first ``n`` chunks.

    Two sums and an exclusive or of 64-bit hashes of whole rows, which Spark adds up before the shuffle; rows that repeat
    count each. Columns are taken by name, so their order does not matter.
    """
    kept = rows if n is None else reduced(rows, n)
    names = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    a, b = F.xxhash64(*names), F.xxhash64(F.lit(1), *names)
    sums = [F.sum(x.cast("decimal(38,0)")).cast("string") for x in (a, b)]
    return kept.groupBy(unit).agg(F.count("*").alias("n_rows"), F.concat_ws(":", *sums, F.bit_xor(a).cast("string")).alias("digest"))


def unit_drift(stored: DataFrame, actual: DataFrame, unit: str) -> DataFrame:
    """``unit, message`` of units whose fingerprint is not the stored one: ``missing``, ``extra`` or ``differs``."""
    a = stored.select(unit, F.struct("n_rows", "digest").alias("_a"))
    b = actual.select(unit, F.struct("n_rows", "digest").alias("_b"))
    message = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "differs")
    return a.join(b, unit, "full_outer").select(unit, message.alias("message")).where("message is not null")


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with ``side``."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def reduced(pool: DataFrame, n: int) -> DataFrame:
    """The first ``n`` chunks of each unit of a verified pool."""
    return pool.where(F.col("chunk_id") < n)


def disagreeing(reused: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of chunks that are in one of two shards only, or whose values differ: a reused pool must agree with a fresh one."""
    a = reused.select(*keys, F.xxhash64(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = fresh.select(*keys, F.xxhash64(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, list(keys), "full_outer")
    message = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(*keys, message.alias("message")).where("message is not null")
