"""Datasets with one atomic state, pools copied by verified prefixes, logs of batches, protocols, chains and nested documents."""

from __future__ import annotations

import json
import os

import compare
import pytest
from pyspark.sql import functions as F

from taxaflow.operators import drift, tables, validation
from taxaflow.plans import datasets

SF = "/root/testdata/sf0.01"


def _version(spark, n):
    return {"species": spark.range(n).withColumn("name", F.concat(F.lit("s"), "id")), "pairs": spark.range(2 * n)}


def _state(spark, root):
    """Rows of both tables as Parquet and as text, and the rows that the document states."""
    document, found = tables.open_dataset(spark, root)
    text = {t: spark.read.option("header", True).csv(f"{root}/{i['path'].replace('.parquet', '.csv')}").count() for t, i in document["tables"].items()}
    return {t: (df.count(), text[t], document["tables"][t]["n_rows"]) for t, df in found.items()}


def test_a_failure_between_any_two_steps_leaves_a_whole_dataset(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    tables.commit_dataset(_version(spark, 3), root, {"name": "demo"})
    old = {"species": (3, 3, 3), "pairs": (6, 6, 6)}
    assert _state(spark, root) == old and os.path.isfile(f"{root}/dataset.json")
    assert json.load(open(f"{root}/dataset.json"))["name"] == "demo"
    reader = tables.open_dataset(spark, root)[1]["pairs"]

    class Stop(Exception):
        pass

    for step in range(5):  # before each text twin, each Parquet table, and the one rename
        left = [step]

        def tick(f, left=left):
            def run(*args, **kwargs):
                left[0] -= 1
                if left[0] < 0:
                    raise Stop
                return f(*args, **kwargs)

            return run

        with monkeypatch.context() as m:
            m.setattr(tables, "csv_cells", tick(tables.csv_cells))
            m.setattr(tables, "_publish", tick(tables._publish))
            m.setattr(type(spark.range(1)), "count", tick(type(spark.range(1)).count))
            with pytest.raises(Stop):
                tables.commit_dataset(_version(spark, 5), root)
        assert _state(spark, root) == old
    tables.commit_dataset(_version(spark, 5), root)
    assert _state(spark, root) == {"species": (5, 5, 5), "pairs": (10, 10, 10)}
    assert reader.count() == 6  # a reader of the former version keeps it until it is pruned
    assert len(tables.prune_versions(spark, root)) == 6 and _state(spark, root)["pairs"] == (10, 10, 10)


def test_a_batch_of_failures_is_logged_once(spark, tmp_path):
    outcomes = spark.createDataFrame([(1, True), (2, False), (3, False)], "id int, ok boolean")
    for batch in ("a", "b", "a", "a"):
        tables.failures(outcomes, str(tmp_path / "log"), batch)
    got = tables.read_failures(spark, str(tmp_path / "log"), "id int, ok boolean").orderBy("batch", "id").collect()
    assert [(r["batch"], r["id"]) for r in got] == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    with pytest.raises(ValueError, match="batch name"):
        tables.failures(outcomes, str(tmp_path / "log"), "a/b")


def test_a_tampered_unit_is_found_and_redone_alone(spark, tmp_path):
    pool = spark.createDataFrame([(f"G{u}", c, [u, c]) for u in range(4) for c in range(5)], "assembly_accession string, chunk_id int, input_ids array<int>")
    stored = spark.createDataFrame(drift.unit_fingerprints(pool, "assembly_accession").collect())
    path = str(tmp_path / "copy")
    assert tables.copy_prefix(pool, stored, path, 3).count() == 0
    before = {f: os.path.getmtime(os.path.join(path, d, f)) for d in os.listdir(path) if d.startswith("assembly") for f in os.listdir(os.path.join(path, d))}
    bad = pool.withColumn("input_ids", F.when(F.expr("assembly_accession = 'G2' and chunk_id = 1"), F.array(F.lit(9))).otherwise(F.col("input_ids")))
    redo = tables.copy_prefix(bad.where("assembly_accession <> 'G3'"), stored, str(tmp_path / "other"), 3)
    assert sorted(map(tuple, redo.collect())) == [("G2", "differs"), ("G3", "missing")]
    again = pool.join(redo, "assembly_accession", "left_semi")  # only these are made anew
    tables.write_units(drift.reduced(again, 3), str(tmp_path / "other"))
    copies = [spark.read.parquet(p).select(*pool.columns).orderBy("assembly_accession", "chunk_id").collect() for p in (path, str(tmp_path / "other"))]
    assert copies[0] == copies[1] and len(copies[0]) == 12 and before
    twice = pool.union(pool.limit(1))
    assert drift.unit_drift(stored, drift.unit_fingerprints(twice, "assembly_accession"), "assembly_accession").count() == 1
    assert drift.unit_drift(stored, drift.unit_fingerprints(pool.select("input_ids", "chunk_id", "assembly_accession"), "assembly_accession"), "assembly_accession").count() == 0


def test_a_sound_comparison_has_no_problems_and_each_fault_has_its_own(spark):
    rows = [("a", "train", 1.0), ("b", "train", 3.0), ("c", "val", 2.0), ("c", "val_sub", 2.0), ("d", "test", 2.5), (None, "train", 9.0)]
    listed = [(s, p) for s, p, _ in rows if s]
    chain = [("x", None), ("y", "x")]
    said = {"mean": 2.0, "sd": 2.0**0.5}

    def report(rows=rows, listed=listed, chain=chain, said=said):
        make = spark.createDataFrame
        found = validation.protocol(make(rows, "species string, split string, y double"), make(listed, "species string, split string"), make(chain, "fingerprint string, parent string"), said, label="y")
        return sorted((r["table"], r["check"], r["key"]) for r in found.collect())

    assert report() == []
    assert report(said={"mean": 2.1, "sd": float("nan")}) == [("normalisation", "value", "mean"), ("normalisation", "value", "sd")]
    assert report(rows=rows + [("d", "train", 2.0)], listed=listed + [("d", "train")], said={"mean": 2.0, "sd": 1.0}) == [("labels", "single", "d"), ("splits", "overlap", "d")]
    assert report(listed=listed[:-1] + [("e", "test")]) == [("splits", "species", "d"), ("splits", "species", "e")]
    assert report(rows=rows + [("d", "val_sub", 2.5)], listed=listed + [("d", "val_sub")]) == [("splits", "subset", "d")]
    assert report(chain=[("x", "z"), ("p", "q"), ("q", "p")]) == [("documents", "parent", k) for k in "pqx"]


def test_chains_of_any_length(spark):
    n = 300
    rows = [(f"d{k}", f"d{k - 1}" if k else None) for k in range(n)] + [("self", "self"), ("on", "self"), ("lost", "?"), ("below", "lost"), (None, "d1"), ("d5", "d4")]
    got = {r["fingerprint"]: (r["root"], r["depth"], r["problem"]) for r in drift.parent_chains(spark.createDataFrame(rows, "fingerprint string, parent string")).collect()}
    assert [got[f"d{k}"] for k in range(n)] == [("d0", k, None) for k in range(n)]
    assert got["self"] == got["on"] == (None, None, "cycle") and got["lost"] == ("lost", 0, "unknown parent") and got["below"] == ("lost", 1, "unknown parent")
    assert drift.parent_chains(spark.createDataFrame([], "fingerprint string, parent string")).count() == 0


def test_leaves_of_nested_documents_equal_a_walk(spark):
    documents = [{"a": {"b": {"c": [1, {"x": 2}], "d": "s"}, "e": None}, "f": 1.5, "g": {}, "h": True, "i": ""}, {}, {"k": {"l": {"m": {"n": {"o": "deep"}}}}}]
    texts = [json.dumps(d) for d in documents] + [None, "", "not json", "[1]", '"x"']
    got = drift.json_leaves(spark.createDataFrame(list(enumerate(texts)), "id int, doc string"), "id", "doc").collect()

    def plain(path, value):
        value = json.loads(value)
        return path, value if isinstance(value, str) else None if value is None else json.dumps(value, separators=(",", ":"))

    want = [(k, *plain(*leaf)) for k, d in enumerate(documents) for leaf in drift.leaves(d)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError, match="deeper than 2"):
        drift.json_leaves(spark.createDataFrame([(0, texts[2])], "id int, doc string"), "id", "doc", depth=2)


@pytest.mark.parametrize("name", ["validate_dataset", "parent_chains"])
def test_reports_equal_their_twins_on_more_rows(spark, name):
    assert compare.spark_rows(datasets.QUERIES[name](spark, SF)) == compare.duck_rows(datasets.ORACLES[name], SF)


def test_finished_genomes_have_their_published_digest(spark, tmp_path):
    import hashlib

    from taxaflow.sources import inventory

    for k in range(4):
        folder = tmp_path / f"G{k}"
        folder.mkdir()
        (folder / f"g{k}_genomic.fna.gz").write_bytes(b"data%d" % k)
        digest = hashlib.md5(b"data%d" % (k if k != 2 else 9)).hexdigest()
        if k != 3:
            (folder / "md5checksums.txt").write_text(f"{digest}  ./g{k}_genomic.fna.gz\n0{digest[1:]}  ./other.txt\n")
    listed = spark.createDataFrame([("G0",), ("G2",), ("G3",), ("G9",)], "assembly_accession string")
    traits = spark.createDataFrame([("G0", 3.5), ("G1", 1.0)], "assembly_accession string, years double")
    good, bad = inventory.finished_genomes(spark, str(tmp_path), listed)
    assert sorted(r["assembly_accession"] for r in good.collect()) == ["G0", "G3"]
    assert [r["assembly_accession"] for r in bad.collect()] == ["G2"]
    with_traits, _ = inventory.finished_genomes(spark, str(tmp_path), listed, traits)
    assert [(r["assembly_accession"], r["years"]) for r in with_traits.collect()] == [("G0", 3.5)]
