"""Random windows of sequences, end to end: placed, fetched across blocks, judged and redrawn."""

from __future__ import annotations

import hashlib
import random

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from taxaflow.operators import sequences
from taxaflow.plans import catalog


def _unit(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def _brute(genomes, window, n, seed, most, tries):
    out = []
    for unit, records in genomes.items():
        spans = [(name, s, len(s) - window + 1) for name, s in sorted(records.items()) if len(s) >= window]
        total = sum(k for _, _, k in spans)
        for slot in range(n):
            for draw in range(tries):
                at = int(_unit(seed, unit, slot, draw) * total)
                for name, s, k in spans:
                    if at < k:
                        break
                    at -= k
                seq = s[at : at + window]
                if seq.count("N") <= most * window:
                    out.append((unit, slot, draw, name, at, seq))
                    break
    return sorted(out)


def _genomes(seed):
    rng = random.Random(seed)
    return {f"g{u}": {f"c{k}": "".join(rng.choices("ACGTN", [5, 5, 5, 5, 8], k=rng.choice([3, 19, 20, 64, 65, 400]))) for k in range(6)} | {"whole": "ACGT" * 20} for u in range(3)}


def _blocks(spark, genomes, size):
    rows = [(u, c, s) for u, records in genomes.items() for c, s in records.items()]
    return sequences.blocks(spark.createDataFrame(rows, "unit string, record string, s string"), ["unit", "record"], "s", size)


@pytest.mark.parametrize("block", [7, 64])
def test_windows_equal_brute_force_whatever_the_blocks(spark, block):
    genomes = _genomes(1)
    got = sequences.sampled_windows(_blocks(spark, genomes, block), "unit", "record", block, 20, 5, seed=3, most=0.2, tries=300)
    want = _brute(genomes, 20, 5, 3, 0.2, 300)
    assert sorted((r["unit"], r["slot"], r["draw"], r["record"], r["start"], r["seq"]) for r in got.collect()) == want
    assert max(w[2] for w in want) >= 4  # some slots are redrawn


def test_units_that_lack_windows_are_named(spark):
    genomes = {"good": {"a": "ACGT" * 50}, "poor": {"a": "N" * 200}, "poorer": {"a": "NA" * 90}}
    with pytest.raises(ValueError, match=r"0.01 in 20 draws: \['poor', 'poorer'\]"):
        sequences.sampled_windows(_blocks(spark, genomes, 32), "unit", "record", 32, 20, 2, tries=20)
    with pytest.raises(ValueError, match=r"at least 500 letters: \['good', 'poor', 'poorer'\]"):
        sequences.sampled_windows(_blocks(spark, genomes, 32), "unit", "record", 32, 500, 2)


def test_open_slots_are_left_out_if_asked_for(spark):
    genomes = {"good": {"a": "ACGT" * 50}, "poor": {"a": "N" * 200}, "poorer": {"a": "NA" * 90 + "ACGT" * 9}, "short": {"a": "ACG"}, None: {"a": "ACGT" * 50}}
    got = sequences.sampled_windows(_blocks(spark, genomes, 32), "unit", "record", 32, 20, 4, seed=1, tries=20, complete=False)
    want = _brute({u: genomes[u] for u in ("good", "poor", "poorer")}, 20, 4, 1, 0.01, 20)
    assert sorted((r["unit"], r["slot"], r["draw"], r["record"], r["start"], r["seq"]) for r in got.collect()) == want
    assert 0 < sum(w[0] == "poorer" for w in want) < 4


def test_good_windows_equal_their_twin_where_draws_run_out(spark, tmp_path):
    table = "'/root/testdata/sf0.001/documents.parquet'"
    made = f"SELECT * FROM {table} UNION ALL SELECT * REPLACE (doc_id + 1000000 AS doc_id) FROM {table}"  # 3 of 160 slots stay open
    made += f" UNION ALL SELECT * REPLACE (doc_id + 2000000 AS doc_id, NULL AS source) FROM {table} WHERE doc_id < 9"
    made += f" UNION ALL SELECT * REPLACE (doc_id + 3000000 AS doc_id, 'short' AS source, 'acgt' AS text) FROM {table} WHERE doc_id < 9"
    duckdb.sql(f"COPY ({made}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    names, rows = compare.spark_rows(catalog.queries()["good_windows"](spark, str(tmp_path)))
    assert (names, rows) == compare.duck_rows(catalog.oracles()["good_windows"], str(tmp_path))
    assert len(rows) == 157


def test_batches_equal_a_loop(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(1, 60), rng.randrange(1, 4)) for k in range(700)]
    df = spark.createDataFrame(rows, "k long, n int, w int").repartition(5)
    dealt = sorted(rows, key=lambda r: hashlib.md5(f"2:{r[0]}".encode()).hexdigest())
    want = []
    for at in range(0, 700, 64):
        batch, longest, held = -1, 0, 0
        for k, n, w in sorted(dealt[at : at + 64], key=lambda r: (r[1], r[0])):
            if not held or max(longest, n) * (held + w) > 150:
                batch, longest, held = batch + 1, n, 0
            longest, held = max(longest, n), held + w
            want.append((k, at // 64, batch))
    got = sequences.budget_batches(df, "k", "n", 150, bucket=64, seed=2, windows="w")
    assert sorted(map(tuple, got.select("k", "bucket", "batch").collect())) == sorted(want)
    assert sequences.budget_batches(df.where(F.lit(False)), "k", "n", 150).count() == 0
