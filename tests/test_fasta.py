"""FASTA in byte ranges: equal blocks whatever the split, and contigs that are not wanted are never read out."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from taxaflow.sources import fasta


def _text(seed):
    rng = random.Random(seed)
    out = []
    for k in range(12):
        out.append(f">c{k} record {'x' * rng.randrange(30)}")
        n = rng.choice([0, 0, 1, 7, 16, 64, 130])
        letters = "".join(rng.choices("acgtN", k=n))
        while letters:
            width = rng.choice([1, 5, 8, 16])
            out.append(letters[:width])
            letters = letters[width:]
            if rng.random() < 0.1:
                out.append("")
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_equal_whatever_the_split(tmp_path, seed):
    path, text = tmp_path / "a.fna", _text(seed)
    path.write_bytes(text.encode())
    for size in (1, 5, 8, 64):
        want = list(fasta.fasta_blocks(iter(text.split("\n")), size))
        for split in (1, 2, 3, 7, 20, 64, 10_000):
            record, header, letters, got = -1, "", 0, []
            for first in range(0, len(text), split):
                stop = min(first + split, len(text))
                got += fasta.split_blocks(fasta._lines(str(path), first), stop, record, header, letters, size)
                for at, line in fasta._lines(str(path), first):
                    if at >= stop:
                        break
                    line = line.strip()
                    record, header, letters = (record + 1, line[1:], 0) if line.startswith(">") else (record, header, letters + len(line))
            assert got == want, (seed, size, split)


def test_source_reads_splits_and_pushes_contigs_down(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.fna").write_bytes(_text(10 + k).encode())
    with gzip.open(tmp_path / "g.fna.gz", "wt") as f:
        f.write(_text(20))
    whole = sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path), 16).collect()))
    cut = fasta.read_fasta(spark, str(tmp_path), 16, split=50)
    assert cut.rdd.getNumPartitions() > 10 and sorted(map(tuple, cut.collect())) == whole
    some = cut.where(F.col("contig").isin("c1", "c7"))
    assert sorted(map(tuple, some.collect())) == [r for r in whole if r[3] in ("c1", "c7")]
    assert sorted(map(tuple, cut.where("contig = 'c2' and record = 2").collect())) == [r for r in whole if r[3] == "c2" and r[1] == 2]


def test_unwanted_contigs_are_never_yielded(tmp_path):
    (tmp_path / "a.fna").write_text(_text(3))
    reader = fasta._Reader({"path": str(tmp_path), "block": "8"})
    left = list(reader.pushFilters([In(("contig",), ("c1", "c5")), GreaterThan(("record",), 0), EqualTo(("contig",), "c5")]))
    assert left == [GreaterThan(("record",), 0)] and reader.wanted == {"c5"}
    assert {r[3] for p in reader.partitions() for r in reader.read(p)} == {"c5"}
