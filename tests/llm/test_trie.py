"""The prefix trie against one of plain Python, its SQL twin, and forced clashes of hashes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import compare
import pytest

from taxaflow.llm import trie
from taxaflow.llm.queries import op11_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    kids = defaultdict(set)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    saved, leaves = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(built[c]) == len(k))
        out.append((members[0], len(k), nodes[k[:-1]][0] if k else None, len(members), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def _random(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), n):
        for k in range(rng.choice([1, 2, 3, 5, 6, 7, 9, 14])):
            turn = rng.choice([k, k, k, None, 2])
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]) if k % 5 == 4 else "user", rng.choice(["a", "b", "", None, "ü😀"]) if k > 2 else "hi"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, seed):
    rows = _random(seed) + [(None, 0, "user", "no id")] * 3
    assert _got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)


def test_long_and_repeated_conversations(spark, monkeypatch):
    """One conversation with most turns, its copies that end early, exact copies, and blocks of few ids."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    long = [(100, k, "user", f"t{k % 7}") for k in range(900)]
    rows = long + [(100 + j, k, "user", f"t{k % 7}") for j in range(1, 40) for k in range(j % 13 + 2)]
    rows += [(900 + j, k, "user", "same") for j in range(60) for k in range(3)] + [(7, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _got(trie.prefix_trie(df)) == _brute(rows)


def test_chains_of_branches_are_summed(spark):
    """Every conversation leaves the one before it one turn later: a tree of paths as high as there are conversations."""
    rows = [(c, k, "user", "m" if k <= c else f"out{c}") for c in range(1, 40) for k in range(c + 9)]
    assert _got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)


def test_trie_equals_its_twin(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.spark_rows(op11_trie(spark, sf)) == compare.duck_rows(trie.ORACLE, sf)
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert _got(op11_trie(spark, sf)) == _brute([tuple(r) for r in rows])


def test_clashing_hashes_are_seen_and_replaced(spark, monkeypatch):
    rows = _random(5, 60)
    keep, seeds = trie._references, []

    def weak(conversations, seed):
        seeds.append(seed)
        made = keep(conversations, seed)
        return made if seed == 2 else made.withColumns({f"c{k}": made.size % 2 for k in trie._K})

    monkeypatch.setattr(trie, "_references", weak)
    assert _got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)
    assert seeds == [0, 1, 2]


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(3, 0, "user", "a", 1, "x"), (3, 0, "user", "a", 1, "x")], SCHEMA + ", depth int, owner string")
    assert _got(trie.prefix_trie(df)) == _brute([(3, 0, "user", "a")] * 2)
    assert trie.prefix_trie(df.where("conv_id > 5")).count() == 0
