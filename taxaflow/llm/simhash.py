"""Near duplicates by SimHash and anchor points of a covering code.

Fingerprint: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; every shingle of four
words (repeats included, joined by one space; fewer words: the whole sequence) is hashed by XXH64 with seed
42; a bit is 1 if it is set in over half the hashes. No words, or null text: fingerprint zero, linked like
any other.

Links: two fingerprints link at four or fewer differing bits. By the pigeonhole principle one 32-bit half
then differs in at most two. On each half the anchors are a covering code: the perfect Hamming code of
length 31 (covering radius 1) beside one free bit, 2^27 anchors. The threshold of two bits is split between
the two sides of a pair: some point lies within one bit of both, the anchor that covers it lies within one
bit of that, so each fingerprint is replicated to every anchor within covering radius + 1 = 2 bits: 17 (or 2)
per half, at most 34 in all whatever the input size. Fingerprints are compared per anchor; nothing is capped.
Anchors are counted first: the fingerprints of a crowded one are dealt to smaller cells before they are shuffled.

Copies collapse first (one row per distinct fingerprint), so a group of copies costs one node. Within an
anchor only a spanning forest of the links is emitted, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, fresh, give_back, raw
from .components import components

SHINGLE = 4
SEED = 42
THRESHOLD = 4
_STEP = 1 << 17
#: Fingerprints of one cell beyond which they are parted once more, and the (first bit, bits) of the parts' blocks.
_MANY = 4096
_BLOCKS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))
#: Fingerprints of one anchor beyond which it is dealt to cells before the shuffle, and the (first bit, bits) of six
#: blocks of its other half: two fingerprints that link differ there in four bits at most, so two blocks are equal.
CROWD = 1 << 16
_SIX = ((0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 5))
_DEAL_BITS = 17
#: A component of more fingerprints than this, and than 1/65,536 of all, gets its name by a broadcast.
HOT = 10_000


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of one text, whole."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, end = starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(begin)
    for at in range(0, n, _STEP):
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(begin[at : at + _STEP], end[at : at + _STEP])], np.uint64
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(x.as_py()) for x in text), np.uint64, len(text))
    return pa.array(found.view(np.int64))


def fingerprints(column: str = "text") -> Column:
    """The fingerprint of a text column, as a signed long of the same bits."""
    return F.arrow_udf(_fingerprints, T.LongType())(raw(column))


# ---------------------------------------------------------------- anchors

_PAIRS = [[(i, i ^ s) for i in range(1, 32) if i < i ^ s < 32 and i ^ s] for s in range(32)]
#: For each syndrome s > 0, the 16 masks that turn a word into a codeword: one single bit and 15 pairs.
_MASKS = np.array(
    [
        [0] * 16 if not s else [1 << (s - 1)] + [(1 << (i - 1)) | (1 << (j - 1)) for i, j in _PAIRS[s]]
        for s in range(32)
    ],
    np.uint64,
)


def _syndrome(word: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the set bits."""
    out = np.zeros(len(word), np.int64)
    for i in range(1, 32):
        out ^= np.where((word >> np.uint64(i - 1)) & np.uint64(1), i, 0)
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) pairs of distinct fingerprints: all anchors within two bits, for both halves."""
    keys, owners = [], []
    for half in (0, 1):
        part = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        word, free = part & np.uint64(0x7FFFFFFF), part >> np.uint64(31)
        s = _syndrome(word)
        base = np.uint64(half << 40)
        code = word[:, None] ^ _MASKS[s]
        near = (base | (free << np.uint64(31)))[:, None] | code
        own = np.ones(near.shape, bool)
        own[s == 0, 1:] = False
        keys += [near[own], base | ((free ^ np.uint64(1)) << np.uint64(31)) | code[:, 0]]
        owners += [np.broadcast_to(prints[:, None], near.shape)[own], prints]
    return np.concatenate(keys), np.concatenate(owners)


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 4096):
            key, owner = anchors(prints[at : at + 4096])
            yield pa.record_batch([key.view(np.int64), owner.view(np.int64)], names=["anchor", "fp"])


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of one cell; memory in proportion to them."""
    left, right, rest = [], [], prints
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            step = max(1, (1 << 20) // len(rest))
            reached = np.full(len(rest), -1)
            for at in range(0, len(frontier), step):
                close = np.bitwise_count(frontier[at : at + step, None] ^ rest[None, :]) <= THRESHOLD
                hit = close.any(axis=0) & (reached < 0)
                reached[hit] = at + close[:, hit].argmax(axis=0)
            new = reached >= 0
            left.append(frontier[reached[new]])
            right.append(rest[new])
            frontier, rest = rest[new], rest[~new]
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _links_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell that connect what all its links connect.

    Beyond ``_MANY`` fingerprints they are first parted by each of five blocks of the half in which they differ more:
    two that link differ in four bits at most, so one block is equal in both.
    """
    if len(prints) <= _MANY:
        return _forest(prints)
    halves = [(prints >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF) for h in (0, 1)]
    other = max(halves, key=lambda x: len(np.unique(x)))
    found = []
    for first, width in _BLOCKS:
        block = (other >> np.uint64(first)) & np.uint64((1 << width) - 1)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        found += [_forest(part) for part in np.split(prints[order], cuts)]
    return tuple(np.concatenate([x[k] for x in found]) for k in (0, 1))


def _link_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell of a partition sorted by cell; a run may span batches."""

    def linked(cell: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(cell)) + 1
        first, size = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(cell)])))
        two = first[size == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= THRESHOLD]
        found = [(prints[near], prints[near + 1])]
        found += [_links_of(prints[a : a + n]) for a, n in zip(first[size > 2], size[size > 2])]
        u, v = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
        return pa.record_batch([u, v], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        prints = prints.view(np.uint64)
        last = int(np.searchsorted(cell, cell[-1]))  # the run that may go on
        if last or (held and held[-1][0][-1] != cell[-1]):
            held.append((cell[:last], prints[:last]))
            yield linked(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            held = []
        held.append((cell[last:], prints[last:]))
    if held:
        yield linked(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
    give_back()


def _deals() -> Column:
    """For each pair of the six blocks, the pair's number and the two blocks' bits: above 0, under 2^``_DEAL_BITS``."""
    upper = F.shiftrightunsigned("fp", 32)
    other = F.when(F.shiftright("anchor", 40) == 0, upper).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    bits = [F.shiftright(other, first).bitwiseAND((1 << width) - 1) for first, width in _SIX]
    pairs = [(i, j) for i in range(6) for j in range(i)]
    return F.array(*(F.lit(1 + (k << 12)) + F.shiftleft(bits[i], _SIX[j][1]) + bits[j] for k, (i, j) in enumerate(pairs)))


def _cells(near: DataFrame, work: Workspace, crowd: int) -> DataFrame:
    """``near(anchor, fp)`` -> ``cell, fp``: an anchor is one cell, a crowded one a cell for each value of two of six blocks.

    Crowded are anchors of more than ``crowd`` fingerprints and more than 1/1,048,576 of all rows: fewer than that many,
    so their names are broadcast.
    """
    counts = near.groupBy("anchor").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(crowd, (total or 0) >> 20)
    whole = F.shiftleft("anchor", _DEAL_BITS)
    if (most or 0) <= least:
        return near.select(whole.alias("cell"), "fp")
    hot = work.cut(counts.where(F.col("n") > least).select("anchor", F.lit(True).alias("crowded")))
    deals = F.when(F.col("crowded"), _deals()).otherwise(F.array(F.lit(0).cast("long")))
    dealt = near.join(F.broadcast(hot), "anchor", "left").select(whole.alias("whole"), "fp", F.explode(deals).alias("deal"))
    return dealt.select((F.col("whole") + F.col("deal")).alias("cell"), "fp")


def _named(prints: DataFrame, first: Column, work: Workspace) -> DataFrame:
    """``prints(fp, ...)`` -> ``fp, first`` for every distinct fingerprint: the least ``first`` of its component.

    Sizes and least values are summed before the shuffle. Roots of very many fingerprints, fewer than 65,536 by their
    size, are then broadcast, so that their members do not meet in one task.
    """
    nodes = work.cut(prints.groupBy("fp").agg(first.alias("first")))
    near = nodes.select("fp").mapInArrow(_anchor_rows, "anchor long, fp long")
    cells = _cells(near, work, CROWD).repartition("cell").sortWithinPartitions("cell", "fp")
    stars = components(cells.mapInArrow(_link_rows, "u long, v long"), work)
    member = nodes.join(stars, nodes.fp == stars.u, "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    member = work.cut(member)
    sizes = member.groupBy("root").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    least_hot = max(HOT, member.count() >> 16)
    hot = work.cut(sizes.where(F.col("n") > least_hot).select("root", "first"))
    cold = member.drop("first").join(F.broadcast(hot.select("root")), "root", "left_anti").join(sizes.select("root", "first"), "root")
    rest = member.drop("first").join(F.broadcast(hot), "root")
    return cold.select("fp", "first").union(rest.select("fp", "first"))


def near_duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own included. Rows with a null
    doc_id take part; a component of such rows only has a null id. Null and empty texts have fingerprint zero; very
    long ones are read whole; repeated rows are kept; other columns are ignored; an empty table gives an empty table.
    """
    work = work or Workspace(docs.sparkSession, "simhash")
    prints = work.cut(docs.select("doc_id", fingerprints().alias("fp")))
    named = _named(prints, F.min("doc_id"), work).withColumnRenamed("first", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_key(docs: DataFrame) -> list[Column]:
    """Two hashes over all columns of a row: equal for repeated rows, different for all others."""
    maps = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.MapType)}
    columns = [F.array_sort(F.map_entries(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in docs.columns]
    # a null adds nothing to a hash: which columns are null is hashed as well
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit("second"), nulls, *columns)]


def keep_first(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: exactly one row of each group stays, unchanged.

    It is the row with the smallest doc_id (null ids last); of several rows with that id, whose texts may well differ,
    the one with the smallest hash over all columns, so the choice depends neither on partitions nor on order.
    Rows of one id in different groups are judged each for itself. Repeated rows are one; columns of any name stay;
    an empty table gives an empty table.
    """
    work = work or Workspace(docs.sparkSession, "simhash")
    one, two = (fresh(name, docs) for name in ("_one", "_two"))
    first, second = _row_key(docs)
    keyed = docs.withColumns({one: first, two: second})
    prints = work.cut(docs.select("doc_id", first.alias("one"), second.alias("two"), fingerprints().alias("fp")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "one", "two"))
    chosen = _named(prints, best, work).select(F.col("first.one").alias(one), F.col("first.two").alias(two)).distinct()
    single = keyed.dropDuplicates([one, two])  # repeated rows meet in map-side aggregates before they are shuffled
    return single.join(chosen, [one, two], "left_semi").select(docs.columns)
