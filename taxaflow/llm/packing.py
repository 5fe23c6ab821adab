"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Documents (pieces) are range-sorted by length, so a piece is known by its length and its
rank among pieces of that length; open sequences are kept sorted by gap in the same way. The match runs in supersteps
from the longest band of lengths to the shortest. In each, the sorted pieces of the band and the sorted gaps of all
open sequences are cut into parts of like rank, dealt in order over ``shards`` tasks, and every task sweeps its share:
pieces from the longest down, each taking its successor gap (the smallest that holds it). Pieces that want the same
gap are served by rank; ranks beyond it go on to the next successor, and open sequences where none is left. Then the
gaps are updated, sorted and dealt anew for the next superstep.

All pieces of one length are interchangeable, and so are all sequences of one gap. Supersteps therefore move *runs*
(a length, or a gap, with a range of ranks), which stay a few thousand however many documents there are; sorting,
ranking, counting and placing the pieces themselves are Spark jobs over all rows.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, give_back, slices

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Supersteps, each for a band of lengths half as long as the one before.
BANDS = 5
#: Sequences that a task of a superstep packs at least, and tasks at most: their work is bounded by lengths, not rows.
SHARE = 10_000
MAX_SHARDS = 64
#: White-space characters in a row from which on a text is left to ``tokenizers``.
LONG_BLANK = 100_000
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, as little-endian unsigned 32-bit bytes.

    Where the file is a byte-level vocabulary whose merges stand in the order of their ids, whole texts are encoded by
    ``tiktoken`` with ranks read from that file, which is several times faster and gives the same ids (tests hold every
    character up to U+1FFFF, a sample of the others and odd texts against ``tokenizers``); special tokens in a text are
    cut out first, as ``tokenizers`` does, or are text like any other with ``plain``. Files of any other kind are left to
    ``tokenizers``, and so are texts with a run of ``LONG_BLANK`` or more white-space characters: on a run of about a
    million the rank encoder's pattern overflows its stack.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {} if plain else {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.fast = self._ranked(spec)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @staticmethod
    def _ranked(spec: dict):
        """A rank encoder of the same vocabulary, or None if the file is of another kind."""
        import tiktoken

        added = spec.get("added_tokens") or []
        bare = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in added)
        kind, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        if not (plain and bare) or spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
            return None
        letters, vocab = _byte_letters(), model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(made):
            return None
        special = {x["content"] for x in added}
        ranks = {bytes(letters[c] for c in word): k for word, k in vocab.items() if word not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or (len(text) >= LONG_BLANK and _LONG_BLANK.search(text)):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not any(map(text.__contains__, self.special)):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        out: list[int] = []
        for k, part in enumerate(self._cut.split(text)):
            out += [self.special[part]] if k % 2 else self.fast.encode_ordinary(part)
        return np.array(out, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def _piece_rows(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in slices(batches):
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                start, stop = 0, n % capacity or capacity
                piece = 0
                while start < n:
                    out.append((key, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = zip(*out)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        give_back()

    return rows


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, piece, start, length, ids_crc32``: ids and the end id, cut if longer.

    Null text is an empty one: the end id alone. Only the first piece of a cut document may be shorter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _piece_rows(path, capacity, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Sweep:
    """Best fit of runs: ranges of ranks of one length onto ranges of sequences of one gap.

    ``counts[length]`` pieces are placed at once, from the longest down; ``gaps`` are runs (gap, first sequence, how
    many) that are open already; new sequences are numbered from ``base``.
    """

    def __init__(self, counts: dict[int, int] | None = None, capacity: int = CAPACITY, gaps: Iterable[tuple[int, int, int]] = (), base: int = 0) -> None:
        self.capacity, self.base, self.sequences = capacity, base, 0
        #: rows (length, first rank, first sequence, offset) with ranks and sequences in step
        self.placed: list[tuple[int, int, int, int]] = []
        self._gaps: dict[int, list[tuple[int, int]]] = {}
        self._order: list[int] = []
        for run in gaps:
            self._free(*run)
        for length in sorted(counts or {}, reverse=True):
            self.place(length, 0, counts[length])

    def _free(self, gap: int, first: int, n: int) -> None:
        if not gap:
            return
        if gap not in self._gaps:
            self._gaps[gap] = []
            bisect.insort(self._order, gap)
        self._gaps[gap].append((first, n))

    def place(self, length: int, rank: int, n: int) -> None:
        """Ranks ``rank`` to ``rank + n`` of a length, no longer than those placed before."""
        stop = rank + n
        while rank < stop:
            at = bisect.bisect_left(self._order, length)
            if at == len(self._order):
                needed = -(-(stop - rank) // (self.capacity // length))
                self._free(self.capacity, self.base + self.sequences, needed)
                self.sequences += needed
                continue
            gap = self._order[at]
            first, size = self._gaps[gap].pop()
            if not self._gaps[gap]:
                del self._gaps[gap], self._order[at]
            taken = min(size, stop - rank)
            self.placed.append((length, rank, first, self.capacity - gap))
            rank += taken
            self._free(gap - length, first, taken)
            if taken < size:
                self._free(gap, first + taken, size - taken)

    def open(self) -> list[tuple[int, int, int]]:
        """The runs (gap, first sequence, how many) that have room left."""
        return [(gap, *run) for gap in self._order for run in self._gaps[gap]]


def _bands(capacity: int) -> list[tuple[int, int]]:
    """Lengths (over, up to) of each superstep: halves, the last from ``capacity / 16`` down."""
    tops = [capacity >> k for k in range(BANDS) if capacity >> k]
    return list(zip([*tops[1:], 0], tops))


_RUNS = "kind int, size long, first long, n long, sequence long, offset long"
_GAP, _PIECE, _PLACED = 0, 1, 2


def _swept(step: int, capacity: int):
    """One task of a superstep: the runs of a shard, a bounded number whatever the corpus."""

    def sweep(key: tuple, runs: pa.Table) -> pa.Table:
        rows = list(zip(*(runs.column(c).to_pylist() for c in ("kind", "size", "first", "n"))))
        base = (step * MAX_SHARDS + key[0].as_py()) << 40
        s = Sweep(None, capacity, sorted(r[1:] for r in rows if r[0] == _GAP), base)
        for _, length, first, n in sorted((r for r in rows if r[0] == _PIECE), key=lambda r: (-r[1], r[2])):
            s.place(length, first, n)
        out = [(_GAP, *run, None, None) for run in s.open()]
        out += [(_PLACED, length, rank, None, first, offset) for length, rank, first, offset in s.placed]
        kinds = [pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                        names=["kind", "size", "first", "n", "sequence", "offset"])

    return sweep


def _dealt(runs: DataFrame, shards: int) -> DataFrame:
    """Runs cut to parts of at most an eighth of a task's share, dealt over the tasks in the order of their sizes.

    A window over all runs of a kind: they are no more than lengths (or gaps) and cuts, not rows of the corpus.
    """
    most = F.ceil(F.sum("n").over(Window.partitionBy("kind")) / (8 * shards)).cast("long")
    parts = runs.withColumn("_q", most).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("_q")).cast("long") - 1)))
    parts = parts.select(
        "kind", "size", (F.col("first") + F.col("_i") * F.col("_q")).alias("first"),
        F.least(F.col("_q"), F.col("n") - F.col("_i") * F.col("_q")).alias("n"),
    )
    order = Window.partitionBy("kind").orderBy(F.desc("size"), "first")
    return parts.withColumn("shard", F.pmod(F.row_number().over(order), F.lit(shards)))


def match(counts: DataFrame, work: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """``counts(length, n)`` -> ``size, first, sequence, offset``: from that rank on, pieces of that length lie in step
    in the sequences from that one on, at that offset. Lengths are at most ``capacity``; no rows give none."""
    tokens = counts.agg(F.sum(F.col("length") * F.col("n"))).first()[0] or 0
    shards = int(min(MAX_SHARDS, max(1, tokens // (capacity * SHARE))))
    null = F.lit(None).cast("long")
    pieces = counts.select(F.lit(_PIECE).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n")
    runs, steps = None, []
    for step, (over, top) in enumerate(_bands(capacity)):
        band = pieces.where((F.col("size") > over) & (F.col("size") <= top))
        both = band if runs is None else band.union(runs.where(F.col("kind") == _GAP).select("kind", "size", "first", "n"))
        runs = work.cut(_dealt(both, shards).groupBy("shard").applyInArrow(_swept(step, capacity), _RUNS))
        steps.append(runs.where(F.col("kind") == _PLACED).select("size", "first", "sequence", "offset"))
    return functools.reduce(DataFrame.union, steps, pieces.select("size", "first", null.alias("sequence"), null.alias("offset")).where(F.lit(False)))


_PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _place(shared):
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, ranks, sequences, offsets = shared.value
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        found = sequences[at] + rank - ranks[at]
        return pa.StructArray.from_arrays([pa.array(found), pa.array(offsets[at])], names=["sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, work: Workspace | None = None
) -> DataFrame:
    """``docs(doc_id, text)`` -> pieces with ``sequence_id`` and ``offset``, in as few sequences as best fit finds.

    Every document gives at least one piece; null and empty texts give the end id alone; very long ones are cut,
    never shortened; repeated rows are packed each for itself; ties of length are ranked by doc_id and piece; a null
    doc_id is an id like any other; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "packing")
    path = path or str(public_tokenizers.path(TOKENIZER))
    cut = work.cut(pieces(docs, path, capacity, end))
    by_length = cut.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    placed = work.cut(by_length.withColumn("_row", F.monotonically_increasing_id()))
    work.drop(cut)
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    runs = placed.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    runs = work.cut(runs)  # range-sorted: at most one row per length and one more per partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("length", "_part", (before - F.col("_first")).alias("_shift"))
    found = match(runs.groupBy("length").agg(F.sum("n").alias("n")), work, capacity)
    table = np.array(sorted(map(tuple, found.collect())), np.int64).reshape(-1, 4)  # runs, not pieces
    shared = spark.sparkContext.broadcast(((table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]))
    ranked = placed.join(F.broadcast(starts), ["length", "_part"]).withColumn("_rank", F.col("_row") + F.col("_shift"))
    at = ranked.withColumn("_at", F.arrow_udf(_place(shared), _PLACE)("length", "_rank"))
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
