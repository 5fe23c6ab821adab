"""Alignment of the tokens that two tokenizers give the same text, and counts of the id pairs that it links.

A is a byte-level vocabulary, B a piece vocabulary with byte fallback that puts a space before a text; both cut the bytes
of space + text. Byte offsets where tokens of both end cut these into groups. Inside a group every token of A is linked
with every token of B whose bytes overlap it; an elementary stretch between two ends, of whichever side, is one link.

*Identity path.* An array over A's ids holds the id of B with the same bytes. A group of one token each whose B id is the
one in that array is exact; such groups are nearly all of plain text, and are counted by A id alone in one vector of
vocabulary length for each partition. Only links of irregular groups enter the shuffle of id pairs, and those of a
document are summed before it.

Counts of the ``HEAD`` most frequent pairs at most, and the vectors, are broadcast when documents are scored; pairs below
a threshold of count are joined instead, so no table that grows with the corpus is broadcast or sent to the driver.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, give_back, slices
from .packing import Encoder, _byte_letters

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Pairs whose counts are broadcast at most (16 bytes each).
HEAD = 500_000
_SPACE = "▁"


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the identity array."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = Encoder(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocab = self.a.model.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            self.bytes_a[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(k) else piece.replace(_SPACE, " ").encode())
        same: dict[bytes, int] = {}
        for k, x in enumerate(self.bytes_b):  # a piece rather than the byte of the same bytes
            if not (self.b.is_control(k) or self.b.is_unknown(k)) and (x not in same or self.b.is_byte(same[x])):
                same[x] = k
        self.identity = np.array([same.get(x, -1) for x in self.bytes_a], np.int64)
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        spell = lambda n, end: np.array([b"%d%s" % (k, end) for k in range(n)], object)
        self.spelled = [spell(len(t), end) for t, end in ((self.bytes_a, b","), (self.bytes_a, b"|"), (self.bytes_b, b","), (self.bytes_b, b";"))]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text; None for null and empty ones and where the bytes are not those of space + text."""
        out: list = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            found = None
            if text:
                data = b" " + text.encode()
                if b"".join(map(self.bytes_b.__getitem__, b)) == data:
                    a = np.frombuffer(self.a(" " + text), "<u4").astype(np.int64)
                    if b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data:
                        found = (a, np.array(b, np.int64))
            out.append(found)
        return out


@functools.lru_cache(1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Aligned:
    """The groups and links of a batch of texts, side by side: bytes of all texts are laid end to end."""

    def __init__(self, t: Tokenizers, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        none = [np.zeros(0, np.int64)]
        self.t, self.n = t, len(pairs)
        a, b = (np.concatenate(none + [p[k] for p in pairs]) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b])
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        stop_a, stop_b = ends_a[at_a] == ends, ends_b[at_b] == ends
        both = stop_a & stop_b
        group = np.cumsum(both) - both
        doc = np.repeat(np.arange(self.n), self.n_a)[at_a]
        self._a, self._b, self._group_a, self._group_b = a, b, group[stop_a], group[stop_b]
        n_groups = int(both.sum())
        self._in_a, self._in_b = np.bincount(self._group_a, minlength=n_groups), np.bincount(self._group_b, minlength=n_groups)
        self.n_groups = np.bincount(doc[both], minlength=self.n)
        self.n_links = np.bincount(doc, minlength=self.n)
        link_a, link_b = a[at_a], b[at_b]
        single = (self._in_a == 1) & (self._in_b == 1)
        exact = single[group] & (t.identity[link_a] == link_b) if n_groups else np.zeros(0, bool)
        width = len(t.bytes_b)
        self.exact = self._counted(doc[exact], link_a[exact], len(t.bytes_a))
        self.others = self._counted(doc[~exact], link_a[~exact] * width + link_b[~exact], len(t.bytes_a) * width)

    def _counted(self, doc: np.ndarray, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of each text and how often: (bounds of texts, keys, times)."""
        code, times = np.unique(doc * size + key, return_counts=True)
        return np.searchsorted(code, np.arange(self.n + 1) * size), code % size, times

    def spelled(self) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        a_comma, a_bar, b_comma, b_semi = self.t.spelled
        upto_a, upto_b = np.cumsum(self._in_a), np.cumsum(self._in_b)
        n_a, n_b = np.arange(len(self._a)), np.arange(len(self._b))
        out = np.empty(len(n_a) + len(n_b), object)
        last_a, last_b = n_a + 1 == upto_a[self._group_a], n_b + 1 == upto_b[self._group_b]
        out[n_a + (upto_b - self._in_b)[self._group_a]] = np.where(last_a, a_bar[self._a], a_comma[self._a])
        out[n_b + upto_a[self._group_b]] = np.where(last_b, b_semi[self._b], b_comma[self._b])
        edges = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return [b"".join(out[i:j].tolist())[:-1] for i, j in zip(edges, edges[1:])]


def _lists(counted: tuple[np.ndarray, np.ndarray, np.ndarray], place: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Keys and times as list columns of ``n`` rows; texts without tokens have empty lists."""
    bounds, keys, times = counted
    sizes = np.zeros(n, np.int64)
    sizes[place] = np.diff(bounds)
    edges = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int64))) for x in (keys, times))


def _align_rows(path_a: str, path_b: str, groups: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in slices(batches, 128):
            n = batch.num_rows
            found = t.encode(batch.column(1).to_pylist())
            place = np.array([k for k, f in enumerate(found) if f is not None], np.int64)
            done = Aligned(t, [f for f in found if f is not None])
            columns = [batch.column(0)]
            for counts in (done.n_a, done.n_b, done.n_groups, done.n_links):
                full = np.zeros(n, np.int64)
                full[place] = counts
                columns.append(pa.array(full))
            texts, hashes = [""] * n, [""] * n
            for k, spelled in zip(place.tolist(), done.spelled()):
                hashes[k] = hashlib.sha256(spelled).hexdigest()
                texts[k] = spelled.decode() if groups else ""
            columns += [pa.array(hashes, pa.string()), *_lists(done.exact, place, n), *_lists(done.others, place, n)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "exact", "exact_times", "others", "others_times"]
            if groups:
                columns.append(pa.array(texts, pa.string()))
                names.append("groups")
            yield pa.record_batch(columns, names=names)
        give_back()

    return rows


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return path_a or str(public_tokenizers.path(TOKENIZER_A)), path_b or str(public_tokenizers.path(TOKENIZER_B))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256``, and its links.

    ``exact, exact_times``: A ids of exact groups and how often; ``others, others_times``: pairs (A id times the size of
    B's vocabulary plus B id) of all other links. With ``groups`` the groups themselves as text. Null and empty texts,
    and those whose bytes a tokenizer changes, have no tokens: zeros and an empty hash. Very long texts are aligned
    whole; repeated rows each for itself; other columns are ignored; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "exact array<long>, exact_times array<long>, others array<long>, others_times array<long>"
    ) + (", groups string" if groups else "")
    return docs.select("doc_id", "text").mapInArrow(_align_rows(*_paths(path_a, path_b), groups), schema)


def _vectors(path_a: str, path_b: str):
    """Exact groups of a partition, summed by A id in one vector."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        total = np.zeros(len(t.bytes_a), np.int64)
        for batch in batches:
            ids, times = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, ids, times)
        a = np.flatnonzero(total)
        yield pa.record_batch([pa.array(a * len(t.bytes_b) + t.identity[a]), pa.array(total[a])], names=["pair", "n"])

    return rows


def pair_counts(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``pair, n``: how many links of all rows of ``align`` hold an A id times the size of B's vocabulary plus a B id."""
    exact = aligned.select("exact", "exact_times").mapInArrow(_vectors(*_paths(path_a, path_b)), "pair long, n long")
    zipped = F.explode(F.arrays_zip("others", "others_times")).alias("z")
    others = aligned.select(zipped).select(F.col("z.others").alias("pair"), F.col("z.others_times").alias("n"))
    return exact.union(others).groupBy("pair").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, head: int) -> int:
    """The smallest count such that at most ``head`` pairs have it or more; counts are binned by their leading bits."""
    bits = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    low = F.greatest(bits - 6, F.lit(0))
    bins = counts.groupBy(F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), low), low).alias("least")).count()
    held = 0
    for r in sorted(bins.collect(), reverse=True):  # some 60 * 64 rows at most
        if held + r["count"] > head:
            return _above(r["least"])
        held += r["count"]
    return 0


def _above(least: int) -> int:
    """The first count beyond the bin that begins with ``least``."""
    return least + (1 << max(least.bit_length() - 1 - 6, 0))


_SCORED = T.StructType(
    [
        T.StructField("n_best", T.LongType()),
        T.StructField("count_sum", T.LongType()),
        T.StructField("rest", T.ArrayType(T.LongType())),
        T.StructField("rest_times", T.ArrayType(T.LongType())),
    ]
)
_SCORED_ARROW = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.int64())), ("rest_times", pa.list_(pa.int64()))])


def _scorer(shared):
    def score(exact: pa.Array, exact_times: pa.Array, others: pa.Array, others_times: pa.Array) -> pa.Array:
        by_a, best_a, keys, counts, best = shared.value
        rows = []
        for row in zip(exact, exact_times, others, others_times):
            e, et, o, ot = (x.values.to_numpy(zero_copy_only=False) for x in row)
            at = np.minimum(np.searchsorted(keys, o), max(len(keys) - 1, 0))
            known = keys[at] == o if len(keys) else np.zeros(len(o), bool)
            hit, times = at[known], ot[known]
            rows.append(
                {
                    "n_best": int(et[best_a[e]].sum() + times[best[hit]].sum()),
                    "count_sum": int((by_a[e] * et).sum() + (counts[hit] * times).sum()),
                    "rest": o[~known].tolist(),
                    "rest_times": ot[~known].tolist(),
                }
            )
        return pa.array(rows, _SCORED_ARROW)

    return score


def digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, head: int = HEAD, work: Workspace | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    ``n_best`` counts a row's links whose pair is the most frequent of all pairs with that B id (ties included),
    ``count_sum`` adds the counts of its links' pairs; counts are those of the whole table. Odd rows: see ``align``.
    """
    spark, work = docs.sparkSession, work or Workspace(docs.sparkSession, "tokalign")
    paths = _paths(path_a, path_b)
    t = tokenizers(*paths)
    width = len(t.bytes_b)
    aligned = work.cut(align(docs, *paths).withColumn("_row", F.monotonically_increasing_id()))
    counts = work.cut(pair_counts(aligned, *paths))
    least = _threshold(counts, head)
    best = np.zeros(width, np.int64)
    for r in counts.groupBy(F.pmod("pair", F.lit(width)).alias("b")).agg(F.max("n").alias("n")).collect():  # B's vocabulary
        best[r["b"]] = r["n"]
    same = [k * width + b for k, b in enumerate(t.identity.tolist()) if b >= 0]
    known = spark.createDataFrame([(x,) for x in same], "pair long")  # A's vocabulary
    by_a = np.zeros(len(t.bytes_a), np.int64)
    for r in counts.join(F.broadcast(known), "pair", "left_semi").collect():
        by_a[r["pair"] // width] = r["n"]
    top = counts.where(F.col("n") >= least).toArrow().sort_by("pair").combine_chunks()  # at most ``head`` rows
    keys, times = (top.column(c).to_numpy() for c in ("pair", "n"))
    shared = spark.sparkContext.broadcast(
        (by_a, (by_a == best[t.identity]) & (t.identity >= 0), keys, times, times == best[keys % width])
    )
    scored = aligned.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.arrow_udf(_scorer(shared), _SCORED)("exact", "exact_times", "others", "others_times").alias("s"))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not least:
        return scored.select(*out[:5], "s.n_best", "s.count_sum", "groups_sha256")
    scored = work.cut(scored)
    bests = spark.createDataFrame([(k, int(n)) for k, n in enumerate(best) if n], "b long, most long")
    tail = counts.where(F.col("n") < least).withColumn("b", F.pmod("pair", F.lit(width))).join(F.broadcast(bests), "b")
    rest = scored.select("_row", F.explode(F.arrays_zip("s.rest", "s.rest_times")).alias("z")).select("_row", F.col("z.rest").alias("pair"), F.col("z.rest_times").alias("times"))
    more = rest.join(tail, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum")
    )
    full = scored.join(more, "_row", "left")
    add = lambda old, new: (F.col(f"s.{old}") + F.coalesce(F.col(new), F.lit(0))).alias(old)
    return full.select(*out[:5], add("n_best", "_best"), add("count_sum", "_sum"), "groups_sha256")
