"""Sequences and token windows: splicing, blocks, windows, controls and packing under a budget."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.scalars import seeded_key, seeded_unit
from ..workspace import Workspace
from .order import hot_join, numbered
from .selection import small


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANTGCAN"))


#: Bases by byte: A, C, G and T in either case, N for everything else.
_BASES = bytes(ord(chr(i).upper()) if chr(i) in "ACGTacgt" else ord("N") for i in range(256))


@F.pandas_udf(T.StringType())
def normal_bases(s: pd.Series) -> pd.Series:
    """Upper case; anything but A, C, G, T becomes N.

    Bytes are looked up in a table; a letter outside ASCII is one N. (A regular expression takes its time for each N.)
    """
    return s.map(lambda x: x.encode("ascii", "replace").translate(_BASES).decode("ascii"), na_action="ignore")


def n_share(s: Column) -> Column:
    return F.try_divide((F.length(s) - F.length(F.replace(s, F.lit("N"), F.lit("")))).cast("double"), F.length(s).cast("double"))


def blocks(df: DataFrame, keys: Sequence[str], text: str, size: int) -> DataFrame:
    """``keys, block_start, seq``: pieces of ``size`` that never cross records; empty records have none.

    Letters are found by counting from the start of a string, so long texts are cut into pieces of sixteen blocks first.
    """

    def cut(rows: DataFrame, source: str, step: int, start: str, into: str) -> DataFrame:
        starts = F.when(F.length(source) > 0, F.sequence(F.lit(0), F.length(source) - 1, F.lit(step)))
        out = rows.withColumn(start, F.explode(starts))
        return out.withColumn(into, F.substring(F.col(source), F.col(start) + 1, F.lit(step))).drop(source)

    pieces = cut(df.select(*keys, F.col(text).alias("_text")), "_text", 16 * size, "_from", "_piece")
    out = cut(pieces, "_piece", size, "_in", "seq")
    return out.select(*keys, (F.col("_from") + F.col("_in")).alias("block_start"), "seq")


def segment_pieces(segments: DataFrame, block_rows: DataFrame, size: int, on: Sequence[str]) -> DataFrame:
    """The parts of each segment ``[start, end)`` in the blocks it touches: an equi-join on block numbers, clipped.

    Few segments, by the optimiser's size, are broadcast, so that blocks stay where they lie.

    ``segments(*on, start, end, ...)``, ``block_rows(*on, block_start, seq)`` with starts at multiples of ``size``.
    """
    first_block, last_block = F.floor(F.col("start") / size) * size, F.floor((F.col("end") - 1) / size) * size
    touched = segments.where(F.col("end") > F.col("start")).withColumn(
        "block_start", F.explode(F.sequence(first_block, last_block, F.lit(size).cast("long")))
    )
    joined = small(touched).join(block_rows, [*on, "block_start"])
    first = F.greatest(F.col("start") - F.col("block_start"), F.lit(0))
    last = F.least(F.col("end") - F.col("block_start"), F.length("seq").cast("long"))
    joined = joined.where(last > first)
    return joined.withColumn("piece_start", F.col("block_start") + first).withColumn(
        "piece", F.substring(F.col("seq"), (first + 1).cast("int"), (last - first).cast("int"))
    ).drop("seq")


def spliced(pieces: DataFrame, keys: Sequence[str], strand: str) -> DataFrame:
    """Pieces of each key in order, joined; the minus strand in reverse complement."""
    listed = F.array_sort(F.collect_list(F.struct("piece_start", "piece")))
    text = F.array_join(F.transform(listed, lambda p: p.piece), "")
    out = pieces.groupBy(*keys, strand).agg(text.alias("_s"))
    return out.select(*keys, strand, F.when(F.col(strand) == "-", reverse_complement(F.col("_s"))).otherwise(F.col("_s")).alias("cds"))


def cut_segments(segments: DataFrame, texts: DataFrame, keys: Sequence[str], on: str, text: str, strand: str, size: int) -> DataFrame:
    """``keys, strand, cds``: segments ``(keys, on, start, end, strand)`` cut out of whole texts and spliced, by strand.

    Texts become blocks of ``size`` where they lie, and only blocks that some segment touches are shuffled: a join of
    the touched block numbers (distinct, so a block asked for often is fetched once) keeps them.
    """
    first, last = F.floor(F.col("start") / size) * size, F.floor((F.col("end") - 1) / size) * size
    touched = segments.where(F.col("end") > F.col("start"))
    touched = touched.select(on, F.explode(F.sequence(first, last, F.lit(size).cast("long"))).alias("block_start")).distinct()
    wanted = blocks(texts.join(touched.select(on).distinct(), on, "left_semi"), [on], text, size)
    wanted = wanted.withColumn("block_start", F.col("block_start").cast("long")).join(touched, [on, "block_start"], "left_semi")
    return spliced(segment_pieces(segments, wanted, size, [on]), keys, strand)


def gene_locus(start: Column, end: Column, strand: Column, limit: int) -> Column:
    """``start, end, span`` of the first ``limit`` bases of a gene in its own direction; ``span`` is its whole length."""
    return F.struct(
        F.when(strand == "-", F.greatest(start, end - limit)).otherwise(start).alias("start"),
        F.when(strand == "-", end).otherwise(F.least(end, start + limit)).alias("end"),
        (end - start).alias("span"),
    )


def offsets(records: DataFrame, unit: str, order: str, length: str) -> DataFrame:
    """Offset of each record when those of a unit are laid end to end."""
    out = numbered(records, [unit], [order], "_at", {"offset": F.col(length)})
    return out.withColumn("offset", F.col("offset") - F.col(length)).drop("_at")


def valid_starts(spans: DataFrame, unit: str, order: str, length: str, window: int) -> DataFrame:
    """Spans with ``cum_lo, cum_hi``: numbered starts of windows that fit; spans that are too short have none."""
    n = F.greatest(F.col(length) - window + 1, F.lit(0))
    upto = numbered(spans, [unit], [order], "_at", {"cum_hi": n}).drop("_at")
    return upto.withColumn("cum_lo", F.col("cum_hi") - n).where("cum_hi > cum_lo")


def place_draws(draws: DataFrame, spans: DataFrame, unit: str) -> DataFrame:
    """Each drawn position in its span, and the ``start`` inside it.

    A draw takes the last span that begins at or before it. Both sides are merged in one distributed order: the running
    number of spans at a draw is the number of its span, and an equi-join fetches that.
    """
    a = spans.select(unit, F.col("cum_lo").alias("_at"), F.lit(0).alias("_kind"), F.struct(*[c for c in spans.columns if c != unit]).alias("_span"))
    b = draws.select(unit, F.col("position").alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in draws.columns if c != unit]).alias("_draw"))
    both = numbered(a.unionByName(b, allowMissingColumns=True), [unit], ["_at", "_kind"], "_n", {"_no": F.col("_kind") == 0})
    placed = hot_join(both.where("_kind = 1").select(unit, "_no", "_draw"), both.where("_kind = 0").select(unit, "_no", "_span"), [unit, "_no"])
    return placed.select(unit, "_draw.*", "_span.*").withColumn("start", F.col("position") - F.col("cum_lo"))


def token_windows(blocks: DataFrame, unit: str, order: Sequence[str], ids: str, n: int, body: int = fixed.BODY_TOKENS, seed: int = 0) -> DataFrame:
    """``unit, chunk_id, order..., start, input_ids``: ``n`` uniform windows of ``body`` tokens for each unit, with specials.

    ``blocks(unit, order..., ids)``: every valid start inside a block is equally likely; windows never cross blocks, are
    drawn with replacement and fixed by the seed. Units without a block of ``body`` tokens have none. Only the sizes of
    blocks are sorted; tokens are fetched by a join on the drawn blocks.
    """
    sizes = blocks.select(unit, F.struct(*order).alias("_block"), F.size(ids).alias("_n"))
    spans = valid_starts(sizes, unit, "_block", "_n", body)
    totals = spans.groupBy(unit).agg(F.max("cum_hi").alias("_total"))
    draws = totals.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    position = F.floor(seeded_unit(seed, F.col(unit), F.col("chunk_id")) * F.col("_total"))
    placed = place_draws(draws.select(unit, "chunk_id", position.alias("position")), spans, unit)
    placed = placed.select(unit, "chunk_id", "_block", F.col("start").cast("int").alias("start"))
    tokens = blocks.select(unit, F.struct(*order).alias("_block"), F.col(ids).alias("_ids"))
    out = placed.join(tokens, [unit, "_block"])
    return out.select(unit, "chunk_id", "_block.*", "start", with_specials(F.slice("_ids", F.col("start") + 1, F.lit(body))).alias("input_ids"))


def sampled_windows(
    block_rows: DataFrame, unit: str, record: str, block: int, window: int, n: int, *, seed: int = 0,
    most: float = fixed.MAX_N_SHARE, tries: int = fixed.MAX_DRAWS, complete: bool = True, work: Workspace | None = None,
) -> DataFrame:
    """``unit, slot, draw, record, start, seq``: ``n`` random windows of each unit with few unknown bases.

    ``block_rows(unit, record, block_start, seq)``: sequences in blocks of ``block`` letters, starts at its multiples.
    Every start of a window that lies inside a record is equally likely. Slot ``s`` of a unit draws until a window has a
    share of unknown bases of at most ``most``: draw ``d`` is fixed by seed, unit, slot and ``d``, so windows depend
    neither on rows nor on each other. Rounds of more and more draws (4, then four times as many) are made only for
    slots that are still open: drawn, placed in records, fetched across the borders of blocks, judged. A unit without a
    record of ``window`` letters, or with a slot that is open after ``tries`` draws, raises an error that names it; if not
    ``complete``, such units and slots have no rows, and neither has a null unit.
    """
    work = work or Workspace(block_rows.sparkSession, "windows")
    if not complete:
        block_rows = block_rows.where(F.col(unit).isNotNull())
    sizes = block_rows.groupBy(unit, record).agg(F.sum(F.length("seq")).alias("_n"))
    spans = work.cut(valid_starts(sizes, unit, record, "_n", window).select(unit, record, "cum_lo", "cum_hi"))
    totals = spans.groupBy(unit).agg(F.max("cum_hi").alias("_total"))
    short = block_rows.select(unit).distinct().join(totals, unit, "left_anti")
    if complete and (names := [r[unit] for r in short.orderBy(unit).limit(fixed.MESSAGES).collect()]):
        raise ValueError(f"no sequence of at least {window} letters: {names}")
    slots = totals.select(unit, "_total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    done, low, high = None, 0, min(4, tries)
    while low < tries:
        drawn = slots.withColumn("draw", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        position = F.floor(seeded_unit(seed, F.col(unit), F.col("slot"), F.col("draw")) * F.col("_total"))
        placed = place_draws(drawn.select(unit, "slot", "draw", position.alias("position")), spans, unit)
        segments = placed.select(unit, record, "slot", "draw", "start", (F.col("start") + window).alias("end"), F.lit("+").alias("strand"))
        segments = work.cut(segments)  # of known size: while few, blocks are not shuffled
        pieces = segment_pieces(segments, block_rows, block, [unit, record])
        read = spliced(pieces, [unit, "slot", "draw", record, "start"], "strand").drop("strand").withColumnRenamed("cds", "seq")
        few = read.where(n_share(F.col("seq")) <= most)
        first = few.withColumn("_r", F.row_number().over(Window.partitionBy(unit, "slot").orderBy("draw"))).where("_r = 1").drop("_r")
        found = work.cut(first)
        done = found if done is None else done.unionByName(found)
        slots = work.cut(slots.join(found.select(unit, "slot"), [unit, "slot"], "left_anti"))
        if not slots.limit(1).count():
            return done
        low, high = high, min(high * 4, tries)
    if not complete:
        return done
    names = [r[unit] for r in slots.select(unit).distinct().orderBy(unit).limit(fixed.MESSAGES).collect()]
    raise ValueError(f"no window with a share of unknown bases of at most {most} in {tries} draws: {names}")


def good_windows(candidates: DataFrame, unit: str, sequence: str, n: int, most: float = fixed.MAX_N_SHARE) -> DataFrame:
    """The first ``n`` drawn windows of each unit with a share of unknown bases of at most ``most``."""
    few = candidates.where(n_share(F.col(sequence)) <= most)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy("draw"))).where(F.col("_r") <= n).drop("_r")


def lacking(windows: DataFrame, units: DataFrame, unit: str, n: int) -> DataFrame:
    """``unit, n_windows``: units with fewer than ``n`` good windows after all draws; must be empty."""
    got = windows.groupBy(unit).agg(F.count("*").alias("n_windows"))
    return units.select(unit).distinct().join(got, unit, "left").fillna({"n_windows": 0}).where(F.col("n_windows") < n)


# ---------------------------------------------------------------- tokens


def with_specials(ids: Column) -> Column:
    return F.concat(F.array(F.lit(fixed.FIRST_TOKEN)), ids, F.array(F.lit(fixed.LAST_TOKEN)))


def crop(ids: Column, body: int = fixed.BODY_TOKENS, seed: int | None = None, *keys: Column) -> Column:
    """The first window, or with a seed a uniform one fixed by seed and keys."""
    if seed is None:
        return F.slice(ids, 1, body)
    spare = F.greatest(F.size(ids) - body, F.lit(0)) + 1
    return F.slice(ids, F.floor(seeded_unit(seed, *keys) * spare).cast("int") + 1, F.lit(body))


def window_count(n: Column, body: int = fixed.BODY_TOKENS) -> Column:
    return F.greatest(F.ceil(n / body), F.lit(1))


def equal_windows(ids: Column, body: int = fixed.BODY_TOKENS) -> Column:
    """All of the tokens in as few windows as fit, of nearly equal length."""
    n = F.size(ids)
    step = F.greatest(F.ceil(n / window_count(n, body)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda s: F.slice(ids, s + 1, step))


def padded(ids: Column, length: Column) -> Column:
    """``ids`` filled up to ``length``, and the mask of real tokens."""
    spare = F.greatest(length - F.size(ids), F.lit(0))
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(fixed.PAD_TOKEN), spare)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), spare)).alias("mask"),
    )


def shuffled(ids: Column, seed: int, key: Column) -> Column:
    """Tokens in an order fixed by seed, key and place; first and last stay where they are specials."""
    lead = F.get(ids, F.lit(0)) == fixed.FIRST_TOKEN
    tail = F.element_at(ids, -1) == fixed.LAST_TOKEN
    first, last = F.coalesce(lead, F.lit(False)).cast("int"), F.coalesce(tail, F.lit(False)).cast("int")
    inner = F.slice(ids, first + 1, F.greatest(F.size(ids) - first - last, F.lit(0)))
    keyed = F.transform(inner, lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("k"), x.alias("x")))
    mixed = F.transform(F.array_sort(keyed), lambda p: p.x)
    return F.concat(F.slice(ids, 1, first), mixed, F.slice(ids, F.size(ids) - last + 1, last))


def budget_batches(df: DataFrame, key: str, length: str, budget: int, bucket: int = 8192, seed: int = 0, windows: str | None = None) -> DataFrame:
    """``key, bucket, batch``: batches of similar lengths whose longest times windows stays within a token budget.

    Rows in a seeded order are cut into buckets of ``bucket`` rows; inside one they are taken by rising length (ties by
    key) and a batch closes when one more row would not fit. A row counts as its ``windows`` (1 where not given), and
    alone may exceed the budget. The fold over a bucket's sorted array keeps where batches begin and nothing else.
    """
    wins = F.col(windows) if windows else F.lit(1)
    rows = df.select(key, F.col(length).cast("long").alias("l"), wins.cast("long").alias("w"))
    placed = numbered(rows, [], [seeded_key(seed, F.col(key)), key], "_at")
    bucket_of = F.floor((F.col("_at") - 1) / bucket).alias("bucket")
    held = placed.groupBy(bucket_of).agg(F.sort_array(F.collect_list(F.struct("l", F.col(key).alias("k"), "w"))).alias("rows"))
    state = lambda longest, n, at, starts: F.struct(longest.alias("longest"), n.alias("n"), at.alias("at"), starts.alias("starts"))
    nought = F.lit(0).cast("long")

    def step(s: Column, x: Column) -> Column:
        closes = (s.n == 0) | (F.greatest(s.longest, x.l) * (s.n + x.w) > budget)
        return F.when(closes, state(x.l, x.w, s.at + 1, F.concat(s.starts, F.array(s.at)))).otherwise(
            state(F.greatest(s.longest, x.l), s.n + x.w, s.at + 1, s.starts)
        )

    starts = F.aggregate("rows", state(nought, nought, F.lit(0), F.array().cast("array<int>")), step, lambda s: s.starts)
    cut = held.withColumn("starts", starts)
    cut = cut.select("bucket", "rows", "starts", F.posexplode("starts").alias("batch", "first"))
    stop = F.coalesce(F.get("starts", F.col("batch") + 1), F.size("rows"))
    out = cut.select("bucket", "batch", F.explode(F.slice("rows", F.col("first") + 1, stop - F.col("first"))).alias("x"))
    return out.select(F.col("x.k").alias(key), "bucket", "batch")


def chunk_budget(rows: DataFrame, unit: str, tokens: str, body: int = fixed.BODY_TOKENS) -> DataFrame:
    """``unit, examples, tokens, chunks``: chunks worth the tokens used, at least one, half up."""
    out = rows.groupBy(unit).agg(F.count("*").alias("examples"), F.sum(F.least(F.col(tokens), F.lit(body))).alias("tokens"))
    return out.withColumn("chunks", F.greatest(F.lit(1), F.floor(F.col("tokens") / body + 0.5)).cast("long"))


def over_budget(budget: DataFrame, most: int = 1000) -> DataFrame:
    """Units whose budget is more chunks than a pool holds; must be empty."""
    return budget.where(F.col("chunks") > most)


def input_statistics(rows: DataFrame, split: str, species: str, tokens: str, body: int = fixed.BODY_TOKENS) -> DataFrame:
    """Per split: species, pairs, windows and tokens with two specials for each window."""
    w = window_count(F.col(tokens), body)
    return rows.groupBy(split).agg(
        F.count_distinct(species).alias("n_species"),
        F.count("*").alias("n_pairs"),
        F.sum(w).cast("long").alias("n_windows"),
        F.sum(F.col(tokens) + 2 * w).cast("long").alias("n_tokens"),
    )


def seeded_chunks(rows: DataFrame, unit: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Rows of each unit numbered by ``chunk_id`` in a seeded order, the first ``n``."""
    at = F.row_number().over(Window.partitionBy(unit).orderBy(seeded_key(seed, F.col(key)), key)) - 1
    return rows.withColumn("chunk_id", at).where(F.col("chunk_id") < n)
