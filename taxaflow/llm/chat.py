"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a dialogue it is rendered once with that speaker as ``assistant`` and all others as
named users; system turns stay system turns and are nobody's perspective. The mask holds the spans the model
learns from: the speaker's own texts with their end markers.

A view is a sequence of pieces of ``PIECE`` turns, so that no row grows with a dialogue. Its places count on through all
pieces: joined in order they are the whole view, with every turn since the first before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

START, STOP = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
OWN = f"{START}assistant\n"
#: Turns in one piece of a view. A dialogue of more turns has several pieces.
PIECE = 512
#: Turns of a dialogue beyond which they are ordered in many tasks.
LONG = 100_000
#: Pieces of one dialogue that meet in one task with its speakers.
_BLOCK = 64


def _named(who: Column) -> Column:
    return F.concat(F.lit(f"{START}user name="), who, F.lit("\n"))


def _header(who: Column, speaker: Column) -> Column:
    return (
        F.when(who == speaker, OWN).when(who == SYSTEM, f"{START}{SYSTEM}\n").otherwise(_named(who))
    )


def _running(value: Column, *by: str, order: tuple[str, ...], through: int = Window.currentRow) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, through))


def _matched(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows joined to a table of the same keys; null keys match each other."""
    theirs = table.withColumnsRenamed({c: f"_their_{c}" for c in on})
    return rows.join(theirs, [F.col(c).eqNullSafe(F.col(f"_their_{c}")) for c in on], how).drop(*(f"_their_{c}" for c in on))


def _stretched(said: DataFrame, long: int) -> tuple[DataFrame, bool]:
    """``said`` with ``stretch``, and whether a dialogue lies in several stretches.

    A stretch holds turns of a dialogue that follow each other: the whole of it, or for dialogues of more than ``long``
    turns, and more than 1/1,048,576 of all (fewer than that many, so their ids are broadcast), those of one of many
    ranges of the order. Ranges are written, so that what counts on them stays right if a task runs again.
    """
    sizes = said.groupBy("conv_id").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    least = max(long, (total or 0) >> 20)
    whole = said.withColumn("stretch", F.lit(0))
    if (most or 0) <= least:
        return whole, False
    work = Workspace(said.sparkSession, "chat")
    hot = F.broadcast(work.cut(sizes.where(F.col("n") > least).select("conv_id")))
    # equal turns may change places with each other, so any number parts a great many of them
    ranged = _matched(said, hot, ["conv_id"], "left_semi").withColumn("copy", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange("conv_id", "turn", "who", "body", "copy").drop("copy")
    ranged = work.cut(ranged.withColumn("stretch", F.spark_partition_id()))
    return _matched(whole, hot, ["conv_id"], "left_anti").unionByName(ranged), True


def rotate(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", piece_turns: int = PIECE, long: int = LONG
) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask`` with mask an array of ``start, end`` (code points).

    Every view of every dialogue, in the order of (turn, speaker, text), whole: ``part`` numbers its pieces of
    ``piece_turns`` turns from 0, and spans count from the start of piece 0. Repeated rows are turns of their own. Null
    texts are empty; null speakers are users named ``unknown`` and no perspective; null turns come first; a null
    conversation id is one conversation. Dialogues of system turns only, and empty tables, give no rows. Other columns are
    ignored. Dialogues of more than ``long`` turns are ordered in many tasks, with the same result.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("who"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    said, parted = _stretched(said, long)
    # Views differ only in the headers of the speaker's own turns, so an end in its view is the end in the text
    # with all named, moved by the difference of headers for each own turn up to there.
    named = (F.length(_header(F.col("who"), F.lit(None).cast("string"))) + F.length("body") + len(STOP)).cast("long")
    stretch, order = ("conv_id", "stretch"), ("turn", "who", "body")
    said = said.withColumns({"k": _running(F.lit(1), *stretch, order=order), "end": _running(named, *stretch, order=order)})
    said = said.withColumn("own", _running(F.lit(1), *stretch, "who", order=("k",)))
    if parted:
        # What a stretch adds is summed in it; only these sums, one for each stretch, are then put in order.
        upto = said.groupBy(*stretch).agg(F.max("k").alias("k0"), F.max("end").alias("end0"))
        own_upto = said.groupBy(*stretch, "who").agg(F.max("own").alias("own0"))
        before = {c: F.coalesce(_running(F.col(c), "conv_id", order=("stretch",), through=-1), F.lit(0)) for c in ("k0", "end0")}
        own_before = F.coalesce(_running(F.col("own0"), "conv_id", "who", order=("stretch",), through=-1), F.lit(0))
        said = _matched(said, upto.withColumns(before).where("k0 > 0"), list(stretch), "left")
        said = _matched(said, own_upto.withColumn("own0", own_before).where("own0 > 0"), [*stretch, "who"], "left")
        said = said.withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}0"), F.lit(0)) for c in ("k", "end", "own")})
    end = F.col("end") + F.col("own") * (len(OWN) - F.length(_named(F.col("who"))))
    said = said.withColumns({"end": end, "start": end - F.length("body") - len(STOP)})
    part = F.floor((F.col("k") - 1) / piece_turns).cast("long")
    parts = said.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("k", "who", "body", "start", "end"))).alias("said")
    )
    speakers = turns.select(F.col(conv).alias("conv_id"), F.col(speaker).alias("speaker")).distinct()
    speakers = speakers.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM))
    if parted:
        # speakers are told to every block of pieces, so that the pieces of a dialogue do not meet in one task
        block = F.floor(F.col("part") / _BLOCK)
        blocks = said.groupBy("conv_id").agg(F.floor((F.max("k") - 1) / (piece_turns * _BLOCK)).alias("last"))
        told = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
        speakers = _matched(speakers, blocks, ["conv_id"], "inner").select("conv_id", "speaker", told.alias("block"))
        views = _matched(parts.withColumn("block", block), speakers, ["conv_id", "block"], "inner")
    else:
        views = _matched(parts, speakers, ["conv_id"], "inner")
    pieces = F.transform("said", lambda t: F.concat(_header(t.who, F.col("speaker")), t.body, F.lit(STOP)))
    mine = F.filter("said", lambda t: t.who == F.col("speaker"))
    return views.select(
        "conv_id",
        "speaker",
        "part",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(pieces, "").alias("text"),
        F.transform(mine, lambda t: F.struct(t.start.alias("start"), t.end.alias("end"))).alias("mask"),
    )


#: DuckDB twin of the query, its mask as ``start:end`` joined by commas.
ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS who, coalesce(text, '') AS body FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
pieces AS (
  SELECT s.*, p.speaker,
         CASE WHEN who = speaker THEN '{START}assistant' WHEN who = '{SYSTEM}' THEN '{START}{SYSTEM}'
              ELSE '{START}user name=' || who END || chr(10) || body || '{STOP.strip()}' || chr(10) AS piece
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS k, sum(length(piece)) OVER w AS stop FROM pieces
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, (k - 1) // {PIECE} AS part, count(*) AS n_turns, string_agg(piece, '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN who = speaker THEN
         CAST(CAST(stop - length(body) - {len(STOP)} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END,
         ',' ORDER BY k), '') AS mask
FROM placed GROUP BY conv_id, speaker, part"""
