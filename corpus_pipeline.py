"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's
result as Parquet to the shared folder and rereads it as the next one's documents.

1. ``language``: rows whose language is undetermined or too uncertain go (learned from the stage's own rows).
2. ``near_duplicates``: one document of each group stays, that with the smallest doc_id.
3. ``decontaminate``: contaminated documents go; in the others the spans that stand in a test item go.
4. ``personal_data``: spans of personal data are replaced by their kind.
5. ``pack``: the last stage returns the pieces of all documents with their places in sequences.

SQL cannot express these stages, so ``ORACLE_SQL`` is None; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import decontam, langid, packing, pii, simhash
from taxaflow.llm.common import Workspace, id_mod, table
from taxaflow.session import ship, spread

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is determined with a score of ``langid.LEAST_SCORE`` or more, unchanged.

    Null, empty and letterless texts go (undetermined); null ids and null langs are judged by their text; repeated rows
    share one fate; no learnable lang, or an empty table: no rows. Columns of any name stay.
    """
    ship(spark)
    held_out = F.coalesce(id_mod("doc_id", 4) == 2, F.lit(False))
    return langid.accept(docs, langid.fit(docs.where(~held_out)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, unchanged: the smallest doc_id (null last), then the smallest row hash.

    Null and empty texts are one group; repeated rows are one row; rows of one id in different groups each have their
    own group; an empty table gives none. Columns of any name stay.
    """
    ship(spark)
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by ``benchmark``, without the spans they share with it; others are untouched.

    Null and empty texts stay; repeated rows share one fate; an empty table or benchmark changes nothing.
    """
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row; spans of personal data are replaced by their kind in brackets, and ``n_chars`` counted anew there.

    Null and empty texts, and all others without such spans, stay as they are; an empty table gives none.
    """
    ship(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences: at least one piece a row, also for null and empty texts.

    Repeated rows are packed each for itself; ties of length go by doc_id and piece; an empty table gives none.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    work = Workspace(spark, "pipeline")
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
