"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import ann, chat, decontam, langid, licences, lm, packing, pii, quality, simhash, tokalign, toxicity, trie
from .common import id_mod, table


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: one row per row; a null text is scored as an empty one; without labels every score is 0.5."""
    return quality.score(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of every document under the model of all training ones; a null text is empty (its end token alone)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_mod("doc_id", 7) == 2, F.lit(False))
    return lm.score(docs, docs.where(~held_out)).withColumn("held_out", held_out)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans by kind, their digest, and all spans; null and empty texts have none."""
    return pii.digest(_documents(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view of every dialogue, whole, in pieces of ``chat.PIECE`` turns; null texts are empty, null roles no view."""
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m.start.cast("string"), m.end.cast("string")))
    return views.withColumn("mask", F.array_join(spans, ","))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all; unusable vectors take no part; ties go to the smaller id."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: one row per row; a null text is scored as an empty one; without labels none is toxic."""
    return toxicity.score(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: ``und`` with score 0 for null texts and texts without a letter."""
    docs = _documents(spark, sf_dir, "lang")
    held_out = F.coalesce(id_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences: one at least for each row, also for null and empty texts."""
    return packing.pack(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words, null ones among them, have fingerprint zero."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of every document against all benchmark items; a null text has no words."""
    return decontam.report(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations; null roles and texts are empty, null ids take no part."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_tokalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers for every document; null and empty texts have zeros."""
    return tokalign.digest(_documents(spark, sf_dir))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of every document; null and empty texts have none."""
    return licences.digest(_documents(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles() -> dict:
    return {"op4_chat": chat.ORACLE, "op10_decontam": decontam.ORACLE, "op11_trie": trie.ORACLE}
