"""Policies, audits and comparisons of runs and pools over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import drift as D
from ..operators import metrics as M
from ..operators import sequences as Q
from ..operators import tables as B
from ..operators import taxonomy as X
from ..operators import validation as V
from ..sources import fasta
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query("""
WITH a AS (SELECT o_orderkey AS acc, o_custkey % 60 AS sp, o_orderstatus AS st, o_orderpriority AS p, o_totalprice AS size, o_orderdate AS d, 'c' || (o_custkey % 3) AS class FROM orders),
k AS (SELECT a.*, coalesce(size BETWEEN least AND most, FALSE) AS ok FROM a LEFT JOIN (VALUES ('c0', 50000, 150000), ('c1', 10000, 90000)) s(class, least, most) USING (class))
SELECT sp AS species_taxid, 'A' || acc AS assembly_accession, ok AS plausible FROM k
QUALIFY row_number() OVER (PARTITION BY sp ORDER BY ok DESC, CASE WHEN st = 'O' THEN 0 ELSE 1 END, p = '5-LOW', p = '4-NOT SPECIFIED', CASE WHEN acc % 3 = 0 THEN 0 ELSE 1 END,
  CASE p WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, strftime(d, '%Y-%m-%d') DESC NULLS LAST, 'A' || acc) = 1""")
def plausible_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assemblies: the best of each species by the stricter policy."""
    p, key = F.col("o_orderpriority"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("A"), key).alias("assembly_accession"), (F.col("o_custkey") % 60).alias("species_taxid"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("class"),
        F.when(F.col("o_orderstatus") == "O", "ncbi_refseq").otherwise("ncbi_genbank").alias("source"), F.col("o_totalprice").alias("genome_size"),
        F.when(p == "5-LOW", "x Alternate haplotype").otherwise("x").alias("asm_name"), F.when(p == "4-NOT SPECIFIED", "partial").otherwise("").alias("excluded_from_refseq"),
        key.alias("taxid"), F.when(key % 3 == 0, key).otherwise(-1).alias("named_taxid"),
        F.when(p == "1-URGENT", fixed.CATEGORIES[0]).when(p == "2-HIGH", fixed.CATEGORIES[1]).alias("refseq_category"), F.lit("x").alias("assembly_level"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("seq_rel_date"),
    )
    sizes = spark.createDataFrame([("c0", 50_000, 150_000), ("c1", 10_000, 90_000)], "class string, least long, most long")
    best = X.plausible_assembly(rows, sizes)
    c, size = F.col("class"), F.col("genome_size")
    ok = F.when(c == "c0", size.between(50_000, 150_000)).when(c == "c1", size.between(10_000, 90_000)).otherwise(F.lit(False))
    return best.select("species_taxid", "assembly_accession", ok.alias("plausible"))


@_r.query("""
SELECT source, count_if(lang = 'en') AS en, count_if(lang = 'de') AS de, count_if(lang = 'fr') AS fr, round(avg(CASE WHEN lang IN ('en', 'de') THEN 1.0 ELSE 0.0 END), 7) AS living_share
FROM documents GROUP BY 1""")
def audit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language as an audit of categories."""
    out = B.audit_matrix(table(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "fr"], ["en", "de"])
    return out.withColumn("living_share", F.round("living_share", 7))


@_r.query("""
WITH i AS (SELECT 'S' || (l_suppkey % 8) AS source, lower(p_name) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 5 <> 0),
r AS (SELECT DISTINCT lower(p_name) AS s FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT source, s, count(*) AS n, s IN (SELECT s FROM r) AS k FROM i GROUP BY ALL)
SELECT source, count(*) AS n_species, sum(n)::BIGINT AS n_images, count_if(k) AS n_shared, coalesce(sum(CASE WHEN k THEN n END), 0)::BIGINT AS n_shared_images,
       count_if(n >= 2) AS n_2, count_if(n >= 50) AS n_50 FROM n GROUP BY 1""")
def dataset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as species by their two-word names, order lines as images, and a reference with every other part."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 5 == 0, "no").otherwise(F.concat(F.upper("p_name"), F.lit(" (L.)")))
    lines = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), name.alias("name")), "l_partkey")
    images = lines.select(F.concat(F.lit("S"), F.col("l_suppkey") % 8).alias("source"), "name")
    reference = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"))
    return B.dataset_overlap(images, reference, source="source", name="name", many=(2, 50))


@_r.query("""
SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS n_labels, (SELECT count(DISTINCT doc_id) FROM documents WHERE lang = 'en') AS n_english,
       (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en')) AS n_all,
       (SELECT count(*) FROM (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'en')) AS n_any""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled, English, both and either."""
    return B.coverage({"labels": table(spark, sf_dir, "labels"), "english": table(spark, sf_dir, "documents").where("lang = 'en'")}, "doc_id")


@_r.query("""
WITH n AS (SELECT source, count(*) AS examples, sum(least(n_chars, 400))::BIGINT AS tokens FROM documents GROUP BY 1),
b AS (SELECT *, greatest(1, CAST(floor(tokens / 400.0 + 0.5) AS BIGINT)) AS chunks FROM n)
SELECT source, chunks, examples FROM b WHERE chunks > 9""")
def over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources worth more than nine chunks of 400 characters."""
    budget = Q.chunk_budget(table(spark, sf_dir, "documents"), "source", "n_chars", 400)
    return Q.over_budget(budget, 9).select("source", "chunks", "examples")


@_r.query("""
WITH g AS (SELECT doc_id, count(*) AS n FROM documents, range(4) r(i) WHERE n_chars >= (i + 1) * 500 GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_windows FROM documents LEFT JOIN g USING (doc_id) WHERE coalesce(n, 0) < 3""")
def lacking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without three windows of 500 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    windows = docs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(F.col("n_chars") >= (F.col("draw") + 1) * 500)
    return Q.lacking(windows, docs, "doc_id", 3)


@_r.query("""
WITH e AS (SELECT user_id, event_type AS method, 'g' || (event_id % 3) AS "group", CASE WHEN event_id % 2 = 0 THEN 'genus' ELSE 'species' END AS rank, round(max(value), 6) AS top1 FROM events GROUP BY ALL)
SELECT user_id, method, "group", max(CASE WHEN rank = 'species' THEN top1 END) AS species, max(CASE WHEN rank = 'genus' THEN top1 END) AS genus FROM e GROUP BY ALL""")
def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of events as methods, one column for each rank."""
    rows = table(spark, sf_dir, "events").groupBy(
        "user_id", F.col("event_type").alias("method"), F.concat(F.lit("g"), F.col("event_id") % 3).alias("group"), F.when(F.col("event_id") % 2 == 0, "genus").otherwise("species").alias("rank")
    ).agg(F.round(F.max("value"), 6).alias("top1"))
    return M.evaluation_matrix(rows, "user_id", ["species", "genus"])


@_r.query("""
WITH s AS (SELECT event_id AS r, user_id AS k, value AS y, value AS p FROM events),
g AS (SELECT r, CASE WHEN r % 97 = 5 THEN -1 ELSE k END AS k, CASE WHEN r % 89 = 3 THEN y + 1 ELSE y END AS y, CASE WHEN r % 50 = 0 THEN p + 0.001 ELSE p END AS p FROM s WHERE r % 300 <> 7),
j AS (SELECT s.p AS p1, g.p AS p2, s.y AS y1, g.y AS y2, s.k IS NOT DISTINCT FROM g.k AS same FROM s FULL JOIN g ON s.r = g.r)
SELECT count(p1) AS n_saved, count(p2) AS n_again, count_if(NOT same OR p1 IS NULL OR p2 IS NULL) AS n_unmatched, count_if(same AND abs(y1 - y2) > 1e-10) AS n_labels,
       round(avg(CASE WHEN same THEN abs(p1 - p2) END), 9) AS mean_change, round(max(CASE WHEN same THEN abs(p1 - p2) END), 9) AS max_change, FALSE AS holds FROM j""")
def positional_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a second run against the first, row by row in the same order."""
    at = F.col("at")
    saved = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("user_id").alias("k"), F.col("value").alias("y"), F.col("value").alias("p"))
    again = saved.where("at % 300 <> 7").withColumns({
        "k": F.when(at % 97 == 5, -1).otherwise(F.col("k")), "y": F.when(at % 89 == 3, F.col("y") + 1).otherwise(F.col("y")), "p": F.when(at % 50 == 0, F.col("p") + 0.001).otherwise(F.col("p")),
    })
    out = D.positional_drift(saved, again, "at", ["k"], "y", "p")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_change", "max_change")})


@_r.query("""
WITH c AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) - 1 AS chunk_id FROM documents)
SELECT source, CAST(chunk_id AS INTEGER) AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'differs' END AS message FROM c WHERE chunk_id < 8 AND (doc_id % 5 = 0 OR doc_id % 5 = 1)""")
def disagreeing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reused pool against a fresh one of which some chunks are gone and some differ."""
    pool = D.reduced(Q.seeded_chunks(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", 12, 5), 8)
    k = F.col("doc_id") % 5
    fresh = pool.where(k != 0).withColumn("text", F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return D.disagreeing(pool, fresh, ["source", "chunk_id"], "text")


@_r.query("""
WITH b AS (SELECT source, doc_id, list_transform(string_split(text, ' '), lambda w: length(w) + 3) AS ids FROM documents),
n AS (SELECT source, doc_id, greatest(len(ids) - 1022 + 1, 0) AS n FROM b), t AS (SELECT source, sum(n) AS total FROM n GROUP BY 1)
SELECT 'chunks' AS "table", 'tokens' AS "check", source || ', ' || i AS key, 'label is not log10 of the years' AS message
FROM t, range(4) r(i) WHERE total > 0 AND CAST(substring(source, 4) AS INT) % 3 = 1""")
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of every source that has a long enough text, with their labels, some of which are wrong."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w) + 3)
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("assembly_accession"), "doc_id", ids.alias("ids"))
    windows = Q.token_windows(blocks, "assembly_accession", ["doc_id"], "ids", 4, fixed.BODY_TOKENS, 2)
    number = F.substring("source", 4, 9).cast("long")
    traits = table(spark, sf_dir, "documents").select(F.col("source").alias("assembly_accession"), number.alias("ncbi_taxid"), (number + 1.0).alias("max_longevity_yrs")).distinct()
    rows = B.chunk_rows(windows, traits, seed=2)
    return V.chunks(rows.withColumn("log10_longevity", F.col("log10_longevity") + F.when(F.col("ncbi_taxid") % 3 == 1, 0.1).otherwise(0.0)))


@_r.query("""
WITH g AS (SELECT s_suppkey AS acc, s_nationkey AS t FROM supplier WHERE s_suppkey % 4 <> 1),
n AS (SELECT n_nationkey AS t, n_name AS class, CAST(n_regionkey AS VARCHAR) AS family FROM nation)
SELECT t AS ncbi_taxid, 'class' AS "column", class AS expected, class || '!' AS actual FROM n WHERE t IN (SELECT t FROM g) AND t % 3 = 0
UNION ALL SELECT t, 'family', family, NULL FROM n WHERE t IN (SELECT t FROM g) AND t % 5 = 0""")
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is frozen of suppliers as verified genomes: the drift of their taxonomy."""
    k = F.col("ncbi_taxid")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ncbi_taxid"), F.col("n_name").alias("class"), F.col("n_regionkey").cast("string").alias("family"))
    now = nation.withColumns({"class": F.when(k % 3 == 0, F.concat("class", F.lit("!"))).otherwise(F.col("class")), "family": F.when(k % 5 != 0, F.col("family"))})
    genomes = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("assembly_accession"), F.col("s_nationkey").alias("ncbi_taxid"))
    traits = nation.select("ncbi_taxid", (k + 1.0).alias("max_longevity_yrs"))
    return D.snapshot(genomes, traits, now, nation, ["class", "family"])[1]


@_r.query("""
WITH d AS (SELECT source, doc_id, length(text) AS n FROM documents WHERE length(text) > 0)
SELECT source AS file, count_if(NOT (doc_id % 4 = 0 OR doc_id % 7 = 3)) AS n_kept, coalesce(sum(CASE WHEN NOT (doc_id % 4 = 0 OR doc_id % 7 = 3) THEN n END), 0)::BIGINT AS total_bp,
       coalesce(string_agg(CASE WHEN doc_id % 4 = 0 OR doc_id % 7 = 3 THEN 'c' || doc_id END, ' ' ORDER BY 'c' || doc_id), '') AS excluded FROM d GROUP BY 1""")
def genome_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of their source's genome: what is kept, its bases, and what is left out."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("seq"), F.concat(F.lit("c"), "doc_id").alias("contig"))
    blocks = Q.blocks(docs, ["source", "doc_id", "contig"], "seq", 500)
    header = F.concat("contig", F.when(F.col("doc_id") % 7 == 3, " Mitochondrion").otherwise(""))
    blocks = blocks.select(F.col("source").alias("file"), F.col("doc_id").alias("record"), header.alias("header"), "contig", "seq")
    gone = docs.where("doc_id % 4 = 0").select(F.col("contig").alias("accession"))
    return fasta.pack_summary(blocks, gone).withColumn("excluded", F.array_join("excluded", " "))
