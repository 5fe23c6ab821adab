"""Selection, naming, taxonomy and dataset tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import selection as S
from ..operators import tables as B
from ..operators import taxonomy as X
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_MATCHED = """
matched AS (
  SELECT doc_id, source AS species_query, n_chars // 500 AS observation_id, lang AS image_type, text
  FROM documents WHERE lang IS NOT NULL AND lang <> 'fr'),
joined AS (
  SELECT m.*, l.quality, l.toxic FROM matched m LEFT JOIN labels l USING (doc_id)
  WHERE coalesce(l.toxic, 0) = 0),
single AS (
  SELECT * FROM joined QUALIFY row_number() OVER (
    PARTITION BY species_query, doc_id ORDER BY quality NULLS LAST, toxic NULLS LAST) = 1),
keyed AS (SELECT *, md5('0:' || CAST(doc_id AS VARCHAR)) AS order_key FROM single),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY species_query, observation_id ORDER BY order_key, doc_id) AS observation_rank
  FROM keyed)"""
_HOW = {
    "group": "species_query",
    "observation": "observation_id",
    "uuid": "doc_id",
    "provenance_order": ["quality", "toxic"],
    "eligible": lambda: F.coalesce("toxic", F.lit(0)) == 0,
}


def _how() -> dict:
    return {k: v() if callable(v) else v for k, v in _HOW.items()}


def _matched(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang is not null and lang <> 'fr'")
    return docs.select(
        *more,
        "doc_id",
        F.col("source").alias("species_query"),
        F.floor(F.col("n_chars") / 500).alias("observation_id"),
        F.col("lang").alias("image_type"),
    )


@_r.query(f"""
WITH {_MATCHED},
final AS (
  SELECT *, row_number() OVER (PARTITION BY species_query ORDER BY order_key, doc_id) AS rank
  FROM ranked WHERE observation_rank <= 1)
SELECT species_query, CAST(rank AS INTEGER) AS rank, doc_id, observation_id, image_type, quality
FROM final WHERE rank <= 10""")
def candidate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents per source, one per length class, non-toxic or unlabelled, in a seeded order."""
    chosen = S.select_candidates(
        _matched(spark, sf_dir), table(spark, sf_dir, "labels"), per_observation=1, per_group=10, **_how()
    )
    return chosen.select("species_query", "rank", "doc_id", "observation_id", "image_type", "quality")


@_r.query("""
WITH matched AS (
  SELECT p_brand AS species_query, l_orderkey, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS uuid
  FROM lineitem JOIN part ON l_partkey = p_partkey),
joined AS (
  SELECT DISTINCT species_query, uuid, l_orderkey, o_orderpriority
  FROM matched LEFT JOIN orders ON l_orderkey = o_orderkey WHERE coalesce(o_orderpriority, '') <> '5-LOW'),
single AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY species_query, uuid ORDER BY o_orderpriority NULLS LAST, l_orderkey) = 1),
keyed AS (SELECT *, md5('0:' || uuid) AS order_key FROM single),
inside AS (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY species_query, l_orderkey ORDER BY order_key, uuid) <= 1)
SELECT species_query, uuid, l_orderkey,
       CAST(row_number() OVER (PARTITION BY species_query ORDER BY order_key, uuid) AS INTEGER) AS rank
FROM inside QUALIFY rank <= 50""")
def candidate_select_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty order lines per brand, one per order, over the largest tables."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("species_query"))
    uuid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", uuid.alias("uuid"))
    matched = lines.join(brands, "l_partkey").select("species_query", "l_orderkey", "uuid")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = matched.join(orders, "l_orderkey", "left").where("coalesce(o_orderpriority, '') <> '5-LOW'")
    single = S.one_per_key(joined, ["species_query", "uuid"], [F.col("o_orderpriority").asc_nulls_last(), F.col("l_orderkey")])
    order = [scalars.seeded_key(0, F.col("uuid")), F.col("uuid")]
    inside = S.capped(single, ["species_query", "l_orderkey"], order, 1, "observation_rank")
    return S.capped(inside, ["species_query"], order, 50, "rank").select("species_query", "uuid", "l_orderkey", "rank")


@_r.query(f"""
WITH {_MATCHED},
kinds AS (SELECT species_query, coalesce(image_type, 'null') AS k, count(*) AS n, count_if(text IS NULL OR trim(text) = '') AS u FROM matched GROUP BY ALL),
rows AS (SELECT species_query, sum(n) AS n_rows, string_agg(k || '=' || n, ',' ORDER BY k) AS image_types, sum(u) AS n_no_url FROM kinds GROUP BY 1),
chosen AS (
  SELECT species_query, count(*) AS n_eligible, count(DISTINCT observation_id) AS n_observations,
         count_if(observation_rank <= 2) AS n_selectable FROM ranked GROUP BY 1),
queries AS (SELECT DISTINCT source AS species_query FROM documents UNION SELECT 'nowhere')
SELECT species_query, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, coalesce(image_types, '') AS image_types,
       CAST(coalesce(n_no_url, 0) AS BIGINT) AS n_no_url, CAST(coalesce(n_eligible, 0) AS BIGINT) AS n_eligible,
       CAST(coalesce(n_observations, 0) AS BIGINT) AS n_observations, CAST(coalesce(n_selectable, 0) AS BIGINT) AS n_selectable
FROM queries LEFT JOIN rows USING (species_query) LEFT JOIN chosen USING (species_query)""")
def species_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    matched = _matched(spark, sf_dir, F.length(F.trim("text")).alias("_size"))
    ranked = S.ranked_candidates(_matched(spark, sf_dir), table(spark, sf_dir, "labels"), **_how())
    names = docs.select(F.col("source").alias("species_query")).union(spark.createDataFrame([("nowhere",)], "species_query string"))
    out = S.species_summary(
        matched, ranked, names, group="species_query", kind="image_type", observation="observation_id",
        has_url=F.coalesce(F.col("_size") > 0, F.lit(False)), per_observation=2,
    )
    kinds = F.transform(F.map_entries("image_types"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return out.withColumn("image_types", F.array_join(kinds, ","))


@_r.query("""
SELECT page_id, nullif(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1)), '') AS host FROM pages""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.url_host(F.col("url")).alias("host"))


@_r.query("""
WITH h AS (SELECT *, coalesce(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1)), '') AS host FROM pages)
SELECT page_id, url FROM h WHERE host NOT IN (SELECT host FROM h WHERE page_id = 0)""")
def url_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on other hosts than that of the first page."""
    pages = table(spark, sf_dir, "pages")
    first = pages.where("page_id = 0").select(scalars.url_host(F.col("url"))).collect()
    hosts = [r[0] for r in first if r[0]]
    return pages.where(S.not_hosted_at(F.col("url"), hosts)).select("page_id", "url")


@_r.query("""
WITH keyed AS (
  SELECT p_partkey, lower(coalesce(nullif(regexp_extract(trim(p_name), '^([A-Za-z]+ [a-z][a-z-]*)(?: \\(?[A-Z].*)?$', 1), ''), trim(p_name))) AS match_key FROM part),
names AS (SELECT DISTINCT upper(p_name) AS name FROM part WHERE p_brand = 'Brand#11' OR p_size < 10)
SELECT match_key, count(*) AS n_parts, min(p_partkey) AS first_part FROM keyed
WHERE match_key IN (SELECT lower(trim(name)) FROM names) GROUP BY 1""")
def match_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts matched by the key of names written otherwise."""
    part = table(spark, sf_dir, "part")
    names = part.where("p_brand = 'Brand#11' or p_size < 10").select(F.lower("p_name").alias("species_query")).distinct()
    found = S.match_catalog(part, S.query_keys(names), "p_name").withColumn("match_key", scalars.match_key(F.col("p_name")))
    return found.groupBy("match_key").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))


@_r.query("""
WITH keys AS (SELECT DISTINCT p_brand AS species_query, lower(trim(p_name)) AS match_key FROM part)
SELECT match_key, string_agg(species_query, '|' ORDER BY species_query) AS queries FROM keys GROUP BY 1 HAVING count(*) > 1""")
def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that several brands claim."""
    part = table(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("species_query")).distinct()
    keys = S.query_keys(brands, part.select(F.col("p_brand").alias("species_query"), F.col("p_name").alias("alias")))
    return S.colliding_keys(keys).select("match_key", F.array_join("queries", "|").alias("queries"))


@_r.query("""
SELECT n_nationkey, s_suppkey, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY
  CASE WHEN s_acctbal > 8000 THEN 0 WHEN s_acctbal > 4000 THEN 1 ELSE 2 END,
  CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 1 WHEN s_suppkey % 4 = 2 THEN 2 ELSE 3 END,
  s_name DESC NULLS LAST, s_suppkey) = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best supplier of each nation by the assembly ranking."""
    category = F.when(F.col("s_acctbal") > 8000, "reference genome").when(F.col("s_acctbal") > 4000, "representative genome").otherwise("other")
    level = F.get(F.array(*map(F.lit, fixed.LEVELS)), (F.col("s_suppkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumns({"refseq_category": category, "assembly_level": level, "seq_rel_date": F.col("s_name"), "assembly_accession": F.col("s_suppkey")})
    return X.best_assembly(rows, "n_nationkey").select("n_nationkey", "s_suppkey", "s_name", "s_acctbal")


@_r.query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1""")
def primary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per customer: a finished one first, then the lowest key."""
    chosen = X.primary_rows(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey")
    return chosen.select("o_custkey", "o_orderkey", "o_orderstatus")


@_r.query("""
WITH names AS (
  SELECT DISTINCT lower(trim(c_mktsegment)) AS k, c_nationkey AS taxid FROM customer
  UNION SELECT lower(n_name), n_nationkey FROM nation),
queries AS (SELECT DISTINCT n_name AS query FROM nation UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT 'nothing')
SELECT query, taxid, n_regionkey AS species_taxid, count(taxid) OVER (PARTITION BY query) AS n_matches
FROM queries LEFT JOIN names ON lower(trim(query)) = k LEFT JOIN nation ON taxid = n_nationkey""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several taxa, lifted to a higher rank: nations and market segments to regions."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    names = customer.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("taxid")).union(nation.select("n_name", "n_nationkey"))
    lineage = F.array(
        F.struct(F.lit(-1).alias("taxid"), F.lit("root").alias("name"), F.lit(None).cast("string").alias("rank")),
        F.struct(F.col("n_regionkey").alias("taxid"), F.lit("region").alias("name"), F.lit("species").alias("rank")),
    )
    taxa = nation.select(F.col("n_nationkey").alias("taxid"), F.lit("subspecies").alias("rank"), lineage.alias("lineage"))
    queries = nation.select(F.col("n_name").alias("query")).union(customer.select("c_mktsegment")).distinct()
    queries = queries.union(spark.createDataFrame([("nothing",)], "query string"))
    return X.resolve_names(queries, names, taxa)


@_r.query("""
SELECT l_partkey, count(*) AS n_genes, round(avg(l_quantity), 6) AS mean_quantity, min(r_name) AS region FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_discount >= 0.03 AND l_quantity / 50 >= 0.5 GROUP BY 1 HAVING count(*) >= 5""")
def many_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of the gene-trait join: quality filters, four lookups, enough rows per key."""
    lines = table(spark, sf_dir, "lineitem").where("l_discount >= 0.03 and l_quantity / 50 >= 0.5")
    out = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = out.groupBy("l_partkey").agg(F.count("*").alias("n_genes"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.min("r_name").alias("region"))
    return found.where("n_genes >= 5")


@_r.query("SELECT coalesce(lang, '(none recorded)') AS lang, count(*) AS n FROM documents GROUP BY 1")
def licence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.histogram(table(spark, sf_dir, "documents"), "lang")


@_r.query("""
SELECT count(*) AS n_species, (SELECT count(*) FROM supplier) AS n_genomes, (SELECT count(*) FROM lineitem) AS n_images,
       (SELECT CAST(sum(s_acctbal * 100) AS BIGINT) FROM supplier) AS genome_bytes,
       (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem) AS image_bytes, 0 AS n_pairs FROM part""")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes = table(spark, sf_dir, "supplier").withColumn("sequence_bytes", F.col("s_acctbal") * 100)
    images = table(spark, sf_dir, "lineitem").withColumn("bytes", F.col("l_quantity"))
    return B.dataset_counts({"species": table(spark, sf_dir, "part"), "genomes": genomes, "images": images, "pairs": None})


@_r.query("""
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, string_agg(l_suppkey || ' (' || n || ')', ', ' ORDER BY r) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS r FROM c) WHERE r <= 3 GROUP BY 1""")
def top_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent suppliers of each part."""
    return B.top_listed(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", 3)


@_r.query("""
WITH l AS (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL),
s AS (SELECT source, list_sort(list(lang)) AS langs FROM l GROUP BY 1)
SELECT source AS ncbi_taxid, array_to_string(list_concat(['en'], list_filter(langs, lambda x: x <> 'en')), '|') AS source_names FROM s""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    images = docs.select(F.col("source").alias("ncbi_taxid"), F.col("lang").alias("original_label"))
    configured = docs.where("lang is not null").select(F.col("source").alias("ncbi_taxid"), F.lit("en").alias("name")).distinct()
    return B.source_names(images, configured).withColumn("source_names", F.array_join("source_names", "|"))


@_r.query("""
WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY
    md5('0:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey || '-' || l_linenumber || '-' || l_partkey) <= 20""")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, sf_dir, "lineitem").select(*columns)
    rows = rows.withColumn("_key", F.concat_ws("-", *columns[1:]))
    return S.cap_per_group(rows, "l_suppkey", "_key", 20, different=True).drop("_key")


@_r.query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_acctbal > 5000 ORDER BY md5('0:' || s_suppkey), s_suppkey) AS turn FROM supplier)
SELECT s_suppkey, s_nationkey FROM t ORDER BY s_acctbal > 5000 DESC, turn, s_nationkey NULLS LAST, s_suppkey LIMIT 20""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.round_robin(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", F.col("s_acctbal") > 5000, 20)
    return found.select("s_suppkey", "s_nationkey")


@_r.query("SELECT doc_id, source FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.systematic(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4)


@_r.query("""
WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
b AS (SELECT *, least(CAST(floor(i * 4 / n) AS BIGINT), 3) AS block FROM a),
c AS (SELECT *, i - CAST(ceil(block * n / 4) AS BIGINT) AS inside FROM b)
SELECT doc_id, source FROM c WHERE n <= 12 OR (inside >= 0 AND inside < least(3, 12 - block * 3))""")
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve documents per source in four runs."""
    return S.block_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 12, 4)
