"""Validation, splits and drift over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import drift as D
from ..operators import splits as P
from ..operators import validation as V
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query("""
SELECT 'images' AS "table", 'reference' AS "check", CAST(l_orderkey AS VARCHAR) || ', ' || CAST(l_linenumber AS VARCHAR) AS key,
       'l_partkey ' || l_partkey || ' not in species' AS message
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 3)
UNION ALL
SELECT 'pairs', 'agreement', CAST(o_orderkey AS VARCHAR), 'o_custkey ' || o_custkey || ' != customer home ' || (c_custkey + 1)
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 50 = 7""")
def validate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of a thinned parent table, and rows that disagree with their parent."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size % 10 <> 3")
    orphans = V.references(lines, "images", "l_partkey", part, "species", "p_partkey", ["l_orderkey", "l_linenumber"])
    home = F.col("c_custkey") + F.when(F.col("c_custkey") % 50 == 7, 1).otherwise(0)
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), home.alias("home"))
    orders = table(spark, sf_dir, "orders")
    return orphans.unionByName(V.agreement(orders, "pairs", "o_custkey", "o_custkey", customer, "customer", "home", ["o_orderkey"]))


@_r.query("""
SELECT 'pairs' AS "table", 'unique' AS "check", l_orderkey || ', ' || l_linenumber AS key,
       'duplicate (l_orderkey, l_linenumber): ' || count(*) || ' rows' AS message
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique(table(spark, sf_dir, "lineitem"), "pairs", ["l_orderkey", "l_linenumber"])


@_r.query("""
WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'species' AS "table", 'count' AS "check", CAST(p_partkey AS VARCHAR) AS key,
       'p_size is ' || p_size || ', there are ' || coalesce(n, 0) AS message
FROM part LEFT JOIN n ON l_partkey = p_partkey WHERE p_size IS DISTINCT FROM coalesce(n, 0)""")
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts_agree(table(spark, sf_dir, "part"), "species", "p_partkey", "p_size", table(spark, sf_dir, "lineitem"), "l_partkey")


@_r.query("""
WITH f AS (
  SELECT source AS t, 'language ' || lang AS c, CAST(doc_id AS VARCHAR) AS key, 'text of ' || n_chars AS message FROM documents WHERE n_chars > 3000),
r AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY key, message) AS r, count(*) OVER (PARTITION BY t, c) AS n FROM f)
SELECT t AS "table", c AS "check", key, message FROM r WHERE r <= 3
UNION ALL SELECT DISTINCT t, c, NULL, '... and ' || (n - 3) || ' more like this' FROM r WHERE n > 3""")
def validate_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut to three per check with a row that counts the rest."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 3000")
    found = docs.select(
        F.col("source").alias("table"),
        F.concat(F.lit("language "), F.col("lang")).alias("check"),
        F.col("doc_id").cast("string").alias("key"),
        F.concat(F.lit("text of "), F.col("n_chars").cast("string")).alias("message"),
    )
    return V.capped(found, 3)


@_r.query("""
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS family, c_mktsegment AS class FROM customer),
n AS (SELECT class, count(*) AS total FROM c GROUP BY 1),
f AS (SELECT class, family, count(*) AS size FROM c GROUP BY ALL),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY class ORDER BY md5('0:' || class || ':' || family), family
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f JOIN n USING (class)),
t AS (SELECT *, before < 0.15 * total AS test FROM o),
h AS (SELECT *, sum(CASE WHEN test THEN size ELSE 0 END) OVER (PARTITION BY class) AS held FROM t)
SELECT c_custkey, CASE WHEN test THEN 'test' WHEN before - held < 0.15 * total THEN 'val' ELSE 'train' END AS split
FROM c JOIN h USING (class, family)""")
def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers split by whole families inside each market segment."""
    family = F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 2000).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", family.alias("family"), F.col("c_mktsegment").alias("class"))
    return P.family_split(rows, family="family", strata=["class"], test=0.15, val=0.15).select("c_custkey", "split")


@_r.query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN source IN ('src3', 'src7') THEN 'val_unseen' WHEN k <= round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM r""")
def record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.record_split(docs, group="source", key="doc_id", share=0.1, unseen=F.col("source").isin("src3", "src7")).select("doc_id", "split")


@_r.query("""
SELECT s_suppkey, coalesce(lead(s_name) OVER w, first_value(s_name) OVER w) AS permuted FROM supplier
WINDOW w AS (ORDER BY md5('0:' || s_suppkey), s_suppkey)""")
def permute_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control at species cardinality: suppliers in one seeded cycle."""
    return P.permuted_genomes(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name").select("s_suppkey", "permuted")


@_r.query("""
WITH u AS (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_orderkey % 1000 = 1),
seen AS (SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM u) ORDER BY md5('0:' || s_suppkey), s_suppkey LIMIT 60)
SELECT s_suppkey, 'unseen' AS "group" FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM u) UNION ALL SELECT s_suppkey, 'seen' FROM seen""")
def held_out_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = table(spark, sf_dir, "lineitem").where("l_orderkey % 1000 = 1").select(F.col("l_suppkey").alias("s_suppkey"))
    return P.held_out_groups(table(spark, sf_dir, "supplier"), unseen, "s_suppkey")


def _edited(docs: DataFrame) -> DataFrame:
    """Documents with some rows gone, some new, some cells changed."""
    kept = docs.where("doc_id % 97 <> 5").withColumn("n_chars", F.when(F.col("doc_id") % 50 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    kept = kept.withColumn("lang", F.when(F.col("doc_id") % 70 == 9, F.lit(None)).otherwise(F.col("lang")))
    return kept.unionByName(docs.where("doc_id % 200 = 0").withColumn("doc_id", -1 - F.col("doc_id")))


@_r.query("""
WITH b AS (
  SELECT doc_id, n_chars + CASE WHEN doc_id % 50 = 3 THEN 1 ELSE 0 END AS n_chars, CASE WHEN doc_id % 70 = 9 THEN NULL ELSE lang END AS lang, source
  FROM documents WHERE doc_id % 97 <> 5 UNION ALL SELECT -1 - doc_id, n_chars, lang, source FROM documents WHERE doc_id % 200 = 0),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n_chars AS n1, b.n_chars AS n2, a.lang AS l1, b.lang AS l2, a.source AS s1, b.source AS s2
      FROM documents a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT x AS doc_id, '(missing)' AS "column", NULL AS expected, NULL AS actual FROM j WHERE y IS NULL
UNION ALL SELECT y, '(extra)', NULL, NULL FROM j WHERE x IS NULL
UNION ALL SELECT x, 'n_chars', CAST(n1 AS VARCHAR), CAST(n2 AS VARCHAR) FROM j WHERE x = y AND n1 IS DISTINCT FROM n2
UNION ALL SELECT x, 'lang', l1, l2 FROM j WHERE x = y AND l1 IS DISTINCT FROM l2
UNION ALL SELECT x, 'source', s1, s2 FROM j WHERE x = y AND s1 IS DISTINCT FROM s2""")
def cohort_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return D.row_drift(docs, _edited(docs), "doc_id", ["n_chars", "lang", "source"])


@_r.query("""
WITH e AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
a AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 AND source <> 'src1' GROUP BY 1)
SELECT source, e.n AS expected, coalesce(a.n, 0) AS actual FROM e LEFT JOIN a USING (source) WHERE e.n <> coalesce(a.n, 0)""")
def count_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return D.count_drift(docs.groupBy("source").agg(F.count("*").alias("n")), docs.where("doc_id % 7 <> 0 and source <> 'src1'"), "source")


@_r.query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, props FROM events),
p AS (SELECT user_id, k, unnest(json_keys(props)) AS path, props FROM e WHERE k <= 2),
v AS (SELECT user_id, k, path, json_extract_string(props, '$.' || path) AS value FROM p),
o AS (SELECT * FROM v WHERE k = 1), n AS (SELECT * FROM v WHERE k = 2)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.path, n.path) AS path,
       coalesce(o.value, '(unset)') AS old, coalesce(n.value, '(unset)') AS new
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.path = n.path WHERE coalesce(o.value, '(unset)') <> coalesce(n.value, '(unset)')""")
def settings_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between a user's first and second event."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "props")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ranked = events.withColumn("k", k).where("k <= 2")
    sides = [D.json_leaves(ranked.where(F.col("k") == i), "user_id", "props") for i in (1, 2)]
    return D.settings_drift(*sides, "user_id")


@_r.query("""
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem),
s AS (SELECT l_orderkey, l_partkey, l_suppkey, avg(l_quantity) AS q FROM a GROUP BY ALL),
g AS (SELECT *, CASE WHEN l_orderkey % 100 = 0 THEN q + 0.001 ELSE q END AS p FROM s WHERE l_orderkey % 1001 <> 0)
SELECT count(s.q) AS n_saved, count(g.p) AS n_again, count_if(s.q IS NULL OR g.p IS NULL) AS n_unmatched, count_if(abs(s.q - g.q) > 1e-10) AS n_labels,
       round(avg(abs(s.q - g.p)), 9) AS mean_change, round(max(abs(s.q - g.p)), 9) AS max_change, FALSE AS holds
FROM s FULL JOIN g ON s.l_orderkey = g.l_orderkey AND s.l_partkey = g.l_partkey AND s.l_suppkey = g.l_suppkey""")
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    saved = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity").distinct().groupBy(*keys).agg(F.avg("l_quantity").alias("q"))
    saved = saved.withColumn("p", F.col("q"))
    again = saved.where("l_orderkey % 1001 <> 0").withColumn("p", F.when(F.col("l_orderkey") % 100 == 0, F.col("q") + 0.001).otherwise(F.col("q")))
    out = D.prediction_drift(saved, again, keys, "q", "p")
    return out.withColumn("mean_change", F.round("mean_change", 9)).withColumn("max_change", F.round("max_change", 9))


@_r.query("""
SELECT doc_id, 'missing' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
UNION ALL SELECT doc_id, 'extra' FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.set_difference(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@_r.query("""
SELECT 'splits' AS "table", 'overlap' AS "check", CAST(l_partkey AS VARCHAR) AS key, string_agg(s, ' and ' ORDER BY s) AS message
FROM (SELECT DISTINCT l_partkey, l_returnflag AS s FROM lineitem WHERE l_quantity > 45) GROUP BY l_partkey HAVING count(*) > 1""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.split_overlap(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_partkey", "l_returnflag")


@_r.query("""
WITH r AS (SELECT p_partkey, p_retailprice AS y, log10(p_retailprice) + CASE WHEN p_partkey % 11 = 0 THEN 1e-3 ELSE 0 END AS l FROM part)
SELECT 'labels' AS "table", 'value' AS "check", CAST(p_partkey AS VARCHAR) AS key, 'label is not log10 of the years' AS message
FROM r WHERE abs(l - log10(y)) > 1e-7""")
def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.col("p_partkey") % 11 == 0, 1e-3).otherwise(0.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("y"), (scalars.log_years(F.col("p_retailprice")) + shift).alias("l"))
    return V.labels(rows, "p_partkey", "y", "l")
