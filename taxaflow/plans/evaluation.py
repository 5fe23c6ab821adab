"""Metrics, logs and embedding retrieval over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import metrics as M
from ..operators import sequences as Q
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per piece as a prediction of the retail price, both in logarithms."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    joined = lines.join(part, "l_partkey")
    return joined.select(
        "l_partkey", "p_brand", "p_type", F.log10("p_retailprice").alias("y"),
        F.log10(F.col("l_extendedprice") / F.col("l_quantity")).alias("guess"),
    )


_PRED = """
pred AS (SELECT l_partkey, p_brand, p_type, log10(p_retailprice) AS y, log10(l_extendedprice / l_quantity) AS guess
         FROM lineitem JOIN part ON l_partkey = p_partkey),
species AS (SELECT l_partkey, min(p_brand) AS p_brand, min(p_type) AS p_type, min(y) AS y, avg(guess) AS pred, count(*) AS n FROM pred GROUP BY 1)"""


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.species_predictions(_predictions(spark, sf_dir), "l_partkey", "y", "guess", ["p_brand", "p_type"])


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@_r.query(f"""
WITH {_PRED},
r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS ry FROM species)
SELECT count(*) AS n_species, round(avg(abs(pred - y)), 6) AS mae_log10, round(avg(abs(pow(10, pred) - pow(10, y))), 6) AS mae_years,
       round(corr(y, pred), 6) AS pearson, round(corr(pow(10, y), pow(10, pred)), 6) AS pearson_years, round(corr(rx, ry), 6) AS spearman,
       round(stddev_samp(y), 6) AS label_sd, round(stddev_samp(pred), 6) AS pred_sd FROM r""")
def species_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.species_metrics(_species(spark, sf_dir), "y"))


@_r.query(f"""
WITH {_PRED},
r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY p_brand ORDER BY pred) + (count(*) OVER (PARTITION BY p_brand, pred) - 1) / 2.0 AS ry FROM species)
SELECT p_brand, count(*) AS n_species, round(avg(abs(pred - y)), 6) AS mae_log10, round(avg(abs(pow(10, pred) - pow(10, y))), 6) AS mae_years,
       round(corr(y, pred), 6) AS pearson, round(corr(pow(10, y), pow(10, pred)), 6) AS pearson_years, round(corr(rx, ry), 6) AS spearman,
       round(stddev_samp(y), 6) AS label_sd, round(stddev_samp(pred), 6) AS pred_sd FROM r GROUP BY 1""")
def metrics_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.species_metrics(_species(spark, sf_dir), "y", group=["p_brand"]))


@_r.query("""
WITH s AS (SELECT p_partkey, log10(p_retailprice) AS y, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS o, p_brand AS c FROM part),
train AS (SELECT * FROM s WHERE p_partkey % 5 <> 0 AND coalesce(o, '') NOT LIKE 'S%'), test AS (SELECT * FROM s WHERE p_partkey % 5 = 0),
om AS (SELECT o, avg(y) AS m FROM train WHERE o IS NOT NULL GROUP BY 1), cm AS (SELECT c, avg(y) AS m FROM train GROUP BY 1),
j AS (SELECT y, coalesce(om.m, cm.m, (SELECT avg(y) FROM train)) AS base,
        CASE WHEN om.m IS NOT NULL THEN 'o' WHEN cm.m IS NOT NULL THEN 'c' ELSE 'all' END AS base_rank
      FROM test LEFT JOIN om ON test.o = om.o LEFT JOIN cm ON test.c = cm.c)
SELECT base_rank, count(*) AS n_species, round(avg(abs(base - y)), 6) AS mae_log10 FROM j GROUP BY 1""")
def taxonomy_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order mean, else class mean, else overall mean of the training rows."""
    order = F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.log10("p_retailprice").alias("y"), order.alias("o"), F.col("p_brand").alias("c"))
    train = rows.where("p_partkey % 5 <> 0").where(~F.coalesce("o", F.lit("")).startswith("S"))
    return _rounded(M.baseline_metrics(M.baselines(train, rows.where("p_partkey % 5 = 0"), "y", ["o", "c"]), "y"))


@_r.query(f"""
WITH {_PRED} SELECT round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, count(*) AS n_species FROM species""")
def target_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.target_normalisation(_predictions(spark, sf_dir), "l_partkey", "y"))


@_r.query(f"""
WITH {_PRED} SELECT count(*) AS n_pairs, round(avg(pow((guess - y) / 0.5, 2)), 6) AS pair_mse_z, round(avg(abs(guess - y)), 6) AS pair_mae_log10 FROM pred""")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.pair_metrics(_predictions(spark, sf_dir), "y", "guess", 0.0, 0.5))


@_r.query("""
WITH one AS (SELECT l_returnflag AS split, l_partkey, min(p_type) AS f, min(p_brand) AS c, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
k AS (SELECT split, c, count(*) AS k FROM one GROUP BY ALL), m AS (SELECT split, string_agg(c || '=' || k, ',' ORDER BY c) AS classes FROM k GROUP BY 1)
SELECT split, count(*) AS n_species, sum(n)::BIGINT AS n_pairs, count(DISTINCT f) AS n_families, min(classes) AS classes,
       string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_partkey) AS species FROM one JOIN m USING (split) GROUP BY split""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumnRenamed("l_returnflag", "split")
    out = M.split_report(rows, "split", "l_partkey", "p_type", "p_brand")
    classes = F.transform(F.map_entries("classes"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return out.withColumn("classes", F.array_join(classes, ",")).withColumn("species", F.array_join(F.col("species").cast("array<string>"), "|"))


@_r.query("""
SELECT l_partkey, count(*) AS n_genes, median(l_quantity) AS median_l_quantity, median(l_discount) AS median_l_discount FROM lineitem GROUP BY 1""")
def gene_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gene_report(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_quantity", "l_discount"])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")


@_r.query("""
WITH b AS (SELECT user_id, event_id AS best_step, value AS best_value FROM events WHERE value IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1),
l AS (SELECT user_id, event_id AS last_step, value AS last_value FROM events WHERE value IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT *, (SELECT count(*) FROM events e WHERE e.user_id = b.user_id AND value IS NOT NULL) AS n_records FROM b JOIN l USING (user_id)""")
def metric_log_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_record(_log(spark, sf_dir), "user_id", "event_id", "value")


@_r.query("""
SELECT user_id, first(value ORDER BY event_id) AS first_loss, last(value ORDER BY event_id) AS last_loss, min(value) AS min_loss,
       round(median(value), 6) AS median_speed, count(*) AS n_records FROM events GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_summary(_log(spark, sf_dir), "user_id", "event_id", "value", "value").withColumn("median_speed", F.round("median_speed", 6))


@_r.query("""
SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rolling FROM events""")
def rolling_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.rolling_mean(_log(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 5)
    return out.select("event_id", "user_id", F.round("rolling", 6).alias("rolling"))


@_r.query("""
WITH b AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT event_id, user_id, value FROM b WHERE before IS NULL OR value < before""")
def new_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.new_minima(_log(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "value")


@_r.query("""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT user_id, CAST(floor(i / ceil(n / 10)) AS BIGINT) AS bucket, avg(value) AS mean FROM a GROUP BY ALL),
s AS (SELECT *, min(mean) OVER (PARTITION BY user_id) AS lo, max(mean) OVER (PARTITION BY user_id) AS hi FROM m)
SELECT user_id, bucket, round(mean, 6) AS mean, CAST(CASE WHEN hi > lo THEN round((mean - lo) / (hi - lo) * 8) ELSE 0 END AS INTEGER) AS level FROM s""")
def spark_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.sparkline(_log(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 10))


# ---------------------------------------------------------------- embeddings


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("species"), "embedding")


_CENTROIDS = """
flat AS (SELECT label AS species, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings WHERE vec_id % 5 <> 0),
mean AS (SELECT species, i, avg(CAST(x AS DOUBLE)) AS m FROM flat GROUP BY ALL),
size AS (SELECT species, sqrt(sum(m * m)) AS s FROM mean GROUP BY 1)"""


@_r.query(f"""
WITH {_CENTROIDS.replace(" WHERE vec_id % 5 <> 0", "")} SELECT species, CAST(i AS INTEGER) AS i, round(m / s, 6) AS x FROM mean JOIN size USING (species)""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.centroids(_vectors(spark, sf_dir), ["species"], "embedding")
    return found.select("species", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


_HITS = f"""{_CENTROIDS},
c AS (SELECT species, list(m / s ORDER BY i) AS v FROM mean JOIN size USING (species) GROUP BY 1),
q AS (SELECT vec_id, label AS target, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 = 0),
sim AS (SELECT vec_id, target, species, list_dot_product(e, v) AS sim FROM q, c),
hits AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, species) AS rank FROM sim QUALIFY rank <= 5)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    gallery = E.centroids(rows.where("vec_id % 5 <> 0"), ["species"], "embedding")
    asked = rows.where("vec_id % 5 = 0")
    hits = E.top_k(asked, gallery, query="vec_id", key="species", vector="embedding", k=5)
    return hits.join(asked.select("vec_id", F.col("species").alias("target")), "vec_id")


@_r.query(f"WITH {_HITS} SELECT vec_id, species, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM hits")
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest species centroids of every fifth vector."""
    return _hits(spark, sf_dir).select("vec_id", "species", "rank", F.round("sim", 6).alias("sim"))


@_r.query(f"""
WITH {_HITS},
s AS (SELECT vec_id, rank, 'species' AS level, CAST(target = species AS INT) AS same FROM hits
      UNION ALL SELECT vec_id, rank, 'genus', CAST(target // 2 = species // 2 AS INT) FROM hits),
e AS (SELECT level, vec_id, max(CASE WHEN rank = 1 THEN same END) AS a, max(same) AS b FROM s GROUP BY ALL)
SELECT level, round(avg(a), 6) AS top1, round(avg(b), 6) AS topk, count(*) AS n FROM e GROUP BY 1""")
def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _vectors(spark, sf_dir).select("species", F.floor(F.col("species") / 2).alias("genus")).distinct()
    ranks = ranks.withColumn("_s", F.col("species")).select("species", "genus", F.col("_s").alias("self"))
    out = E.rank_scores(_hits(spark, sf_dir), ranks, query="vec_id", key="species", levels=["self", "genus"])
    return _rounded(out.withColumn("level", F.when(F.col("level") == "self", "species").otherwise(F.col("level"))))


@_r.query("""
WITH s AS (SELECT DISTINCT label AS species, label // 2 AS genus FROM embeddings), n AS (SELECT count(*) AS n FROM s),
m AS (SELECT 'genus' AS level, species, count(*) OVER (PARTITION BY genus) AS m FROM s UNION ALL SELECT 'self', species, 1 FROM s)
SELECT level, round(avg(m / n), 6) AS top1, round(avg(1 - list_product(list_transform(range(3), lambda i: greatest(0.0, (n - m - i) / (n - i))))), 6) AS topk
FROM m, n GROUP BY 1""")
def chance_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = _vectors(spark, sf_dir).select("species", F.floor(F.col("species") / 2).alias("genus"), F.col("species").alias("self")).distinct()
    return _rounded(E.chance(species, species, key="species", levels=["self", "genus"], k=3))


@_r.query("""
WITH p AS (SELECT CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0)
SELECT round(avg(list_cosine_similarity(x, y)), 6) AS mean_cosine, count(*) AS n FROM p""")
def mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a = rows.where("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("x"))
    b = rows.select("vec_id", F.col("embedding").alias("y"))
    return _rounded(E.mean_cosine(a.join(b, "vec_id"), "x", "y"))


@_r.query()
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge from the first 32 components to the last 32, fitted on four fifths, scored by cosine on the rest."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    fitted = E.ridge(rows.where("vec_id % 5 <> 0"), "x", "y", 0.1)
    held = E.predict_ridge(rows.where("vec_id % 5 = 0"), "x", fitted)
    return held.select("vec_id", F.posexplode("pred").alias("i", "value"))


# ---------------------------------------------------------------- survey tables


@_r.query("""
SELECT source, count_if(lang = 'en') AS en, count_if(lang = 'de') AS de, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es,
       round(avg(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 END), 6) AS good_share
FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) GROUP BY 1""")
def pivot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language, and the share of good ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    counts = docs.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().fillna(0)
    good = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.round(F.avg(F.col("quality").cast("double")), 6).alias("good_share"))
    return counts.join(good, "source")


@_r.query("""
WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT p_partkey FROM part WHERE p_size > 25)
SELECT l_suppkey, count(*) AS n_species, sum(n)::BIGINT AS n_images, count_if(l_partkey IN (SELECT p_partkey FROM r)) AS n_shared,
       coalesce(sum(CASE WHEN l_partkey IN (SELECT p_partkey FROM r) THEN n END), 0)::BIGINT AS n_shared_images, count_if(n >= 2) AS n_many
FROM s GROUP BY 1""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier its parts, and those that are in a second collection."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("shared"))
    both = n.join(known, "l_partkey", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return both.groupBy("l_suppkey").agg(
        F.count("*").alias("n_species"),
        F.sum("n").alias("n_images"),
        F.count_if("shared").alias("n_shared"),
        F.coalesce(F.sum(F.when(F.col("shared"), F.col("n"))), F.lit(0)).alias("n_shared_images"),
        F.count_if(F.col("n") >= 2).alias("n_many"),
    )


@_r.query("""
WITH u AS (SELECT DISTINCT source, lang, text FROM documents)
SELECT source, count(*) AS n_rows, count_if(n_lang > 1) AS n_several FROM (
  SELECT source, text, count(DISTINCT lang) AS n_lang FROM u GROUP BY ALL) GROUP BY 1""")
def provenance_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts per source that stand there under several languages."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = table(spark, sf_dir, "documents").select("source", key.alias("k"), "lang")
    each = rows.groupBy("source", "k").agg(F.count_distinct("lang").alias("n_lang"))
    return each.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_lang") > 1).alias("n_several"))


@_r.query("""
WITH t AS (SELECT l_suppkey AS u, least(l_quantity * 40, 1022)::BIGINT AS t FROM lineitem)
SELECT u AS l_suppkey, count(*) AS examples, sum(t)::BIGINT AS tokens, greatest(1, CAST(floor(sum(t) / 1022 + 0.5) AS BIGINT)) AS chunks FROM t GROUP BY 1""")
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") * 40).cast("long").alias("tokens"))
    return Q.chunk_budget(rows, "l_suppkey", "tokens")
