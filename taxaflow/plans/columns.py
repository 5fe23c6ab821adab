"""Column functions, predicates and small tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import selection as S
from ..operators import sequences as Q
from ..operators import tables as B
from ..operators import taxonomy as X
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_HOST = fixed.INAT_HOST
#: Names with brackets, authors and plain epithets made of parts.
_NAME = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || ' (L.)' WHEN p_partkey % 3 = 1 THEN p_name || ' Smith' ELSE p_brand END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" (L.)"))).when(k == 1, F.concat("p_name", F.lit(" Smith"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", name.alias("name"))


@_r.query(f"""
WITH n AS (SELECT p_partkey, p_type, {_NAME} AS name FROM part),
w AS (SELECT *, string_split_regex(trim(regexp_replace(lower(name), '\\([^)]*\\)', ' ', 'g')), '\\s+') AS ws FROM n)
SELECT p_partkey, CASE WHEN regexp_matches(ws[2], '^[a-z]+$') THEN ws[1] || ' ' || ws[2] END AS species,
       regexp_replace(trim('  ' || name || '   x '), '\\s+', ' ', 'g') AS plain,
       CASE WHEN lower(p_type) <> 'economy' THEN lower(p_type) END AS rank,
       CASE WHEN p_partkey % 4 = 0 THEN name || ' sp.' ELSE p_type END AS finest
FROM w""")
def names_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species-level names, names with single spaces, ranks, and finest labels."""
    rows = _named(spark, sf_dir)
    rank = scalars.normal_rank(F.when(F.lower("p_type") == "economy", "NO RANK").otherwise(F.col("p_type")))
    species = F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).otherwise("")
    return rows.select(
        "p_partkey",
        scalars.species_level(F.col("name")).alias("species"),
        scalars.normal_name(F.concat(F.lit("  "), "name", F.lit("   x "))).alias("plain"),
        rank.alias("rank"),
        scalars.finest_label(F.col("name"), species).alias("finest"),
    )


@_r.query(f"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://{_HOST}/photos/' || page_id || '/original.jpg' ELSE url END AS url,
                  CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'elsewhere' END AS used FROM pages),
v AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN replace(url, '/original.', '/medium.') END AS variant FROM u),
l AS (SELECT *, CASE WHEN variant IS NULL THEN [url] ELSE [variant, url] END AS urls FROM v)
SELECT page_id, variant, array_to_string(CASE WHEN list_contains(urls, used) THEN list_concat([used], list_filter(urls, lambda x: x <> used)) ELSE urls END, ' ') AS urls
FROM l""")
def url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to try for each page: the one used before, the rewritten photo, the catalogued one."""
    k = F.col("page_id")
    photo = F.concat(F.lit(f"https://{_HOST}/photos/"), k.cast("string"), F.lit("/original.jpg"))
    url = F.when(k % 2 == 0, photo).otherwise(F.col("url"))
    used = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, "elsewhere")
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), used.alias("used"))
    urls = scalars.candidate_urls(F.col("url"), "medium", F.col("used"))
    return pages.select("page_id", scalars.inat_variant(F.col("url"), "medium").alias("variant"), F.array_join(urls, " ").alias("urls"))


@_r.query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT o_orderkey,
       CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN NULL ELSE p END AS license,
       CASE WHEN p = '3-MEDIUM' OR s = 'F' THEN NULL ELSE p END AS listing,
       CASE WHEN s = 'O' THEN 'inaturalist' WHEN p = '1-URGENT' THEN NULL ELSE lower(p) END AS provider,
       p NOT LIKE '5%' AND NOT (o_custkey % 4 = 0) AS safe
FROM o""")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that become null, providers, and paths that leave the dataset."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    marked = F.when(p == "1-URGENT", " Not Provided ").when(p == "2-HIGH", "  ").otherwise(p)
    listed = F.when(p == "3-MEDIUM", "na").when(s == "F", "").otherwise(p)
    path = F.when(p.startswith("5"), F.concat(F.lit("/"), p)).when(F.col("o_custkey") % 4 == 0, F.concat(p, F.lit("/../x"))).otherwise(F.concat(p, F.lit("/..x")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalars.missing_to_null(marked).alias("license"),
        scalars.na_to_null(listed).alias("listing"),
        scalars.provider(F.when(s == "O", fixed.INAT_PUBLISHER), F.when(p == "1-URGENT", "").otherwise(p)).alias("provider"),
        scalars.safe_path(path).alias("safe"),
    )


@_r.query(f"""
WITH a AS (SELECT p_partkey, 'GCF_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.' || (p_partkey % 3 + 1) AS acc, p_name || '#' || p_size AS asm FROM part),
d AS (SELECT *, 'https://{fixed.FTP_HOST}/genomes/all/GCF/' || substring(acc, 5, 3) || '/' || substring(acc, 8, 3) || '/' || substring(acc, 11, 3) || '/'
        || acc || '_' || regexp_replace(asm, '[^A-Za-z0-9._-]+', '_', 'g') AS dir FROM a)
SELECT p_partkey, dir AS directory, dir || '/' || regexp_extract(dir, '([^/]+)$', 1) || '_genomic.fna.gz' AS sequence,
       dir || '/md5checksums.txt' AS checksums FROM d""")
def genome_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where assemblies lie by accession and name, and their files by an old ftp address."""
    k = F.col("p_partkey")
    acc = F.concat(F.lit("GCF_"), F.lpad(k.cast("string"), 9, "0"), F.lit("."), (k % 3 + 1).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", scalars.ftp_directory(acc, F.concat("p_name", F.lit("#"), F.col("p_size"))).alias("directory"))
    files = scalars.genome_urls(F.concat(F.regexp_replace("directory", "^https:", "ftp:"), F.lit("//")))
    return rows.select("p_partkey", "directory", files["sequence"].alias("sequence"), files["md5checksums"].alias("checksums"))


@_r.query("""
WITH l AS (SELECT n_nationkey, n_name, r_name, CAST(n_regionkey AS BIGINT) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, array_to_string([r, 1000 + r, 10000 + n_nationkey], ',') AS taxids, r_name AS family,
       CASE WHEN n_nationkey % 5 = 0 THEN 'Animalia' WHEN n_nationkey % 5 = 1 THEN 'Plantae' ELSE 'Fungi' END AS kingdom,
       CASE WHEN n_nationkey % 4 = 0 THEN 'Tracheophyta' ELSE n_name END AS phylum,
       CASE WHEN n_nationkey % 3 = 0 THEN 'Reptilia' WHEN n_nationkey % 3 = 1 THEN 'Actinopterygii' ELSE '' END AS class
FROM l""")
def caption_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages of nations, and ranks in caption vocabulary with overrides by lineage."""
    k = F.col("n_nationkey")
    entry = lambda t, name, rank: F.struct(t.cast("long").alias("taxid"), name.alias("name"), F.lit(rank).alias("rank"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lineage = F.array(entry(F.col("n_regionkey"), F.col("r_name"), "family"), entry(1000 + F.col("n_regionkey"), F.lit("x"), "family"), entry(10000 + k, F.col("n_name"), "genus"))
    taxids = F.when(k % 3 == 0, F.array(F.lit(8504).cast("long"))).when(k % 4 == 0, F.array(F.lit(58023).cast("long")))
    both = F.when((k % 3 == 0) & (k % 4 == 0), F.array(F.lit(58023).cast("long"), F.lit(8504).cast("long"))).otherwise(taxids)
    ranks = scalars.caption_ranks(
        F.when(k % 5 == 0, "Metazoa").when(k % 5 == 1, "Viridiplantae").otherwise("Fungi"), F.when(k % 4 == 0, "Streptophyta").otherwise(F.col("n_name")),
        F.when(k % 3 == 1, "Actinopteri"), F.coalesce(both, F.array(F.lit(-1).cast("long"))),
    )
    return rows.select(
        "n_nationkey", F.array_join(scalars.lineage_taxids(lineage).cast("array<string>"), ",").alias("taxids"),
        scalars.ancestor(lineage, "family")["name"].alias("family"), ranks["kingdom"].alias("kingdom"), ranks["phylum"].alias("phylum"), ranks["class"].alias("class"),
    )


@_r.query("""
WITH n AS (SELECT n_nationkey, r_name AS ord, 'F' || n_regionkey AS fam, n_name AS gen, CASE WHEN n_nationkey % 4 <> 0 THEN n_name || ' minor' END AS sp
           FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT unnest(['class', 'order', 'family', 'genus', 'species']) AS rank, unnest(range(5)) AS k)
SELECT n_nationkey, rank, 'a photo of Animalia' || CASE WHEN k >= 1 THEN ' ' || ord ELSE '' END || CASE WHEN k >= 2 THEN ' ' || fam ELSE '' END
         || CASE WHEN k >= 3 THEN ' ' || gen ELSE '' END || CASE WHEN k >= 4 AND sp IS NOT NULL THEN ' minor' ELSE '' END AS caption,
       coalesce(sp, gen || ' sp.') AS species, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'C' END AS class
FROM n, r""")
def captions_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of each nation cut at every rank, and its rank columns."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, higher = F.col("n_nationkey"), [F.lit("Animalia")]
    names = F.col("r_name"), F.concat(F.lit("F"), "n_regionkey"), F.col("n_name"), F.when(k % 4 != 0, F.concat("n_name", F.lit(" minor")))
    ranks = scalars.rank_columns(F.when(k % 2 != 0, "C"), *names)
    cut = [F.struct(F.lit(r).alias("rank"), scalars.caption_at(r, *names, higher).alias("caption")) for r in ("class", *fixed.CAPTION_RANKS)]
    return rows.select("n_nationkey", F.explode(F.array(*cut)).alias("c"), ranks.alias("r")).select(
        "n_nationkey", "c.rank", "c.caption", F.col("r.species").alias("species"), F.col("r.class").alias("class")
    )


@_r.query("""
WITH t AS (SELECT avg(log10(p_retailprice)) AS m, stddev_samp(log10(p_retailprice)) AS s FROM part WHERE p_size <= 25)
SELECT p_partkey, round((log10(p_retailprice) - m) / s, 7) AS z, round(p_retailprice, 5) AS years FROM part, t""")
def scaled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as z-scores of a training part, and back to years."""
    part = table(spark, sf_dir, "part")
    y = scalars.log_years(F.col("p_retailprice"))
    norm = part.where("p_size <= 25").agg(F.avg(y).alias("m"), F.stddev_samp(y).alias("s"))
    z = scalars.scaled(y, F.col("m"), F.col("s"))
    rows = part.crossJoin(F.broadcast(norm)).withColumn("z", z)  # one row
    back = F.pow(F.lit(10.0), scalars.unscaled(F.col("z"), F.col("m"), F.col("s")))
    return rows.select("p_partkey", F.round("z", 7).alias("z"), F.round(back, 5).alias("years"))


@_r.query("""
SELECT doc_id, lang IS NULL OR lang IN ('en', 'de') AS listed, lang IS NULL OR lang NOT IN ('fr') AS kept, text IS NOT NULL AND trim(text) <> '' AS has_text,
       CASE source WHEN 'src1' THEN TRUE WHEN 'src2' THEN TRUE ELSE FALSE END AS cc_only, source = 'src1' AS permissive, TRUE AS anything
FROM documents""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership with nulls, exclusion that keeps nulls, presence, and licence policies."""
    slug = F.when(F.col("source") == "src1", "CC-BY-4.0").when(F.col("source") == "src2", "cc-by-nc").when(F.col("source") == "src3", "all rights reserved")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        S.one_of(F.col("lang"), ["en", None, "de"]).alias("listed"),
        S.none_of(F.col("lang"), ["fr"]).alias("kept"),
        scalars.present(F.col("text")).alias("has_text"),
        scalars.licence_allowed(slug, "cc_only").alias("cc_only"),
        scalars.licence_allowed(slug, "permissive").alias("permissive"),
        scalars.licence_allowed(slug, "any").alias("anything"),
    )


@_r.query("""
WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS s FROM documents)
SELECT doc_id, md5(s) AS bases, (length(s) - length(replace(s, 'N', ''))) / CAST(nullif(length(s), 0) AS DOUBLE) AS n_share FROM d""")
def unknown_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as bases, and the share of unknown ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", Q.normal_bases(F.col("text")).alias("bases"))
    return rows.select("doc_id", F.md5("bases").alias("bases"), Q.n_share(F.col("bases")).alias("n_share"))


@_r.query("""
SELECT o_orderkey AS candidate_id, 'orders' AS source_dataset, CASE WHEN o_orderstatus = 'O' THEN 'inaturalist' ELSE 'gbif' END AS source_provider,
       CAST(o_custkey AS VARCHAR) AS observation_id, 'http://x/' || o_orderkey AS source_url,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'citizen_science' ELSE 'unknown' END AS image_type,
       CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS license FROM orders""")
def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalog rows, projected to candidate records."""
    p = F.col("o_orderpriority")
    ranked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uuid"), F.lit("q").alias("species_query"), F.lit("n").alias("scientific_name"),
        F.when(F.col("o_orderstatus") == "O", fixed.INAT_PUBLISHER).alias("publisher"), F.lit("gbif").alias("data_source"),
        F.col("o_custkey").cast("string").alias("source_id"), F.concat(F.lit("http://x/"), "o_orderkey").alias("source_url"),
        F.when(p == "1-URGENT", "Citizen Science").otherwise(p).alias("img_type"), F.when(p == "2-HIGH", "not provided").otherwise(p).alias("license_name"),
        p.alias("license_link"), p.alias("copyright_owner"),
    )
    out = S.candidate_columns(ranked, dataset="orders")
    return out.select("candidate_id", "source_dataset", "source_provider", "observation_id", "source_url", "image_type", "license")


@_r.query("""
WITH c AS (SELECT 'a' || (l_partkey % 40) AS q, l_partkey % 40 AS k, l_suppkey AS id, l_linenumber AS rank FROM lineitem),
f AS (SELECT q, k, id, min(rank) AS rank FROM c GROUP BY ALL),
n AS (SELECT *, 's' || (k // 2) AS species, k % 2 AS name_rank FROM f),
s AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY species, id ORDER BY name_rank, rank) = 1)
SELECT species, id AS candidate_id, q AS species_query, CAST(row_number() OVER (PARTITION BY species ORDER BY name_rank, rank, id) AS INTEGER) AS merged_rank
FROM s QUALIFY merged_rank <= 12""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates found under two names of a species: the first name's stands, twelve for each."""
    k = F.col("l_partkey") % 40
    found = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), k).alias("species_query"), F.col("l_suppkey").alias("candidate_id"), F.col("l_linenumber").alias("rank"))
    found = found.groupBy("species_query", "candidate_id").agg(F.min("rank").alias("rank"))
    names = spark.range(40).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("species"), F.concat(F.lit("a"), "id").alias("species_query"), (F.col("id") % 2).alias("name_rank"))
    return S.merge_candidates(found, names, 12).select("species", "candidate_id", "species_query", "merged_rank")


@_r.query("""
WITH i AS (SELECT page_id AS image_id, page_id AS photo FROM pages),
s AS (SELECT page_id AS photo, 'cc-' || (page_id % 5) AS license FROM pages WHERE page_id % 3 <> 0)
SELECT image_id, license FROM i LEFT JOIN s USING (photo)""")
def recovered_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of photos from a later snapshot by the number in their addresses."""
    k = F.col("page_id")
    images = table(spark, sf_dir, "pages").select(k.alias("image_id"), F.concat(F.lit(f"https://{_HOST}/photos/"), k, F.lit("/large.jpg")).alias("source_url"))
    later = table(spark, sf_dir, "pages").where(k % 3 != 0).select(k.cast("string").alias("photo_id"), F.concat(F.lit("cc-"), k % 5).alias("license"))
    return X.recover_licences(images, later).select("image_id", "license")


@_r.query("""
SELECT c_custkey AS image_id, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'format' WHEN least(c_nationkey * 50, abs(c_acctbal)) < 300 THEN 'too small'
         WHEN CAST(c_nationkey * 50 AS BIGINT) * CAST(floor(abs(c_acctbal)) AS BIGINT) > 6000000 THEN 'too large' END AS problem FROM customer""")
def image_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images: format, least side and pixels."""
    images = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("image_id"), F.col("c_mktsegment").alias("format"), (F.col("c_nationkey") * 50).alias("width"), F.floor(F.abs("c_acctbal")).alias("height")
    )
    return S.image_policy(images, ["BUILDING", "MACHINERY", "AUTOMOBILE"], 300, 6_000_000).select("image_id", "problem")


@_r.query("""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE '' END AS flag,
       CASE WHEN l_linenumber = 1 THEN 'a|b' WHEN l_linenumber = 2 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS listed,
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS shipped FROM lineitem""")
def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the cells of a text table: nulls, lists and times."""
    n = F.col("l_linenumber")
    listed = F.when(n == 1, F.array(F.lit("a"), F.lit("b"))).when(n > 2, F.array(n.cast("string")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("flag"), listed.alias("listed"), F.col("l_shipdate").cast("timestamp").alias("shipped"))
    return B.csv_cells(lines)
