"""Whole datasets over the test tables: the catalog source, a validated dataset, chunk pools, protocols and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..operators import drift as D
from ..operators import selection as S
from ..operators import tables as B
from ..operators import validation as V
from ..operators.order import numbered
from ..session import spread
from ..sources import catalog as C
from ..sources import listings, registry
from ..workspace import Workspace
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

# ---------------------------------------------------------------- the catalog source

_SPECIES = ["Cold widget", "Small widget", "Large bolt", "No such"]
_CATALOG = f"""
c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS uuid, l_orderkey, l_suppkey, l_linenumber, min(l_returnflag) AS flag,
      any_value(upper(p_name[1:1]) || p_name[2:]) AS species_query, any_value(p_type) AS class
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
m AS (SELECT * FROM c WHERE species_query IN ({", ".join(f"'{s}'" for s in _SPECIES)})),
e AS (SELECT *, md5('0:' || uuid) AS k FROM m WHERE l_linenumber <> 7 AND l_suppkey % 10 <> 3 AND flag <> 'R' AND l_suppkey % 4 < 2),
o AS (SELECT *, row_number() OVER (PARTITION BY species_query, l_orderkey ORDER BY k, uuid) AS r FROM e)"""


def _written_catalog(spark: SparkSession, sf_dir: str) -> tuple[Workspace, dict]:
    """A catalog with a provenance table made of order lines, written as a release is: two Parquet tables."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_returnflag").alias("flag")).join(part, "l_partkey")
    supplier, uuid = F.col("l_suppkey"), F.concat_ws("-", *keys)
    host = F.when(supplier % 10 == 3, fixed.EXCLUDED_HOSTS[0]).otherwise("img.example.org")
    author = F.when(supplier % 3 == 0, " (Linnaeus, 1758)").otherwise("")
    rows = lines.select(
        uuid.alias("uuid"), F.when(F.col("l_linenumber") != 7, F.concat(F.lit("https://"), host, F.lit("/"), uuid, F.lit(".jpg"))).alias("source_url"),
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), author).alias("scientific_name"), F.lit("gbif").alias("data_source"),
        F.lit("iNaturalist.org").alias("publisher"), F.when(F.col("flag") == "R", "FOSSIL_SPECIMEN").otherwise("HUMAN_OBSERVATION").alias("basis_of_record"),
        F.when(supplier % 5 != 0, "Citizen Science").alias("img_type"), F.concat(F.lit("obs-"), "l_orderkey").alias("source_id"), F.col("p_type").alias("class"),
        supplier.alias("_s"),
    )
    work = Workspace(spark, "catalog")
    rows.write.parquet(f"{work.root}/catalog.parquet")
    written = spark.read.parquet(f"{work.root}/catalog.parquet").where("_s % 4 < 3")  # lines are grouped and joined once
    licence = F.when(F.col("_s") % 4 == 0, "cc-by-4.0").when(F.col("_s") % 4 == 1, "cc-by-nc-4.0").otherwise("other")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("license_link", "copyright_owner", "title")]
    written.select("uuid", licence.alias("license_name"), *nothing).write.parquet(f"{work.root}/provenance.parquet")
    return work, {"catalog": f"{work.root}/catalog.parquet", "provenance": f"{work.root}/provenance.parquet", "species": _SPECIES, "exclude_basis": ["FOSSIL_SPECIMEN"]}


@_r.query(f"""
WITH {_CATALOG}
SELECT species_query, uuid AS candidate_id, 'obs-' || l_orderkey AS observation_id, 'https://img.example.org/' || uuid || '.jpg' AS source_url,
       CASE WHEN l_suppkey % 5 <> 0 THEN 'citizen_science' ELSE 'unknown' END AS image_type,
       CAST(row_number() OVER (PARTITION BY species_query ORDER BY k, uuid) AS INTEGER) AS rank FROM o WHERE r = 1 QUALIFY rank <= 20""")
def catalog_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty candidates of each species out of a written catalog, selected through the registry of sources."""
    _, how = _written_catalog(spark, sf_dir)
    found = registry.candidates(spark, "catalog", **how, per_species=20)
    return found.select("species_query", "candidate_id", "observation_id", "source_url", "image_type", "rank")


@_r.query(f"""
WITH {_CATALOG.replace("FROM lineitem JOIN part ON l_partkey = p_partkey GROUP", "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY' GROUP")},
n AS (SELECT species_query, count(*) AS n_rows, count_if(l_linenumber = 7) AS n_no_url, count_if(l_suppkey % 5 <> 0) AS n_citizen FROM m GROUP BY 1),
s AS (SELECT species_query, count(*) AS n_eligible, count(DISTINCT l_orderkey) AS n_observations, count_if(r = 1) AS n_selectable FROM o GROUP BY 1)
SELECT q.species_query, coalesce(n_rows, 0) AS n_rows, CAST(coalesce(n_no_url, 0) AS BIGINT) AS n_no_url, CAST(coalesce(n_citizen, 0) AS BIGINT) AS n_citizen,
       coalesce(n_eligible, 0) AS n_eligible, coalesce(n_observations, 0) AS n_observations, CAST(coalesce(n_selectable, 0) AS BIGINT) AS n_selectable
FROM (SELECT unnest([{", ".join(f"'{s}'" for s in _SPECIES)}]) AS species_query) q LEFT JOIN n USING (species_query) LEFT JOIN s USING (species_query)""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be selected of each species out of one class of a written catalog."""
    work, how = _written_catalog(spark, sf_dir)
    C.class_subset(spark, how["catalog"], how["provenance"], f"{work.root}/class", "ECONOMY")
    how |= {"catalog": f"{work.root}/class/catalog.parquet", "provenance": f"{work.root}/class/provenance.parquet"}
    out = C.summary(spark, **how)
    citizen = F.coalesce(F.try_element_at("image_types", F.lit("Citizen Science")), F.lit(0)).cast("long")
    return out.select("species_query", "n_rows", "n_no_url", citizen.alias("n_citizen"), "n_eligible", "n_observations", "n_selectable")


# ---------------------------------------------------------------- a whole dataset


def _dataset_table(df: DataFrame, name: str, **given: Column) -> DataFrame:
    """A dataset table with the given columns; others hold a plain value of their type."""
    plain = {"bigint": F.lit(1), "string": F.lit("x"), "double": F.lit(0.5), "timestamp": F.timestamp_micros(F.lit(0))}
    columns = []
    for f in schemas.TABLES[name]:
        kind = f.dataType.simpleString()
        columns.append((given[f.name] if f.name in given else F.array() if kind.startswith("array") else plain[kind]).cast(kind).alias(f.name))
    return df.select(*columns)


@_r.query(f"""
WITH sp AS (SELECT p_partkey AS taxid, p_size AS n_images, CASE WHEN p_partkey % 400 = 9 THEN 'hidden' ELSE 'train' END AS split FROM part),
g AS (SELECT 'G' || s_suppkey AS acc, s_suppkey * (CASE WHEN s_suppkey % 10 = 7 THEN 1000003 ELSE 1 END) AS st, CASE WHEN s_suppkey % 9 = 4 THEN 'Piece' ELSE 'Chromosome' END AS level,
      's' || (s_suppkey // 2 * (CASE WHEN s_suppkey % 8 < 2 THEN 2 ELSE 0 END) + s_suppkey * (CASE WHEN s_suppkey % 8 < 2 THEN 0 ELSE 2 END) ) AS file FROM supplier),
im AS (SELECT 'I' || o_orderkey AS id, o_custkey AS taxid, CASE WHEN o_orderkey % 700 = 5 THEN NULL ELSE 'd' END AS sha FROM orders),
pr AS (SELECT DISTINCT 'I' || l_orderkey AS id, 'G' || l_suppkey AS acc, l_suppkey AS taxid, CASE WHEN l_suppkey % 25 = 6 THEN 'guess' ELSE 'species_reference' END AS pairing
       FROM lineitem WHERE l_orderkey % 20 = 0 OR l_suppkey % 3 = 0),
f AS (SELECT 'species' AS t, 'row' AS c, CAST(taxid AS VARCHAR) AS key, 'split is not allowed: hidden' AS m FROM sp WHERE split = 'hidden'
  UNION ALL SELECT 'species', 'schema', NULL, 'extra column note'
  UNION ALL SELECT 'genomes', 'row', acc, 'assembly_level is not allowed: Piece' FROM g WHERE level = 'Piece'
  UNION ALL SELECT 'genomes', 'unique', file, 'duplicate (sequence_file): ' || count(*) || ' rows' FROM g GROUP BY file HAVING count(*) > 1
  UNION ALL SELECT 'genomes', 'reference', acc, 'species_taxid ' || st || ' not in species' FROM g WHERE st NOT IN (SELECT taxid FROM sp)
  UNION ALL SELECT 'images', 'row', id, 'sha256 is null' FROM im WHERE sha IS NULL
  UNION ALL SELECT 'images', 'reference', id, 'ncbi_taxid ' || taxid || ' not in species' FROM im WHERE taxid NOT IN (SELECT taxid FROM sp)
  UNION ALL SELECT 'pairs', 'row', id || ', ' || acc, 'pairing is not allowed: guess' FROM pr WHERE pairing = 'guess'
  UNION ALL SELECT 'pairs', 'reference', id || ', ' || acc, 'image_id ' || id || ' not in images' FROM pr WHERE id NOT IN (SELECT id FROM im)
  UNION ALL SELECT 'pairs', 'reference', id || ', ' || acc, 'assembly_accession ' || acc || ' not in genomes' FROM pr WHERE acc NOT IN (SELECT acc FROM g)
  UNION ALL SELECT 'pairs', 'agreement', pr.id || ', ' || acc, 'ncbi_taxid ' || pr.taxid || ' != images ncbi_taxid ' || im.taxid FROM pr JOIN im USING (id) WHERE pr.taxid <> im.taxid
  UNION ALL SELECT 'pairs', 'agreement', id || ', ' || acc, 'ncbi_taxid ' || taxid || ' != genomes species_taxid ' || st FROM pr JOIN g USING (acc) WHERE taxid <> st
  UNION ALL SELECT 'species', 'count', CAST(taxid AS VARCHAR), 'n_images is ' || n_images || ', there are ' || (SELECT count(*) FROM im WHERE im.taxid = sp.taxid) FROM sp
      WHERE n_images <> (SELECT count(*) FROM im WHERE im.taxid = sp.taxid)
  UNION ALL SELECT 'species', 'count', CAST(taxid AS VARCHAR), 'n_genomes is 1, there are ' || (SELECT count(*) FROM g WHERE st = taxid) FROM sp WHERE 1 <> (SELECT count(*) FROM g WHERE st = taxid)),
r AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY key, m) AS r, count(*) OVER (PARTITION BY t, c) AS n FROM f)
SELECT t AS "table", c AS "check", key, m AS message FROM r WHERE r <= {fixed.MESSAGES}
UNION ALL SELECT DISTINCT t, c, NULL, '... and ' || (n - {fixed.MESSAGES}) || ' more like this' FROM r WHERE n > {fixed.MESSAGES}""")
def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report over a broken dataset of four tables: schema, rows, keys, references, agreements and counts."""
    part, supplier, orders, lines = (table(spark, sf_dir, t) for t in ("part", "supplier", "orders", "lineitem"))
    k = F.col("s_suppkey")
    species = _dataset_table(
        part, "species", ncbi_taxid=F.col("p_partkey"), n_images=F.col("p_size"), split=F.when(F.col("p_partkey") % 400 == 9, "hidden").otherwise("train")
    ).withColumn("note", F.lit("x"))
    shared = k % 8 < 2
    genomes = _dataset_table(
        supplier, "genomes", assembly_accession=F.concat(F.lit("G"), k), species_taxid=k * F.when(k % 10 == 7, 1000003).otherwise(1),
        assembly_level=F.when(k % 9 == 4, "Piece").otherwise("Chromosome"), source=F.lit("ncbi_refseq"),
        sequence_file=F.concat(F.lit("s"), F.when(shared, F.floor(k / 2) * 2).otherwise(k * 2).cast("string")),
    )
    images = _dataset_table(
        orders, "images", image_id=F.concat(F.lit("I"), "o_orderkey"), ncbi_taxid=F.col("o_custkey"), file=F.concat(F.lit("f"), "o_orderkey"),
        image_type=F.lit("unknown"), sha256=F.when(F.col("o_orderkey") % 700 != 5, "d"),
    )
    used = lines.where("l_orderkey % 20 = 0 or l_suppkey % 3 = 0").select("l_orderkey", "l_suppkey").distinct()
    pairs = _dataset_table(
        used, "pairs", image_id=F.concat(F.lit("I"), "l_orderkey"), assembly_accession=F.concat(F.lit("G"), "l_suppkey"), ncbi_taxid=F.col("l_suppkey"),
        pairing=F.when(F.col("l_suppkey") % 25 == 6, "guess").otherwise("species_reference"),
    )
    return V.dataset({"species": species, "genomes": genomes, "images": images, "pairs": pairs})


# ---------------------------------------------------------------- pools, protocols, documents


@_r.query("""
WITH d AS (SELECT source, doc_id, n_chars FROM documents),
p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk FROM d),
s AS (SELECT DISTINCT source FROM d)
SELECT source, CASE WHEN source = 'src3' THEN 'differs' WHEN source = 'src5' THEN 'missing' ELSE 'copied' END AS state,
       CASE WHEN source IN ('src3', 'src5') THEN 0 ELSE (SELECT count(*) FROM p WHERE p.source = s.source AND chunk < 5) END AS n_chunks FROM s""")
def prefix_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chunks of every source copied from a pool in which one source was tampered with and one is lost."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    work = Workspace(spark, "pool")
    pool = numbered(docs, ["source"], ["doc_id"], "_n", work=work).select("source", (F.col("_n") - 1).cast("int").alias("chunk_id"), F.split("text", " ").alias("input_ids"))
    stored = work.cut(D.unit_fingerprints(pool, "source"))
    spoiled = F.when((F.col("source") == "src3") & (F.col("chunk_id") == 0), F.array(F.lit("tampered"))).otherwise(F.col("input_ids"))
    now = pool.where("source <> 'src5'").withColumn("input_ids", spoiled)
    redo = B.copy_prefix(now, stored, f"{work.root}/copy", 5, "source")
    copied = spark.read.parquet(f"{work.root}/copy").groupBy("source").agg(F.count("*").alias("n_chunks"))
    out = redo.select("source", F.col("message").alias("state"), F.lit(0).cast("long").alias("n_chunks"))
    return out.unionByName(copied.select("source", F.lit("copied").alias("state"), "n_chunks"))


@_r.query("""
WITH RECURSIVE d AS (SELECT 'f' || c_custkey AS f, CASE WHEN c_custkey <= 1 THEN NULL WHEN c_custkey = 30 THEN 'gone' WHEN c_custkey = 40 THEN 'f80' ELSE 'f' || (c_custkey // 2) END AS p FROM customer),
w AS (SELECT f, f AS here, 0 AS depth FROM d UNION ALL SELECT w.f, d.p, depth + 1 FROM w JOIN d ON d.f = w.here WHERE d.p IS NOT NULL AND depth < 60 AND d.p IN (SELECT f FROM d)),
e AS (SELECT f, max(depth) AS depth, arg_max(here, depth) AS root FROM w GROUP BY 1)
SELECT f AS fingerprint, CASE WHEN depth < 60 THEN root END AS root, CASE WHEN depth < 60 THEN CAST(depth AS BIGINT) END AS depth,
       CASE WHEN depth >= 60 THEN 'cycle' WHEN (SELECT p FROM d WHERE d.f = e.root) = 'gone' THEN 'unknown parent' END AS problem FROM e""")
def parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen documents, customers standing for them, walked up to their roots: one lost parent and one cycle."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    parent = F.when(k == 30, "gone").when(k == 40, "f80").when(k > 1, name(F.floor(k / 2)))
    return D.parent_chains(table(spark, sf_dir, "customer").select(name(k).alias("fingerprint"), parent.alias("parent")))


@_r.query("""
WITH r AS (SELECT DISTINCT p_partkey AS species, s AS split, p_partkey % 500 = 11 AS twice, log10(p_retailprice) AS y FROM part,
             LATERAL (SELECT unnest(CASE WHEN p_partkey % 5 = 0 THEN ['val', 'val_sub'] WHEN p_partkey % 5 = 1 THEN ['test'] ELSE ['train'] END) AS s)
           UNION SELECT p_partkey, 'test', FALSE, log10(p_retailprice) FROM part WHERE p_partkey % 333 = 2
           UNION SELECT p_partkey, 'val_sub', FALSE, log10(p_retailprice) FROM part WHERE p_partkey % 250 = 3),
l AS (SELECT species, split FROM r WHERE species % 400 <> 7 UNION SELECT species, 'train' FROM r WHERE species % 600 = 10)
SELECT 'splits' AS "table", 'overlap' AS "check", CAST(species AS VARCHAR) AS key, 'test and train' AS message FROM r WHERE split <> 'val_sub' GROUP BY species HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'splits', 'species', CAST(species AS VARCHAR), 'used but not listed in ' || split FROM (SELECT DISTINCT species, split FROM r) WHERE (species, split) NOT IN (SELECT (species, split) FROM l)
UNION ALL SELECT 'splits', 'species', CAST(species AS VARCHAR), 'listed but not used in ' || split FROM l WHERE (species, split) NOT IN (SELECT (species, split) FROM r)
UNION ALL SELECT DISTINCT 'splits', 'subset', CAST(species AS VARCHAR), 'in val_sub but not in val' FROM r WHERE split = 'val_sub' AND species NOT IN (SELECT species FROM r WHERE split = 'val')
UNION ALL SELECT DISTINCT 'labels', 'single', CAST(species AS VARCHAR), 'species has several labels' FROM r WHERE twice
UNION ALL SELECT 'normalisation', 'value', 'sd', 'recorded value is not that of the training species'
UNION ALL SELECT 'documents', 'parent', 'b', 'cycle' UNION ALL SELECT 'documents', 'parent', 'c', 'cycle' UNION ALL SELECT 'documents', 'parent', 'd', 'unknown parent'""")
def protocol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison, parts standing for species, with one broken thing for each check."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("species"), F.log10("p_retailprice").alias("y"))
    k = F.col("species")
    names = F.when(k % 5 == 0, F.array(F.lit("val"), F.lit("val_sub"))).when(k % 5 == 1, F.array(F.lit("test"))).otherwise(F.array(F.lit("train")))
    rows = part.select("species", F.explode(names).alias("split"), "y")
    rows = rows.unionByName(part.where(k % 333 == 2).withColumn("split", F.lit("test"))).unionByName(part.where(k % 250 == 3).withColumn("split", F.lit("val_sub")))
    listed = rows.where(k % 400 != 7).select("species", "split").unionByName(rows.where(k % 600 == 10).select("species", F.lit("train").alias("split")))
    mean = rows.where("split = 'train'").groupBy("species").agg(F.min("y").alias("y")).agg(F.avg("y")).first()[0]
    labelled = rows.unionByName(rows.where(k % 500 == 11).withColumn("y", F.col("y") + 1))
    chain = spark.createDataFrame([("a", None), ("b", "c"), ("c", "b"), ("d", "e")], "fingerprint string, parent string")
    return V.protocol(labelled, listed, chain, {"mean": mean, "sd": -1.0}, label="y")


@_r.query("""
WITH RECURSIVE d AS (SELECT o_orderkey AS id, json_object('order', json_object('key', o_orderkey, 'of', json_object('status', o_orderstatus, 'list', json_array(o_custkey, json_object('x', 1)), 'none', NULL)),
    'priority', o_orderpriority, 'whole', o_orderkey % 2 = 0, 'empty', CAST('{}' AS JSON)) AS doc FROM orders),
r AS (SELECT id, k AS path, json_extract(doc, '$.' || k) AS v FROM (SELECT id, doc, unnest(json_keys(doc)) AS k FROM d)
      UNION ALL SELECT id, path || '.' || k, json_extract(v, '$.' || k) FROM (SELECT id, path, v, unnest(json_keys(v)) AS k FROM r WHERE json_type(v) = 'OBJECT'))
SELECT id, path, CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$') WHEN 'NULL' THEN NULL ELSE CAST(v AS VARCHAR) END AS value
FROM r WHERE json_type(v) <> 'OBJECT' OR len(json_keys(v)) = 0""")
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of documents of three levels, one for each order."""
    k = F.col("o_orderkey")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    doc = F.concat(
        F.lit('{"order":{"key":'), k.cast("string"), F.lit(',"of":{"status":'), text(F.col("o_orderstatus")), F.lit(',"list":['), F.col("o_custkey").cast("string"),
        F.lit(',{"x":1}],"none":null}},"priority":'), text(F.col("o_orderpriority")), F.lit(',"whole":'), (k % 2 == 0).cast("string"), F.lit(',"empty":{}}'),
    )
    return D.json_leaves(spread(table(spark, sf_dir, "orders")).select(k.alias("id"), doc.alias("doc")), "id", "doc")


# ---------------------------------------------------------------- listings written from the tables and parsed again


@_r.query("""
SELECT 'gbif:' || o_orderkey AS candidate_id, CAST(o_orderkey AS VARCHAR) AS source_id, 'https://img.example.org/' || o_orderkey || '.jpg' AS source_url,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Cold widget' ELSE 'Cold widget L.' END AS original_label, CASE WHEN o_custkey % 2 = 0 THEN 'own' ELSE 'all' END AS publisher
FROM orders WHERE o_orderkey % 5 <> 0""")
def parse_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence documents, one for each order: the first still image with an address, names and publishers by preference."""
    k, text = F.col("o_orderkey"), lambda x: F.lit(x)
    medium = lambda kind, at: F.struct(text(kind).alias("type"), at.alias("identifier"), F.when(F.col("o_custkey") % 2 == 0, "own").alias("publisher"))
    url = F.concat(F.lit("https://img.example.org/"), k.cast("string"), F.lit(".jpg"))
    media = F.array(medium("Sound", url), medium("StillImage", F.lit("")), medium("StillImage", F.when(k % 5 != 0, url).otherwise("")), medium("StillImage", F.when(k % 5 != 0, F.lit("later")).otherwise("")))
    doc = F.struct(k.alias("key"), F.when(k % 3 != 0, "Cold widget L.").otherwise("").alias("scientificName"), text("Cold widget").alias("species"), text("all").alias("publisher"), media.alias("media"))
    found = listings.parse_occurrences(table(spark, sf_dir, "orders").select(F.to_json(doc).alias("doc")), "doc")
    return found.select("candidate_id", "source_id", "source_url", "original_label", "publisher")


@_r.query("""SELECT 'f' || o_orderkey || '.fna.gz' AS name, md5(CAST(o_orderkey AS VARCHAR)) AS md5 FROM orders WHERE o_orderkey % 11 <> 3""")
def parse_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checksum list written from orders, with and without folders, capitals and lines that are none."""
    k = F.col("o_orderkey")
    digest = F.when(k % 2 == 0, F.upper(F.md5(k.cast("string")))).otherwise(F.md5(k.cast("string")))
    line = F.concat(digest, F.when(k % 3 == 0, "  ./").when(k % 3 == 1, "  ").otherwise("  a/b/"), F.lit("f"), k.cast("string"), F.lit(".fna.gz"))
    return listings.parse_checksums(table(spark, sf_dir, "orders").select(F.when(k % 11 == 3, "no-list").otherwise(line).alias("value")))


@_r.query("""
SELECT 'GCF_' || p_partkey AS assembly_accession, p_size AS species_taxid, p_partkey AS taxid, p_name AS organism_name, p_retailprice AS gc_percent, p_partkey * 7 AS genome_size,
       CASE p_partkey % 3 WHEN 0 THEN 'breed=' || p_brand WHEN 1 THEN 'strain=' || p_type END AS infraspecific_name,
       CASE WHEN p_partkey % 4 = 0 THEN 'suppressed' ELSE 'latest' END AS version_status,
       CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'different' ELSE 'identical' END AS paired_asm_comp, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'ASM' || p_partkey END AS asm_name FROM part""")
def parse_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested assembly reports, one for each part, flattened again."""
    k = F.col("p_partkey")
    infra = F.when(k % 3 == 0, F.create_map(F.lit("breed"), "p_brand", F.lit("strain"), F.lit(""))).when(k % 3 == 1, F.create_map(F.lit("strain"), "p_type"))
    doc = F.struct(
        F.concat(F.lit("GCF_"), k.cast("string")).alias("accession"),
        F.struct(k.alias("tax_id"), F.col("p_name").alias("organism_name"), infra.alias("infraspecific_names")).alias("organism"),
        F.struct(
            F.when(k % 6 != 0, F.concat(F.lit("ASM"), k.cast("string"))).alias("assembly_name"), F.when(k % 4 == 0, "suppressed").otherwise("current").alias("assembly_status"),
            F.struct(F.when(k % 5 != 0, k % 5 == 1).alias("refseq_genbank_are_different")).alias("paired_assembly"),
        ).alias("assembly_info"),
        F.struct((k * 7).alias("total_sequence_length"), F.col("p_retailprice").alias("gc_percent")).alias("assembly_stats"),
    )
    found = listings.parse_reports(table(spark, sf_dir, "part").select(F.to_json(doc).alias("doc"), "p_size"), "doc", "p_size")
    return found.select("assembly_accession", "species_taxid", "taxid", "organism_name", "gc_percent", "genome_size", "infraspecific_name", "version_status", "paired_asm_comp", "asm_name")


@_r.query("""SELECT doc_id, lang, source FROM documents WHERE trim(coalesce(lang, '')) <> '' AND trim(coalesce(CASE WHEN doc_id % 6 = 0 THEN '  ' ELSE source END, '')) <> ''""")
def with_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a language and a source that are neither null nor blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 6 == 0, "  ").otherwise(F.col("source")).alias("source"))
    return S.with_filled(docs, "lang", "source")
