"""Sequences, tokens, k-mers and parsers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import kmers as K
from ..operators import sequences as Q
from ..operators import splits as P
from ..sources import fasta, listings
from ..session import spread
from .base import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_DNA = "regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'), '(?s)[^acgt]', 'n', 'g')"


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts spelled with bases: every letter stands for one, everything else for N."""
    text = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", Q.normal_bases(text).alias("seq"))


@_r.query(f"""
WITH d AS (SELECT doc_id, upper({_DNA}) AS s FROM documents)
SELECT doc_id, md5(reverse(translate(s, 'ACGTN', 'TGCAN'))) AS digest, length(s) AS n FROM d""")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("doc_id", F.md5(Q.reverse_complement(F.col("seq"))).alias("digest"), F.length("seq").alias("n"))


@_r.query(f"""
WITH d AS (SELECT doc_id, upper({_DNA}) AS s FROM documents), b AS (SELECT doc_id, s, unnest(range(0, length(s), 500)) AS block_start FROM d)
SELECT doc_id, CAST(block_start AS INTEGER) AS block_start, substring(s, block_start + 1, 500) AS seq FROM b""")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.blocks(_dna(spark, sf_dir), ["doc_id"], "seq", 500)


@_r.query(f"""
WITH d AS (SELECT source, upper({_DNA}) AS s FROM documents),
m AS (SELECT source, substring(s, i, 4) AS m FROM (SELECT source, s, unnest(range(1, length(s) - 2)) AS i FROM d WHERE length(s) >= 4)),
c AS (SELECT source, least(m, reverse(translate(m, 'ACGTN', 'TGCAN'))) AS kmer, count(*) AS n FROM m WHERE NOT contains(m, 'N') GROUP BY ALL)
SELECT source, kmer, round(n / sum(n) OVER (PARTITION BY source), 9) AS share FROM c""")
def kmer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical 4-mer shares of each source over its whole texts."""
    counts = K.kmer_counts(_dna(spark, sf_dir), ["source"], "seq", 4)
    return K.kmer_profile(counts, ["source"]).withColumn("share", F.round("share", 9))


@_r.query(f"""
WITH d AS (SELECT source, upper({_DNA}) AS s FROM documents),
m AS (SELECT source, substring(s, i, 4) AS m FROM (SELECT source, s, unnest(range(1, length(s) - 2)) AS i FROM d WHERE length(s) >= 4)),
c AS (SELECT source, least(m, reverse(translate(m, 'ACGTN', 'TGCAN'))) AS kmer, count(*) AS n FROM m WHERE NOT contains(m, 'N') GROUP BY ALL),
p AS (SELECT source, kmer, n / sum(n) OVER (PARTITION BY source) AS share FROM c),
f AS (SELECT source, kmer, coalesce(share, 0) AS share FROM (SELECT DISTINCT source FROM p) CROSS JOIN (SELECT DISTINCT kmer FROM p) LEFT JOIN p USING (source, kmer)),
z AS (SELECT source, kmer, (share - avg(share) OVER k) / (stddev_pop(share) OVER k + 1e-12) AS z FROM f WINDOW k AS (PARTITION BY kmer)),
v AS (SELECT source, list(z ORDER BY kmer) AS v FROM z GROUP BY 1),
s AS (SELECT a.source AS query, b.source AS source, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.source <> b.source)
SELECT query, source, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, source) = 1""")
def kmer_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with the most similar k-mers, never itself."""
    profile = K.kmer_profile(K.kmer_counts(_dna(spark, sf_dir), ["source"], "seq", 4), ["source"])
    vectors = K.scaled_vectors(profile, "source")
    return K.nearest(vectors, vectors, "source").withColumn("sim", F.round("sim", 6))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths as stand-ins for tokens."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w) + 3)
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", ids.alias("ids"))


_IDS = "ids AS (SELECT doc_id, source, lang, list_transform(string_split(text, ' '), lambda w: length(w) + 3) AS ids FROM documents)"


@_r.query(f"""
WITH {_IDS}, c AS (SELECT doc_id, list_concat([1], ids[1:64], [2]) AS t FROM ids)
SELECT doc_id, len(t) AS n, array_to_string(list_concat(t, list_transform(range(66 - len(t)), lambda i: 3)), ' ') AS ids FROM c""")
def crop_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 tokens with specials, padded to 66."""
    ids = Q.with_specials(Q.crop(F.col("ids"), 64))
    filled = Q.padded(ids, F.lit(66))
    return _ids(spark, sf_dir).select("doc_id", F.size(ids).alias("n"), F.array_join(filled["ids"].cast("array<string>"), " ").alias("ids"))


@_r.query(f"""
WITH {_IDS}, k AS (SELECT doc_id, ids, len(ids) AS n, greatest(CAST(ceil(len(ids) / greatest(ceil(len(ids) / 100), 1)) AS BIGINT), 1) AS step FROM ids),
w AS (SELECT doc_id, ids, step, unnest(range(0, greatest(n, 1), step)) AS s FROM k)
SELECT doc_id, s // step AS window_no, len(ids[s + 1:s + step]) AS n, list_sum(ids[s + 1:s + step])::BIGINT AS total FROM w""")
def equal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens in as few windows of at most 100 as fit."""
    rows = _ids(spark, sf_dir).select("doc_id", F.posexplode(Q.equal_windows(F.col("ids"), 100)).alias("window_no", "w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.size("w").alias("n"), total.alias("total"))


@_r.query(f"""
WITH {_IDS}, t AS (SELECT doc_id, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM ids)
SELECT doc_id, '1 ' || string_agg(CAST(x AS VARCHAR), ' ' ORDER BY md5('7:' || doc_id || ':' || i), x) || ' 2' AS ids FROM t GROUP BY 1""")
def shuffle_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens between the specials in a seeded order."""
    ids = Q.shuffled(Q.with_specials(F.col("ids")), 7, F.col("doc_id"))
    return _ids(spark, sf_dir).select("doc_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@_r.query(f"""
WITH {_IDS}, n AS (SELECT lang AS split, source, len(ids) AS n, greatest(CAST(ceil(len(ids) / 100) AS BIGINT), 1) AS w FROM ids)
SELECT split, count(DISTINCT source) AS n_species, count(*) AS n_pairs, sum(w)::BIGINT AS n_windows, sum(n + 2 * w)::BIGINT AS n_tokens FROM n GROUP BY 1""")
def input_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select(F.col("lang").alias("split"), "source", F.size("ids").alias("n"))
    return Q.input_statistics(rows, "split", "source", "n", 100)


@_r.query(f"""
WITH d AS (SELECT doc_id, upper({_DNA}) AS s FROM documents),
c AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0),
e AS (SELECT event_id, event_id * 7919 % (SELECT count(*) FROM documents) AS doc_id, event_id % 3 = 0 AS minus FROM events),
p AS (SELECT event_id, minus, substring(s, CAST(event_id * 104729 % n AS BIGINT) + 1, 60 + event_id % 500) AS piece FROM e JOIN c USING (doc_id) JOIN d USING (doc_id))
SELECT event_id, CASE WHEN minus THEN reverse(translate(piece, 'ACGTN', 'TGCAN')) ELSE piece END AS cds FROM p""")
def interval_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments anywhere in all texts, cut out of the blocks they touch and spliced, by strand."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.length("text").cast("long").alias("n")).where("n > 0")
    doc = F.col("event_id") * 7919 % docs.count()
    events = table(spark, sf_dir, "events").select("event_id", doc.alias("doc_id")).join(sizes, "doc_id")
    start = F.col("event_id") * 104729 % F.col("n")
    segments = events.select(
        "event_id",
        "doc_id",
        start.alias("start"),
        (start + 60 + F.col("event_id") % 500).alias("end"),
        F.when(F.col("event_id") % 3 == 0, "-").otherwise("+").alias("strand"),
    )
    texts = _dna(spark, sf_dir).select("doc_id", F.col("seq").alias("text"))
    return Q.cut_segments(segments, texts, ["event_id"], "doc_id", "text", "strand", 1024).select("event_id", "cds")


@_r.query("""
WITH s AS (SELECT source, doc_id, n_chars, greatest(n_chars - 100 + 1, 0) AS n FROM documents),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS hi FROM s)
SELECT source, doc_id, CAST(hi - n AS BIGINT) AS cum_lo, CAST(hi AS BIGINT) AS cum_hi FROM c WHERE n > 0""")
def valid_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return Q.valid_starts(docs, "source", "doc_id", "n_chars", 100).select("source", "doc_id", "cum_lo", "cum_hi")


@_r.query("""
WITH s AS (SELECT source, doc_id, greatest(n_chars - 100 + 1, 0) AS n FROM documents),
c AS (SELECT source, doc_id, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS hi, n FROM s),
t AS (SELECT source, sum(n) AS total FROM s GROUP BY 1),
d AS (SELECT source, i AS draw, CAST(floor(CAST('0x' || substring(md5('3:' || source || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0 * total) AS BIGINT) AS position
      FROM t, range(50) r(i) WHERE total > 0)
SELECT d.source, CAST(draw AS INTEGER) AS draw, doc_id, CAST(position - (hi - n) AS BIGINT) AS start
FROM d JOIN c ON d.source = c.source AND position >= hi - n AND position < hi""")
def window_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty seeded uniform windows of each source over all valid starts."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    spans = Q.valid_starts(docs, "source", "doc_id", "n_chars", 100)
    totals = spans.groupBy("source").agg(F.max("cum_hi").alias("total"))
    draws = P.uniform_draws(totals, "source", "total", 50, 3).select("source", "draw", "position")
    return Q.place_draws(draws, spans, "source").select("source", "draw", "doc_id", F.col("start").cast("long").alias("start"))


@_r.query(f"""
WITH RECURSIVE {_IDS}, p AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS l, (row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1) // 512 AS bucket FROM ids),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY l, doc_id) AS i FROM p),
r AS (SELECT bucket, doc_id, i, l AS longest, 1 AS n, 0 AS batch FROM o WHERE i = 1
      UNION ALL SELECT o.bucket, o.doc_id, o.i, CASE WHEN greatest(longest, l) * (n + 1) <= 16384 THEN greatest(longest, l) ELSE l END,
          CASE WHEN greatest(longest, l) * (n + 1) <= 16384 THEN n + 1 ELSE 1 END, CASE WHEN greatest(longest, l) * (n + 1) <= 16384 THEN batch ELSE batch + 1 END
      FROM r JOIN o ON o.bucket = r.bucket AND o.i = r.i + 1)
SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, CAST(batch AS INTEGER) AS batch FROM r""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of at most 16,384 padded tokens."""
    rows = _ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    return Q.budget_batches(rows, "doc_id", "n", 16_384, bucket=512)


@_r.query("""
SELECT CAST(p_partkey AS VARCHAR) AS assembly_accession, p_type AS refseq_category, p_partkey AS taxid, CAST(p_size AS BIGINT) AS species_taxid,
       p_name AS organism_name, p_brand AS assembly_level, p_retailprice AS gc_percent FROM part WHERE p_partkey % 7 <> 0""")
def parse_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assembly listing written from parts and parsed again; every seventh line is bad."""
    part = table(spark, sf_dir, "part")
    bad = F.when(F.col("p_partkey") % 7 == 0, "not-a-taxid").otherwise(F.col("p_partkey").cast("string"))
    cells = [F.col("p_partkey").cast("string"), F.col("p_type"), bad, F.col("p_size").cast("string"), F.col("p_name"), F.col("p_brand"), F.lit("na"), F.col("p_retailprice").cast("string")]
    lines = part.select(F.concat_ws("\t", *cells).alias("value"))
    header = ["assembly_accession", "refseq_category", "taxid", "species_taxid", "organism_name", "assembly_level", "asm_name", "gc_percent"]
    good, _ = listings.parse_listing(lines, header, listings.ASSEMBLY_KINDS, listings.ASSEMBLY_REQUIRED)
    return good.select(*[c for c in header if c != "asm_name"])


@_r.query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem),
h AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey, l_suppkey FROM l WHERE l_orderkey % 2 = 1)
SELECT id, 'P' || l_partkey AS protein, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_suppkey + 5 AS q_end,
       (100 + l_partkey) || '-' || (120 + l_partkey) || ' ' || (200 + l_partkey) || '-' || (220 + l_partkey) AS segments FROM h""")
def parse_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment lines written from order lines and parsed again: best hits with their segments."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    name = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    strand = F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-")
    rank = F.when(F.col("l_orderkey") % 2 == 1, "1").otherwise("2")
    head = F.concat(F.lit("ID="), name, F.lit(";Rank="), rank, F.lit(";Identity=0.9;Target=P"), F.col("l_partkey"), F.lit(" 1 "), F.col("l_suppkey") + 5)
    at = lambda kind, a, b, extra: F.concat_ws("\t", F.lit("chr"), F.lit("x"), F.lit(kind), (F.col("l_partkey") + a).cast("string"), (F.col("l_partkey") + b).cast("string"), F.lit("."), strand, F.lit("0"), extra)
    parent = F.concat(F.lit("Parent="), name)
    rows = F.array(at("CDS", 200, 220, parent), at("mRNA", 100, 220, head), at("CDS", 100, 120, parent))
    found = listings.parse_gff(lines.select(F.explode(rows).alias("value")))
    text = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), " ")
    return found.select("id", "protein", "strand", "q_end", text.alias("segments"))


@_r.query("""
SELECT event_id, CAST(user_id % 100 AS INTEGER) AS epoch, round(value, 3) AS loss, CAST(user_id AS DOUBLE) AS tok_per_s FROM events""")
def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log lines written from events and parsed again."""
    events = table(spark, sf_dir, "events")
    value = F.format_string("epoch %d loss %s tok/s=%d lr=0.1", (F.col("user_id") % 100).cast("int"), F.round("value", 3).cast("string"), F.col("user_id"))
    found = listings.parse_log(events.select("event_id", value.alias("value")))
    return found.select("event_id", "epoch", "loss", F.try_element_at("values", F.lit("tok/s")).cast("double").alias("tok_per_s"))


@_r.query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')) AS lines FROM documents),
r AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS record FROM l)
SELECT doc_id, CAST(record AS INTEGER) AS record, greatest(1, CAST(ceil(length(line) / 300) AS BIGINT)) AS n_blocks, length(line) AS n_bases FROM r""")
def fasta_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA documents made of the lines of texts, read as blocks that never join records."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    text = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit(">r"), i.cast("string"), F.lit("\n"), F.regexp_replace(x, "[^A-Za-z]", ""))), "\n")
    found = fasta.from_text(docs.select("doc_id", text.alias("text")), "doc_id", "text", 300)
    return found.groupBy("doc_id", "record").agg(F.count("*").alias("n_blocks"), F.sum(F.length("seq")).alias("n_bases"))


@_r.query("""
WITH e AS (SELECT event_id, user_id, unnest(json_keys(props)) AS path, props FROM events)
SELECT event_id, path, json_extract_string(props, '$.' || path) AS value FROM e""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.drift import json_leaves as leaves

    return leaves(table(spark, sf_dir, "events"), "event_id", "props")


@_r.query("""
SELECT doc_id, regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9_-]+', '_', 'g') AS stem,
       CASE WHEN lang = 'en' THEN 'citizen_science' WHEN lang = 'de' THEN 'museum_specimen' ELSE 'unknown' END AS kind,
       CASE WHEN doc_id % 3 = 0 THEN 'CC BY-NC 4.0' WHEN doc_id % 3 = 1 THEN 'CC0 1.0' ELSE source END AS licence
FROM documents""")
def scalar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems, image types and licences."""
    docs = table(spark, sf_dir, "documents")
    label = F.when(F.col("lang") == "en", "Citizen Science").when(F.col("lang") == "de", "Museum Specimen (x)").otherwise(F.col("lang"))
    address = (
        F.when(F.col("doc_id") % 3 == 0, "https://creativecommons.org/licenses/by-nc/4.0/legalcode")
        .when(F.col("doc_id") % 3 == 1, "http://creativecommons.org/publicdomain/zero/1.0/")
        .otherwise(F.col("source"))
    )
    return docs.select(
        "doc_id",
        scalars.file_stem(F.concat_ws(" / ", "source", "lang")).alias("stem"),
        scalars.image_type(label).alias("kind"),
        scalars.licence(address)["name"].alias("licence"),
    )
