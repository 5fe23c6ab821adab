"""Text listings: assembly tables, alignments, checksums, reports and logs, parsed in column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators.selection import small

# ---------------------------------------------------------------- assembly summary


def listing_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the last comment line at the head of a file."""
    head = [r[0] for r in spark.read.text(path).limit(50).collect()]
    comments = [x for x in head if x.startswith("#")]
    if not comments:
        raise ValueError(f"{path} has no header line")
    return [c.strip() for c in comments[-1].lstrip("# ").split("\t")]


def parse_listing(lines: DataFrame, header: list[str], kinds: Mapping[str, str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows and bad lines of a tab-separated listing ``value``.

    Columns outside ``kinds`` are ignored, missing ones are null; empty and lower-case ``na`` are null; dates
    lose their slashes. A line is bad if a required value is null or a number is not one; it is returned
    whole with the columns at fault.
    """
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    out, faults = [], []
    for name, kind in kinds.items():
        text = scalars.na_to_null(F.get(cells, F.lit(header.index(name)))) if name in header else F.lit(None).cast("string")
        if kind == "date":
            value: Column = F.regexp_replace(text, "/", "-")
        elif kind == "list":
            value = F.split(text, ";")
        else:
            value = text if kind == "string" else text.try_cast(kind)
        out.append(value.alias(name))
        fault = (text.isNotNull() & value.isNull()) | (F.lit(name in required) & text.isNull())
        faults.append(F.when(fault, F.lit(name)))
    parsed = body.select(*[c for c in body.columns if c != "value"], "value", *out, F.array_compact(F.array(*faults)).alias("_faults"))
    known = [c for c in body.columns if c != "value"]
    bad = parsed.where(F.size("_faults") > 0).select(*known, "value", F.array_join("_faults", ", ").alias("columns"))
    return parsed.where(F.size("_faults") == 0).drop("value", "_faults"), bad


ASSEMBLY_KINDS = (
    dict.fromkeys(fixed.ASSEMBLY_TEXT.split(), "string") | dict.fromkeys(fixed.ASSEMBLY_NUMBERS.split(), "long")
    | dict.fromkeys(fixed.ASSEMBLY_DATES.split(), "date") | {"gc_percent": "double", "pubmed_id": "list"}
)
ASSEMBLY_REQUIRED = ["assembly_accession", "taxid", "species_taxid", "organism_name", "assembly_level"]


def read_assembly_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Assemblies of a summary, and its bad lines with their file and line number."""
    good, bad = parse_listing(numbered_lines(spark, path), listing_header(spark, path), ASSEMBLY_KINDS, ASSEMBLY_REQUIRED)
    return good.drop("file", "line"), bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line`` of text files, lines from 1.

    Each split of a file counts its own lines; the counts of the splits before it (one small row each) are added.
    """
    at = F.col("_metadata")
    lines = spark.read.text(path).select("value", at["file_path"].alias("file"), at["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    starts = blocks.select("file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(small(starts), ["file", "_block"]).select("value", "file", (F.col("_id") + F.col("_shift")).alias("line"))


def _last_values(pairs: Column) -> Column:
    """A map of pairs ``k, v``; of a key that repeats, the last value stands."""
    later = F.reverse(pairs)
    keys = F.transform(later, lambda p: p["k"])
    first = F.filter(later, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


# ---------------------------------------------------------------- alignments


def _attribute(attributes: Column, name: str) -> Column:
    """The value of ``name`` in ``name=value;...``; of a name that repeats, the last value stands.

    Cut out by its name: a map of all attributes costs many times the line.
    """
    listed, mark = F.concat(F.lit(";"), attributes), f";{name}="
    return F.when(F.contains(listed, F.lit(mark)), F.substring_index(F.substring_index(listed, mark, -1), ";", 1))


def parse_gff(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best hit of each protein (``Rank=1`` mRNA) with its sorted coding segments, from GFF lines ``value``.

    Fields are cut out of lines of nine; an array of all fields would be made again for each condition.
    """
    keys = keys or []
    line, tab = F.col("value"), "\t"
    c = lambda i: F.substring_index(F.substring_index(line, tab, i + 1), tab, -1)
    tabs = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(tab), F.lit("")))
    a = lambda name: _attribute(c(8), name)

    def of(kind: str) -> DataFrame:
        """Whole lines of one kind; others are passed over before they are cut."""
        return lines.where(F.contains(line, F.lit(f"\t{kind}\t")) & ~line.startswith("#") & (tabs == 8) & (c(2) == kind))

    start, end = c(3).try_cast("long").alias("start"), c(4).try_cast("long").alias("end")
    target = F.split(a("Target"), " ")
    hits = of("mRNA").where(a("Rank") == "1").select(
        *keys, a("ID").alias("id"), c(0).alias("contig"), c(6).alias("strand"), start, end, F.get(target, F.lit(0)).alias("protein"),
        F.get(target, F.lit(1)).try_cast("long").alias("q_start"), F.get(target, F.lit(2)).try_cast("long").alias("q_end"),
        a("Identity").try_cast("double").alias("identity"), a("Positive").try_cast("double").alias("positive"),
        F.coalesce(a("Frameshift").try_cast("int"), F.lit(0)).alias("frameshifts"), F.coalesce(a("StopCodon").try_cast("int"), F.lit(0)).alias("stop_codons"),
    )
    coding = of("CDS").select(*keys, a("Parent").alias("id"), start, end).groupBy(*keys, "id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("segments")
    )
    return hits.join(coding, [*keys, "id"])


# ---------------------------------------------------------------- checksums, reports, occurrences


def parse_checksums(lines: DataFrame) -> DataFrame:
    """``name, md5`` of checksum lines ``value``."""
    pattern = r"^(\S+)\s+(?:.*/)?([^/]+)$"
    out = lines.select(F.regexp_extract("value", pattern, 2).alias("name"), F.lower(F.regexp_extract("value", pattern, 1)).alias("md5"))
    return out.where("name <> ''")


_REPORT = """accession string, paired_accession string,
 organism struct<tax_id: bigint, organism_name: string, infraspecific_names: map<string, string>>,
 assembly_info struct<assembly_name: string, assembly_level: string, assembly_status: string, assembly_type: string,
   bioproject_accession: string, refseq_category: string, release_date: string, submitter: string,
   biosample: struct<accession: string>, paired_assembly: struct<refseq_genbank_are_different: boolean>>,
 assembly_stats struct<total_sequence_length: bigint, total_ungapped_length: bigint, gc_percent: double,
   number_of_scaffolds: bigint, number_of_contigs: bigint, contig_n50: bigint, scaffold_n50: bigint>,
 annotation_info struct<provider: string, name: string, release_date: string,
   stats: struct<gene_counts: struct<total: bigint, protein_coding: bigint, non_coding: bigint>>>"""


def parse_reports(documents: DataFrame, column: str, species_taxid: str, ftp_path: str | None = None) -> DataFrame:
    """Flat assembly rows of nested reports in a JSON column; the directory is built where none is given."""
    r = documents.select(F.from_json(column, _REPORT).alias("r"), F.col(species_taxid).alias("species_taxid"), (F.col(ftp_path) if ftp_path else F.lit(None).cast("string")).alias("_ftp"))
    infra = F.col("r.organism.infraspecific_names")
    value = lambda k: F.nullif(F.try_element_at(infra, F.lit(k)), F.lit(""))
    named = F.coalesce(*(F.concat(F.lit(f"{k}="), value(k)) for k in fixed.INFRASPECIFIC))
    status, different = F.col("r.assembly_info.assembly_status"), F.col("r.assembly_info.paired_assembly.refseq_genbank_are_different")
    name = F.coalesce("r.assembly_info.assembly_name", F.lit(""))
    plain = {
        "bioproject": "assembly_info.bioproject_accession", "biosample": "assembly_info.biosample.accession",
        "refseq_category": "assembly_info.refseq_category", "taxid": "organism.tax_id", "organism_name": "organism.organism_name",
        "assembly_level": "assembly_info.assembly_level", "seq_rel_date": "assembly_info.release_date",
        "asm_submitter": "assembly_info.submitter", "gbrs_paired_asm": "paired_accession", "assembly_type": "assembly_info.assembly_type",
        "genome_size": "assembly_stats.total_sequence_length", "genome_size_ungapped": "assembly_stats.total_ungapped_length",
        "gc_percent": "assembly_stats.gc_percent", "scaffold_count": "assembly_stats.number_of_scaffolds",
        "contig_count": "assembly_stats.number_of_contigs", "contig_n50": "assembly_stats.contig_n50",
        "scaffold_n50": "assembly_stats.scaffold_n50", "annotation_provider": "annotation_info.provider",
        "annotation_name": "annotation_info.name", "annotation_date": "annotation_info.release_date",
        "total_gene_count": "annotation_info.stats.gene_counts.total",
        "protein_coding_gene_count": "annotation_info.stats.gene_counts.protein_coding",
        "non_coding_gene_count": "annotation_info.stats.gene_counts.non_coding",
    }
    return r.select(
        F.col("r.accession").alias("assembly_accession"),
        "species_taxid",
        *(F.col(f"r.{path}").alias(k) for k, path in plain.items()),
        named.alias("infraspecific_name"),
        F.try_element_at(infra, F.lit("isolate")).alias("isolate"),
        F.when(status == "current", "latest").otherwise(status).alias("version_status"),
        F.when(different, "different").when(~different, "identical").alias("paired_asm_comp"),
        name.alias("asm_name"),
        F.coalesce("_ftp", scalars.ftp_directory(F.col("r.accession"), name)).alias("ftp_path"),
    )


_OCCURRENCE = """key bigint, scientificName string, species string, basisOfRecord string, publisher string, datasetName string,
 license string, rightsHolder string,
 media array<struct<type: string, identifier: string, license: string, publisher: string, rightsHolder: string>>"""


def parse_occurrences(documents: DataFrame, column: str) -> DataFrame:
    """One image candidate per occurrence: its first still image with an address."""
    o = documents.select(F.from_json(column, _OCCURRENCE).alias("o"))
    still = F.filter("o.media", lambda m: (m["type"] == "StillImage") & (m["identifier"] != ""))
    o = o.withColumn("m", F.get(still, F.lit(0))).where("m is not null")
    first = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c))
    licence = scalars.licence(first("m.license", "o.license"))
    key = F.col("o.key").cast("string")
    return o.select(
        F.concat(F.lit("gbif:"), key).alias("candidate_id"),
        key.alias("source_id"),
        F.col("m.identifier").alias("source_url"),
        first("o.scientificName", "o.species").alias("original_label"),
        scalars.basis_type(F.coalesce("o.basisOfRecord", F.lit(""))).alias("image_type"),
        F.col("o.basisOfRecord").alias("source_image_type"),
        first("m.publisher", "o.publisher", "o.datasetName").alias("publisher"),
        licence["name"].alias("license"),
        licence["url"].alias("license_url"),
        first("m.rightsHolder", "o.rightsHolder").alias("rights_holder"),
    )


# ---------------------------------------------------------------- logs

METRIC_LOG = """kind string, step long, epoch long, loss double, grad_norm double, lr_encoder double, seq_per_s double,
 tok_per_s double, elapsed_min double, peak_gb double, seconds double, pair_mse_z double, pair_mae_log10 double,
 species_mae_log10 double, baseline_species_mae_log10 double, n_species long, n_pairs long, species_spearman double,
 species_pearson double, eval_step long, train_minutes double,
 species array<struct<ncbi_taxid: bigint, scientific_name: string, observed_log10: double, predicted_log10: double>>"""


def read_metric_log(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    log = spark.read.schema(METRIC_LOG).json(path)
    return log.where(F.col("kind") == kind) if kind else log


def parse_log(lines: DataFrame) -> DataFrame:
    """``epoch, loss`` and a map of ``key=value`` numbers of training log lines ``value``; other lines are left out."""
    epoch = F.regexp_extract("value", r"epoch\s+([0-9]+)", 1)
    loss = F.regexp_extract("value", r"loss[\s=]+([0-9.]+)", 1)
    pairs = [F.regexp_extract_all("value", F.lit(r"([^\s=]+)=([0-9.]+)"), F.lit(k)) for k in (1, 2)]
    found = lines.where(epoch != "")
    return found.select(
        *[c for c in lines.columns if c != "value"],
        epoch.cast("int").alias("epoch"),
        loss.try_cast("double").alias("loss"),
        _last_values(F.arrays_zip(pairs[0].alias("k"), pairs[1].alias("v"))).alias("values"),
    )
