"""Explicit schemas of the dataset tables, with keys and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions import fixed


def _struct(text: str) -> T.StructType:
    """``name type`` items, comma-separated; a ``?`` after the type makes it nullable."""
    kinds = {
        "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
        "longs": T.ArrayType(T.LongType()), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()),
    }
    fields = []
    for item in text.replace("\n", " ").split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


SPECIES = _struct("""ncbi_taxid long, scientific_name string, common_name string?, kingdom string?, phylum string?,
 class string?, order string?, family string?, genus string?, lineage_taxids longs, source_names strings,
 n_images long, n_genomes long, split string?""")
GENOMES = _struct("""assembly_accession string, ncbi_taxid long, species_taxid long, organism_name string,
 assembly_name string, assembly_level string, refseq_category string?, source string, release_date string?,
 genome_size long?, genome_size_ungapped long?, gc_percent double?, scaffold_count long?, contig_count long?,
 scaffold_n50 long?, contig_n50 long?, ftp_path string, sequence_file string, sequence_md5 string,
 sequence_bytes long, n_sequences long?, extra_files strings, downloaded_at timestamp""")
IMAGES = _struct("""image_id string, ncbi_taxid long, source_dataset string, source_dataset_revision string?,
 source_provider string?, source_id string?, observation_id string?, source_url string, original_label string,
 image_type string, source_image_type string?, publisher string?, license string?, license_url string?,
 rights_holder string?, file string, sha256 string, bytes long, width long, height long, format string,
 downloaded_at timestamp""")
PAIRS = _struct("image_id string, assembly_accession string, ncbi_taxid long, pairing string")

TABLES = {"species": SPECIES, "genomes": GENOMES, "images": IMAGES, "pairs": PAIRS}
KEYS = {
    "species": [["ncbi_taxid"]],
    "genomes": [["assembly_accession"], ["sequence_file"]],
    "images": [["image_id"], ["file"]],
    "pairs": [["image_id", "assembly_accession"]],
}
ALLOWED = {
    "species": {"split": ["train", "val", "test"]},
    "genomes": {"assembly_level": fixed.LEVELS, "source": ["ncbi_refseq", "ncbi_genbank"]},
    "images": {
        "image_type": ["citizen_science", "camera_trap", "museum_specimen", "lab_specimen", "illustration", "unknown"]
    },
    "pairs": {"pairing": ["species_reference", "same_specimen"]},
}
#: child table and column, parent table and column
REFERENCES = [
    ("genomes", "species_taxid", "species", "ncbi_taxid"),
    ("images", "ncbi_taxid", "species", "ncbi_taxid"),
    ("pairs", "image_id", "images", "image_id"),
    ("pairs", "assembly_accession", "genomes", "assembly_accession"),
]
#: child table, join column, its value, parent table, the parent's value
AGREEMENTS = [
    ("pairs", "image_id", "ncbi_taxid", "images", "ncbi_taxid"),
    ("pairs", "assembly_accession", "ncbi_taxid", "genomes", "species_taxid"),
]
VERSION = "0.1.0"
