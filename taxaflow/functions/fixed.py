"""Fixed values that results depend on."""

# Names and hosts.
BINOMIAL = r"^([A-Za-z]+ [a-z][a-z-]*)(?: \(?[A-Z].*)?$"
INAT_HOST = "inaturalist-open-data.s3.amazonaws.com"
INAT_PHOTO = r"^(https?://{host}/photos/[0-9]+)/({sizes})(\.[^/]*)$"
INAT_VARIANTS = ["original", "large", "medium", "small", "thumb", "square"]
EXCLUDED_HOSTS = ["content.eol.org"]
MISSING = "not provided"
INAT_PUBLISHER = "iNaturalist.org"

# Licences.
PERMISSIVE = "^cc-(0|publicdomain|by|by-sa)(-[0-9.]+)?$"
CC_URL = r"creativecommons\.org/(?:licenses/([a-z-]+)|publicdomain/(zero|mark))/([0-9]\.[0-9])"

# Image types by source label and by basis of record.
IMAGE_TYPES = {"Citizen Science": "citizen_science", "Camera-trap": "camera_trap"}
MUSEUM_PREFIX = "Museum Specimen"
BASIS_TYPES = {
    "HUMAN_OBSERVATION": "citizen_science",
    "MACHINE_OBSERVATION": "camera_trap",
    "PRESERVED_SPECIMEN": "museum_specimen",
    "MATERIAL_SAMPLE": "lab_specimen",
}

# Assemblies.
CATEGORIES = ["reference genome", "representative genome"]
LEVELS = ["Complete Genome", "Chromosome", "Scaffold", "Contig"]
FTP_HOST = "ftp.ncbi.nlm.nih.gov"
GENOME_FILES = {"sequence": "_genomic.fna.gz", "assembly_report": "_assembly_report.txt"}
CHECKSUMS = "md5checksums.txt"
ASSEMBLY_TEXT = (
    "assembly_accession bioproject biosample wgs_master refseq_category organism_name infraspecific_name isolate"
    " version_status assembly_level release_type genome_rep asm_name asm_submitter gbrs_paired_asm paired_asm_comp"
    " ftp_path excluded_from_refseq relation_to_type_material assembly_type group annotation_provider annotation_name"
)
ASSEMBLY_NUMBERS = (
    "taxid species_taxid genome_size genome_size_ungapped replicon_count scaffold_count contig_count total_gene_count"
    " protein_coding_gene_count non_coding_gene_count"
)
ASSEMBLY_DATES = "seq_rel_date asm_not_live_date annotation_date"
INFRASPECIFIC = ["strain", "breed", "cultivar", "ecotype"]
ORGANELLES = ["Mitochondrion", "Chloroplast", "Plastid", "Apicoplast"]
NON_PRIMARY_ROLES = ["alt-scaffold", "fix-patch", "novel-patch"]

# Caption vocabulary; lineage taxids in order of priority.
KINGDOM_NAMES = {"Metazoa": "Animalia", "Viridiplantae": "Plantae"}
CLASS_NAMES = {"Actinopteri": "Actinopterygii", "Hyperoartia": "Petromyzonti"}
PLANT_PHYLA = {58023: "Tracheophyta", 3208: "Bryophyta", 3195: "Marchantiophyta", 13809: "Anthocerotophyta"}
CLASS_BY_LINEAGE = {
    4447: "Liliopsida",
    7778: "Elasmobranchii",
    7863: "Holocephali",
    8504: "Reptilia",
    8459: "Reptilia",
    1294634: "Reptilia",
}
DEFAULT_HIGHER_RANKS = ["Animalia", "Arthropoda", "Insecta"]
CAPTION_RANKS = ["order", "family", "genus", "species"]

# Tokens and windows.
FIRST_TOKEN, LAST_TOKEN, PAD_TOKEN, VOCABULARY = 1, 2, 3, 32768
CHUNK_TOKENS = 1024
BODY_TOKENS = 1022
WINDOW_BP = 10_000
MAX_N_SHARE = 0.01
MAX_DRAWS = 1000
MESSAGES = 50
