"""Names, URLs, licences, ranks, captions and labels, as Column -> Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _lookup(value: Column, names: dict[str, str], default: Column) -> Column:
    return reduce(lambda out, kv: out.when(value == kv[0], kv[1]), names.items(), F.when(F.lit(False), "")).otherwise(default)


def match_key(name: Column) -> Column:
    """Join key of a species name: the trimmed binomial without authorship, else the whole name; lower case."""
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    found = F.regexp_extract(name, fixed.BINOMIAL, 1)
    return F.lower(F.when(found != "", found).otherwise(name))


def species_level(name: Column) -> Column:
    """``genus epithet`` in lower case if the second word is a plain epithet, else null."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")), r"\s+")
    epithet = F.get(words, F.lit(1))
    return F.when(epithet.rlike("^[a-z]+$"), F.concat_ws(" ", F.get(words, F.lit(0)), epithet))


def normal_name(name: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(F.trim(name), r"\s+", " ")


def normal_rank(rank: Column) -> Column:
    """Lower case; ``no rank`` is null."""
    return F.nullif(F.lower(rank), F.lit("no rank"))


def file_stem(name: Column) -> Column:
    """Characters outside ``[A-Za-z0-9_-]`` become ``_`` (runs: one); nothing left: ``image``."""
    stem = F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_")
    return F.when(stem != "", stem).otherwise("image")


# ---------------------------------------------------------------- URLs and paths


def url_host(url: Column) -> Column:
    """Host in lower case without the port; null if there is no scheme."""
    return F.lower(F.nullif(F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))


def inat_variant(url: Column, variant: str) -> Column:
    """The same photo in another size, its suffix kept; null for any other URL."""
    host, sizes = fixed.INAT_HOST.replace(".", r"\."), "|".join(fixed.INAT_VARIANTS)
    pattern = fixed.INAT_PHOTO.format(host=host, sizes=sizes)
    return F.when(url.rlike(pattern), F.regexp_replace(url, pattern, f"$1/{variant}$3"))


def candidate_urls(url: Column, variant: str, used: Column | None = None) -> Column:
    """URLs to try in order: one used before (if listed), the rewritten one, the catalogued one."""
    urls = F.array_compact(F.array_distinct(F.array(inat_variant(url, variant), url)))
    if used is None:
        return urls
    listed = F.coalesce(F.array_contains(urls, used), F.lit(False))
    return F.when(listed, F.concat(F.array(used), F.array_remove(urls, used))).otherwise(urls)


def ftp_https(path: Column) -> Column:
    """An ftp or https address as https without trailing slashes; null for anything else."""
    url = F.regexp_replace(F.trim(path), "^ftp://", "https://")
    return F.when(url.startswith("https://"), F.regexp_replace(url, "/+$", ""))


def ftp_directory(accession: Column, assembly: Column) -> Column:
    """Where an assembly lies by its accession and name."""
    digits = F.regexp_extract(accession, r"^[^_]+_([^.]*)", 1)
    threes = [F.substring(digits, k, 3) for k in (1, 4, 7)]
    name = F.concat(accession, F.lit("_"), F.regexp_replace(assembly, "[^A-Za-z0-9._-]+", "_"))
    head = F.lit(f"https://{fixed.FTP_HOST}/genomes/all")
    return F.concat_ws("/", head, F.regexp_extract(accession, "^([^_]+)_", 1), *threes, name)


def genome_urls(path: Column) -> Column:
    """``sequence, assembly_report, md5checksums`` of an assembly directory."""
    base = ftp_https(path)
    name = F.regexp_extract(base, "([^/]+)$", 1)
    stem = F.concat(base, F.lit("/"), name)
    files = [F.concat(stem, F.lit(end)).alias(name) for name, end in fixed.GENOME_FILES.items()]
    return F.struct(*files, F.concat(base, F.lit(f"/{fixed.CHECKSUMS}")).alias("md5checksums"))


def safe_path(path: Column) -> Column:
    """Relative, without ``..`` parts."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


# ---------------------------------------------------------------- values


def present(value: Column) -> Column:
    """Neither null nor blank."""
    return value.isNotNull() & (F.trim(value) != "")


def missing_to_null(value: Column, marker: str = fixed.MISSING) -> Column:
    """Blanks and the marker (any case) become null."""
    return F.when(present(value) & (F.lower(F.trim(value)) != marker), value)


def na_to_null(value: Column) -> Column:
    """Empty and lower-case ``na`` become null; ``NA`` is a value."""
    return F.when((value != "") & (value != "na"), value)


def seeded_key(seed: int, key: Column) -> Column:
    """A pseudo-random order that depends on the seed and the key only, not on rows or partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def image_type(label: Column) -> Column:
    named = _lookup(label, fixed.IMAGE_TYPES, F.lit("unknown"))
    return F.when(label.startswith(fixed.MUSEUM_PREFIX), "museum_specimen").otherwise(named)


def basis_type(basis: Column) -> Column:
    return _lookup(basis, fixed.BASIS_TYPES, F.lit("unknown"))


def provider(publisher: Column, data_source: Column) -> Column:
    return F.when(publisher == fixed.INAT_PUBLISHER, "inaturalist").otherwise(
        F.when(data_source != "", F.lower(data_source))
    )


def licence(value: Column) -> Column:
    """``name, url``: Creative Commons addresses by their short names, anything else verbatim."""
    kind, public, version = (F.regexp_extract(value, fixed.CC_URL, k) for k in (1, 2, 3))
    name = (
        F.when(public == "zero", F.concat(F.lit("CC0 "), version))
        .when(public == "mark", F.concat(F.lit("Public Domain Mark "), version))
        .when(kind != "", F.concat_ws(" ", F.lit("CC"), F.upper(kind), version))
        .otherwise(value)
    )
    return F.struct(
        F.when(value != "", name).alias("name"), F.when(value.startswith("http"), value).alias("url")
    )


def licence_allowed(slug: Column, policy: str) -> Column:
    """Null licences pass only under ``any``."""
    if policy == "any":
        return F.lit(True)
    if policy not in ("cc_only", "permissive"):
        raise ValueError(f"unknown licence policy {policy!r}")
    low = F.lower(F.coalesce(slug, F.lit("")))
    return low.startswith("cc-") if policy == "cc_only" else low.rlike(fixed.PERMISSIVE)


# ---------------------------------------------------------------- ranks and captions


def ancestor(lineage: Column, rank: str) -> Column:
    """The first entry of that rank in a lineage of ``taxid, name, rank``."""
    return F.get(F.filter(lineage, lambda t: t["rank"] == rank), F.lit(0))


def lineage_taxids(lineage: Column) -> Column:
    """The taxids of a lineage of ``taxid, name, rank``, in its order."""
    return F.transform(lineage, lambda t: t["taxid"])


def caption_ranks(kingdom: Column, phylum: Column, class_: Column, lineage: Column) -> Column:
    """``kingdom, phylum, class`` in the vocabulary of captions; nulls become empty."""
    kingdom, phylum, class_ = (F.coalesce(c, F.lit("")) for c in (kingdom, phylum, class_))

    def first_in(names: dict[int, str], default: Column) -> Column:
        listed = [F.when(F.array_contains(lineage, F.lit(t).cast("long")), name) for t, name in names.items()]
        return F.coalesce(*listed, default)

    return F.struct(
        _lookup(kingdom, fixed.KINGDOM_NAMES, kingdom).alias("kingdom"),
        F.when(phylum == "Streptophyta", first_in(fixed.PLANT_PHYLA, F.lit(""))).otherwise(phylum).alias("phylum"),
        first_in(fixed.CLASS_BY_LINEAGE, _lookup(class_, fixed.CLASS_NAMES, class_)).alias("class"),
    )


def caption(order: Column, family: Column, genus: Column, species: Column, higher: list[Column] | None = None) -> Column:
    """``a photo of`` the ranks that are known; the genus is not repeated before the epithet."""
    if higher is None:
        higher = [F.lit(x) for x in fixed.DEFAULT_HIGHER_RANKS]
    genus_name, species_name = (F.trim(F.coalesce(c, F.lit(""))) for c in (genus, species))
    repeated = (genus_name != "") & species_name.startswith(F.concat(genus_name, F.lit(" ")))
    epithet = F.when(repeated, F.substr(species_name, F.length(genus_name) + 2)).otherwise(species_name)

    def known(c: Column) -> Column:
        c = F.trim(c)
        return F.when((c != "") & (F.lower(c) != "not_classified"), c)

    names = [known(c) for c in (order, family, genus)] + [known(epithet)]
    return F.concat_ws(" ", F.lit("a photo of"), *(F.when(F.trim(h) != "", F.trim(h)) for h in higher), *names)


def caption_at(rank: str, order: Column, family: Column, genus: Column, species: Column, higher: list[Column] | None = None) -> Column:
    """The caption down to ``rank``: the names below it are left out (``class``: only the higher ranks)."""
    kept = ["class", *fixed.CAPTION_RANKS].index(rank)
    names = [c if k < kept else F.lit("") for k, c in enumerate((order, family, genus, species))]
    return caption(*names, higher)


def rank_columns(class_: Column, order: Column, family: Column, genus: Column, species: Column) -> Column:
    """``species, genus, family, order, class`` of a record: the finest label, and a blank class where none is known."""
    named = {"species": finest_label(genus, species), "genus": genus, "family": family, "order": order, "class": F.coalesce(class_, F.lit(""))}
    return F.struct(*(c.alias(k) for k, c in named.items()))


def finest_label(genus: Column, species: Column) -> Column:
    return F.coalesce(F.when(species != "", species), F.concat(genus, F.lit(" sp.")))


def log_years(years: Column) -> Column:
    """log10, null for values that are not positive."""
    return F.when(years > 0, F.log10(years))


def coverage(start: Column, end: Column, length: Column) -> Column:
    """Aligned share of a protein."""
    return F.try_divide((end - start + 1).cast("double"), length.cast("double"))


def scaled(value: Column, mean: Column, sd: Column) -> Column:
    """z-score; null where sd is zero."""
    return F.try_divide(value - mean, sd)


def unscaled(z: Column, mean: Column, sd: Column) -> Column:
    return z * sd + mean


def protein_query(query: Column) -> Column:
    """``id, symbol`` of a query ``id|symbol``; no symbol: null."""
    parts = F.split(query, r"\|")
    return F.struct(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("symbol"))
