"""Operators on small fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import scalars as C
from taxaflow.operators import drift, embeddings, kmers, metrics, selection, sequences, splits, tables, taxonomy, validation
from taxaflow.schemas import TABLES
from taxaflow.sources import fasta, inventory, listings, registry


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def column(spark, items, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], schema).select(f(F.col("x"))).collect()]


# ---------------------------------------------------------------- scalars


def test_match_key(spark):
    names = ["Vulpes vulpes", " Vulpes vulpes (Linnaeus, 1758) ", "Lutra lutra Pocock, 1913", "Canis lupus familiaris", "Vulpes", None]
    assert column(spark, names, C.match_key) == ["vulpes vulpes", "vulpes vulpes", "lutra lutra", "canis lupus familiaris", "vulpes", None]


def test_species_level(spark):
    assert column(spark, ["Vulpes (Fox) vulpes L.", "Vulpes sp.", "Vulpes", None], C.species_level) == ["vulpes vulpes", None, None, None]


def test_inat_variant_and_candidate_urls(spark):
    host = "https://inaturalist-open-data.s3.amazonaws.com/photos/12"
    urls = [f"{host}/original.jpg", f"{host}/medium.", "https://x.org/a.jpg", None]
    assert column(spark, urls, lambda c: C.inat_variant(c, "medium")) == [f"{host}/medium.jpg", f"{host}/medium.", None, None]
    assert column(spark, urls[:3], lambda c: C.candidate_urls(c, "medium")) == [[f"{host}/medium.jpg", urls[0]], [urls[1]], [urls[2]]]
    assert column(spark, urls[:1], lambda c: C.candidate_urls(c, "medium", c)) == [[urls[0], f"{host}/medium.jpg"]]


def test_hosts_and_paths(spark):
    assert column(spark, ["HTTP://A.org:80/x", "a.org", None], C.url_host) == ["a.org", None, None]
    assert column(spark, ["ftp://ftp.x/a/ ", "https://x/b", "file:/c"], C.ftp_https) == ["https://ftp.x/a", "https://x/b", None]
    assert column(spark, ["a/b", "/a", "a/../b"], C.safe_path) == [True, False, False]
    assert values(spark, [("GCF_018350215.1", "P.leo Ple1 pat")], "a string, n string", C.ftp_directory(F.col("a"), F.col("n"))) == [
        ("https://ftp.ncbi.nlm.nih.gov/genomes/all/GCF/018/350/215/GCF_018350215.1_P.leo_Ple1_pat",)
    ]


def test_missing_values_and_licences(spark):
    assert column(spark, ["Not Provided", " ", "x", None], C.missing_to_null) == [None, None, "x", None]
    assert column(spark, ["na", "", "NA", None], C.na_to_null) == [None, None, "NA", None]
    slugs = ["cc-by", "CC-BY-SA-4.0", "cc-by-nc", "other", None]
    assert column(spark, slugs, lambda c: C.licence_allowed(c, "permissive")) == [True, True, False, False, False]
    assert column(spark, slugs, lambda c: C.licence_allowed(c, "cc_only")) == [True, True, True, False, False]
    assert column(spark, slugs, lambda c: C.licence_allowed(c, "any")) == [True] * 5
    with pytest.raises(ValueError):
        C.licence_allowed(F.lit("x"), "none")
    named = column(spark, ["http://creativecommons.org/licenses/by-nc/4.0/", "own words", "", None], lambda c: C.licence(c)["name"])
    assert named == ["CC BY-NC 4.0", "own words", None, None]


def test_captions(spark):
    schema = "o string, f string, g string, s string"
    rows = [("Carnivora", "Canidae", "Vulpes", "Vulpes vulpes"), (None, " ", "not_classified", "Vulpes"), ("Diptera", None, "Musca", "")]
    got = values(spark, rows, schema, C.caption(F.col("o"), F.col("f"), F.col("g"), F.col("s"), [F.lit("Animalia"), F.lit("")]))
    assert got == [("a photo of Animalia Carnivora Canidae Vulpes vulpes",), ("a photo of Animalia Vulpes",), ("a photo of Animalia Diptera Musca",)]
    ranks = values(
        spark, [("Viridiplantae", "Streptophyta", "Magnoliopsida", [1, 58023, 4447]), ("Metazoa", "Chordata", None, [8459])],
        "k string, p string, c string, l array<bigint>", C.caption_ranks(*(F.col(x) for x in "kpcl")),
    )
    assert [tuple(r[0]) for r in ranks] == [("Plantae", "Tracheophyta", "Liliopsida"), ("Animalia", "Chordata", "Reptilia")]


# ---------------------------------------------------------------- selection


def test_selection_caps_and_does_not_depend_on_other_groups(spark):
    rows = [(f"a{i}", "fox", "obs-A") for i in range(3)] + [("b0", "fox", "obs-B"), ("z0", "owl", "obs-A")]
    rows += [(f"m{i}", "fox", f"solo{i}") for i in range(6)]
    catalog = spark.createDataFrame(rows, "uuid string, species_query string, obs string")
    licences = spark.createDataFrame([(r[0], "cc-by") for r in rows] + [("a0", None)], "uuid string, license string")

    def pick(df, **caps):
        out = selection.select_candidates(
            df, licences, group="species_query", observation="obs", uuid="uuid", provenance_order=["license"],
            eligible=F.col("license").isNotNull(), **caps,
        )
        return [(r["species_query"], r["uuid"], r["rank"]) for r in out.orderBy("species_query", "rank").collect()]

    one = pick(catalog, per_observation=1, per_group=5)
    assert len([r for r in one if r[0] == "fox"]) == 5
    assert pick(catalog.where("species_query = 'fox'"), per_observation=1, per_group=5) == [r for r in one if r[0] == "fox"]
    assert pick(catalog.repartition(7).orderBy("obs"), per_observation=1, per_group=5) == one
    every = pick(catalog, per_observation=None, per_group=None)
    assert len(every) == len(rows) and [r for r in pick(catalog, per_observation=None, per_group=4)] == [r for r in every if r[2] <= 4]


def test_membership_predicates(spark):
    assert column(spark, ["a", "b", None], lambda c: selection.one_of(c, ["a", None])) == [True, False, True]
    assert column(spark, ["a", None], lambda c: selection.one_of(c, [])) == [False, False]
    assert column(spark, ["a", "b", None], lambda c: selection.none_of(c, ["a"])) == [False, True, True]


def test_top_up_and_reuse(spark):
    cands = spark.createDataFrame([("fox", f"c{i}", i, i == 3) for i in range(1, 6)], "species_query string, candidate_id string, rank int, present boolean")
    seen = spark.createDataFrame([("c1", "u", 1, False), ("c2", "u", 1, False), ("c2", "v", 2, True), ("c3", "u", 1, True), ("c4", "u", 1, True)], "candidate_id string, url string, url_pos int, ok boolean")
    got = selection.top_up(cands, seen, 3).orderBy("taken")
    assert [(r["candidate_id"], r["used_url"]) for r in got.collect()] == [("c3", "u"), ("c2", "v"), ("c4", "u")]
    assert [tuple(r) for r in selection.shortfall(cands, got, 4).collect()] == [("fox", 3, 1)]
    held = spark.createDataFrame([("a", ["u"]), ("b", ["u"]), ("c", ["u"]), ("d", ["u"]), ("e", ["u"])], "candidate_id string, urls array<string>")
    before = spark.createDataFrame([("a", "u", "fa"), ("b", None, "fb"), ("c", "w", "fc"), ("d", "u", "fd")], "candidate_id string, used_url string, file string")
    files = spark.createDataFrame([("fa", 300, 300), ("fb", 300, 300), ("fc", 300, 300), ("fd", 10, 300), ("fx", 1, 1)], "file string, width int, height int")
    status = selection.reuse_status(held, before, files, 100).orderBy("candidate_id")
    assert [r["status"] for r in status.collect()] == ["reused", "unverified", "stale", "rejected", "absent"]
    assert [r["file"] for r in selection.unreferenced(files, before).collect()] == ["fx"]


# ---------------------------------------------------------------- taxonomy and tables


def test_best_assembly(spark):
    rows = [
        (1, "A3", None, "Contig", "2024-01-01"), (1, "A2", "representative genome", "Scaffold", None), (1, "A1", "reference genome", "Contig", "2001-01-01"),
        (2, "B1", None, "Scaffold", None), (2, "B2", None, "Scaffold", "2000-01-01"), (2, "B0", None, "Scaffold", "2000-01-01"),
    ]
    df = spark.createDataFrame(rows, "species_taxid int, assembly_accession string, refseq_category string, assembly_level string, seq_rel_date string")
    assert sorted(r["assembly_accession"] for r in taxonomy.best_assembly(df).collect()) == ["A1", "B0"]


def test_many_to_one_contract(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="more than once"):
        tables.join_many_to_one(left, right, "k")
    with pytest.raises(ValueError, match="no match"):
        tables.join_many_to_one(left, right.limit(1), "k", complete=True)


def test_write_table_keeps_an_empty_schema(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b array<string>")
    tables.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).dtypes == df.dtypes
    cells = tables.csv_cells(spark.createDataFrame([(None, ["x", "y"])], "a int, b array<string>")).first()
    assert tuple(cells) == ("", "x|y")
    more = spark.createDataFrame([(1, ["x"])], df.schema)
    tables.write_table(more, str(tmp_path / "t"))
    bad = more.withColumn("a", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        tables.write_table(bad, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t.parquet")).collect()] == [(1, ["x"])]
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "t.csv")).collect()] == [("1", "x")]


def test_a_written_dataset_reads_back_and_its_manifest_agrees(spark, tmp_path):
    tables_ = dataset(spark)
    for name, df in tables_.items():
        tables.write_table(df, str(tmp_path / name), csv=False)
    read = {name: tables.read_table(spark, str(tmp_path), name) for name in tables_}
    assert all(read[n].exceptAll(df).count() == 0 for n, df in tables_.items())
    counts = tables.dataset_counts(read)
    tables.write_manifest(spark, str(tmp_path), counts, name="d", version="1")
    document = tables.read_manifest(spark, str(tmp_path))
    assert document["counts"] == {"n_species": 1, "n_genomes": 1, "genome_bytes": 10, "n_images": 2, "image_bytes": 10, "n_pairs": 2}
    assert validation.manifest(document, counts).count() == 0
    wrong = document | {"schema_version": "9", "counts": document["counts"] | {"n_pairs": 3}}
    assert sorted(r["check"] for r in validation.manifest(wrong, counts).collect()) == ["counts", "version"]


# ---------------------------------------------------------------- validation


def dataset(spark):
    stamp = __import__("datetime").datetime(2024, 1, 1)
    one = {
        "species": [(9606, "Homo sapiens", None, None, None, None, None, None, None, [1], ["Homo"], 2, 1, "train")],
        "genomes": [("GCF_1.1", 9606, 9606, "Homo", "h1", "Contig", None, "ncbi_refseq", None, 1, None, None, None, None, None, None, "https://x", "g/1.fna.gz", "m", 10, None, [], stamp)],
        "images": [(f"i{k}", 9606, "d", None, None, None, None, "u", "Homo", "unknown", None, None, None, None, None, f"f{k}.jpg", "s", 5, 1, 1, "JPEG", stamp) for k in (1, 2)],
        "pairs": [(f"i{k}", "GCF_1.1", 9606, "species_reference") for k in (1, 2)],
    }
    return {k: spark.createDataFrame(v, TABLES[k]) for k, v in one.items()}


def found(tables_):
    return sorted((r["table"], r["check"]) for r in validation.dataset(tables_).collect())


def test_a_valid_dataset_has_no_problems(spark):
    assert found(dataset(spark)) == []


@pytest.mark.parametrize(
    ("table", "change", "expected"),
    [
        ("species", lambda d: d.withColumn("n_images", F.lit(7).cast("long")), [("species", "count")]),
        ("species", lambda d: d.withColumn("split", F.lit("dev")), [("species", "row")]),
        ("genomes", lambda d: d.union(d), [("genomes", "unique"), ("genomes", "unique"), ("species", "count")]),
        ("images", lambda d: d.where("image_id = 'i1'"), [("pairs", "reference"), ("species", "count")]),
        ("pairs", lambda d: d.withColumn("ncbi_taxid", F.lit(1).cast("long")), [("pairs", "agreement")] * 4),
        ("pairs", lambda d: d.withColumn("more", F.lit(1)), [("pairs", "schema")]),
        ("images", lambda d: None, [("images", "table")]),
    ],
)
def test_one_broken_thing_gives_its_problems(spark, table, change, expected):
    tables_ = dataset(spark)
    tables_[table] = change(tables_[table])
    assert found(tables_) == expected


def test_files_are_checked(spark, tmp_path):
    (tmp_path / "f1.jpg").write_bytes(b"12345")
    (tmp_path / "x.part").write_bytes(b"1")
    seen = inventory.inventory(spark, str(tmp_path))
    images = spark.createDataFrame([("i1", "f1.jpg", 5), ("i2", "f1.jpg", 6), ("i3", "../f", 1), ("i4", "g", 1)], "image_id string, file string, bytes long")
    got = {r["key"]: r["message"] for r in validation.files(images, "images", "image_id", "file", "bytes", seen).collect()}
    assert got == {"i2": "file has 5 bytes", "i3": "path is not relative to the dataset", "i4": "file is missing"}
    assert validation.leftovers(seen).count() == 1


# ---------------------------------------------------------------- splits and drift


def test_family_split_is_the_greedy_rule_and_never_straddles(spark):
    rows = [(i, None if i % 9 == 0 else f"f{i % 13}", "c" if i < 60 else "d") for i in range(66)]
    df = spark.createDataFrame(rows, "id int, family string, class string")
    got = splits.family_split(df, family="family", strata=["class"], test=0.2, val=0.2, min_species=10).toPandas()
    assert set(got[got["class"] == "d"].split) == {"train"} and set(got[got.family.isna()].split) == {"train"}
    big = got[(got["class"] == "c") & got.family.notna()]
    assert (big.groupby("family").split.nunique() == 1).all() and set(big.split) == {"train", "val", "test"}


def test_permutation_is_one_cycle(spark):
    df = spark.createDataFrame([(i, f"g{i}") for i in range(9)], "k int, g string")
    nxt = {f"g{r['k']}": r["permuted"] for r in splits.permuted_genomes(df, "k", "g").collect()}
    at, seen = "g0", []
    while at not in seen:
        seen.append(at)
        at = nxt[at]
    assert len(seen) == 9


def test_frozen_documents(spark):
    doc = drift.freeze({"a": [1, 2], "b": {"c": None}}, "parent")
    assert drift.verified(doc)["parent"] == "parent"
    with pytest.raises(ValueError):
        drift.verified(doc | {"a": [1]})
    assert drift.leaves({"a": {"b": 1, "c": {}}, "d": [1]}) == [("a.b", "1"), ("a.c", "{}"), ("d", "[1]")]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert drift.table_fingerprint(df).first() == drift.table_fingerprint(df.orderBy(F.desc("a"))).first()


# ---------------------------------------------------------------- metrics


def test_species_metrics_golden(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0), (1, 1.0, 2.0), (2, 2.0, 1.0)], "s int, y double, p double")
    m = metrics.species_metrics(metrics.species_predictions(rows, "s", "y", "p"), "y").first()
    assert (m["mae_log10"], m["mae_years"], m["pearson_years"], m["spearman"]) == (0.5, 45.0, None, None)
    with pytest.raises(ValueError):
        metrics.finite(rows.withColumn("p", F.lit(float("nan"))), "p")


def test_target_normalisation_of_a_single_species(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0)], "s int, y double")
    assert tuple(metrics.target_normalisation(rows, "s", "y").first()) == (2.0, 1.0, 1)


def test_scores_and_chance_golden(spark):
    ranks = spark.createDataFrame([(1, "a", "f"), (2, "a", "f"), (3, "b", "f"), (4, "b", "f")], "k int, genus string, family string").withColumn("species", F.col("k"))
    hits = spark.createDataFrame([(q, q, {1: 1, 2: 2, 3: 4, 4: 4}[q], 1) for q in (1, 2, 3, 4)], "q int, target int, k int, rank int")
    got = {r["level"]: r["top1"] for r in embeddings.rank_scores(hits, ranks, query="q", key="k", levels=["species", "genus", "family"]).collect()}
    assert got == {"species": 0.75, "genus": 1.0, "family": 1.0}
    chance = {r["level"]: (r["top1"], r["topk"]) for r in embeddings.chance(ranks, ranks, key="k", levels=["species", "genus"], k=2).collect()}
    assert chance["species"] == (0.25, 0.5) and chance["genus"][0] == 0.5 and math.isclose(chance["genus"][1], 1 - 2 / 12)


def test_ridge_recovers_a_linear_map(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = x @ np.array([[1.0, 2.0], [0.0, -1.0], [3.0, 0.5]])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y - y.mean(0))], "x array<double>, y array<double>")
    fitted = embeddings.ridge(df, "x", "y", 1e-9)
    pred = np.array([r[0] for r in embeddings.predict_ridge(df, "x", fitted).select("pred").collect()])
    assert np.allclose(pred, y - y.mean(0), atol=1e-6)


def test_top_k_in_blocks_is_the_same(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.standard_normal(4).round(1).tolist()) for i in range(60)], "k int, v array<double>")
    asked = rows.select(F.col("k").alias("q"), "v")
    take = lambda: sorted(map(tuple, embeddings.top_k(asked, rows, query="q", key="k", vector="v", k=3, exclude_self=True).select("q", "k", "rank").collect()))
    whole = take()
    monkeypatch.setattr(embeddings, "GALLERY_ROWS", 17)
    assert take() == whole and all(q != k for q, k, _ in whole)


def test_encode_distinct(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    got = embeddings.encode_distinct(df, "t", lambda keys: [[float(ord(k))] for k in keys])
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted([("a", [97.0]), ("a", [97.0]), ("b", [98.0]), (None, None)], key=repr)


# ---------------------------------------------------------------- sequences


def test_kmers_are_strand_symmetric(spark):
    rows = spark.createDataFrame([(1, "ACGTTTGCANACC"), (2, "GGTNTGCAAACGT")], "k int, s string")
    by = {k: sorted((r["kmer"], r["n"]) for r in kmers.kmer_counts(rows.where(F.col("k") == k), ["k"], "s", 3).collect()) for k in (1, 2)}
    assert by[1] == by[2] and sum(n for _, n in by[1]) == 8


def test_token_windows(spark):
    ids = list(range(10, 35))
    got = column(spark, [ids, []], lambda c: sequences.equal_windows(c, 10), "x array<int>")
    assert [x for w in got[0] for x in w] == ids and max(map(len, got[0])) == 9
    mixed = column(spark, [[1, *ids, 2]], lambda c: sequences.shuffled(c, 3, F.lit("k")), "x array<int>")[0]
    assert mixed[0] == 1 and mixed[-1] == 2 and sorted(mixed[1:-1]) == ids and mixed[1:-1] != ids


def test_chunk_budget_golden(spark):
    rows = [("G1", 100), ("G1", 400), ("G2", 10000), ("G2", 1022), ("G3", 700), ("G3", 900), ("G3", 500), ("G4", 700), ("G4", 100)]
    got = {r[0]: r["chunks"] for r in sequences.chunk_budget(spark.createDataFrame(rows, "u string, t int"), "u", "t").collect()}
    assert got == {"G1": 1, "G2": 2, "G3": 2, "G4": 1}


def test_budget_batches(spark):
    df = spark.createDataFrame([(i, 1 + i * 7 % 50) for i in range(300)], "k int, n int")
    got = sequences.budget_batches(df, "k", "n", 200, bucket=64).join(df, "k").groupBy("bucket", "batch").agg((F.max("n") * F.count("*")).alias("t"), F.count("*").alias("c")).collect()
    assert sum(r["c"] for r in got) == 300 and all(r["t"] <= 200 for r in got)


def test_fasta_blocks_and_packing(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">first x\n" + "a" * 2100 + "\n>second mitochondrion\n" + "C" * 1500 + "\n" + "C" * 1600 + "\n")
    got = fasta.read_fasta(spark, str(tmp_path), 2048)
    assert [(r["contig"], r["block_start"], len(r["seq"])) for r in got.orderBy("record", "block_start").collect()] == [
        ("first", 0, 2048), ("first", 2048, 52), ("second", 0, 2048), ("second", 2048, 1052),
    ]
    none = spark.createDataFrame([], "accession string")
    assert [(r["contig"], r["length"], r["offset"]) for r in fasta.packed_index(got, none).collect()] == [("first", 2100, 0)]
    with pytest.raises(ValueError):
        list(fasta.fasta_blocks(iter(["ACGT"]), 10))
    assert fasta.record_counts(spark, str(tmp_path)).first()["n_sequences"] == 2


def test_excluded_accessions(spark):
    lines = ["# c", "chr1\tassembled-molecule\t1\tChromosome\tCM1\t=\tNC_1.1\tPrimary", "alt\talt-scaffold\t1\tChromosome\tGL1\t=\tNT_1.1\tALT", "MT\tassembled-molecule\tMT\tMitochondrion\tna\t=\tNC_MT.1\tnon-nuclear"]
    got = fasta.excluded_accessions(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r[0] for r in got.collect()) == ["GL1", "NC_MT.1", "NT_1.1"]


def test_listing_nulls_dates_and_bad_lines(spark, tmp_path):
    text = "##  See\n#assembly_accession\ttaxid\tspecies_taxid\torganism_name\tassembly_level\tseq_rel_date\tasm_name\tunknown\n"
    text += "A\t1\t1\tNA\tContig\t2020/11/06\tna\tx\nB\tnot-a-taxid\t1\tb\tContig\t\t\t\n"
    (tmp_path / "s.txt").write_text(text)
    good, bad = listings.read_assembly_summary(spark, str(tmp_path / "s.txt"))
    row = good.first()
    assert (row["organism_name"], row["seq_rel_date"], row["asm_name"], row["genome_size"]) == ("NA", "2020-11-06", None, None)
    assert [r["columns"] for r in bad.collect()] == ["taxid"]


def test_json_sources(spark):
    doc = '{"accession": "GCF_000001405.40", "organism": {"tax_id": 9606, "organism_name": "Homo sapiens", "infraspecific_names": {"breed": "b"}}, "assembly_info": {"assembly_name": "GRCh38.p14", "assembly_level": "Chromosome", "assembly_status": "current", "paired_assembly": {"refseq_genbank_are_different": true}}}'
    r = listings.parse_reports(spark.createDataFrame([(doc, 9606)], "j string, t long"), "j", "t").first()
    assert (r["infraspecific_name"], r["version_status"], r["paired_asm_comp"]) == ("breed=b", "latest", "different")
    occ = '{"key": 5, "basisOfRecord": "HUMAN_OBSERVATION", "species": "Vulpes vulpes", "license": "x", "media": [{"type": "Sound", "identifier": "s"}, {"type": "StillImage", "identifier": "u1"}]}'
    o = listings.parse_occurrences(spark.createDataFrame([(occ,), ('{"key": 6}',)], "j string"), "j").collect()
    assert [(x["candidate_id"], x["source_url"], x["image_type"], x["license"]) for x in o] == [("gbif:5", "u1", "citizen_science", "x")]


def test_checksums_and_registry(spark):
    got = listings.parse_checksums(spark.createDataFrame([("ABC  ./a/b.gz",), ("",)], "value string")).collect()
    assert [tuple(r) for r in got] == [("b.gz", "abc")]

    @registry.register("toy")
    def toy(spark, n=2):
        return spark.range(n)

    assert registry.candidates(spark, "toy").count() == 2
    with pytest.raises(ValueError, match="unknown source"):
        registry.candidates(spark, "no")
    with pytest.raises(ValueError, match="no option"):
        registry.candidates(spark, "toy", m=1)


# ---------------------------------------------------------------- broken input, files and reports


def test_a_dataset_with_broken_columns_is_reported_and_never_raises(spark):
    good = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    images = good["images"].drop("ncbi_taxid").withColumn("bytes", F.col("bytes").cast("string"))
    found = {(r["table"], r["message"]) for r in validation.dataset(good | {"images": images}, None, {}).collect()}
    assert ("images", "no column ncbi_taxid") in found and ("images", "bytes is string, not bigint") in found
    manifest = {(r["check"], r["key"]) for r in validation.dataset(good, None, {"schema_version": "0"}).collect() if r["table"] == "manifest"}
    assert ("version", "0") in manifest and ("tables", "pairs") in manifest and ("counts", "n_images") in manifest


def test_manifest_tables_and_rows(spark):
    counts = tables.dataset_counts({name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
    listed = {name: {"path": f"{name}.parquet", "n_rows": 0} for name in TABLES}
    whole = {"schema_version": __import__("taxaflow.schemas").schemas.VERSION, "counts": counts.first().asDict(), "tables": listed}
    assert validation.manifest(whole, counts).count() == 0
    broken = whole | {"tables": {**listed, "pairs": {"path": "x.parquet", "n_rows": 3}}}
    assert {(r["check"], r["key"]) for r in validation.manifest(broken, counts).collect()} == {("tables", "pairs"), ("rows", "n_pairs")}


def test_a_failed_rename_puts_the_former_table_back(spark, tmp_path):
    old = tmp_path / "t.parquet"
    tables.write_table(spark.range(3), str(tmp_path / "t"), csv=False)
    with pytest.raises(OSError):
        tables._rename(spark, str(tmp_path / "nothing"), str(old))
    assert spark.read.parquet(str(old)).count() == 3 and not (tmp_path / "t.parquet.former").exists()
    tables.write_table(spark.range(5), str(tmp_path / "t"), csv=False)
    assert spark.read.parquet(str(old)).count() == 5 and not (tmp_path / "t.parquet.former").exists()


def test_units_are_written_read_and_checked(spark, tmp_path):
    ids = [1, *[7] * 1022, 2]
    rows = [("A", i, ids, 1.0, 10.0, 5) for i in range(3)] + [("B", 0, ids[:-1], 1.0, 10.0, 6), ("B", 1, ids, 2.0, 10.0, 6)]
    schema = "assembly_accession string, chunk_id int, input_ids array<int>, log10_longevity double, max_longevity_yrs double, ncbi_taxid long"
    path = str(tmp_path / "chunks")
    tables.write_units(spark.createDataFrame(rows, schema), path)
    tables.write_units(spark.createDataFrame(rows[:2], schema), path)  # unit A again, with two chunks
    back = tables.read_units(spark, path)
    assert sorted((r["assembly_accession"], r["chunk_id"]) for r in back.collect()) == [("A", 0), ("A", 1), ("B", 0), ("B", 1)]
    assert tables.read_units(spark, path, wanted=spark.createDataFrame([("A",)], "assembly_accession string")).count() == 2
    assert {r["message"] for r in validation.chunks(back).collect()} == {"length", "label is not log10 of the years"}
    assert [r[0] for r in tables.unfinished(spark.createDataFrame([("A",), ("C",)], "assembly_accession string"), back).collect()] == ["C"]
    spark.range(2).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="chunk_id is missing"):
        tables.read_units(spark, str(tmp_path / "other"))


def test_reports_logs_and_records_on_disk(spark, tmp_path):
    tables.write_report(spark.createDataFrame([(1, ["a", "b"]), (2, None)], "n int, x array<string>"), str(tmp_path / "r"))
    part = next((tmp_path / "r").glob("*.csv"))
    assert part.read_text().splitlines() == ["n,x", "1,a|b", "2,"]
    assert [(r["n"], r["x"]) for r in inventory.read_records(spark, str(tmp_path / "r"), "n int, x string").collect()] == [(1, "a|b"), (2, None)]
    outcomes = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    for _ in range(2):
        tables.failures(outcomes, str(tmp_path / "f"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "f")).collect()] == [2, 2]
    (tmp_path / "m.jsonl").write_text('{"kind": "train", "step": 1, "loss": 2.5}\n{"kind": "done", "step": 9}\n')
    assert [r["loss"] for r in listings.read_metric_log(spark, str(tmp_path / "m.jsonl"), "train").collect()] == [2.5]
    assert metrics.incomplete_runs(listings.read_metric_log(spark, str(tmp_path / "m.jsonl")).withColumn("run", F.lit("a")), "run", spark.createDataFrame([("a", 9), ("b", 9)], "run string, step long")).count() == 1


def test_lines_that_repeat_a_key_keep_the_last(spark):
    log = listings.parse_log(spark.createDataFrame([("epoch 3 loss=0.5 lr=1 lr=2",)], "value string")).first()
    assert (log["epoch"], log["values"]["lr"], log["values"]["loss"]) == (3, "2", "0.5")
    lines = ["c\tx\tmRNA\t1\t9\t.\t+\t.\tID=a;ID=m;Rank=1;Target=p 1 3;Identity=0.5", "c\tx\tCDS\t1\t9\t.\t+\t.\tParent=m;Parent=m"]
    hit = listings.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string")).first()
    assert (hit["id"], hit["protein"], hit["identity"]) == ("m", "p", 0.5)


def test_bad_lines_have_their_numbers(spark, tmp_path):
    path = tmp_path / "s.txt"
    row = "GCF_1\t9606\t9606\tHomo\tContig"
    path.write_text("##x\n#assembly_accession\ttaxid\tspecies_taxid\torganism_name\tassembly_level\n" + f"{row}\n" * 500 + "GCF_2\tnone\t1\tx\tContig\n" + f"{row}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        good, bad = listings.read_assembly_summary(spark, str(path))
        assert good.count() == 501 and [(r["line"], r["columns"]) for r in bad.collect()] == [(503, "taxid")]
        assert "pubmed_id" in good.columns and "line" not in good.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(b"x" * 100)
    (tmp_path / "b.bin").write_bytes(b"y" * 3)
    whole = sorted(map(tuple, inventory.inventory(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(inventory, "CELL_BYTES", 10)
    assert sorted(map(tuple, inventory.inventory(spark, str(tmp_path)).collect())) == whole and len(whole) == 2


def test_fasta_by_address_and_pack_summary(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "g.fna.gz", "wt") as f:
        f.write(">a one\nACGT\n>b Mitochondrion x\nAC\n>c\nGG\n")
    (tmp_path / "plain.fna").write_text("no header here\n")
    got = fasta.read_fasta(spark, f"file://{tmp_path}/*.gz", 3)
    gone = spark.createDataFrame([("c",)], "accession string")
    row = fasta.pack_summary(got, gone).first()
    assert (row["n_kept"], row["total_bp"], row["excluded"]) == (1, 4, ["b", "c"])
    counts = {r["file"].rsplit("/", 1)[1]: r["n_sequences"] for r in fasta.record_counts(spark, str(tmp_path)).collect()}
    assert counts == {"g.fna.gz": 3, "plain.fna": 0}


def test_cohorts_batches_and_counts_by_windows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert drift.cohort(rows, "k", ["v"], single=True).count() == 2
    with pytest.raises(ValueError, match="2 different rows"):
        drift.cohort(rows.union(spark.createDataFrame([("a", 3)], "k string, v int")), "k", ["v"], single=True)
    df = spark.createDataFrame([(i, 10 + i % 5, 1 + i % 3) for i in range(300)], "k long, n int, w int")
    got = sequences.budget_batches(df, "k", "n", 100, bucket=64, windows="w").join(df, "k")
    sizes = got.groupBy("bucket", "batch").agg((F.max("n") * F.sum("w")).alias("t"), F.count("*").alias("c")).collect()
    assert sum(r["c"] for r in sizes) == 300 and all(r["t"] <= 100 or r["c"] == 1 for r in sizes)


def test_retrieval_and_unknown_groups(spark):
    own = spark.createDataFrame([(1, "a", "g"), (2, "b", "g"), (3, "c", "h")], "query int, species string, genus string")
    hits = spark.createDataFrame([(1, 1, 1, "a", "g"), (1, 2, 2, "b", "g"), (2, 1, 1, "a", "g"), (2, 2, 2, "b", "g"), (3, 1, 1, "a", "g")], "query int, key int, rank int, species string, genus string")
    m = metrics.retrieval_metrics(hits, own).first()
    assert [round(m[c], 3) for c in ("specimen_top1", "specimen_topk", "species_top1", "genus_top1")] == [0.333, 0.667, 0.333, 0.667]
    rows = spark.createDataFrame([(i, None if i % 2 else f"f{i % 6}") for i in range(40)], "id int, family string")
    split = {r["id"]: r["split"] for r in splits.group_split(rows, group="family", test=0.1, val=0.1).collect()}
    assert len({split[i] for i in range(1, 40, 2)}) == 1 and set(split.values()) == {"train", "val", "test"}


def test_tables_on_disk_that_are_missing_or_unreadable(spark, tmp_path):
    spark.createDataFrame([], TABLES["pairs"]).write.parquet(str(tmp_path / "pairs.parquet"))
    (tmp_path / "images.parquet").write_text("not a table")
    found = {(r["table"], r["message"]) for r in validation.on_disk(spark, str(tmp_path)).where("check = 'table'").collect()}
    assert found == {("species", "missing table"), ("genomes", "missing table"), ("images", "unreadable table")}
    nothing = validation.on_disk(spark, str(tmp_path / "nowhere")).collect()
    assert {r["table"] for r in nothing} == set(TABLES) and {r["message"] for r in nothing} == {"missing table"}
