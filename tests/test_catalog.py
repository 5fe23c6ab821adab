"""The catalog source on tiny catalogs, as in the cases of FIXTURES.md."""

import pytest

from taxaflow.sources import catalog, registry

CATALOG = "uuid string, source_url string, scientific_name string, data_source string, publisher string, basis_of_record string, img_type string, source_id string, class string"
PROVENANCE = "uuid string, license_name string, license_link string, copyright_owner string, title string"


@pytest.fixture
def write(spark, tmp_path):
    def made(rows, provenance=None):
        """Rows ``uuid`` -> changes over the defaults."""
        base = {"source_url": "https://h.org/x.jpg", "scientific_name": "Vulpes vulpes", "data_source": "gbif", "publisher": "iNaturalist.org", "basis_of_record": "HUMAN_OBSERVATION", "img_type": "Citizen Science", "class": "Mammalia"}
        full = [{"uuid": u, "source_id": f"obs-{u}"} | base | change for u, change in rows.items()]
        names = [c.split()[0] for c in CATALOG.split(", ")]
        spark.createDataFrame([tuple(r[c] for c in names) for r in full], CATALOG).write.parquet(str(tmp_path / "c"))
        default = {u: ("cc-by-nc-4.0", "link", "not provided", "not provided") for u in rows}
        listed = default | (provenance or {})
        spark.createDataFrame([(u, *v) for u, v in listed.items() if v], PROVENANCE).write.parquet(str(tmp_path / "p"))
        return {"catalog": str(tmp_path / "c"), "provenance": str(tmp_path / "p"), "species": ["Vulpes vulpes"]}

    return made


def picked(spark, how, **options):
    return [r["candidate_id"] for r in registry.candidates(spark, "catalog", **how, **options).orderBy("rank").collect()]


def test_caps_and_order(spark, write):
    eol = {"img_type": None, "data_source": "eol", "source_id": None}
    how = write({f"a{i}": {"source_id": "obs-A"} for i in range(3)} | {"b0": {}, "c0": {"source_id": "obs-C"}, "c1": {"source_id": "obs-C"}, "e0": eol, "e1": eol})
    assert [len(picked(spark, how, per_observation=n)) for n in (1, 2, None)] == [5, 7, 8]
    from hashlib import md5

    every = picked(spark, how, per_observation=None)
    assert every == sorted(every, key=lambda u: md5(f"0:{u}".encode()).hexdigest())
    assert picked(spark, how, per_observation=None, seed=1) != every
    assert picked(spark, how, per_observation=None, per_species=3) == every[:3]


def test_filters(spark, write):
    how = write(
        {"ok": {}, "museum": {"img_type": "Museum Specimen: x"}, "null": {"img_type": None}, "eol": {"source_url": "https://content.eol.org/1.jpg"}, "fossil": {"basis_of_record": "FOSSIL_SPECIMEN"}, "blank": {"source_url": " "}, "none": {}},
        {"museum": ("other", None, None, None), "none": None},
    )
    assert set(picked(spark, how)) == {"ok", "null", "fossil"}
    assert set(picked(spark, how, license_policy="any", exclude_hosts=None)) == {"ok", "museum", "null", "eol", "fossil", "none"}
    assert set(picked(spark, how, image_types=["Citizen Science"], exclude_basis=["FOSSIL_SPECIMEN"])) == {"ok"}
    assert set(picked(spark, how, image_types=[None])) == {"null"} and picked(spark, how, image_types=[]) == []


def test_names_aliases_and_collisions(spark, write):
    how = write({"a": {"scientific_name": "Vulpes vulpes (Linnaeus, 1758)"}, "b": {"scientific_name": "Canis vulpes Linnaeus, 1758"}, "c": {"scientific_name": "Vulpes vulpes fulva"}})
    assert picked(spark, how) == ["a"]
    assert set(picked(spark, how, aliases={"Vulpes vulpes": ["Canis vulpes", "Vulpes vulpes fulva"]})) == {"a", "b", "c"}
    with pytest.raises(ValueError, match="claimed"):
        picked(spark, how | {"species": ["Vulpes vulpes", "Canis lupus"]}, aliases={"Canis lupus": ["vulpes vulpes"]})


def test_candidate_columns(spark, write):
    photo = "https://inaturalist-open-data.s3.amazonaws.com/photos/5/original.jpeg"
    how = write({"a": {"source_url": photo}, "b": {"data_source": "EOL", "publisher": None}})
    rows = {r["candidate_id"]: r for r in registry.candidates(spark, "catalog", **how).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["source_url"], a["fallback_urls"]) == (photo.replace("original", "medium"), [photo])
    assert (a["source_provider"], a["observation_id"], a["image_type"], a["rights_holder"]) == ("inaturalist", "obs-a", "citizen_science", None)
    assert (b["source_provider"], b["observation_id"], b["fallback_urls"]) == ("eol", None, [])


def test_summary(spark, write):
    rows = {f"a{i}": {"source_id": "obs-A"} for i in range(3)} | {f"b{i}": {"source_id": "obs-B"} for i in range(2)}
    rows |= {"m": {"img_type": "Museum Specimen", "source_url": None}, "n": {"img_type": None, "source_url": ""}, "x": {"scientific_name": "Canis lupus"}}
    how = write(rows, {"b1": ("other", None, None, None)})
    got = {r["species_query"]: r for r in catalog.summary(spark, **how | {"species": ["Vulpes vulpes", "Nope"]}).collect()}
    fox, nope = got["Vulpes vulpes"], got["Nope"]
    assert (fox["n_rows"], fox["n_no_url"], fox["n_eligible"], fox["n_observations"], fox["n_selectable"]) == (7, 2, 4, 2, 2)
    assert fox["image_types"] == {"Citizen Science": 5, "Museum Specimen": 1, "null": 1}
    assert (nope["n_rows"], nope["n_selectable"], nope["image_types"]) == (0, 0, {})


def test_class_subset(spark, write, tmp_path):
    how = write({"a": {}, "b": {"class": "Aves"}})
    catalog.class_subset(spark, how["catalog"], how["provenance"], str(tmp_path / "sub"), "Mammalia")
    assert [r["uuid"] for r in spark.read.parquet(str(tmp_path / "sub/provenance.parquet")).collect()] == ["a"]
    assert picked(spark, {"catalog": str(tmp_path / "sub/catalog.parquet"), "provenance": str(tmp_path / "sub/provenance.parquet"), "species": ["Vulpes vulpes"]}) == ["a"]
