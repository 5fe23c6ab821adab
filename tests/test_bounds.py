"""Work and memory that grow no faster than the input: what plans must and must not hold."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from taxaflow.operators import embeddings as E
from taxaflow.operators import kmers as K
from taxaflow.operators import selection as S
from taxaflow.operators import sequences as Q
from taxaflow.operators import tables as B
from taxaflow.plans import catalog, datasets
from taxaflow.sources import listings

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_image_pairs_make_strings_of_images_before_the_join(spark):
    images = spark.createDataFrame([("i1", 1, 7), ("i2", 1, 8), ("i3", 2, 9), ("i4", None, 10)], "image_id string, ncbi_taxid long, place long")
    genomes = spark.createDataFrame([("G1", 1), ("G2", 1), ("G3", 3), ("G4", None)], "assembly_accession string, species_taxid long")
    found = sorted(tuple(r) for r in B.image_pairs(images, genomes, ["place"]).collect())
    assert found == [(i, g, 1, "species_reference", p) for i, p in (("i1", 7), ("i2", 8)) for g in ("G1", "G2")]
    above, below = _plan(catalog.queries()["image_pairs"](spark, SF)).split("Join", 1)
    assert "concat" not in above and "split" not in above and "Repartition" in below and "concat" in below


def test_tasks_take_images_by_species(spark, monkeypatch):
    images = spark.range(3000).select(F.concat(F.lit("i"), "id").alias("image_id"), (F.col("id") * 7 % 5).alias("ncbi_taxid"))
    genomes = spark.range(40).select(F.concat(F.lit("G"), "id").alias("assembly_accession"), (F.col("id") % 5).alias("species_taxid"))
    pairs = B.image_pairs(images, genomes).withColumn("part", F.spark_partition_id()).collect()
    assert {(r["image_id"], r["assembly_accession"]) for r in pairs} == {(f"i{i}", f"G{g}") for i in range(3000) for g in range(40) if i * 7 % 5 == g % 5}
    assert len(pairs) == 3000 * 8
    lists = {}
    for r in pairs:
        lists.setdefault(r["part"], []).append(r["ncbi_taxid"])
    assert len(lists) > 1
    for seen in lists.values():
        assert 1 + sum(a != b for a, b in zip(seen, seen[1:])) == len(set(seen))
    # stretches are bounded, and lose no row
    monkeypatch.setattr(B, "STRETCH_BYTES", 4000)
    table = pa.table({"k": [3, 1, None, 2] * 1000, "x": [f"x{i}" for i in range(4000)]})
    made = list(B._clustered("k")(iter(table.to_batches(max_chunksize=50))))
    assert sorted(r["x"] for b in made for r in b.to_pylist()) == sorted(table["x"].to_pylist())
    assert max(b.nbytes for b in made) < 2 * 4000 and [b for b in made if b.column("k").null_count < len(b)] == made


def test_a_search_holds_few_products_at_once():
    draw = np.random.default_rng(3)
    keys, matrix = np.arange(20_000), draw.normal(size=(20_000, 8))
    asked = pd.DataFrame({"query": np.arange(1100), "v": list(draw.normal(size=(1100, 8)))})
    best = E._search("query", "key", "v", 3, True)
    tracemalloc.start()
    found = pd.concat(best(asked, keys, matrix))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    for q in (0, 777, 1099):
        sims = matrix @ asked["v"][q]
        sims[q] = -np.inf
        own = found[found["query"] == q].sort_values("sim", ascending=False)
        assert own["key"].tolist() == np.argsort(-sims)[:3].tolist()


def test_gff_attributes_are_cut_out_without_maps(spark):
    lines = [
        "#c\tx\tmRNA\t1\t9\t.\t+\t.\tID=no;Rank=1;Target=p 1 3", "c\tx\tmRNA\t1\t9\t.\t+\tID=no;Rank=1;Target=p 1 3",
        "c\tx\tmRNA\t1\t9\t.\t+\t.\tID=no;Rank=1;Target=p 1 3\t", "c\tmRNA\tgene\t1\t9\t.\t+\t.\tID=no;Rank=1;Target=p 1 3",
        "c\tx\tmRNA\t1\t9\t.\t-\t.\tOtherID=z;ID=a=b;Rank=2;Rank=1;Target=p 1 3;Identity=;note;=q", "c\tx\tmRNA\t1\t9\t.\t+\t.\tID=d;Rank=1",
        "c\tx\tCDS\t5\t9\t.\t-\t.\tParent=a=b", "c\tCDS\tCDS\t1\tx\t.\t-\t.\tParent=d;Parent=a=b", "c\tx\tCDS\t1\t2\t.\t-\t.\tID=s", "c\tx\tCDS\t1\t2\t.\t-\t.\tGrandParent=d",
    ]
    found = listings.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert "map_from_entries" not in _plan(found) and "lambda" not in _plan(found)
    (hit,) = found.collect()
    assert (hit["id"], hit["protein"], hit["strand"], hit["q_end"], hit["identity"], hit["frameshifts"]) == ("a=b", "p", "-", 3, None, 0)
    assert [tuple(s) for s in hit["segments"]] == [(1, None), (5, 9)]


def test_bases_and_blocks_of_long_texts(spark):
    odd = "acgtnACGTNxyz-\n\x00é\U0001f600k" * 3
    texts = [("a", odd), ("b", ""), ("c", None), ("d", "acgtz" * 41), ("e", "A" * 32), ("f", "C" * 33)]
    rows = spark.createDataFrame(texts, "record string, s string").select("record", Q.normal_bases("s").alias("s"))
    assert "regexp_replace" not in _plan(rows)
    found = {r["record"]: r["s"] for r in rows.collect()}
    want = {k: t and "".join(c.upper() if c in "acgtACGT" else "N" for c in t) for k, t in texts}
    assert found == want
    made = sorted(tuple(r) for r in Q.blocks(rows, ["record"], "s", 2).collect())
    assert made == sorted((k, i, t[i : i + 2]) for k, t in want.items() if t for i in range(0, len(t), 2))


def test_kmer_profiles_read_their_sequences_once(spark):
    rows = spark.createDataFrame([("a", "ACGTT"), ("b", "GGGGC")], "k string, s string")
    profile = K.kmer_profile(K.kmer_counts(rows, ["k"], "s", 2), ["k"])
    assert "MapInPandas" not in _plan(profile)
    assert sum(r["share"] for r in profile.collect()) == 2.0


def test_provenance_is_made_of_the_written_catalog(spark):
    _, how = datasets._written_catalog(spark, SF)
    catalog_rows = spark.read.parquet(how["catalog"])
    assert "_s" in catalog_rows.columns  # kept, so that lines are not grouped again
    assert spark.read.parquet(how["provenance"]).count() == catalog_rows.where("_s % 4 < 3").count() > 0


def test_capped_groups_are_dealt_before_rows_are_held(spark, monkeypatch):
    above, below = _plan(catalog.queries()["cap_per_group"](spark, SF)).rsplit("Repartition", 1)
    assert "Aggregate" in above and "Window" in above  # over what a partition of bounded size has
    assert "Aggregate" not in below and "Window" not in below and "Sort" not in below  # not over a whole split
    # 4,000 rows of one group, 3,000 copies of one row, 600 small groups, 300 rows without a group
    at = F.col("id")
    group = F.when(at < 4000, 1).when(at < 7000, 2).when(at < 10_000, 3 + at % 600)
    made = spark.range(0, 10_300, 1, 32).repartition(32).select(group.alias("g"), F.when((at >= 4000) & (at < 7000), 0).otherwise(at).alias("k"))
    rows = made.unionByName(made.where("k % 3 = 0 and k > 0"))
    monkeypatch.setattr(S, "PART_ROWS", 500)
    dealt, cut = S._dealt(rows, "g", "k")
    parts, n = dealt.rdd.getNumPartitions(), rows.count()
    assert cut and parts == -(-n // 500)
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) <= 3 * 500
    held = [tuple(r) for r in rows.collect()]
    for different in (True, False):
        want = {}
        for g, k in set(held) if different else held:
            want.setdefault(g, []).append((hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
        want = sorted((str(g), k) for g, ks in want.items() for _, k in sorted(ks)[:6])
        for size in (500, 1 << 30):  # groups cut into cells, and whole
            monkeypatch.setattr(S, "PART_ROWS", size)
            found = S.cap_per_group(rows, "g", "k", 6, 7, different).collect()
            assert sorted((str(r["g"]), r["k"]) for r in found) == want


def test_rows_with_one_key_are_capped_too(spark):
    rows = spark.createDataFrame([(1, "a", x) for x in (1, 1, 2, 3)] + [(1, "b", 1), (2, "a", 1)], "g int, k string, x int")
    found = S.cap_per_group(rows, "g", "k", 2, different=True).collect()
    assert sorted(r["g"] for r in found) == [1, 1, 2] and len({tuple(r) for r in found}) == 3
