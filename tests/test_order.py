"""Distributed order: numbers, running sums, ranks and joins on hot keys against windows and plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from taxaflow.operators import order


def _rows(seed: int, n: int = 3000):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * n + [None, "b", "c"] * (n // 3)) if k % 3 else "hot", k * 7919 % n, rng.randrange(-5, 9) if k % 11 else None) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_and_sums_equal_a_window(spark, parts):
    rows = spark.createDataFrame(_rows(parts), "g string, k long, v long").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = order.numbered(rows, ["g"], ["k"], "n", {"s": F.col("v")})
        spread = got.groupBy("g").agg(F.count("*").alias("c")).orderBy(F.desc("c")).first()
        assert spread["g"] == "hot" and spread["c"] > 1000
        w = Window.partitionBy("g").orderBy("k")
        want = rows.withColumn("n", F.row_number().over(w).cast("long")).withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_lies_in_many_partitions(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = {}
        keep = order.Workspace.cut

        def cut(self, df):
            out = keep(self, df)
            seen["most"] = out.groupBy("_part").count().agg(F.max("count")).first()[0]
            return out

        order.Workspace.cut = cut
        try:
            got = order.numbered(rows, ["g"], ["k"])
        finally:
            order.Workspace.cut = keep
        assert got.where(F.col("n") != F.col("k") + 1).count() == 0
        assert seen["most"] < 20_000 / 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_table_as_one_group_and_empty_table(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert [r["n"] for r in order.numbered(rows, [], [F.desc("k")]).orderBy("k").collect()] == list(range(100, 0, -1))
    assert order.numbered(rows.where("k < 0"), [], ["k"]).count() == 0
    with pytest.raises(ValueError, match="there already"):
        order.numbered(rows, [], ["k"], "K")


def test_average_ranks_share_ties(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 3.0), (5, None), (6, 0.5)], "k long, v double")
    got = {r["k"]: r["r"] for r in order.average_ranks(rows, [], "v", "r").collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 4.0, 4: 4.0, 5: None, 6: 1.0}


def test_joins_on_hot_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(order, "HOT", 10)
    rows = spark.createDataFrame([(None if k % 50 == 1 else 0 if k % 3 else k, k) for k in range(6000)], "g long, k long")
    table = spark.createDataFrame([(g, g * 2) for g in range(0, 6000, 2)], "g long, x long")
    for how in ("inner", "left"):
        got = order.hot_join(rows, table, ["g"], how).select("g", "k", "x")
        assert sorted(got.collect(), key=str) == sorted(rows.join(table, ["g"], how).select("g", "k", "x").collect(), key=str)


def test_columns_of_the_order_alone_go(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 2, "x"), ("a", None, "z")], "g string, k long, t string")
    got = order.numbered(rows, ["g"], [F.asc_nulls_first("k"), "t"], drop=["t"])
    assert got.columns == ["g", "k", "n"] and [tuple(r) for r in got.orderBy("n").collect()] == [("a", None, 1), ("a", 2, 2), ("a", 2, 3)]


def test_medians_equal_those_of_sorted_lists(spark):
    import statistics

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.choice([1.5, 1.5, 2.0, -3.0, None, float(rng.randrange(9))])) for _ in range(999)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert {r["g"]: r["m"] for r in order.medians(df, ["g"], "v", "m").collect()} == {g: statistics.median(v) for g, v in want.items()}
    assert order.medians(df, [], "v").first()[0] == statistics.median([v for _, v in rows if v is not None])
    assert order.medians(df.where("g = 'c'"), ["g"], "v").count() == 0


def test_operators_over_one_group_with_a_third_of_all_rows(spark):
    from taxaflow.operators import selection, splits

    rows = [("hot" if k % 3 == 0 else f"g{k % 40}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(6)
    own = {}
    for g, k in rows:
        own.setdefault(g, []).append(k)
    got = sorted(r["k"] for r in selection.systematic(df, "g", "k", 7).collect())
    assert got == sorted(k for ks in own.values() for k in ks[::7])
    split = splits.record_split(df, group="g", key="k", share=0.1).groupBy("g").agg(F.count_if(F.col("split") == "val").alias("v")).collect()
    assert {r["g"]: r["v"] for r in split} == {g: round(len(ks) * 0.1) for g, ks in own.items()}
    runs = selection.block_sample(df, "g", ["k"], 10, 2).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in runs} == {g: min(10, len(ks)) for g, ks in own.items()}
    plan = selection.systematic(df, "g", "k", 7)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_medians_of_columns_of_several_types_and_groups_that_lack_some(spark):
    import statistics

    rng = random.Random(6)
    value = lambda g, k: None if rng.random() < 0.2 or (g, k) in (("b", 0), (None, 2)) else rng.randrange(7)
    rows = [(g, value(g, 0), value(g, 1), value(g, 2)) for g in ["hot"] * 300 + ["b"] * 40 + [None] * 30 + ["c"]]
    rows = [(g, x, None if y is None else y / 2, z) for g, x, y, z in rows[:-1]] + [("c", None, None, None)]
    df = spark.createDataFrame(rows, "g string, x long, y double, z long").repartition(4)
    got = {r["g"]: (r["mx"], r["my"], r["mz"]) for r in order.medians_of(df, ["g"], {"x": "mx", "y": "my", "z": "mz"}).collect()}

    def middle(g, k):
        known = [r[k] for r in rows if r[0] == g and r[k] is not None]
        return statistics.median(known) if known else None

    assert got == {g: tuple(middle(g, k) for k in (1, 2, 3)) for g in ("hot", "b", None)}
    assert [tuple(r) for r in order.medians_of(df, [], {"x": "mx", "y": "my"}).collect()] == [
        tuple(statistics.median([r[k] for r in rows if r[k] is not None]) for k in (1, 2))
    ]


def test_ranks_of_several_columns_equal_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(order, "HOT", 10)
    rng = random.Random(8)
    rows = [(k, None if k % 5 == 0 else "a", rng.choice([None, 1.0, 1.0, 2.5, float(rng.randrange(9))]), rng.choice([None, 1.0, rng.random()]), rng.randrange(3)) for k in range(3500)]
    df = spark.createDataFrame(rows, "k long, g string, x double, y double, z int").repartition(5)
    got = {r["k"]: (r["rx"], r["ry"], r["rz"]) for r in order.ranked_by(df, ["g"], {"x": "rx", "y": "ry", "z": "rz"}).collect()}
    want = {k: [None] * 3 for k, *_ in rows}
    for g in (None, "a"):
        for c in (2, 3, 4):
            known = sorted((r[c], r[0]) for r in rows if r[1] == g and r[c] is not None)
            places = {}
            for n, (v, _) in enumerate(known, 1):
                places.setdefault(v, []).append(n)
            for v, k in known:
                want[k][c - 2] = sum(places[v]) / len(places[v])
    assert got == {k: tuple(v) for k, v in want.items()}
