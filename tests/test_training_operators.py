"""The general training-data operators on small fixtures, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoweft.operators import deliveries, nearby, skew


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(autouse=True)
def no_table_is_small(monkeypatch):
    """The fixtures are tiny: take the way of large tables."""
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)


# salted aggregation


def test_salted_aggregate_equals_plain_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([1, 2, 3, None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v bigint, rows bigint")  # a column that shares its name with a result
    got = skew.salted_aggregate(df, "k", {"rows": ("count", None), "n": ("count", "v"), "total": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v"), "mean": ("avg", "v"), "kinds": ("count_distinct", "v")}, salts=5)
    want = df.groupBy("k").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"), F.count_distinct("v"))
    key = lambda t: str(t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_salted_aggregate_over_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([("x", 1)] * 50, "k string, v bigint")
    assert [tuple(r) for r in skew.salted_aggregate(df, "k", {"n": ("count", None)}).collect()] == [("x", 50)]
    assert skew.salted_aggregate(df.limit(0), "k", {"n": ("count", None), "d": ("count_distinct", "v")}).collect() == []


def test_keys_by_share_counts_null_keys_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10 + [(None,)] * 60, "k string")
    assert [r["k"] for r in skew.keys_by_share(df, "k", 0.3).collect()] == ["a"]
    assert sorted(r["k"] for r in skew.keys_by_share(df, "k", 0.1).collect()) == ["a", "b"]


def test_skew_safe_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (3, 0), (None, 0)], "k bigint, v bigint")
    right = spark.createDataFrame([(1, "one"), (2, "two")], "k bigint, w string")
    got = skew.skew_safe_join(left, right, "k")
    assert got.count() == 101 and got.where("w = 'two'").count() == 1


def test_heavy_keys_by_share_and_by_number(spark):
    df = spark.createDataFrame([(1,)] * 60 + [(2,)] * 4 + [(i,) for i in range(10, 46)] + [(None,)] * 900, "k bigint")
    assert skew.heavy_candidates(df, "k", 0.3) == [1]
    assert sorted(skew.heavy_candidates(df, "k", 0.3, rows=3)) == [1, 2]  # 4 of 100 rows are no large share
    assert skew.heavy_candidates(df.limit(0), "k") == []


def test_skew_safe_left_semi_and_anti(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (2, 0), (3, 0)] + [(None, i) for i in range(50)], "k bigint, w bigint")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "k bigint, v string")
    joined = skew.skew_safe_left(left, right, "k")
    assert joined.columns == ["k", "w", "v"] and sorted(map(str, joined.collect())) == sorted(map(str, left.join(right, "k", "left").collect()))
    twice = right.unionByName(right)
    for anti in (False, True):
        got = skew.skew_safe_semi(left, twice, "k", anti=anti)
        assert got.columns == left.columns and sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", "left_anti" if anti else "left_semi").collect()))
        assert skew.skew_safe_semi(left.limit(0), twice, "k", anti=anti).collect() == []


def test_a_key_with_half_of_the_rows_fills_no_task(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 4 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(40_000).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined, rows in ((skew.skew_safe_left(left, right, "k"), 40_000), (skew.skew_safe_join(left, right, "k"), 30_000), (skew.skew_safe_semi(left, right, "k"), 30_000)):
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == rows and max(sizes) <= 2 * rows / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# deliveries


def test_exactly_one_copy_of_each_message(spark):
    r = random.Random(2)
    rows = [(r.choice([7] * 5 + list(range(20)) + [None]), i, "x") for i in range(500)]  # 7 is hot
    df = spark.createDataFrame(rows, "id bigint, delivery bigint, is_first string")
    first = {}
    for i, n, _ in rows:
        if i is not None:
            first[i] = min(n, first.get(i, n))
    kept = deliveries.keep_first(df, "id", ["delivery"])
    assert {r["id"]: r["delivery"] for r in kept.collect()} == first and kept.columns == df.columns
    excess = {r["delivery"] for r in deliveries.excess_deliveries(df, "id", ["delivery"]).collect()}
    assert excess == {n for i, n, _ in rows if i is not None and first[i] != n}


def test_new_messages_skip_what_is_stored(spark):
    stored = spark.createDataFrame([(1,), (None,)], "id bigint")
    batch = spark.createDataFrame([(1, 10), (2, 11), (2, 12), (None, 13)], "id bigint, n bigint")
    assert [tuple(r) for r in deliveries.new_messages(batch, stored, "id", ["n"]).collect()] == [(2, 11)]
    assert deliveries.new_messages(batch.limit(0), stored, "id", ["n"]).collect() == []


def test_ties_in_arrival_are_broken_by_the_next_column(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, None, "z")], "id bigint, at bigint, tie string")
    assert [r["tie"] for r in deliveries.keep_first(df, "id", ["at", "tie"]).collect()] == ["a"]


# nearby points


@pytest.mark.parametrize("center", [(51.5, 0.0), (0.0, 179.9999), (89.9995, 10.0), (-89.9999, -100.0), (45.0, -180.0)])
def test_pairs_within_equal_brute_force(spark, center):
    r = random.Random(3)
    spread = 0.002
    points = [(i, max(-90.0, min(90.0, center[0] + r.uniform(-spread, spread))), center[1] + r.uniform(-spread, spread) * (1 if abs(center[0]) < 80 else 40000)) for i in range(120)]
    points = [(i, la, (lo + 180) % 360 - 180) for i, la, lo in points]
    df = spark.createDataFrame([*points, (None, 1.0, 1.0), (999, None, 1.0)], "id bigint, lat double, lon double").withColumn("cell", F.lit("clash"))
    got = {(r["id_a"], r["id_b"]) for r in nearby.pairs_within(df, 50.0, per_task=20).collect()}
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and km(a[1:], b[1:]) * 1000 <= 50}
    assert got == want and got


def test_equal_points_are_pairs_and_no_points_none(spark):
    df = spark.createDataFrame([(3, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)], "id bigint, lat double, lon double")
    assert {tuple(r)[:2] for r in nearby.pairs_within(df, 50.0).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert nearby.pairs_within(df.limit(0), 50.0).collect() == []


def test_regions_holding_equal_brute_force(spark):
    r = random.Random(4)
    points = [(i, r.uniform(50, 51), r.uniform(0, 1)) for i in range(80)]
    discs = [(100 + i, r.uniform(50, 51), r.uniform(0, 1)) for i in range(10)]
    got = {(r["id"], r["region_id"]) for r in nearby.regions_holding(spark.createDataFrame(points, "id bigint, lat double, lon double"), spark.createDataFrame(discs, "region_id bigint, lat double, lon double"), 20_000.0).collect()}
    assert got == {(p[0], d[0]) for p in points for d in discs if km(p[1:], d[1:]) <= 20}


def test_valid_points(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([91.0, 0.0],), ([1.0, 181.0],), ([1.0],), ([1.0, 2.0, 3.0],), ([None, 1.0],), (None,), ([],), ([float("nan"), 1.0],)]
    df = spark.createDataFrame(rows, "p array<double>")
    assert [r[0] for r in df.select(nearby.valid_point(F.col("p"))).collect()] == [True] + [False] * 9
