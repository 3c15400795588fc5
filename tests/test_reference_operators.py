"""The engine's own operators on hand-checkable fixtures."""

import itertools
import random
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.functions import curves, geo, text
from geoweft.operators import aggregates, datasets, gazetteer, graph, toponyms
from geoweft.plans import evaluation, methods, reference_queries

POINTS = "user_id bigint, ord bigint, lat double, lon double, weight double"
LOC = "user_id bigint, lat double, lon double"
POSTS = "id bigint, delivery_id bigint, user_id string, text string, location string, geo struct<coordinates: array<double>>, place struct<place_type: string, full_name: string, country: string>"
EDGES = "src bigint, dst bigint, weight bigint"


def both_ways(spark, pairs):
    return spark.createDataFrame([e for a, b, *w in pairs for e in ((a, b, *(w or [1])), (b, a, *(w or [1])))], EDGES)


def located(df):
    return {r["user_id"]: (r["lat"], r["lon"]) for r in df.collect()}


# functions


def test_ellipsoidal_distance_against_known_values(spark):
    got = geo.np_vincenty_km([50.06632, 0, 10], [-5.71475, 0, 20], [58.64402, 0, 10], [-3.07009, 1, 20])
    assert np.allclose(got, [969.954166, 111.319491, 0], atol=1e-3)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (None, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    out = [r[0] for r in df.select(geo.vincenty_km(*map(F.col, "abcd"))).collect()]
    assert out[0] == pytest.approx(313.7054, abs=1e-3) and out[1] is None
    assert [r[0] for r in df.select(geo.known_distance(geo.haversine_km(*map(F.col, "abcd")))).collect()][1] == -1


def test_coordinates(spark):
    df = spark.createDataFrame([(90.1, 0.0), (-90.0, 180.0), (None, 1.0), (95.0, 190.0)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.valid_coord(F.col("lat"), F.col("lon"))).collect()] == [False, True, False, False]
    assert tuple(df.where("lat = 95").select(geo.wrap_lat(F.col("lat")), geo.wrap_lon(F.col("lon"))).head()) == (-85.0, -170.0)
    t = spark.createDataFrame([("48.85, 2.35",), ("40°26'46\"N 79°58'56\"W",), ("nowhere",), (None,), ("200, 300",)], "t string")
    got = [r[0] for r in t.select(geo.parse_coordinates(F.col("t"))).collect()]
    assert tuple(got[0]) == (48.85, 2.35) and got[1]["lat"] == pytest.approx(40.4461, abs=1e-3) and got[1]["lon"] == pytest.approx(-79.9822, abs=1e-3)
    assert got[2:] == [None, None, None]


def test_rounding_and_bins(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.4,)], "x double")
    assert [r[0] for r in df.select(geo.round_half_up(F.col("x"))).collect()] == [3.0, -3.0, 0.0]
    n = spark.createDataFrame([(i,) for i in (0, 4, 5, 19, 20, 40)], "n int")
    assert [r[0] for r in n.select(curves.triad_bin(F.col("n"))).collect()] == [0, 0, 1, 2, 3, 4]
    assert [r[0] for r in n.select(curves.city_bin(F.col("n"))).collect()] == [0, 2, 3, 4, 4, 4]


def test_curve_fits_recover_their_parameters():
    x = np.arange(1, 50)
    assert curves.fit_power_law(x, 0.02 * x**-0.7) == pytest.approx((-0.7, 0.02))
    a, b, c = curves.fit_decay(x, 0.5 * (x + 5.0) ** -1.2)
    assert (a, b, c) == pytest.approx((0.5, 5, 1.2))
    assert curves.fit_power_law([], []) == (-0.55, 0.0045)


def test_texts(spark):
    df = spark.createDataFrame([("a  b\n c ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.squash(F.col("t"))).collect()] == ["a b c", None, ""]
    assert text.tokens("Hi @bob, see http://t.example/x. It's 5:30pm :) #fun &amp; done!!") == ["Hi", "@bob", ",", "see", "http://t.example/x", ".", "It's", "5:30pm", ":)", "#fun", "&", "done", "!!"]
    assert text.split_contraction("don't") == ["do", "n't"] and text.split_contraction("plain") == ["plain"]
    assert [r[0] for r in df.select(text.tokenize(F.col("t"))).collect()] == [["a", "b", "c"], None, []]


# graphs


def test_reciprocal_graphs(spark):
    rows = spark.createDataFrame([(1, 2)] * 5 + [(2, 1)] * 2 + [(1, 3), (4, 4), (5, None), (None, 5)], "src bigint, dst bigint")
    e = graph.weighted_edges(rows)
    assert {tuple(r) for r in graph.reciprocal(e).collect()} == {(1, 2, 5, 2), (2, 1, 2, 5), (4, 4, 1, 1)}
    assert {tuple(r) for r in graph.undirected(e).collect()} == {(1, 2, 2), (2, 1, 2)}


def test_triangles_equal_brute_force(spark):
    r = random.Random(5)
    pairs = {(a, b) for a in range(14) for b in range(a) if r.random() < 0.4}
    nb = {v: {x for p in pairs for x in p if v in p and x != v} for v in range(14)}
    got = {(x["src"], x["dst"]): x["common"] for x in graph.triangles(both_ways(spark, pairs)).collect()}
    assert got == {(a, b): len(nb[a] & nb[b]) for p in pairs for a, b in (p, p[::-1])}


# data sets


def test_user_records_are_bounded_and_whole(spark):
    posts = spark.createDataFrame([(1, i, "x") for i in range(25)] + [(2, 99, None), (None, 5, "y"), (3, None, "z")], "user_id bigint, id bigint, text string")
    rows = datasets.user_records(posts, "user_id", "id", ["text"], per_record=10).collect()
    assert max(len(r["posts"]) for r in rows) <= 10
    assert sorted((r["user_id"], p["id"]) for r in rows for p in r["posts"]) == [(1, i) for i in range(25)] + [(2, 99)]


def test_folds_differ_by_one_user_at_most(spark):
    gold = spark.createDataFrame([(u, u * 10 + i) for u in (30, 10, 20) for i in range(2)], "user_id bigint, post_id bigint")
    assert {r["user_id"]: r["fold"] for r in datasets.assign_folds(gold, 2).collect()} == {10: 0, 20: 1, 30: 0}
    with pytest.raises(ValueError):
        datasets.assign_folds(gold, 1)


def test_hold_out_masks_points_and_keeps_text(spark):
    posts = spark.createDataFrame([(1, 7, "g", "p", "t"), (2, 8, "g", "p", "t"), (3, None, "g", "p", "t")], "id bigint, user_id bigint, geo string, place string, text string")
    held = spark.createDataFrame([(7,), (7,), (None,)], "user_id bigint")
    got = {r["id"]: (r["geo"], r["place"], r["text"], r["held_out"]) for r in datasets.mask_holdout(posts, "user_id", held).collect()}
    assert got == {1: (None, None, "t", True), 2: ("g", "p", "t", False), 3: ("g", "p", "t", False)}


def test_top_per_key_and_global_index(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 5)], "k bigint, v bigint")
    assert sorted(tuple(r) for r in datasets.top_per_key(df, "k", [F.col("v").desc()], 3, salts=4).collect()) == [(1, 297), (1, 298), (1, 299), (2, 5)]
    got = datasets.global_index(df.where("k = 1").select("v"), ["v"]).collect()
    assert all(r["v"] == r["index"] for r in got) and len(got) == 300
    assert datasets.global_index(df.limit(0), ["v"]).collect() == []


# aggregates


def test_medoid_fixtures(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.0, 1.0, 1.0), (1, 2, 0.0, 10.0, 1.0), (2, 7, 5.0, 5.0, 1.0), (2, 3, 6.0, 6.0, 1.0), (3, 1, 1.0, 1.0, 1.0), (4, 1, None, 1.0, 1.0)]
    got = {r["user_id"]: (r["ord"], r["n"]) for r in aggregates.medoids(spark.createDataFrame(rows, POINTS), "user_id").collect()}
    assert got == {1: (1, 3), 2: (3, 2), 3: (1, 1)}


@pytest.mark.parametrize("kind", ["haversine", "vincenty"])
def test_medoid_equals_brute_force(spark, kind):
    r = np.random.default_rng(6)
    rows, want = [], {}
    for u, n in ((1, 1), (2, 2), (3, 40), (4, 200)):
        lat, lon, w = r.normal(40, 5, n), r.normal(-70, 5, n), r.integers(1, 5, n).astype(float)
        cost = [round(float((w * geo.np_distance(kind)(lat[i], lon[i], lat, lon)).sum()), 6) for i in range(n)]
        want[u] = (int(np.argmin(cost)), min(cost))
        rows += [(u, i, float(lat[i]), float(lon[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, POINTS)
    assert {x["user_id"]: (x["ord"], x["cost"]) for x in aggregates.medoids(df, "user_id", kind=kind).collect()} == want
    large = {x["user_id"]: x["ord"] for x in aggregates._large_medoids(df.where("user_id = 4"), "user_id", kind, 100.0, width=16).collect()}
    assert large == {4: want[4][0]}


def test_upper_median_modes_quantiles(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (2, 5.0), (2, None)], "k bigint, v double")
    assert {tuple(r) for r in aggregates.upper_median(df, "k", "v", "m").collect()} == {(1, 3.0), (2, 5.0)}
    assert aggregates.upper_median(df, None, "v", "m").head()[0] == 3.0
    assert {tuple(r) for r in aggregates.modes(df, "k", ["v"]).collect()} == {(1, 1.0, 1), (2, None, 1)}
    q = spark.createDataFrame([(float(i % 7),) for i in range(50)], "v double")
    values = sorted(float(i % 7) for i in range(50))
    assert {r["j"]: r["bound"] for r in aggregates.quantile_bounds(q, "v", 4).collect()} == {j: values[j * 50 // 4] for j in range(4)}


def test_centroids_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    lats = (51.204751, 51.204739, 51.20476, -0.1, 0.2, 0.7)
    rows = [(u, 10 * u + i, x, -x) for u, order in enumerate(itertools.permutations(lats)) for i, x in enumerate(order)]
    df = spark.createDataFrame(rows, "user_id bigint, post_id bigint, lat double, lon double").coalesce(1)
    want = float(sum(map(Decimal, map(str, lats)))) / 6
    assert {(r["lat"], r["lon"], r["n"]) for r in aggregates.centroids(df, "user_id", 3).collect()} == {(want, -want, 6)}
    tie = [(u, i, x, 1.0) for u, order in enumerate(itertools.permutations((67.727466, 44.046481, 45.636092, -38.225039))) for i, x in enumerate(order)]
    tied = spark.createDataFrame(tie, df.schema).coalesce(1)
    monkeypatch.setattr(reference_queries, "gold_posts", lambda spark, d: tied)
    assert {r["lat"] for r in reference_queries.centroid(spark, "").collect()} == {29.7963}  # the mean is 29.79625


def test_error_curve(spark):
    zero = spark.createDataFrame([(0.0,)] * 3, "km double")
    assert aggregates.error_auc(aggregates.error_cdf(zero, "km")).head()[0] == pytest.approx(1.0)
    assert aggregates.error_auc(aggregates.error_cdf(zero.limit(0), "km")).head()[0] == 0


# gazetteer


@pytest.fixture(scope="module")
def places(spark):
    rows = [(1, "Paris", "Ile", "France", 48.85, 2.35), (2, "Springfield", "Illinois", "United States", 39.8, -89.65), (3, "Springfield", "Ohio", "United States", 39.92, -83.8), (4, "Monaco", None, "Monaco", 43.73, 7.42), (5, None, "X", "Y", 0.0, 0.0), (6, "New York", "New York", "United States", 40.71, -74.0), (7, "St. Denis", "Reunion", "France", -20.88, 55.45)]
    return gazetteer.standard(spark.createDataFrame(rows, "place_id bigint, city string, region string, country string, lat double, lon double"))


def test_names(spark, places):
    names = {r["name"] for r in gazetteer.names(places).collect()}
    assert {"paris", "paris\tile\tfrance", "paris\tfrance", "monaco", "springfield\tohio"} <= names and "springfield" not in names


def test_noisy_names(spark, places):
    asked = {"Springfield, IL": 39.8, "Downtown Paris": None, "the city of Paris": 48.85, "nyc": 40.71, "Illinois | Springfield": 39.8, "saint denis, france": -20.88, "New York City USA": None, "Ohio-Springfield!": 39.92, "": None, "  ": None, "monaco": 43.73}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*asked, None])], "id bigint, t string")
    got = {r["id"]: r["lat"] for r in gazetteer.geocode_noisy(rows, "id", "t", gazetteer.names(places), {"IL": "Illinois", "OH": "Ohio"}).collect()}
    want = {i: lat for i, (_, lat) in enumerate(asked.items()) if lat is not None}
    assert got == want  # prefixes fall away in lower case only, so "Downtown Paris" is no known place


def test_reverse_and_canonical(spark, places):
    points = spark.createDataFrame([(1, 48.851, 2.351), (2, 48.862, 2.341), (3, 10.0, 10.0), (4, None, 1.0)], "id bigint, lat double, lon double")
    assert {r["id"]: r["city"] for r in gazetteer.reverse_geocode(points, "id", places).collect()} == {1: "paris", 2: "paris"}
    assert {r["id"]: (r["lat"], r["lon"]) for r in gazetteer.canonicalize(points, "id", places).collect()} == {1: (48.85, 2.35), 2: (48.85, 2.35), 3: (10.0, 10.0), 4: (None, 1.0)}


def test_toponyms(spark, places):
    known = {r["name"] for r in gazetteer.names(places).collect()}
    assert toponyms.scan("from Springfield Ohio to Paris and Monaco", known) == ["springfield\tohio", "paris", "monaco"]
    assert toponyms.scan("Springfield Ohio Nowhere", known) == []  # a failed run of three tries nothing shorter there
    posts = spark.createDataFrame([(1, "in Paris"), (2, None), (3, "")], "id bigint, text string")
    assert [tuple(r) for r in toponyms.toponyms(posts, ["id"], "text", gazetteer.names(places)).collect()] == [(1, "paris")]
    assert [tuple(r) for r in toponyms.toponym_ngrams(posts, ["id"], "text", gazetteer.names(places)).collect()] == [(1, "paris")]


# methods


def test_propagation_moves_along_a_chain(spark):
    edges, home = both_ways(spark, [(1, 2), (2, 3)]), spark.createDataFrame([(1, 10.0, 20.0)], LOC)
    assert set(located(methods.spatial_label_propagation(edges, home, 1))) == {1, 2}
    assert located(methods.spatial_label_propagation(edges, home, 2)) == {1: (10.0, 20.0), 2: (10.0, 20.0), 3: (10.0, 20.0)}
    assert located(methods.random_neighbor(edges, home, 2)) == {1: (10.0, 20.0), 2: (10.0, 20.0), 3: (10.0, 20.0)}


def test_total_variation_respects_dispersion_and_weight(spark):
    home = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.8), (3, 0.0, 0.0), (4, 0.0, 0.1), (5, 0.0, 0.2)], LOC)
    edges = both_ways(spark, [(10, 1, 1), (10, 2, 1), (11, 3, 10), (11, 4, 1), (11, 5, 1)])
    got = located(methods.total_variation(edges, home, 1))
    assert 10 not in got and got[11] == (0.0, 0.0)


def test_friend_vote(spark):
    gold = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 2.0)], LOC)
    got = located(methods.friend_vote(both_ways(spark, [(9, 1), (9, 2), (9, 3), (8, 1), (8, 3)]), gold))
    assert got[9] == (1.0, 1.0) and 8 not in got


def test_other_methods_give_unlocated_users_a_point(spark, places):
    r = random.Random(7)
    pairs = {tuple(sorted(p)) for p in itertools.combinations(range(1, 25), 2) if r.random() < 0.3}
    edges = both_ways(spark, pairs)
    home = spark.createDataFrame([(u, 48.0 + u % 3, 2.0 + u % 2) for u in range(1, 17)], LOC)
    reached = {b for a, b in [*pairs, *[p[::-1] for p in pairs]] if a <= 16}
    for run in (methods.social_tightness, methods.social_energy, methods.multi_location):
        got = located(run(edges, home))
        assert set(got) == set(range(1, 17)) | reached and all(got[u] == (48.0 + u % 3, 2.0 + u % 2) for u in range(1, 17))
    got = located(methods.tie_strength(edges, edges, home, quantiles=3, min_leaf=2))
    assert set(got) == set(range(1, 17)) | reached
    moved = located(methods.influence_profiling(edges, home, 2))
    assert set(moved) >= set(range(1, 25)) - {u for u in range(1, 25) if not any(u in p for p in pairs)}
    cities = methods.city_homes(home, places, 2)
    features = methods.city_features(edges, edges, cities)
    assert features.where("value < 0").count() == 0 and set(located(methods.city_classifier(features, cities))) <= set(range(17, 25))


def test_methods_of_empty_graphs(spark):
    edges, home = spark.createDataFrame([], EDGES), spark.createDataFrame([(1, 1.0, 1.0)], LOC)
    for run in (methods.spatial_label_propagation, methods.total_variation, methods.random_neighbor, methods.social_tightness, methods.multi_location, methods.influence_profiling):
        assert located(run(edges, home)) == {1: (1.0, 1.0)}
    with pytest.raises(KeyError):
        methods.train("none", None)


# evaluation


def test_scores(spark):
    gold = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (3, 2, 0.0, 0.0)], "post_id bigint, user_id bigint, lat double, lon double")
    s = evaluation.score(gold, gold.where("post_id < 3").select("post_id", "lat", "lon"), "haversine").head()
    assert s["auc"] == pytest.approx(1.0) and s["post_coverage"] == pytest.approx(2 / 3) and s["user_coverage"] == 0.5 and s["median_max"] == 0
    none = evaluation.score(gold, gold.limit(0).select("post_id", "lat", "lon"), "haversine").head()
    assert none["auc"] == 0 and none["post_coverage"] == 0 and np.isnan(none["median_max"])


def test_home_detection(spark):
    near = [(1, i, 10.0 + i * 0.01, 20.0) for i in range(5)] + [(1, 9, 50.0, 20.0)]
    far = [(2, i, 10.0 + i, 20.0) for i in range(6)]
    ring = [(3, i, 10 + 0.06 * np.cos(i * 2 * np.pi / 5), 20 + 0.06 * np.sin(i * 2 * np.pi / 5)) for i in range(5)]  # pairwise within 15 km, in no small disc
    df = spark.createDataFrame([(u, o, float(a), float(b)) for u, o, a, b in near + far + ring], "user_id bigint, ord bigint, lat double, lon double")
    assert set(located(evaluation.home_locations(df))) == {1, 3}


def test_cross_validation_never_sees_held_out_homes(spark):
    home = spark.createDataFrame([(u, float(u), float(u)) for u in range(1, 5)], LOC)
    gold = spark.createDataFrame([(u * 10, u, u % 2) for u in range(1, 5)], "post_id bigint, user_id bigint, fold int")
    seen = []
    out = evaluation.cross_validate(gold, home, gold.select("post_id", "user_id"), lambda h: (seen.append({r[0] for r in h.select("user_id").collect()}), h)[1], [0, 1])
    assert out.count() == 0 and seen == [{1, 3}, {2, 4}]


def test_whole_cross_validation_holds_out_every_fold(spark, monkeypatch):
    home = {u: (float(u), float(u)) for u in range(1, 11)}  # a chain of 13 users, the last three without a home
    gold = spark.createDataFrame([(u * 10, u, 0.0, 0.0) for u in range(1, 14)], "post_id bigint, user_id bigint, lat double, lon double")
    monkeypatch.setattr(reference_queries, "gold_posts", lambda s, d: gold)
    monkeypatch.setattr(reference_queries, "ties", lambda s, d: both_ways(spark, [(u, u + 1) for u in range(1, 13)]))
    monkeypatch.setattr(reference_queries, "homes", lambda s, d: spark.createDataFrame([(u, *p) for u, p in home.items()], LOC))
    got = {r["user_id"]: (r["fold"], r["post_id"], r["lat"], r["lon"]) for r in reference_queries.QUERIES["cross_validate_whole"](spark, "").collect()}
    assert got == {u: ((u - 1) % 5, u * 10, *home[min(u - 1, 10) or 2]) for u in range(1, 14)}


def test_medoid_of_a_hub_whose_neighbours_share_its_point(spark):
    crowd = spark.range(60_000).selectExpr("1L AS user_id", "id + 100 AS ord", "10.0D AS lat", "20.0D AS lon", "1.0D AS weight")
    rest = [(1, 7, 10.5, 20.0, 3.0), (1, 8, -40.0, 100.0, 1.0), (2, 5, 1.0, 1.0, 1.0), (2, 4, 1.0, 2.0, 1.0), (3, 6, 0.0, 0.0, 2.0)]
    began = time.time()
    got = {r["user_id"]: r for r in aggregates.medoids(crowd.unionByName(spark.createDataFrame(rest, POINTS)), "user_id").collect()}
    assert time.time() - began < 60  # one distance for each pair of members takes minutes
    far = geo.np_haversine_km(10.0, 20.0, [10.5, -40.0], [20.0, 100.0])
    assert (got[1]["ord"], got[1]["near"], got[1]["n"]) == (100, 60_001, 60_002) and got[1]["cost"] == pytest.approx(3 * far[0] + far[1], abs=1e-5)
    assert (got[2]["ord"], got[2]["near"], got[2]["n"]) == (4, 1, 2) and (got[3]["ord"], got[3]["cost"], got[3]["n"]) == (6, 0.0, 1)


@pytest.mark.parametrize("kind", ["haversine", "vincenty"])
def test_medoids_equal_all_pairs(kind):
    r, columns, want = np.random.default_rng(5), [], []
    for k in range(80):
        n = int(r.integers(1, 300 if k % 4 == 0 else 5))
        lat, lon = r.uniform(-85, 85, n), r.uniform(-180, 180, n)
        if k % 3 == 1:  # pairs at and beside antipodes
            half = n // 2
            lat[half : 2 * half], lon[half : 2 * half] = -lat[:half] + r.uniform(-0.3, 0.3, half), (lon[:half] + r.uniform(-0.3, 0.3, half)) % 360 - 180
        weight, order, members = r.integers(1, 5, n).astype(float), np.sort(r.permutation(3 * n)[:n]), r.integers(1, 4, n)
        d = geo.np_distance(kind)(lat[:, None], lon[:, None], lat, lon)
        cost = [round(float((weight * x).sum()), 6) for x in d]
        at = cost.index(min(cost))
        assert aggregates.np_medoid(lat, lon, weight, order, kind)[:2] == (at, cost[at])
        want.append((k, order[at], cost[at], members[d[at] <= 500].sum(), members.sum()))
        columns.append((np.full(n, k), order, lat, lon, weight, members))
    g = dict(zip(("key", "ord", "lat", "lon", "weight", "members"), map(np.concatenate, zip(*columns))))
    at, *rest = aggregates.np_medoids(g, "key", kind, 500.0)
    assert list(zip(g["key"][at], g["ord"][at], *rest)) == want


def test_medoid_on_the_ellipsoid_is_exact():
    lon, weight = np.array([5.4, 22.4, 22.5]), np.array([20.0, 34.0, 56.0])  # two members cost nearly the same
    assert aggregates.np_medoid(np.zeros(3), lon, weight, np.arange(3), "vincenty")[:2] == (2, 38449.75212)


def test_ellipsoidal_distance_of_a_pair_does_not_depend_on_the_others():
    r = np.random.default_rng(2)
    pairs = [np.append(r.uniform(-a, a, 50), last) for a, last in ((80, 10.0), (180, 20.0), (80, -10.1), (180, -160.2))]  # the last is beside antipodes
    assert geo.np_vincenty_km(*pairs).tolist() == [float(geo.np_vincenty_km(*p)) for p in zip(*pairs)]


def test_whole_methods_run_their_own_rounds(spark, monkeypatch):
    monkeypatch.setattr(reference_queries, "ties", lambda s, d: both_ways(spark, [(u, u + 1) for u in range(1, 8)]))
    monkeypatch.setattr(reference_queries, "homes", lambda s, d: spark.createDataFrame([(1, 10.0, 20.0)], LOC))
    for name, rounds in (("random_neighbor_whole", 4), ("total_variation_whole", 4), ("social_tightness_whole", 3), ("spatial_label_propagation_ellipsoid", 5)):
        assert located(reference_queries.QUERIES[name](spark, "")) == {u: (10.0, 20.0) for u in range(1, rounds + 2)}


def test_whole_influence_runs_until_it_converges(spark, monkeypatch, places):
    monkeypatch.setattr(reference_queries, "table", lambda s, d, name: spark.createDataFrame([], POSTS))
    monkeypatch.setattr(reference_queries, "places", lambda s, d: places)
    monkeypatch.setattr(reference_queries, "ties", lambda s, d: both_ways(spark, [(1, 3), (2, 3), (3, 4)]))
    monkeypatch.setattr(reference_queries, "homes", lambda s, d: spark.createDataFrame([(1, 10.0, 20.0), (2, 11.0, 21.0)], LOC))
    near = {1: [3], 2: [3], 3: [1, 2, 4], 4: [3]}
    at = {1: (10.0, 20.0), 2: (11.0, 21.0)} | {u: (u * 37 % 1400 / 10 - 70, u * 91 % 3400 / 10 - 170) for u in (3, 4)}
    for _ in range(5):
        s = {u: sum((at[v][0] - at[u][0]) ** 2 + (at[v][1] - at[u][1]) ** 2 for v in near[u]) / (2 * len(near[u])) for u in near}
        new = {u: tuple(sum((1 / s[u] + 1 / s[v]) * at[v][k] for v in near[u]) / sum(1 / s[u] + 1 / s[v] for v in near[u]) for k in (0, 1)) for u in (3, 4)}
        done = max(abs(new[u][k] - at[u][k]) for u in new for k in (0, 1)) <= 0.1
        at |= new
        if done:
            break
    got = located(reference_queries.QUERIES["influence_profiling_whole"](spark, ""))
    assert set(got) == set(at) and all(got[u] == pytest.approx(at[u], abs=1e-5) for u in at)


def test_all_pairs_equal_brute_force(spark):
    r = np.random.default_rng(8)
    at = [(u, float(r.uniform(-80, 80)), float(r.uniform(-170, 170))) for u in range(70)] + [(70, 1.0, 1.0), (71, 1.0, 1.0)]
    want = {}
    for a, b in itertools.permutations(at, 2):
        m = int(np.floor(geo.np_haversine_km(a[1], a[2], b[1], b[2]) * geo.MILES_PER_KM * 10 + 0.5))
        want[m] = want.get(m, 0) + 1
    assert {x["bin"]: x["pairs"] for x in methods.all_pair_distances(methods.paired_users(spark.createDataFrame(at, LOC))).collect()} == want
    assert methods.all_pair_distances(spark.createDataFrame([], LOC)).collect() == []


def test_tie_strength_keeps_the_ratio_of_ties_that_draws_miss(spark):
    r = np.random.default_rng(9)
    home = [(1, 60.0, 0.0), (2, -40.0, 50.0), (3, -40.0, 50.1), (4, -40.0, 100.0), (5, -40.0, 100.1)] + [(u, float(r.uniform(-30, 50)), float(r.uniform(-170, 170))) for u in range(6, 305)]
    edges = both_ways(spark, [(4, 5), (900, 1), (900, 2), (900, 3)])  # 2 and 3 are as far apart as the tied 4 and 5; ten draws a user meet neither pair
    assert located(methods.tie_strength(edges, edges, spark.createDataFrame(home, LOC), quantiles=1, min_leaf=1))[900] == (-40.0, 50.0)


def test_named_places_locate_users(spark, places, monkeypatch):
    posts = spark.createDataFrame([(i, i, str(u), "in Paris", None, None, None) for i, u in enumerate((2, 3, 9))] + [(0, 7, "2", "in Paris", None, None, None)], POSTS)
    edges, home = both_ways(spark, [(1, 2), (3, 4)]), spark.createDataFrame([(1, 10.0, 20.0)], LOC)
    monkeypatch.setattr(reference_queries, "ties", lambda s, d: edges)
    monkeypatch.setattr(reference_queries, "homes", lambda s, d: home)
    monkeypatch.setattr(reference_queries, "places", lambda s, d: places)
    monkeypatch.setattr(reference_queries, "table", lambda s, d, name: posts)
    inputs = methods.Inputs(spark, posts, edges, edges, home, places)
    for got in (located(methods.train("multi_location", inputs)), located(reference_queries.QUERIES["multi_location_whole"](spark, ""))):
        assert got == {1: (10.0, 20.0), 2: (10.0, 20.0), 3: (48.85, 2.35)}  # 4 names nothing, 9 is not in the network
    x, v = (2 * 37 % 1400 / 10 - 70, 2 * 91 % 3400 / 10 - 170), (48.85, 2.35)
    far = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) / 2
    w, wv = 2 / far(x, (10, 20)), 1 / ((far(x, v) + far((3 * 37 % 1400 / 10 - 70, 3 * 91 % 3400 / 10 - 170), v)) / 2)
    got = located(methods.train("influence_profiling", methods.Inputs(spark, posts, edges, edges, home, places, {"rounds": 1})))
    assert got[2] == pytest.approx([(w * h + wv * p) / (w + wv) for h, p in zip((10, 20), v)])


def test_following_coefficients_count_all_pairs(spark):
    home = spark.createDataFrame([(u, 0.0, x) for u, x in enumerate((0.0, 1.0, 3.0, 3.5))], LOC)  # of the pairs at a half, one, two degrees and more, those two are tied
    alpha, beta = methods.following_coefficients(both_ways(spark, [(0, 1), (1, 2)]), home)
    assert (alpha, beta) == pytest.approx(curves.fit_power_law([69, 138], [1, 1]))


def test_city_classifier_of_more_than_ten_thousand_cities(spark):
    where = {u: (0, 3, 20_000)[u % 3] for u in range(24)}
    cities = spark.createDataFrame([(u, c, float(c) / 1000, 1.0) for u, c in where.items()], "user_id bigint, city bigint, lat double, lon double")
    features = spark.createDataFrame([(u, 7 * c + u % 2, 1.0) for u, c in where.items()] + [(100 + i, 7 * c + k, 1.0) for i, c in enumerate((0, 3, 20_000)) for k in (0, 1)], "user_id bigint, feature bigint, value double")
    for at_once in (32, 2):
        assert located(methods.city_classifier(features, cities, at_once)) == {100 + i: (c / 1000, 1.0) for i, c in enumerate((0, 3, 20_000))}


def test_whole_vote_and_cities_take_true_locations(spark, places, monkeypatch):
    posts = spark.createDataFrame([(u, u, str(u), None, None, ([10.123, 20.456],), None) for u in (1, 2)], POSTS)
    paris, denis, few = range(1, 21), range(21, 41), range(41, 60)  # 19 are too few for a city
    home = [(u, 48.851, 2.351) for u in paris] + [(u, -20.881, 55.451) for u in denis] + [(u, 40.711, -74.001) for u in few]
    edges = both_ways(spark, [(u, u + 1) for us in (paris, denis) for u in us[:-1]] + [(900, u) for u in (1, 2, 3)])
    for name, got in {"ties": edges, "network": edges, "homes": spark.createDataFrame(home, LOC), "places": places}.items():
        monkeypatch.setattr(reference_queries, name, lambda s, d, got=got: got)
    monkeypatch.setattr(reference_queries, "table", lambda s, d, name: posts)
    voted = located(reference_queries.QUERIES["friend_vote_whole"](spark, ""))
    assert voted[1] == voted[2] == voted[900] == (10.123, 20.456)
    assert {r["feature"] // 7 for r in reference_queries.QUERIES["city_features_whole"](spark, "").collect()} == {0, 1}
    assert located(reference_queries.QUERIES["city_classifier"](spark, ""))[900] == (48.85, 2.35)
