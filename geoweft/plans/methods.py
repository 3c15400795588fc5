"""The location-inference methods. Each ends in one relation ``user_id, lat, lon``.

``edges`` is an undirected weighted graph stored in both directions (src, dst, weight); ``homes`` holds
one located row per user. Rounds are synchronous: a round reads only the estimates of the one before
and ends in the shared checkpoint folder. Ties go to the smallest neighbour id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.curves import city_bin, fit_power_law, power_law, rank_logistic, triad_bin
from ..functions.geo import MILES_PER_KM, haversine_km, np_haversine_km, round_half_up
from ..operators.aggregates import by_group, medoids, modes, quantile_bounds
from ..operators.datasets import global_index, infer_posts, top_per_key
from ..operators.deliveries import keep_first
from ..operators.gazetteer import TAB, canonicalize, geocode, geocode_noisy, names
from ..operators.graph import degree, neighbours, reciprocal, triangle_list, triangles
from ..operators.skew import skew_safe_join, skew_safe_left, skew_safe_semi
from ..operators.toponyms import toponyms
from ..session import cut
from ..sources import readers, writers


def constant_baseline(users: DataFrame, lat: float = -6.2, lon: float = 106.8) -> DataFrame:
    """The same point for every user."""
    return users.select("user_id").distinct().select("user_id", F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))


def _unlocated(edges: DataFrame, located: DataFrame) -> DataFrame:
    """The edges whose source has no home."""
    return skew_safe_semi(edges, located.select(F.col("user_id").alias("src")), "src", anti=True)


def _rounds(edges: DataFrame, home: DataFrame, rounds: int, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Homes stay; others take the newest estimate that a round gave them."""
    home = cut(home.select("user_id", "lat", "lon"))
    open_edges = cut(_unlocated(edges, home))
    found, known = None, home
    for i in range(rounds):
        new = step(neighbours(open_edges, known), i).select("user_id", "lat", "lon", F.lit(i).alias("round"))
        merged = new if found is None else found.unionByName(new)
        merged = merged.groupBy("user_id").agg(F.max_by(F.struct("lat", "lon", "round"), "round").alias("p"))
        found = cut(merged.select("user_id", "p.lat", "p.lon", "p.round"))
        known = home.unionByName(found.drop("round"))
    return known


def random_neighbor(edges: DataFrame, home: DataFrame, rounds: int = 4) -> DataFrame:
    """Unlocated users take over a located neighbour drawn by a hash of both ids and the round."""

    def step(near: DataFrame, i: int) -> DataFrame:
        draw = F.pmod(F.col("src") % 1000003 * 7919 + F.col("dst") % 1000003 * 104729 + F.lit(i * 15485863), F.lit(1000003))
        return near.groupBy("src").agg(F.min_by(F.struct("lat", "lon"), F.struct(draw, F.col("dst"))).alias("p")).select(F.col("src").alias("user_id"), "p.lat", "p.lon")

    return _rounds(edges, home, rounds, step)


def _group_points(near: DataFrame, weight: Column) -> DataFrame:
    return near.select(F.col("src").alias("user_id"), F.col("dst").alias("ord"), "lat", "lon", weight.alias("weight"))


def spatial_label_propagation(edges: DataFrame, home: DataFrame, rounds: int = 5, kind: str = "vincenty") -> DataFrame:
    """Unlocated users move to the medoid of their located neighbours."""
    return _rounds(edges, home, rounds, lambda near, i: medoids(_group_points(near, F.lit(1.0)), "user_id", kind=kind))


def total_variation(edges: DataFrame, home: DataFrame, rounds: int = 4, max_dispersion: float = 100.0, kind: str = "vincenty") -> DataFrame:
    """As label propagation with mention weights; no move where the neighbours' median distance from their medoid exceeds the limit."""

    def step(near: DataFrame, i: int) -> DataFrame:
        found = medoids(_group_points(near, F.col("weight")), "user_id", kind=kind, near_km=max_dispersion)
        return found.where("near > n div 2")  # the upper median is within the limit

    return _rounds(edges, home, rounds, step)


def gold_locations(posts: DataFrame, users: DataFrame, places: DataFrame, home: DataFrame | None = None, posts_to_use: int = 10, kind: str = "vincenty") -> DataFrame:
    """A location for each network user from the last posts: the first point, else the first city place, else the profile.

    A post place that the gazetteer does not know gives no location, and the profile is not asked either.
    """
    mine = posts.withColumn("user_id", F.col("user_id").try_cast("bigint")).where("user_id IS NOT NULL AND id IS NOT NULL").join(users.select("user_id").distinct(), "user_id", "left_semi")
    mine = mine.groupBy("user_id", "id").agg(F.min_by(F.struct("geo", "place", "location"), "delivery_id").alias("p")).select("user_id", "id", "p.*")
    last = top_per_key(mine, "user_id", [F.col("id").desc()], posts_to_use)
    has_point = F.size("geo.coordinates") == 2
    has_city = F.col("place.place_type") == "city"
    firsts = last.groupBy("user_id").agg(
        F.min_by(F.when(has_point, F.col("geo.coordinates")), F.when(has_point, F.col("id"))).alias("point"),
        F.min_by(F.when(has_city, F.concat_ws(TAB, F.lower("place.full_name"), F.lower("place.country"))), F.when(has_city, F.col("id"))).alias("place"),
        F.min_by("location", F.when(F.col("location").isNotNull(), F.col("id"))).alias("profile"),
    )
    firsts = cut(firsts)
    known = names(places)
    by_point = canonicalize(firsts.where("point IS NOT NULL").select("user_id", F.get("point", F.lit(0)).alias("lat"), F.get("point", F.lit(1)).alias("lon")), "user_id", places, kind)
    by_place = geocode(firsts.where("point IS NULL AND place IS NOT NULL"), "place", known).where("lat IS NOT NULL").select("user_id", "lat", "lon")
    rest = firsts.where("point IS NULL AND place IS NULL")
    by_profile = rest.join(home, "user_id").select("user_id", "lat", "lon") if home is not None else geocode_noisy(rest, "user_id", "profile", known)
    return by_point.unionByName(by_place).unionByName(by_profile)


def friend_vote(edges: DataFrame, gold: DataFrame, min_votes: int = 2, min_friends: int = 1, max_friends: int = 100_000) -> DataFrame:
    """Users without gold location take the most frequent location of their neighbours, if it has enough votes."""
    sizes = degree(edges).where(F.col("degree").between(min_friends, max_friends)).select(F.col("user_id").alias("src"))
    near = neighbours(_unlocated(edges, gold).join(sizes, "src", "left_semi"), gold).withColumnRenamed("src", "user_id")
    voted = modes(near, "user_id", ["lat", "lon"]).where(F.col("votes") >= min_votes).select("user_id", "lat", "lon")
    return gold.select("user_id", "lat", "lon").unionByName(voted)


def closeness(edges: DataFrame, root: bool = False) -> DataFrame:
    """(src, dst, closeness): common neighbours over the product of both degrees (or over its square root)."""
    edges = cut(edges.select("src", "dst"))
    d = degree(edges)
    both = skew_safe_join(cut(triangles(edges)), d.select(F.col("user_id").alias("src"), F.col("degree").alias("a")), "src")
    both = skew_safe_join(both, d.select(F.col("user_id").alias("dst"), F.col("degree").alias("b")), "dst")
    product = (F.col("a") * F.col("b")).cast("double")
    return both.select("src", "dst", (F.col("common") / (F.sqrt(product) if root else product)).alias("closeness"))


def located_ties(ties: DataFrame, located: DataFrame) -> DataFrame:
    """The ties with both ends located, and their distance in km."""
    a = located.select(F.col("user_id").alias("src"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = located.select(F.col("user_id").alias("dst"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return skew_safe_join(skew_safe_join(ties, a, "src"), b, "dst").withColumn("km", haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))).drop("alat", "alon", "blat", "blon")


def closeness_table(ties: DataFrame, located: DataFrame) -> DataFrame:
    """(d, s, p): share of the located ties at each whole-km distance and closeness rounded to hundredths."""
    binned = located_ties(ties, located).select(round_half_up(F.col("km")).cast("bigint").alias("d"), round_half_up(F.col("closeness"), 2).alias("s"))
    counts = cut(binned.groupBy("d", "s").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).head()[0] or 1
    return counts.select("d", "s", (F.col("n") / F.lit(float(total))).alias("p"))


def _best_neighbour(edges: DataFrame, located: DataFrame, scores: DataFrame) -> DataFrame:
    """Each unlocated user goes to the located neighbour of the highest score (user_id, score; 0 where none)."""
    known = located.join(scores, "user_id", "left").select("user_id", "lat", "lon", F.coalesce(F.round("score", 9), F.lit(0.0)).alias("score"))
    near = skew_safe_join(_unlocated(edges, located), known.withColumnRenamed("user_id", "dst"), "dst")
    best = near.groupBy("src").agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.col("score"), F.col("dst"))).alias("p"))
    return best.select(F.col("src").alias("user_id"), "p.lat", "p.lon")


def social_tightness(edges: DataFrame, home: DataFrame, rounds: int = 3, root: bool = False) -> DataFrame:
    """Unlocated users go to the neighbour whose own ties are likeliest for their distance and closeness.

    A neighbour's score depends on the neighbour alone, so it is summed once per located user, not once per pair.
    """
    ties, located = cut(closeness(edges, root)), cut(home.select("user_id", "lat", "lon"))
    for _ in range(rounds):
        table = closeness_table(ties, located)
        binned = located_ties(ties, located).select("src", round_half_up(F.col("km")).cast("bigint").alias("d"), round_half_up(F.col("closeness"), 2).alias("s"))
        scores = binned.join(table, ["d", "s"]).groupBy(F.col("src").alias("user_id")).agg(F.sum("p").alias("score"))
        located = cut(located.unionByName(_best_neighbour(edges, located, scores)))
    return located


def clustering(edges: DataFrame) -> DataFrame:
    """(user_id, c): three closed over three closed plus open triads of each user."""
    closed = triangles(edges).groupBy(F.col("src").alias("user_id")).agg((F.sum("common") / 2).alias("closed"))
    d = degree(edges).withColumn("pairs", F.col("degree") * (F.col("degree") - 1) / 2)
    c = F.when(F.col("pairs") > 0, 3 * F.col("closed") / (3 * F.col("closed") + F.col("pairs") - F.col("closed"))).otherwise(F.lit(0.0))
    return d.join(closed, "user_id").select("user_id", c.alias("c"))


def social_energy(edges: DataFrame, home: DataFrame, alpha: float = 0.0, beta1: float = -1.0, beta2: float = -1.0) -> DataFrame:
    """Energy of each located user's ties and their clustering, ranked among a user's candidates and combined by a logistic."""
    ties = cut(located_ties(closeness(edges, True), home).withColumn("s", round_half_up(F.col("closeness"), 1)))
    reach = ties.groupBy("s").agg(F.avg("km").alias("dr"))
    energy = ties.join(reach, "s").groupBy(F.col("src").alias("user_id")).agg(F.sum(-F.col("closeness") * F.exp(-F.col("km") / F.greatest("dr", F.lit(1e-6)))).alias("g"))
    known = home.join(energy, "user_id", "left").join(clustering(edges), "user_id", "left").select(F.col("user_id").alias("dst"), "lat", "lon", F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("c", F.lit(0.0)).alias("c"))
    near = skew_safe_join(_unlocated(edges, home), known, "dst")
    w = Window.partitionBy("src")
    ranked = near.withColumn("rg", F.rank().over(w.orderBy(F.round("g", 9)))).withColumn("rc", F.rank().over(w.orderBy(F.round(-F.col("c"), 9))))
    scored = ranked.withColumn("score", F.round(rank_logistic(F.col("rg"), F.col("rc"), alpha, beta1, beta2), 12))
    best = scored.groupBy("src").agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.col("score"), F.col("dst"))).alias("p"))
    return home.select("user_id", "lat", "lon").unionByName(best.select(F.col("src").alias("user_id"), "p.lat", "p.lon"))


def city_homes(home: DataFrame, places: DataFrame, least: int = 20, kind: str = "vincenty") -> DataFrame:
    """(user_id, city): homes moved to their settlement; only points that at least ``least`` users share. Cities are numbered by (lat, lon)."""
    moved = cut(canonicalize(home.select("user_id", "lat", "lon"), "user_id", places, kind))
    frequent = moved.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    cities = global_index(frequent.select("lat", "lon"), ["lat", "lon"], "city")
    return moved.join(cities, ["lat", "lon"]).select("user_id", "city", "lat", "lon")


def city_features(edges: DataFrame, directed: DataFrame, cities: DataFrame) -> DataFrame:
    """Long form (user_id, feature, value); seven features per city: size bin of friends there, reciprocal share, and shares of five triad bins."""
    where = cities.select(F.col("user_id").alias("dst"), "city")
    friends = cut(skew_safe_join(edges, where, "dst").select("src", "dst", "city"))
    back = reciprocal(directed).where("src <> dst").select("src", "dst").withColumn("both", F.lit(1))
    counts = friends.join(back, ["src", "dst"], "left").groupBy("src", "city").agg(F.count(F.lit(1)).alias("n"), F.count("both").alias("r"))
    ways = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(c).alias("third")) for a, b, c in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")])
    triads = triangle_list(edges).select(F.explode(ways).alias("t")).select("t.*").join(where, "dst")
    inner = triads.join(where.select(F.col("dst").alias("third"), "city"), ["third", "city"]).groupBy("src", "city", "dst").agg(F.count(F.lit(1)).alias("t"))
    bins = friends.join(inner, ["src", "city", "dst"], "left").select("src", "city", triad_bin(F.coalesce("t", F.lit(0))).alias("b"))
    shares = bins.groupBy("src", "city", "b").agg(F.count(F.lit(1)).alias("n")).join(degree(edges).select(F.col("user_id").alias("src"), "degree"), "src")
    base = F.col("city") * 7
    first = counts.select("src", F.explode(F.array(F.struct(base.alias("f"), city_bin(F.col("n")).cast("double").alias("v")), F.struct((base + 1).alias("f"), (F.col("r") / F.col("n")).alias("v")))).alias("x")).select("src", "x.f", "x.v")
    return first.unionByName(shares.select("src", (base + 2 + F.col("b")).alias("f"), (F.col("n") / F.col("degree")).alias("v"))).select(F.col("src").alias("user_id"), F.col("f").cast("bigint").alias("feature"), F.col("v").alias("value"))


def city_classifier(features: DataFrame, cities: DataFrame, at_once: int = 32) -> DataFrame:
    """Users without a city get the one a linear classifier (one against the rest) picks from their features; empty without enough classes.

    A user's features are at most seven per city of their friends. The classes are fitted in blocks of ``at_once``: the weights of one block are held
    at a time, and each user keeps the best class so far (of equal margins the first).
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.linalg import SparseVector, VectorUDT

    count = cities.agg(F.max("city")).head()[0]
    points = cities.groupBy("city").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    if not count:
        return cities.limit(0).select("user_id", "lat", "lon")
    size = 7 * (int(count) + 1)
    to_vector = F.udf(lambda pairs: SparseVector(size, sorted((int(f), float(v)) for f, v in pairs)), VectorUDT())
    rows = features.where("value <> 0").groupBy("user_id").agg(to_vector(F.collect_list(F.struct("feature", "value"))).alias("raw"))
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=False).fit(rows).transform(rows)
    train = cut(rows.join(cities.select("user_id", "city"), "user_id").select("features", "city"))
    classes = sorted(r[0] for r in train.select("city").distinct().collect())  # one number for each city
    if len(classes) < 2:
        return cities.limit(0).select("user_id", "lat", "lon")
    asked = cut(rows.join(cities.select("user_id"), "user_id", "left_anti").select("user_id", "features"))
    svc, best = LinearSVC(maxIter=20, tol=1e-2), None
    for start in range(0, len(classes), at_once):
        block = classes[start : start + at_once]
        fits = [svc.fit(train.select("features", (F.col("city") == c).cast("double").alias("label"))) for c in block]
        shared = rows.sparkSession.sparkContext.broadcast((block, np.array([m.coefficients.toArray() for m in fits]), np.array([m.intercept for m in fits])))

        def pick(v: SparseVector, shared=shared) -> tuple[float, int]:
            cities, weights, intercepts = shared.value
            margins = weights[:, v.indices] @ v.values + intercepts
            i = int(np.argmax(margins))
            return float(margins[i]), int(cities[i])

        scored = asked.select("user_id", F.udf(pick, "margin double, city bigint")("features").alias("b"))
        scored = scored if best is None else best.unionByName(scored)
        best = cut(scored.groupBy("user_id").agg(F.min_by("b", F.struct(-F.col("b.margin"), F.col("b.city"))).alias("b")))
        shared.destroy()
    return best.select("user_id", F.col("b.city").alias("city")).join(points, "city").select("user_id", "lat", "lon")


def random_pairs(located: DataFrame, draws: int) -> DataFrame:
    """``draws`` pairs for each located user (km), partners drawn by arithmetic on positions; never all pairs."""
    placed = cut(global_index(located.select("user_id", "lat", "lon"), ["user_id"]))
    n = placed.count()
    if n < 2:
        return placed.select(F.lit(0.0).alias("km")).limit(0)
    asked = placed.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    asked = asked.withColumn("other", F.pmod(F.col("index") * 7919 + F.col("k") * 104729 + 1, F.lit(n))).where("other <> index")
    partner = placed.select(F.col("index").alias("other"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return asked.join(partner, "other").select(haversine_km(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")).alias("km"))


def pair_distances(located: DataFrame, draws: int = 10) -> DataFrame:
    """(miles, pairs): how many drawn pairs lie at each tenth of a mile."""
    tenth = round_half_up(F.col("km") * MILES_PER_KM, 1)
    return random_pairs(located, draws).groupBy(tenth.alias("miles")).agg(F.count(F.lit(1)).alias("pairs"))


MOST_PAIRED = 50_000


def paired_users(located: DataFrame) -> DataFrame:
    """The located users between whom all pairs are counted: all of them, or ``MOST_PAIRED`` by a hash of the id where there are more."""
    return located.select("user_id", "lat", "lon").orderBy(F.xxhash64("user_id"), "user_id").limit(MOST_PAIRED)


def all_pair_distances(users: DataFrame, per_mile: int = 10) -> DataFrame:
    """(bin, pairs): ordered pairs of different users at each distance in miles times ``per_mile``, rounded. ``users`` is bounded by :func:`paired_users`; no pair is kept."""
    spark = users.sparkSession
    points = np.array([(r["lat"], r["lon"]) for r in users.collect()], dtype=float).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(points)
    tasks = min(len(points), 48) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, lon = shared.value.T
        for batch in batches:
            counts = np.zeros(0, dtype=np.int64)
            for b in batch.column(0).to_pylist():
                for i in range(b, len(lat), tasks):  # each user against those behind it
                    at = np.floor(np_haversine_km(lat[i], lon[i], lat[i + 1 :], lon[i + 1 :]) * MILES_PER_KM * per_mile + 0.5).astype(np.int64)
                    more = np.bincount(at, minlength=len(counts))
                    more[: len(counts)] += counts
                    counts = more
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(2 * counts[bins], pa.int64())], names=["bin", "pairs"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "bin bigint, pairs bigint").groupBy("bin").agg(F.sum("pairs").alias("pairs"))


def tie_features(directed: DataFrame, undirected_edges: DataFrame) -> DataFrame:
    """(src, dst, out_weight, in_weight, common) of each reciprocal tie."""
    ties = reciprocal(directed).where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("out_weight"), F.col("back").cast("double").alias("in_weight"))
    return ties.join(triangles(undirected_edges), ["src", "dst"], "left").withColumn("common", F.coalesce("common", F.lit(0)).cast("double"))


def tie_strength(directed: DataFrame, undirected_edges: DataFrame, home: DataFrame, quantiles: int = 10, min_leaf: int = 1000) -> DataFrame:
    """Unlocated users take the neighbour's location that makes their ties likeliest, tie strength told by a regression tree.

    The tree predicts a tie's distance from its mentions and common neighbours; in each quantile of the
    prediction, the share of ties against strangers at a distance is the likelihood of that distance.
    Ties and all ordered pairs are counted between the same users, so every tie that is counted has a share.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    ties = cut(tie_features(directed, undirected_edges))
    near = cut(located_ties(ties, home).withColumn("miles", F.col("km") * MILES_PER_KM).where("miles > 0"))
    if near.head() is None:
        return home.select("user_id", "lat", "lon")
    assemble = VectorAssembler(inputCols=["out_weight", "in_weight", "common"], outputCol="features")
    model = DecisionTreeRegressor(labelCol="miles", minInstancesPerNode=min_leaf, seed=7).fit(assemble.transform(near))
    predicted = cut(model.transform(assemble.transform(ties)).select("src", "dst", F.round("prediction", 9).alias("p")))
    seen = near.select("src", "dst", "miles").join(predicted, ["src", "dst"])
    bounds = [r["bound"] for r in quantile_bounds(seen, "p", quantiles).orderBy("j").collect()]
    part = F.lit(0)
    for b in bounds[1:]:
        part = part + F.when(F.col("p") >= b, 1).otherwise(0)
    paired = cut(paired_users(home))
    for end in ("src", "dst"):
        seen = seen.join(paired.select(F.col("user_id").alias(end)), end, "left_semi")
    tenth = round_half_up(F.col("miles") * 10).cast("bigint")
    act = {(r["j"], r["m"]): r["n"] for r in seen.groupBy(part.alias("j"), tenth.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}  # distances are tenths of miles up to half the globe: bounded
    strangers = {r["bin"]: r["pairs"] for r in all_pair_distances(paired).collect()}
    shared = ties.sparkSession.sparkContext.broadcast({k: float(np.log(v / strangers[k[1]])) for k, v in act.items() if strangers.get(k[1])})
    asked = neighbours(_unlocated(predicted.select("src", "dst", F.col("p").alias("weight")), home), home)
    asked = asked.withColumnRenamed("weight", "p").select(F.col("src").alias("user_id"), F.col("dst").alias("ord"), "lat", "lon", part.cast("bigint").alias("j"))

    def run(g: dict[str, np.ndarray]) -> tuple:
        table, n = shared.value, len(g["ord"])
        best, at = np.inf, 0
        for i in range(n):  # one candidate against all neighbours at a time: no pair is kept
            tenths = np.floor(np_haversine_km(g["lat"][i], g["lon"][i], g["lat"], g["lon"]) * MILES_PER_KM * 10 + 0.5).astype(int)
            total = -sum(table.get((j, m), 0.0) for j, m in zip(g["j"].tolist(), tenths.tolist()))
            total = round(total, 9) if total != 0 else 1e6
            if total < best:
                best, at = total, i
        return int(g["user_id"][0]), float(g["lat"][at]), float(g["lon"][at])

    found = by_group(asked, "user_id", ["ord"], "user_id bigint, lat double, lon double", run)
    return home.select("user_id", "lat", "lon").unionByName(found)


def following_coefficients(edges: DataFrame, home: DataFrame) -> tuple[float, float]:
    """(alpha, beta) of the power law: share of located pairs that follow each other, by whole miles up to 10,000; ties and all pairs of the same users."""
    users = cut(paired_users(home))
    miles = round_half_up(F.col("km") * MILES_PER_KM).cast("bigint").alias("m")
    ties = {r["m"]: r["n"] for r in located_ties(edges.select("src", "dst"), users).groupBy(miles).agg(F.count(F.lit(1)).alias("n")).where("m <= 10000").collect()}
    pairs = {r["bin"]: r["pairs"] for r in all_pair_distances(users, 1).where("bin <= 10000").collect()}
    xs = sorted(m for m in ties if m > 0 and pairs.get(m))
    return fit_power_law(xs, [ties[m] / pairs[m] for m in xs])


def venues(posts: DataFrame, places: DataFrame, last: int = 600) -> DataFrame:
    """(user_id, name, n): places that users name in their last posts."""
    mine = posts.withColumn("user_id", F.col("user_id").try_cast("bigint")).where("user_id IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL")
    recent = top_per_key(mine.select("user_id", "id", "delivery_id", "text"), "user_id", [F.col("id").desc(), F.col("delivery_id")], last)
    return toponyms(recent, ["user_id"], "text", names(places)).groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n"))


def multi_location(edges: DataFrame, home: DataFrame, alpha: float = -0.55, beta: float = 0.0045, named: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Unlocated users: the neighbour whose own ties are likeliest under the power law, and the best-known place they name, combined by medoid.

    Random choices of the model (random following, random naming) are left out: their selectors are 0 here. Without ``named`` only ties count. Only users of the graph are located.
    """
    p = power_law(F.col("km"), alpha, beta)
    odds = F.when((p > 0) & (p < 1), F.log(p / (1 - p))).otherwise(F.lit(0.0))
    scores = located_ties(edges.select("src", "dst"), home).groupBy(F.col("src").alias("user_id")).agg(F.sum(odds).alias("score"))
    found = _best_neighbour(edges, home, scores).withColumn("ord", F.lit(0).cast("bigint"))
    if named is not None and known is not None:
        psi = named.groupBy("name").agg(F.count(F.lit(1)).alias("psi"))
        best = named.join(psi, "name").join(known, "name").groupBy("user_id").agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.col("psi"), F.col("name"))).alias("p"))
        best = best.join(home, "user_id", "left_anti").join(edges.select(F.col("src").alias("user_id")), "user_id", "left_semi").select("user_id", "p.lat", "p.lon", F.lit(1).cast("bigint").alias("ord"))
        found = found.unionByName(best)
    picked = medoids(found.withColumn("weight", F.lit(1.0)), "user_id")
    return home.select("user_id", "lat", "lon").unionByName(picked.select("user_id", "lat", "lon"))


def influence_profiling(edges: DataFrame, home: DataFrame, rounds: int = 5, named: DataFrame | None = None, known: DataFrame | None = None, tolerance: float = 0.1) -> DataFrame:
    """Unlocated users move to the mean of neighbours and named places, weighted by how focused their influence is.

    Influence is a variance in squared degrees. Unlocated users start from points derived from their ids.
    """
    start = [((F.col("user_id") % 1000003 * 37) % 1400).cast("double") / 10 - 70, ((F.col("user_id") % 1000003 * 91) % 3400).cast("double") / 10 - 170]
    open_ = edges.select(F.col("src").alias("user_id")).distinct().join(home, "user_id", "left_anti").select("user_id", start[0].alias("lat"), start[1].alias("lon"))
    place = None
    if named is not None and known is not None:
        place = cut(named.join(home, "user_id", "left_anti").join(known, "name").select("user_id", "name", F.col("n").cast("double").alias("w"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon")))
    fixed = cut(home.select("user_id", "lat", "lon").withColumn("fixed", F.lit(True)))
    x = cut(fixed.unionByName(open_.withColumn("fixed", F.lit(False))))
    square = lambda a, b, c, d: (F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) + (F.col(b) - F.col(d)) * (F.col(b) - F.col(d))
    for _ in range(rounds):
        own = skew_safe_join(edges.select("src", "dst"), x.select(F.col("user_id").alias("src"), F.col("lat").alias("alat"), F.col("lon").alias("alon")), "src")
        tied = skew_safe_join(own, x.select(F.col("user_id").alias("dst"), F.col("lat").alias("blat"), F.col("lon").alias("blon")), "dst")
        sigma = cut(tied.groupBy("src").agg((F.sum(square("blat", "blon", "alat", "alon")) / (2 * F.count(F.lit(1)))).alias("sigma")).where("sigma > 0"))
        s = x.join(sigma.withColumnRenamed("src", "user_id"), "user_id", "left")
        friends = skew_safe_join(edges.select("src", "dst"), s.where("NOT fixed AND sigma IS NOT NULL").select(F.col("user_id").alias("src"), F.col("sigma").alias("su")), "src")
        friends = skew_safe_join(friends, s.where("sigma IS NOT NULL").select(F.col("user_id").alias("dst"), "lat", "lon", F.col("sigma").alias("sf")), "dst")
        parts = friends.select(F.col("src").alias("user_id"), (1 / F.col("su") + 1 / F.col("sf")).alias("w"), "lat", "lon")
        if place is not None:
            at = place.join(s.where("sigma IS NOT NULL").select("user_id", "lat", "lon"), "user_id")
            spread = at.groupBy("name").agg((F.sum(F.col("w") * square("lat", "lon", "vlat", "vlon")) / (2 * F.sum("w"))).alias("sv")).where("sv > 0")
            parts = parts.unionByName(at.join(spread, "name").select("user_id", (F.col("w") / F.col("sv")).alias("w"), F.col("vlat").alias("lat"), F.col("vlon").alias("lon")))
        moved = parts.groupBy("user_id").agg((F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("nlat"), (F.sum(F.col("w") * F.col("lon")) / F.sum("w")).alias("nlon"))
        after = cut(x.join(moved, "user_id", "left").select("user_id", F.coalesce("nlat", "lat").alias("lat"), F.coalesce("nlon", "lon").alias("lon"), "fixed", F.greatest(F.abs(F.col("nlat") - F.col("lat")), F.abs(F.col("nlon") - F.col("lon"))).alias("delta")))
        most = after.agg(F.max("delta")).head()[0]
        x = after.drop("delta")
        if most is None or most <= tolerance:
            break
    return x.select("user_id", "lat", "lon")


@dataclass(frozen=True)
class Inputs:
    """What the methods read: posts as delivered, mention rows, home rows, gazetteer rows."""

    spark: SparkSession
    posts: DataFrame
    edges: DataFrame
    directed: DataFrame
    home: DataFrame
    places: DataFrame
    settings: dict = field(default_factory=dict)


def texts(posts: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """What multi-location and influence profiling read of the posts (as delivered): the places that users name, and where these are."""
    once = keep_first(posts.select("id", "delivery_id", "user_id", "text").where("id IS NOT NULL"), "id", ["delivery_id"])
    return {"named": cut(venues(once, places)), "known": cut(names(places))}


METHODS: dict[str, Callable[[Inputs], DataFrame]] = {
    "constant_baseline": lambda x: constant_baseline(x.edges.select(F.col("src").alias("user_id")), **x.settings),
    "random_neighbor": lambda x: random_neighbor(x.edges, x.home, **x.settings),
    "spatial_label_propagation": lambda x: spatial_label_propagation(x.edges, x.home, **x.settings),
    "total_variation": lambda x: total_variation(x.edges, x.home, **x.settings),
    "friend_vote": lambda x: friend_vote(x.edges, gold_locations(x.posts, x.edges.select(F.col("src").alias("user_id")), x.places, x.home), **x.settings),
    "tie_strength": lambda x: tie_strength(x.directed, x.edges, x.home, **x.settings),
    "social_tightness": lambda x: social_tightness(x.edges, x.home, **x.settings),
    "social_energy": lambda x: social_energy(x.edges, x.home, **x.settings),
    "city_classifier": lambda x: city_classifier(city_features(x.edges, x.directed, c := cut(city_homes(x.home, x.places, **x.settings))), c),
    "multi_location": lambda x: multi_location(x.edges, x.home, **dict(zip(("alpha", "beta"), following_coefficients(x.edges, x.home))) | texts(x.posts, x.places) | x.settings),
    "influence_profiling": lambda x: influence_profiling(x.edges, x.home, **texts(x.posts, x.places) | x.settings),
}


def train(name: str, inputs: Inputs) -> DataFrame:
    """The method's relation user_id, lat, lon."""
    if name not in METHODS:
        raise KeyError(f"unknown method {name}; known are {', '.join(sorted(METHODS))}")
    return METHODS[name](inputs)


class Method:
    """A method as an object: fit, save, load, and infer by post or by user."""

    def __init__(self, name: str, settings: dict | str | None = None) -> None:
        """``settings``: the method's parameters, or the path of a JSON file that holds them."""
        if name not in METHODS:
            raise KeyError(f"unknown method {name}; known are {', '.join(sorted(METHODS))}")
        self.name, self.settings = name, readers.read_settings(settings) if isinstance(settings, str) else dict(settings or {})
        self.model: DataFrame | None = None

    def fit(self, inputs: Inputs) -> Method:
        self.model = cut(METHODS[self.name](replace(inputs, settings=inputs.settings | self.settings)))
        return self

    def save(self, path: str | None, force: bool = False) -> None:
        writers.write_model(self._fitted(), path, force)

    def load(self, spark: SparkSession, path: str) -> Method:
        self.model = readers.read_model(spark, path)
        return self

    def infer_posts(self, posts: DataFrame) -> DataFrame:
        """post_id, user_id, lat, lon of ``posts`` (post_id, user_id) whose author has a location."""
        return infer_posts(posts, self._fitted())

    def infer_users(self, records: DataFrame, key: str = "user_id") -> DataFrame:
        """``records`` with the array ``locations``, as long as ``posts``: the owner's point, or null, for each post."""
        point = self._fitted().select(F.col("user_id").alias(key), F.struct("lat", "lon").alias("__p"))
        return skew_safe_left(records, point, key).withColumn("locations", F.transform("posts", lambda p: F.col("__p"))).drop("__p")

    def _fitted(self) -> DataFrame:
        if self.model is None:
            raise ValueError(f"{self.name} has no model yet: fit or load one")
        return self.model
