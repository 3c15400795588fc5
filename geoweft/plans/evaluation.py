"""Scoring of predictions, validation of located posts, home detection, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_km, haversine_km, np_distance, valid_coord
from ..operators.aggregates import by_group, error_auc, error_cdf, medoids, upper_median
from ..operators.datasets import infer_posts
from ..operators.gazetteer import reverse_geocode
from ..operators.skew import salted_aggregate, skew_safe_semi
from ..session import cut


def prediction_errors(gold: DataFrame, predictions: DataFrame, kind: str = "vincenty") -> DataFrame:
    """(post_id, user_id, km, lat, lon) of gold posts with a prediction; of several predictions of a post one is read."""
    one = predictions.groupBy("post_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("post_id", F.col("p.lat").alias("plat"), F.col("p.lon").alias("plon"))
    joined = gold.join(one, "post_id")
    return joined.select("post_id", "user_id", distance_km(kind, F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")).alias("km"), F.col("plat").alias("lat"), F.col("plon").alias("lon"))


def coverage(gold: DataFrame, errors: DataFrame) -> DataFrame:
    """(post_coverage, user_coverage): shares of gold posts and users with a prediction; 0 where there is no gold."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    counted = gold.select("post_id", "user_id").join(errors.select("post_id", F.lit(1).alias("hit")), "post_id", "left")
    users = salted_aggregate(counted, "user_id", {"posts": ("count", None), "hits": ("count", "hit")})
    return users.agg(share(F.sum("hits"), F.sum("posts")).alias("post_coverage"), share(F.sum((F.col("hits") > 0).cast("int")), F.count(F.lit(1))).alias("user_coverage"))


def median_max_error(errors: DataFrame) -> DataFrame:
    """Upper median over users of their largest error; NaN without errors."""
    most = salted_aggregate(errors, "user_id", {"km": ("max", "km")})
    return upper_median(most, None, "km", "median_max").select(F.coalesce("median_max", F.lit(float("nan"))).alias("median_max"))


def median_median_error(errors: DataFrame) -> DataFrame:
    """Upper median over users of the upper median of their errors; NaN without errors."""
    middle = upper_median(errors, "user_id", "km", "km")
    return upper_median(middle, None, "km", "median_median").select(F.coalesce("median_median", F.lit(float("nan"))).alias("median_median"))


def error_sample(errors: DataFrame, size: int = 10_000) -> DataFrame:
    """At most ``size`` errors in an order drawn from the post id: a sample for plots."""
    draw = F.pmod(F.col("post_id") % 1000003 * 7919 + 104729, F.lit(1000003))
    return errors.orderBy(draw, "post_id").limit(size)


def score(gold: DataFrame, predictions: DataFrame, kind: str = "vincenty") -> DataFrame:
    """One row: auc, post_coverage, user_coverage, median_max."""
    errors = cut(prediction_errors(gold, predictions, kind))
    out = error_auc(error_cdf(errors, "km")).withColumn("k", F.lit(1))
    for part in (coverage(gold, errors), median_max_error(errors)):
        out = out.join(F.broadcast(part.withColumn("k", F.lit(1))), "k")  # one row each
    return out.drop("k")


def validate_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """(mean_km, median_km): great-circle distance between two sets of located posts with valid points, joined by post id."""
    b = right.select("post_id", F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    both = left.join(b, "post_id").where(valid_coord(F.col("lat"), F.col("lon")) & valid_coord(F.col("blat"), F.col("blon")))
    far = cut(both.select(haversine_km(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")).alias("km")))
    mean = far.agg(F.avg("km").alias("mean_km")).withColumn("k", F.lit(1))
    return mean.join(upper_median(far, None, "km", "median_km").withColumn("k", F.lit(1)), "k", "left").select("mean_km", "median_km")


def validate_names(left: DataFrame, right: DataFrame, places: DataFrame, level: str = "city", kind: str = "vincenty") -> DataFrame:
    """(compared, same, share) of posts whose two points lie at settlements with the same city, region or country."""
    columns = {"city": ["city", "region", "country"], "region": ["region", "country"], "country": ["country"]}[level]
    named = [reverse_geocode(t, "post_id", places, kind).select("post_id", F.concat_ws("\t", *columns).alias(n)) for t, n in ((left, "a"), (right, "b"))]
    both = named[0].join(named[1], "post_id")
    counts = both.agg(F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum((F.col("a") == F.col("b")).cast("bigint")), F.lit(0)).alias("same"))
    return counts.select("compared", "same", F.when(F.col("compared") > 0, F.col("same") / F.col("compared")).alias("share"))


def has_cluster(lat: np.ndarray, lon: np.ndarray, size: int, km: float, kind: str) -> bool:
    """Whether ``size`` points are pairwise within ``km``. Two tests by one point's distances decide nearly always; else cliques are grown."""
    distance, n = np_distance(kind), len(lat)
    if n < size:
        return False
    degrees = np.empty(n, dtype=int)
    for i in range(n):
        d = distance(lat[i], lon[i], lat, lon)
        if (d <= km / 2).sum() >= size:
            return True  # all of these are within km of each other
        degrees[i] = (d <= km).sum()
    left = np.flatnonzero(degrees >= size)  # others are in no cluster
    if len(left) < size:
        return False
    lat, lon = lat[left], lon[left]

    def grow(chosen: int, room: np.ndarray) -> bool:
        if chosen == size:
            return True
        while chosen + len(room) >= size:
            i, room = room[0], room[1:]
            if grow(chosen + 1, room[distance(lat[i], lon[i], lat[room], lon[room]) <= km]):
                return True
        return False

    return grow(0, np.arange(len(lat)))


def home_locations(points: DataFrame, kind: str = "vincenty", size: int = 5, km: float = 15.0) -> DataFrame:
    """(user_id, lat, lon): the medoid of all points of each user who has ``size`` points pairwise within ``km``.

    ``points``: user_id, ord (unique), lat, lon. One passing cell decides for users of many points: where ``size`` points share a cell
    of less than ``km`` across, they are a cluster, which is counted without bringing the user's points together.
    """
    cell = [F.floor(F.col(c) * 20) for c in ("lat", "lon")]  # cells of a twentieth of a degree: at most 7.9 km across
    sure = points.groupBy("user_id", *[c.alias(n) for c, n in zip(cell, ("x", "y"))]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).select("user_id").distinct()
    unsure = skew_safe_semi(points, sure, "user_id", anti=True)

    def run(g: dict[str, np.ndarray]) -> tuple | None:
        return (int(g["user_id"][0]),) if has_cluster(g["lat"], g["lon"], size, km, kind) else None

    found = sure.unionByName(by_group(unsure.select("user_id", "ord", "lat", "lon"), "user_id", ["ord"], "user_id bigint", run))
    settled = skew_safe_semi(points, found, "user_id").withColumn("weight", F.lit(1.0))
    return medoids(settled, "user_id", kind=kind).select("user_id", "lat", "lon")


def cross_validate(gold: DataFrame, home: DataFrame, posts: DataFrame, method: Callable[[DataFrame], DataFrame], folds: list[int]) -> DataFrame:
    """(fold, post_id, user_id, lat, lon): for each fold the method is trained without its users' homes and asked for their posts.

    ``gold`` holds post_id, user_id and fold; ``posts`` post_id and user_id. Hold-out is by user.
    """
    out = None
    for fold in folds:
        held = gold.where(F.col("fold") == fold).select("user_id").distinct()
        model = method(home.join(held, "user_id", "left_anti"))
        asked = skew_safe_semi(posts, held, "user_id").dropDuplicates(["post_id"])
        part = infer_posts(asked, model).select(F.lit(fold).alias("fold"), "post_id", "user_id", "lat", "lon")
        out = part if out is None else out.unionByName(part)
    return out
