"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, geo, text
from ..operators import aggregates, datasets, gazetteer, graph, toponyms
from ..operators.deliveries import keep_first
from ..session import cut, scratch, table
from ..sources import readers, writers
from . import evaluation, methods
from .training_queries import _POINTS, post_point

ROUNDS = 3
FOLDS = 5


# Inputs


def first_posts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first delivery of each post."""
    return keep_first(table(spark, d, "posts").select("id", "delivery_id", *columns), "id", ["delivery_id"])


def gold_posts(spark: SparkSession, d: str) -> DataFrame:
    """post_id, user_id, lat, lon of the posts with a valid point and an author."""
    lat, lon = post_point()
    rows = first_posts(spark, d, "user_id", "geo", "coordinates").select(F.col("id").alias("post_id"), F.col("user_id").try_cast("bigint").alias("user_id"), lat.alias("lat"), lon.alias("lon"))
    return rows.where("lat IS NOT NULL AND user_id IS NOT NULL")


def network(spark: SparkSession, d: str) -> DataFrame:
    """Directed weighted mentions; repeated rows count once."""
    rows = table(spark, d, "mention_network").distinct().withColumnRenamed("user_id", "src")
    return graph.weighted_edges(rows, F.col("weight"))


def ties(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(network(spark, d))


def homes(spark: SparkSession, d: str) -> DataFrame:
    return datasets.homes(table(spark, d, "home_locations"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.standard(table(spark, d, "gazetteer"))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    """Users of fold 0: every fifth user with a located post, by id."""
    return datasets.assign_folds(gold_posts(spark, d).select("user_id").distinct(), FOLDS).where("fold = 0").select("user_id")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return datasets.infer_posts(gold_posts(spark, d), homes(spark, d)).select("post_id", "lat", "lon")


def errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.prediction_errors(gold_posts(spark, d), predictions(spark, d), "haversine")


# Graphs


def extract_mentions(spark, d):
    rows = table(spark, d, "posts").select("delivery_id", F.explode("mentions").alias("mentioned"))
    return rows.where("mentioned IS NOT NULL")


def _mentions(spark, d):
    return graph.mentions(first_posts(spark, d, "user_id", "mentions"), "user_id", F.col("mentions"))


def mention_edges(spark, d):
    return graph.distinct_edges(_mentions(spark, d))


def mention_edges_weighted(spark, d):
    return graph.weighted_edges(_mentions(spark, d))


def bi_mention_edges(spark, d):
    return graph.reciprocal(network(spark, d)).where("dst < src").select("src", "dst")


def bi_mention_directed_weighted(spark, d):
    return graph.reciprocal(network(spark, d)).select("src", "dst", "weight")


def bi_mention_weighted(spark, d):
    return ties(spark, d).where("dst < src")


def degree(spark, d):
    return graph.degree(ties(spark, d))


def social_triangles(spark, d):
    return graph.triangles(ties(spark, d))


def users_in_network(spark, d):
    users = table(spark, d, "users").select("record_id", F.col("user_id").try_cast("bigint").alias("user_id"))
    return graph.in_network(users, "user_id", ties(spark, d)).select("record_id", "user_id")


def clustering_coefficient(spark, d):
    return methods.clustering(ties(spark, d)).select("user_id", F.round("c", 6).alias("c"))


# Data sets


def posts_to_users(spark, d):
    records = datasets.user_records(first_posts(spark, d, "user_id", "text"), "user_id", "id", ["text"], per_record=1000)
    return records.select("user_id", "part", F.size("posts").cast("bigint").alias("posts"), F.get("posts", F.lit(0))["id"].alias("first_id"), F.element_at("posts", -1)["id"].alias("last_id"), F.aggregate("posts", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(F.length(p["text"]), F.lit(0))).alias("characters"))


def last_n_posts(spark, d):
    rows = first_posts(spark, d, "user_id").where("user_id IS NOT NULL").select("user_id", "id")
    return datasets.top_per_key(rows, "user_id", [F.col("id").desc()], 10)


def sparsify_posts(spark, d):
    sparse = datasets.sparse_posts(first_posts(spark, d, "user_id", "text", "location", "geo", "mentions", "hashtags", "retweeted_status", "place"))
    return sparse.select("user_id", "post_id", F.length("text").alias("text_length"), F.length("location").alias("location_length"), "mentions", "hashtags", "is_retweet", (F.col("point") != "").alias("has_point"), (F.col("place") != "").alias("has_place"))


def create_folds(spark, d):
    return datasets.assign_folds(gold_posts(spark, d), FOLDS).select("post_id", "user_id", "fold")


def mask_holdout(spark, d):
    posts = first_posts(spark, d, "user_id", "geo", "place", "text").withColumn("user_id", F.col("user_id").try_cast("bigint"))
    masked = datasets.mask_holdout(posts, "user_id", held_out(spark, d))
    return masked.select("id", F.col("geo").isNotNull().alias("has_geo"), F.col("place").isNotNull().alias("has_place"), F.col("text").isNotNull().alias("has_text"), "held_out")


def infer_by_post(spark, d):
    posts = first_posts(spark, d, "user_id").select(F.col("id").alias("post_id"), F.col("user_id").try_cast("bigint").alias("user_id"))
    return datasets.infer_posts(posts, homes(spark, d))


def infer_by_user(spark, d):
    records = table(spark, d, "users").select("record_id", F.col("user_id").try_cast("bigint").alias("user_id"), F.explode("posts.id").alias("post_id"))
    found = datasets.infer_posts(records.where("post_id IS NOT NULL").select("post_id", "user_id").distinct(), homes(spark, d))
    return found.select("user_id", "post_id", "lat", "lon")


# Scalars


def haversine_pairs(spark, d):
    a = gold_posts(spark, d)
    h = homes(spark, d).select("user_id", F.col("lat").alias("hlat"), F.col("lon").alias("hlon"))
    pairs = datasets.skew_safe_join(a, h, "user_id")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon"))
    return pairs.select("post_id", F.round(km, 6).alias("km"), F.round(km * geo.MILES_PER_KM, 6).alias("miles"))


def vincenty_pairs(spark, d):
    a = gold_posts(spark, d)
    h = homes(spark, d).select("user_id", F.col("lat").alias("hlat"), F.col("lon").alias("hlon"))
    pairs = datasets.skew_safe_join(a, h, "user_id")
    return pairs.select("post_id", F.round(geo.vincenty_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon")), 6).alias("km"))


def known_distance(spark, d):
    a = datasets.skew_safe_left(gold_posts(spark, d), homes(spark, d).select("user_id", F.col("lat").alias("hlat"), F.col("lon").alias("hlon")), "user_id")
    km = geo.known_distance(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon")))
    return a.select("post_id", F.round(km, 6).alias("km"))


def _raw_points(spark, d):
    p = F.col("geo.coordinates")
    return table(spark, d, "posts").where(F.size(p) >= 2).select("delivery_id", p[0].alias("lat"), p[1].alias("lon"))


def valid_coord(spark, d):
    return _raw_points(spark, d).select("delivery_id", geo.valid_coord(F.col("lat"), F.col("lon")).alias("valid"))


def wrap_coord(spark, d):
    p = _raw_points(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL")
    return p.select("delivery_id", F.round(geo.wrap_lat(F.col("lat")), 6).alias("lat"), F.round(geo.wrap_lon(F.col("lon")), 6).alias("lon"))


def round_half_up(spark, d):
    p = _raw_points(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL")
    return p.select("delivery_id", geo.round_half_up(F.col("lat"), 2).alias("lat"), geo.round_half_up(F.col("lon")).alias("lon"))


def bins(spark, d):
    return graph.degree(network(spark, d)).select("user_id", curves.triad_bin(F.col("degree")).alias("triad"), curves.city_bin(F.col("degree")).alias("city"), curves.quantile_of(F.col("degree"), (2, 3, 5, 8, 13)).alias("quantile"))


def curve_form(spark, d):
    km = F.col("weight").cast("double")
    e = network(spark, d)
    return e.select("src", "dst", F.round(curves.decay_curve(km, 0.5, 2.0, 1.1), 9).alias("decay"), F.round(curves.power_law(km, -0.55, 0.0045), 9).alias("power"), F.round(curves.rank_logistic(km, km, 0.5, -0.2, -0.1), 9).alias("logistic"))


def parsed_coordinates(spark, d):
    """Points written out in two notations (decimals; degrees, minutes and seconds) and read again."""
    part = lambda v, neg, pos: F.concat_ws(" ", F.format_string("%d°%d'%d\"", F.floor(F.abs(v)), F.floor(F.abs(v) * 60) % 60, F.floor(F.abs(v) * 3600) % 60), F.when(v < 0, neg).otherwise(pos))
    lat, lon = F.col("lat"), F.col("lon")
    decimals = F.concat(F.format_string("%.6f", lat), F.lit(", "), F.format_string("%.6f", lon))
    written = F.when(F.col("post_id") % 2 == 0, decimals).otherwise(F.concat_ws(", ", part(lat, "S", "N"), part(lon, "W", "E")))
    rows = gold_posts(spark, d).select("post_id", geo.parse_coordinates(written).alias("p"))
    return rows.select("post_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


# Aggregates


def _user_points(spark, d):
    return gold_posts(spark, d).select("user_id", F.col("post_id").alias("ord"), "lat", "lon", F.lit(1.0).alias("weight"))


def geometric_median(spark, d):
    return aggregates.medoids(_user_points(spark, d), "user_id").select("user_id", F.col("ord").alias("post_id"), "lat", "lon", F.round("cost", 3).alias("cost"), "n")


def weighted_median_dispersion(spark, d):
    near = graph.neighbours(ties(spark, d), homes(spark, d))
    points = near.select(F.col("src").alias("user_id"), F.col("dst").alias("ord"), "lat", "lon", "weight")
    return aggregates.medoids(points, "user_id", near_km=500.0).select("user_id", F.col("ord").alias("neighbour"), "lat", "lon", (F.col("near") > F.floor(F.col("n") / 2)).alias("kept"))


def upper_median(spark, d):
    return aggregates.upper_median(errors(spark, d).select("user_id", F.round("km", 6).alias("km")), "user_id", "km", "median_km")


def mode_location(spark, d):
    rows = gold_posts(spark, d).select("user_id", geo.round_half_up(F.col("lat"), 1).alias("lat"), geo.round_half_up(F.col("lon"), 1).alias("lon"))
    return aggregates.modes(rows, "user_id", ["lat", "lon"])


def centroid(spark, d):
    rounded = [(F.round(F.col(c) * 10000) / 10000).alias(c) for c in ("lat", "lon")]  # as SQL rounds a double
    return aggregates.centroids(gold_posts(spark, d), "user_id", 3).select("user_id", *rounded, "n")


def pair_distance_hist(spark, d):
    return methods.pair_distances(homes(spark, d), 10)


def closeness_distance_table(spark, d):
    t = methods.closeness_table(methods.closeness(ties(spark, d)), homes(spark, d))
    return t.select("d", "s", F.round("p", 9).alias("p"))


def error_cdf(spark, d):
    return aggregates.error_cdf(errors(spark, d), "km").select("km", "count", F.round("cdf", 9).alias("cdf"))


def error_auc(spark, d):
    return aggregates.error_auc(aggregates.error_cdf(errors(spark, d), "km")).select(F.round("auc", 6).alias("auc"))


def quantile_bounds(spark, d):
    return aggregates.quantile_bounds(errors(spark, d).select(F.round("km", 6).alias("km")), "km", 10)


# Gazetteer


def gazetteer_names(spark, d):
    return gazetteer.names(places(spark, d))


def unambiguous_cities(spark, d):
    return gazetteer.unambiguous(places(spark, d)).select("city", "lat", "lon")


def geocode_exact(spark, d):
    posts = first_posts(spark, d, "location").where("location IS NOT NULL")
    return gazetteer.geocode(posts, "location", gazetteer.names(places(spark, d))).where("lat IS NOT NULL").select("id", "lat", "lon")


def geocode_noisy(spark, d):
    codes = {r["abbreviation"]: r["name"] for r in table(spark, d, "region_codes").where("abbreviation IS NOT NULL AND name IS NOT NULL").collect()}
    return gazetteer.geocode_noisy(first_posts(spark, d, "location"), "id", "location", gazetteer.names(places(spark, d)), codes)


def reverse_geocode(spark, d):
    return gazetteer.reverse_geocode(gold_posts(spark, d), "post_id", places(spark, d), "haversine").select("post_id", F.col("seq").alias("place_id"))


def canonicalize(spark, d):
    return gazetteer.canonicalize(gold_posts(spark, d), "post_id", places(spark, d), "haversine")


# Methods


def constant_baseline(spark, d):
    return methods.constant_baseline(ties(spark, d).select(F.col("src").alias("user_id")))


def random_neighbor(spark, d):
    return methods.random_neighbor(ties(spark, d), homes(spark, d), 2)


def spatial_label_propagation(spark, d):
    return methods.spatial_label_propagation(cut(ties(spark, d)), homes(spark, d), ROUNDS, "haversine")


def spatial_label_propagation_ellipsoid(spark, d):
    return methods.spatial_label_propagation(cut(ties(spark, d)), homes(spark, d))


def total_variation(spark, d):
    return methods.total_variation(cut(ties(spark, d)), homes(spark, d), 2, 2000.0, "haversine")


def random_neighbor_whole(spark, d):
    return methods.random_neighbor(cut(ties(spark, d)), homes(spark, d))


def total_variation_whole(spark, d):
    return methods.total_variation(cut(ties(spark, d)), homes(spark, d), kind="haversine")


def gold_locations(spark, d):
    return methods.gold_locations(table(spark, d, "posts"), ties(spark, d).select(F.col("src").alias("user_id")), places(spark, d), homes(spark, d), kind="haversine")


def friend_vote(spark, d):
    rounded = homes(spark, d).select("user_id", geo.round_half_up(F.col("lat") / 10).alias("lat"), geo.round_half_up(F.col("lon") / 10).alias("lon"))
    return methods.friend_vote(ties(spark, d), rounded)


def friend_vote_whole(spark, d):
    return methods.friend_vote(cut(ties(spark, d)), cut(gold_locations(spark, d)))


def social_tightness(spark, d):
    return methods.social_tightness(cut(ties(spark, d)), homes(spark, d), 1)


def social_tightness_whole(spark, d):
    return methods.social_tightness(cut(ties(spark, d)), homes(spark, d))


def social_energy(spark, d):
    return methods.social_energy(cut(ties(spark, d)), homes(spark, d))


def _cities(spark, d):
    rough = homes(spark, d).select("user_id", (geo.round_half_up(F.col("lat") / 20) * 20).alias("lat"), (geo.round_half_up(F.col("lon") / 20) * 20).alias("lon"))
    return methods.city_homes(rough, places(spark, d), 3, "haversine")


def city_features(spark, d):
    f = methods.city_features(cut(ties(spark, d)), network(spark, d), cut(_cities(spark, d)))
    return f.select("user_id", "feature", F.round("value", 6).alias("value"))


def _whole_cities(spark, d):
    return methods.city_homes(homes(spark, d), places(spark, d))


def city_features_whole(spark, d):
    f = methods.city_features(cut(ties(spark, d)), network(spark, d), cut(_whole_cities(spark, d)))
    return f.select("user_id", "feature", F.round("value", 6).alias("value"))


def city_classifier(spark, d):
    cities = cut(_whole_cities(spark, d))
    return methods.city_classifier(cut(methods.city_features(cut(ties(spark, d)), network(spark, d), cities)), cities)


def tie_strength(spark, d):
    return methods.tie_strength(cut(network(spark, d)), cut(ties(spark, d)), cut(homes(spark, d)), min_leaf=5)


def multi_location(spark, d):
    return methods.multi_location(cut(ties(spark, d)), homes(spark, d))


def influence_profiling(spark, d):
    out = methods.influence_profiling(cut(ties(spark, d)), homes(spark, d), 1)
    return out.select("user_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def multi_location_whole(spark, d):
    edges, home = cut(ties(spark, d)), cut(homes(spark, d))
    return methods.multi_location(edges, home, *methods.following_coefficients(edges, home), **methods.texts(table(spark, d, "posts"), places(spark, d)))


def influence_profiling_whole(spark, d):
    out = methods.influence_profiling(cut(ties(spark, d)), homes(spark, d), **methods.texts(table(spark, d, "posts"), places(spark, d)))
    return out.select("user_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# Texts


def toponym_scan(spark, d):
    return toponyms.toponyms(first_posts(spark, d, "text"), ["id"], "text", gazetteer.names(places(spark, d))).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def toponym_ngrams(spark, d):
    found = toponyms.toponym_ngrams(first_posts(spark, d, "text"), ["id"], "text", gazetteer.names(places(spark, d)))
    return found.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def tokenize(spark, d):
    return first_posts(spark, d, "text").select("id", F.size(text.tokenize(F.col("text"))).alias("tokens"))


def squash_text(spark, d):
    return first_posts(spark, d, "text").where("text IS NOT NULL").select("id", F.md5(text.squash(text.unescape(F.col("text")))).alias("digest"))


# Evaluation


def prediction_errors(spark, d):
    return errors(spark, d).select("post_id", "user_id", F.round("km", 6).alias("km"))


def coverage(spark, d):
    return evaluation.coverage(gold_posts(spark, d), errors(spark, d)).select(F.round("post_coverage", 9).alias("post_coverage"), F.round("user_coverage", 9).alias("user_coverage"))


def median_max_error(spark, d):
    return evaluation.median_max_error(errors(spark, d)).select(F.round("median_max", 6).alias("median_max"))


def median_median_error(spark, d):
    return evaluation.median_median_error(errors(spark, d)).select(F.round("median_median", 6).alias("median_median"))


def error_sample(spark, d):
    return evaluation.error_sample(errors(spark, d)).select("post_id", F.round("km", 6).alias("km"))


def score_report(spark, d):
    s = evaluation.score(gold_posts(spark, d), predictions(spark, d), "haversine")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def validate_dist(spark, d):
    v = evaluation.validate_distance(gold_posts(spark, d), predictions(spark, d))
    return v.select(F.round("mean_km", 6).alias("mean_km"), F.round("median_km", 6).alias("median_km"))


def validate_name(spark, d):
    v = evaluation.validate_names(gold_posts(spark, d), predictions(spark, d), places(spark, d), "city", "haversine")
    return v.select("compared", "same", F.round("share", 6).alias("share"))


def cross_validate(spark, d):
    gold = cut(datasets.assign_folds(gold_posts(spark, d), FOLDS))
    edges, home = cut(ties(spark, d)), cut(homes(spark, d))
    method = lambda h: methods.spatial_label_propagation(edges, h, 1, "haversine")
    return evaluation.cross_validate(gold, home, gold.select("post_id", "user_id"), method, [0, 1])


def cross_validate_whole(spark, d):
    """All folds, the method with its own rounds."""
    gold = cut(datasets.assign_folds(cut(gold_posts(spark, d)), FOLDS))
    edges, home = cut(ties(spark, d)), cut(homes(spark, d))
    return evaluation.cross_validate(gold, home, gold.select("post_id", "user_id"), lambda h: methods.spatial_label_propagation(edges, h, kind="haversine"), list(range(FOLDS)))


def home_locations(spark, d):
    return evaluation.home_locations(_user_points(spark, d).drop("weight"), "haversine")


# Files, written and read again


def stored_users(spark, d):
    """User records as JSON lines of the users in the network, read again and flattened to posts."""
    path, users = scratch(spark), table(spark, d, "users").select(F.col("user_id").try_cast("bigint").alias("key"), "user_id", "posts")
    writers.write_network_users(users.where("key IS NOT NULL"), "key", ties(spark, d), path)
    return datasets.flatten_records(readers.read_users(spark, path), "user_id").select("user_id", "id", F.md5("text").alias("digest"))


def stored_sparse_users(spark, d):
    path = scratch(spark)
    sparse = datasets.sparse_posts(first_posts(spark, d, "user_id", "text", "location", "geo", "mentions", "hashtags", "retweeted_status", "place")).where("user_id IS NOT NULL")
    writers.write_sparse_users(datasets.user_records(sparse, "user_id", "post_id", [c for c in sparse.columns if c != "user_id"]), path)
    return readers.read_sparse_users(spark, path).select("user_id", "id", F.md5("text").alias("text"), F.md5("location").alias("location"), "lat", "lon", F.array_join(F.col("mentions").cast("array<string>"), " ").alias("mentions"), "is_retweet", F.col("place").isNotNull().alias("has_place"))


def stored_edges(spark, d):
    path = scratch(spark)
    writers.write_edges(network(spark, d), path, weighted=True)
    return readers.read_edges(spark, path, weighted=True)


def stored_model(spark, d):
    path = f"{scratch(spark)}.tsv.gz"
    writers.write_model(homes(spark, d), path)
    return readers.read_model(spark, path)


def stored_homes(spark, d):
    """Homes as lines, read again without the users of fold 0."""
    path = f"{scratch(spark)}.tsv.gz"
    writers.write_model(homes(spark, d), path)
    return readers.read_homes(spark, path, held_out(spark, d))


def stored_folds(spark, d):
    """Fold files by their manifest; each post once, with the numbers of its fold's posts and users from the id files."""
    folder = scratch(spark)
    records = table(spark, d, "users").select(F.col("user_id").try_cast("bigint").alias("user_id"), "posts").where("user_id IS NOT NULL")
    writers.write_fold_files(datasets.assign_folds(gold_posts(spark, d), FOLDS), records, "user_id", folder)
    sizes = None
    for fold in range(FOLDS):
        n = [readers.read_held_out(spark, folder, fold, what).agg(F.count(F.lit(1)).alias(f"{what}s")).withColumn("fold", F.lit(fold)) for what in ("post", "user")]
        both = n[0].join(n[1], "fold")
        sizes = both if sizes is None else sizes.unionByName(both)
    return readers.read_fold_files(spark, folder).join(F.broadcast(sizes), "fold").select("post_id", "user_id", "lat", "lon", "fold", "posts", "users")  # sizes: one row a fold


def stored_predictions(spark, d):
    """Predictions of each fold as result files, read again; the file of fold 5 does not exist."""
    folder = scratch(spark)
    folds = datasets.assign_folds(gold_posts(spark, d), FOLDS).select("post_id", "fold")
    rows = predictions(spark, d).join(folds, "post_id")
    writers.write_fold_predictions(rows, folder, list(range(FOLDS)))
    return readers.read_fold_predictions(spark, folder, [*range(FOLDS), FOLDS]).select("fold", "post_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def stored_gazetteer(spark, d):
    """The gazetteer in a format with quoted cells, read again and turned into names."""
    path = scratch(spark)
    rows = table(spark, d, "gazetteer").where("city IS NOT NULL").select("lat", "lon", "country", "region", F.concat("city", F.lit(", town")).alias("city"))
    rows.write.csv(path, quoteAll=True)
    back = readers.read_gazetteer(spark, path, "geolite")
    return back.groupBy("city", "region", "country").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("lat"), 6).alias("lat"), F.round(F.min("lon"), 6).alias("lon"))


_NAMES = """
stored_users stored_sparse_users stored_edges stored_model stored_homes stored_folds stored_predictions stored_gazetteer
extract_mentions mention_edges mention_edges_weighted bi_mention_edges bi_mention_directed_weighted bi_mention_weighted degree
social_triangles users_in_network clustering_coefficient posts_to_users last_n_posts sparsify_posts create_folds mask_holdout
infer_by_post infer_by_user haversine_pairs vincenty_pairs known_distance valid_coord wrap_coord round_half_up bins curve_form
parsed_coordinates geometric_median weighted_median_dispersion upper_median mode_location centroid pair_distance_hist
closeness_distance_table error_cdf error_auc quantile_bounds gazetteer_names unambiguous_cities geocode_exact geocode_noisy
reverse_geocode canonicalize constant_baseline random_neighbor random_neighbor_whole spatial_label_propagation spatial_label_propagation_ellipsoid
total_variation total_variation_whole gold_locations friend_vote friend_vote_whole social_tightness social_tightness_whole social_energy city_features city_features_whole city_classifier tie_strength multi_location multi_location_whole
influence_profiling influence_profiling_whole toponym_scan toponym_ngrams tokenize squash_text prediction_errors coverage median_max_error
median_median_error error_sample score_report validate_dist validate_name cross_validate cross_validate_whole home_locations
""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# SQL

_FIRST = "p AS (SELECT * FROM posts WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery_id) = 1)"
_POINTS_FIRST = _POINTS.replace("FROM posts WHERE id IS NOT NULL", "FROM p")
_GOLD = f"{_FIRST}, {_POINTS_FIRST}, gold AS (SELECT p.id AS post_id, TRY_CAST(p.user_id AS BIGINT) AS user_id, q.lat, q.lon FROM p JOIN points q ON p.id = q.id WHERE TRY_CAST(p.user_id AS BIGINT) IS NOT NULL)"
_NET = "e AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT DISTINCT batch, user_id AS src, dst, weight FROM mention_network) WHERE src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL GROUP BY src, dst)"
_RECIP = f"{_NET}, rec AS (SELECT a.src, a.dst, a.weight, b.weight AS back FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src), r AS (SELECT src, dst, least(weight, back) AS weight FROM rec WHERE src <> dst)"
_HOME = "h AS (SELECT user_id, lat, lon FROM home_locations WHERE user_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lat, lon) = 1)"
_GAZ = "gaz AS (SELECT place_id AS seq, lower(trim(city)) AS city, lower(trim(region)) AS region, lower(trim(country)) AS country, lat, lon FROM gazetteer WHERE city IS NOT NULL AND trim(city) <> '' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"
_KEYS = f"""{_GAZ}, one AS (SELECT city, min(seq) AS seq, min(lat) AS lat, min(lon) AS lon FROM gaz GROUP BY city HAVING count(*) = 1),
  k AS (SELECT seq, lat, lon, city || chr(9) || region || chr(9) || country AS name FROM gaz WHERE region <> '' AND country <> ''
        UNION ALL SELECT seq, lat, lon, city || chr(9) || region FROM gaz WHERE region <> ''
        UNION ALL SELECT seq, lat, lon, city || chr(9) || country FROM gaz WHERE country <> '' AND city <> country
        UNION ALL SELECT seq, lat, lon, city FROM gaz WHERE city = country
        UNION ALL SELECT seq, lat, lon, city FROM one),
  names AS (SELECT name, lat, lon FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1)"""


def _km(a: str, b: str, alon: str = "lon", alat: str = "lat") -> str:
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.{alat}) / 2), 2) + cos(radians({a}.{alat})) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.{alon}) / 2), 2)))))"


def _half(x: str, digits: int = 0) -> str:
    scale = f"{10.0**digits!r}"
    return f"(sign({x}) * floor(abs({x}) * CAST({scale} AS DOUBLE) + 0.5) / CAST({scale} AS DOUBLE))"


_ERRORS = f"{_GOLD}, {_HOME}, err AS (SELECT g.post_id, g.user_id, {_km('g', 'h')} AS km FROM gold g JOIN h ON g.user_id = h.user_id)"
_RAW = "raw AS (SELECT delivery_id, geo.coordinates[1] AS lat, geo.coordinates[2] AS lon FROM posts WHERE len(geo.coordinates) >= 2)"
_TRI = "t AS (SELECT a.src, a.dst, count(c.dst) AS common FROM r a LEFT JOIN (r b JOIN r c ON b.dst = c.dst) ON b.src = a.src AND c.src = a.dst GROUP BY a.src, a.dst)"
_DEG = "deg AS (SELECT src AS user_id, count(*) AS degree FROM r GROUP BY src)"
_CLOSE = f"{_RECIP}, {_TRI}, {_DEG}, {_HOME}, cl AS (SELECT t.src, t.dst, t.common / CAST(x.degree * y.degree AS DOUBLE) AS s FROM t JOIN deg x ON x.user_id = t.src JOIN deg y ON y.user_id = t.dst), lt AS (SELECT cl.src, cl.dst, CAST({_half(_km('x', 'y'))} AS BIGINT) AS d, {_half('s', 2)} AS s FROM cl JOIN h x ON x.user_id = src JOIN h y ON y.user_id = dst), tab AS (SELECT d, s, count(*) / CAST((SELECT count(*) FROM lt) AS DOUBLE) AS p FROM lt GROUP BY d, s)"


def _rounds(step: str, n: int) -> str:
    """CTEs est0..estn; ``step`` uses {near} (src, dst, weight, lat, lon of unlocated users' located neighbours), {i} and gives new{i}."""
    out = ["est0 AS (SELECT user_id, lat, lon FROM h)"]
    for i in range(n):
        out.append(f"near{i} AS (SELECT r.src, r.dst, r.weight, x.lat, x.lon FROM r JOIN est{i} x ON r.dst = x.user_id WHERE r.src NOT IN (SELECT user_id FROM h))")
        out.append(f"new{i} AS ({step.format(near=f'near{i}', i=i)})")
        out.append(f"est{i + 1} AS (SELECT user_id, lat, lon FROM new{i} UNION ALL SELECT user_id, lat, lon FROM est{i} WHERE user_id NOT IN (SELECT user_id FROM new{i}))")
    return ", ".join(out)


_MEDOID = "SELECT user_id, lat, lon FROM (SELECT a.src AS user_id, a.dst, any_value(a.lat) AS lat, any_value(a.lon) AS lon, round(sum({w} * " + _km("a", "b") + "), 6) AS cost FROM {{near}} a JOIN {{near}} b ON a.src = b.src GROUP BY a.src, a.dst QUALIFY row_number() OVER (PARTITION BY a.src ORDER BY cost, a.dst) = 1)"
_TV = (
    "WITH m AS (SELECT a.src, a.dst, any_value(a.lat) AS lat, any_value(a.lon) AS lon, round(sum(b.weight * " + _km("a", "b") + "), 6) AS cost FROM {near} a JOIN {near} b ON a.src = b.src GROUP BY a.src, a.dst QUALIFY row_number() OVER (PARTITION BY a.src ORDER BY cost, a.dst) = 1)"
    " SELECT m.src AS user_id, any_value(m.lat) AS lat, any_value(m.lon) AS lon FROM m JOIN {near} b ON m.src = b.src GROUP BY m.src HAVING count(*) FILTER (WHERE " + _km("m", "b") + " <= 2000) > count(*) // 2"
)
_FOLDS = "folds AS (SELECT user_id, CAST((dense_rank() OVER (ORDER BY user_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM gold))"
_CELL = lambda v: f"CAST(sign({v}) * floor(abs({v}) * 100 + 0.5) AS INTEGER)"


def _reverse(points: str, key: str) -> str:
    return f"""SELECT {key}, seq, city, region, country FROM (
      SELECT q.{key}, z.seq, z.city, z.region, z.country, round({_km('q', 'z')}, 6) AS km, ({_CELL('q.lat')} <> {_CELL('z.lat')} OR {_CELL('q.lon')} <> {_CELL('z.lon')}) AS ring
      FROM {points} q JOIN gaz z ON abs({_CELL('q.lat')} - {_CELL('z.lat')}) <= 1 AND abs({_CELL('q.lon')} - {_CELL('z.lon')}) <= 1)
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ring OR km >= 20, km, seq) = 1"""


def _canonical(points: str, key: str) -> str:
    return f"SELECT q.{key}, coalesce(n.lat, q.lat) AS lat, coalesce(n.lon, q.lon) AS lon FROM {points} q LEFT JOIN ({_reverse(points, key)}) v ON v.{key} = q.{key} LEFT JOIN names n ON n.name = v.city || chr(9) || v.region || chr(9) || v.country"


_ROUGH = f"rough AS (SELECT user_id, {_half('lat / 20')} * 20 AS lat, {_half('lon / 20')} * 20 AS lon FROM h)"
_CITIES = f"{_ROUGH}, {_KEYS}, moved AS ({_canonical('rough', 'user_id')}), freq AS (SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) - 1 AS city FROM (SELECT lat, lon FROM moved GROUP BY lat, lon HAVING count(*) >= 3)), c AS (SELECT user_id, city FROM moved JOIN freq USING (lat, lon))"

_SQUASHED = "{1}(trim(regexp_replace({0}, '[\\s\\x0b\\x{{85}}\\pZ]+', ' ', 'g')))"
_PLAIN = "text"
for _old, _new in (("&amp;amp;", "&amp;"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_old}', '{_new}')"

SQL = {
    "extract_mentions": "SELECT delivery_id, m AS mentioned FROM (SELECT delivery_id, unnest(mentions) AS m FROM posts) WHERE m IS NOT NULL",
    "mention_edges": f"WITH {_FIRST} SELECT DISTINCT src, dst FROM (SELECT TRY_CAST(user_id AS BIGINT) AS src, TRY_CAST(unnest(mentions) AS BIGINT) AS dst FROM p) WHERE src IS NOT NULL AND dst IS NOT NULL",
    "mention_edges_weighted": f"WITH {_FIRST} SELECT src, dst, count(*) AS weight FROM (SELECT TRY_CAST(user_id AS BIGINT) AS src, TRY_CAST(unnest(mentions) AS BIGINT) AS dst FROM p) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst",
    "bi_mention_edges": f"WITH {_RECIP} SELECT src, dst FROM rec WHERE dst < src",
    "bi_mention_directed_weighted": f"WITH {_RECIP} SELECT src, dst, weight FROM rec",
    "bi_mention_weighted": f"WITH {_RECIP} SELECT src, dst, weight FROM r WHERE dst < src",
    "degree": f"WITH {_RECIP}, {_DEG} SELECT * FROM deg",
    "social_triangles": f"WITH {_RECIP}, {_TRI} SELECT src, dst, common FROM t",
    "users_in_network": f"WITH {_RECIP} SELECT record_id, TRY_CAST(user_id AS BIGINT) AS user_id FROM users WHERE TRY_CAST(user_id AS BIGINT) IN (SELECT src FROM r)",
    "clustering_coefficient": f"WITH {_RECIP}, {_TRI}, {_DEG} SELECT user_id, round(CASE WHEN degree > 1 THEN 3 * closed / (3 * closed + degree * (degree - 1) / 2.0 - closed) ELSE 0.0 END, 6) AS c FROM deg JOIN (SELECT src, CAST(sum(common) AS DOUBLE) / 2 AS closed FROM t GROUP BY src) ON src = user_id",
    "posts_to_users": f"""WITH {_FIRST}, n AS (SELECT user_id, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts FROM p WHERE user_id IS NOT NULL GROUP BY user_id)
        SELECT user_id, id % parts AS part, count(*) AS posts, min(id) AS first_id, max(id) AS last_id, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS characters
        FROM p JOIN n USING (user_id) GROUP BY user_id, id % parts""",
    "last_n_posts": f"WITH {_FIRST} SELECT user_id, id FROM p WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 10",
    "sparsify_posts": f"""WITH {_FIRST} SELECT TRY_CAST(user_id AS BIGINT) AS user_id, id AS post_id, {_SQUASHED.format("coalesce(text, '')", 'length')} AS text_length, {_SQUASHED.format("coalesce(location, '')", 'length')} AS location_length,
        coalesce(array_to_string(mentions, ' '), '') AS mentions, coalesce(array_to_string(hashtags, ' '), '') AS hashtags, retweeted_status IS NOT NULL AS is_retweet,
        coalesce(len(geo.coordinates) = 2 AND geo.coordinates[1] IS NOT NULL, false) AS has_point, place IS NOT NULL AS has_place FROM p""",
    "squash_text": f"""WITH {_FIRST} SELECT id, {_SQUASHED.format(_PLAIN, 'md5')} AS digest FROM p WHERE text IS NOT NULL""",
    "create_folds": f"WITH {_GOLD}, {_FOLDS} SELECT post_id, user_id, fold FROM gold JOIN folds USING (user_id)",
    "mask_holdout": f"""WITH {_GOLD}, {_FOLDS}, held AS (SELECT user_id FROM folds WHERE fold = 0)
        SELECT id, geo IS NOT NULL AND NOT o AS has_geo, place IS NOT NULL AND NOT o AS has_place, text IS NOT NULL AS has_text, o AS held_out
        FROM (SELECT *, coalesce(TRY_CAST(user_id AS BIGINT) IN (SELECT user_id FROM held), false) AS o FROM p)""",
    "infer_by_post": f"WITH {_FIRST}, {_HOME} SELECT p.id AS post_id, h.user_id, h.lat, h.lon FROM p JOIN h ON h.user_id = TRY_CAST(p.user_id AS BIGINT)",
    "infer_by_user": f"WITH {_HOME} SELECT DISTINCT u.user_id, u.q.id AS post_id, h.lat, h.lon FROM (SELECT TRY_CAST(user_id AS BIGINT) AS user_id, unnest(posts) AS q FROM users) u JOIN h ON h.user_id = u.user_id WHERE u.q.id IS NOT NULL",
    "haversine_pairs": f"WITH {_ERRORS} SELECT post_id, round(km, 6) AS km, round(km * CAST(0.621371 AS DOUBLE), 6) AS miles FROM err",
    "known_distance": f"WITH {_ERRORS} SELECT g.post_id, round(coalesce(km, -1.0), 6) AS km FROM gold g LEFT JOIN err ON err.post_id = g.post_id",
    "valid_coord": f"WITH {_RAW} SELECT delivery_id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS valid FROM raw",
    "wrap_coord": f"""WITH {_RAW} SELECT delivery_id,
        round(lat + CASE WHEN lat > 90 THEN -ceil((lat - 90) / 180) WHEN lat < -90 THEN ceil((-90 - lat) / 180) ELSE 0 END * 180.0, 6) AS lat,
        round(lon + CASE WHEN lon > 180 THEN -ceil((lon - 180) / 360) WHEN lon < -180 THEN ceil((-180 - lon) / 360) ELSE 0 END * 360.0, 6) AS lon
        FROM raw WHERE lat IS NOT NULL AND lon IS NOT NULL""",
    "round_half_up": f"WITH {_RAW} SELECT delivery_id, {_half('lat', 2)} AS lat, {_half('lon')} AS lon FROM raw WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "bins": f"""WITH {_NET}, g AS (SELECT src AS user_id, count(*) AS n FROM e GROUP BY src) SELECT user_id,
        CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 WHEN n < 20 THEN 2 WHEN n < 40 THEN 3 ELSE 4 END AS triad,
        CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 12 THEN 3 ELSE 4 END AS city,
        CASE WHEN n < 2 THEN 0 WHEN n < 3 THEN 1 WHEN n < 5 THEN 2 WHEN n < 8 THEN 3 ELSE 4 END AS quantile FROM g""",
    "curve_form": f"""WITH {_NET}, w AS (SELECT src, dst, CAST(weight AS DOUBLE) AS x FROM e)
        SELECT src, dst, round(0.5 * pow(x + 2.0, -1.1), 9) AS decay, round(0.0045 * pow(CASE WHEN x <= 0 THEN 1e-8 ELSE x END, -0.55), 9) AS power,
        round(exp(0.5 - 0.2 * x - 0.1 * x) / (1 + exp(0.5 - 0.2 * x - 0.1 * x)), 9) AS logistic FROM w""",
    "geometric_median": f"""WITH {_GOLD} SELECT a.user_id, a.post_id, any_value(a.lat) AS lat, any_value(a.lon) AS lon, round(round(sum({_km('a', 'b')}), 6), 3) AS cost, count(*) AS n
        FROM gold a JOIN gold b ON a.user_id = b.user_id GROUP BY a.user_id, a.post_id
        QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY round(sum({_km('a', 'b')}), 6), a.post_id) = 1""",
    "weighted_median_dispersion": f"""WITH {_RECIP}, {_HOME}, nb AS (SELECT r.src, r.dst, r.weight, h.lat, h.lon FROM r JOIN h ON h.user_id = r.dst),
        m AS (SELECT a.src, a.dst, any_value(a.lat) AS lat, any_value(a.lon) AS lon FROM nb a JOIN nb b ON a.src = b.src GROUP BY a.src, a.dst
              QUALIFY row_number() OVER (PARTITION BY a.src ORDER BY round(sum(b.weight * {_km('a', 'b')}), 6), a.dst) = 1)
        SELECT m.src AS user_id, any_value(m.dst) AS neighbour, any_value(m.lat) AS lat, any_value(m.lon) AS lon,
        count(*) FILTER (WHERE {_km('m', 'b')} <= 500) > count(*) // 2 AS kept FROM m JOIN nb b ON m.src = b.src GROUP BY m.src""",
    "upper_median": f"WITH {_ERRORS} SELECT user_id, list_sort(list(round(km, 6)))[count(*) // 2 + 1] AS median_km FROM err GROUP BY user_id",
    "mode_location": f"""WITH {_GOLD}, g AS (SELECT user_id, {_half('lat', 1)} AS lat, {_half('lon', 1)} AS lon FROM gold)
        SELECT user_id, lat, lon, count(*) AS votes FROM g GROUP BY user_id, lat, lon QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, lat, lon) = 1""",
    "centroid": f"WITH {_GOLD} SELECT user_id, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, count(*) AS n FROM gold GROUP BY user_id HAVING count(*) >= 3",
    "pair_distance_hist": f"""WITH {_HOME}, x AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM h)
        SELECT {_half(f"{_km('a', 'b')} * CAST(0.621371 AS DOUBLE)", 1)} AS miles, count(*) AS pairs
        FROM x a, range(1, 11) k(k), x b WHERE b.i = (a.i * 7919 + k.k * 104729 + 1) % a.n AND a.i <> b.i GROUP BY 1""",
    "closeness_distance_table": f"WITH {_CLOSE} SELECT d, s, round(p, 9) AS p FROM tab",
    "error_cdf": f"""WITH {_ERRORS}, c AS (SELECT least(CAST(floor(km + 0.5) AS BIGINT), 20038) AS km, count(*) AS n FROM err GROUP BY 1)
        SELECT range AS km, coalesce(n, 0) AS count, round(sum(coalesce(n, 0)) OVER (ORDER BY range) / CAST((SELECT sum(n) FROM c) AS DOUBLE), 9) AS cdf FROM range(20039) LEFT JOIN c ON c.km = range""",
    "error_auc": f"""WITH {_ERRORS}, c AS (SELECT least(CAST(floor(km + 0.5) AS BIGINT), 20038) AS km, count(*) AS n FROM err GROUP BY 1),
        f AS (SELECT range AS km, sum(coalesce(n, 0)) OVER (ORDER BY range) / CAST((SELECT sum(n) FROM c) AS DOUBLE) AS cdf FROM range(20039) LEFT JOIN c ON c.km = range)
        SELECT round(sum(cdf * (log10(least(km + 0.5, 20038.0)) - log10(greatest(km - 0.5, 1.0))) / log10(20038.0)), 6) AS auc FROM f WHERE km >= 1""",
    "quantile_bounds": f"WITH {_ERRORS}, s AS (SELECT list_sort(list(round(km, 6))) AS v, count(*) AS n FROM err) SELECT CAST(j AS INTEGER) AS j, v[CAST(j * n // 10 AS BIGINT) + 1] AS bound FROM s, range(10) t(j)",
    "gazetteer_names": f"WITH {_KEYS} SELECT name, lat, lon FROM names",
    "unambiguous_cities": f"WITH {_KEYS} SELECT city, lat, lon FROM one",
    "geocode_exact": f"WITH {_FIRST}, {_KEYS} SELECT p.id, n.lat, n.lon FROM p JOIN names n ON n.name = lower(p.location)",
    "reverse_geocode": f"WITH {_GOLD}, {_GAZ} SELECT post_id, seq AS place_id FROM ({_reverse('gold', 'post_id')})",
    "canonicalize": f"WITH {_GOLD}, {_KEYS} {_canonical('gold', 'post_id')}",
    "constant_baseline": f"WITH {_RECIP} SELECT DISTINCT src AS user_id, CAST(-6.2 AS DOUBLE) AS lat, CAST(106.8 AS DOUBLE) AS lon FROM r",
    "random_neighbor": f"WITH {_RECIP}, {_HOME}, {_rounds('SELECT src AS user_id, lat, lon FROM {near} QUALIFY row_number() OVER (PARTITION BY src ORDER BY (src % 1000003 * 7919 + dst % 1000003 * 104729 + {i} * 15485863) % 1000003, dst) = 1', 2)} SELECT user_id, lat, lon FROM est2",
    "spatial_label_propagation": f"WITH {_RECIP}, {_HOME}, {_rounds(_MEDOID.format(w='1.0'), 3)} SELECT user_id, lat, lon FROM est3",
    "total_variation": f"WITH {_RECIP}, {_HOME}, {_rounds(_TV, 2)} SELECT user_id, lat, lon FROM est2",
    "friend_vote": f"""WITH {_RECIP}, {_HOME}, g AS (SELECT user_id, {_half('lat / 10')} AS lat, {_half('lon / 10')} AS lon FROM h),
        v AS (SELECT r.src AS user_id, g.lat, g.lon, count(*) AS votes FROM r JOIN g ON g.user_id = r.dst WHERE r.src NOT IN (SELECT user_id FROM g) GROUP BY 1, 2, 3
              QUALIFY row_number() OVER (PARTITION BY r.src ORDER BY count(*) DESC, g.lat, g.lon) = 1)
        SELECT user_id, lat, lon FROM g UNION ALL SELECT user_id, lat, lon FROM v WHERE votes >= 2""",
    "social_tightness": f"""WITH {_CLOSE}, sc AS (SELECT lt.src AS user_id, sum(tab.p) AS score FROM lt JOIN tab USING (d, s) GROUP BY lt.src)
        SELECT user_id, lat, lon FROM h UNION ALL SELECT src AS user_id, lat, lon FROM (
          SELECT r.src, r.dst, h.lat, h.lon, coalesce(round(sc.score, 9), 0) AS best FROM r JOIN h ON h.user_id = r.dst LEFT JOIN sc ON sc.user_id = r.dst
          WHERE r.src NOT IN (SELECT user_id FROM h) QUALIFY row_number() OVER (PARTITION BY r.src ORDER BY best DESC, r.dst) = 1)""",
    "multi_location": f"""WITH {_RECIP}, {_HOME}, lt AS (SELECT r.src, {_km('x', 'y')} AS km FROM r JOIN h x ON x.user_id = r.src JOIN h y ON y.user_id = r.dst),
        o AS (SELECT src, 0.0045 * pow(CASE WHEN km <= 0 THEN 1e-8 ELSE km END, -0.55) AS p FROM lt),
        sc AS (SELECT src AS user_id, sum(CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) ELSE 0 END) AS score FROM o GROUP BY src)
        SELECT user_id, lat, lon FROM h UNION ALL SELECT src AS user_id, lat, lon FROM (
          SELECT r.src, r.dst, h.lat, h.lon, coalesce(round(sc.score, 9), 0) AS best FROM r JOIN h ON h.user_id = r.dst LEFT JOIN sc ON sc.user_id = r.dst
          WHERE r.src NOT IN (SELECT user_id FROM h) QUALIFY row_number() OVER (PARTITION BY r.src ORDER BY best DESC, r.dst) = 1)""",
    "influence_profiling": f"""WITH {_RECIP}, {_HOME}, x AS (SELECT user_id, lat, lon, true AS fixed FROM h UNION ALL
          SELECT DISTINCT src, CAST((src % 1000003 * 37) % 1400 AS DOUBLE) / 10 - 70, CAST((src % 1000003 * 91) % 3400 AS DOUBLE) / 10 - 170, false FROM r WHERE src NOT IN (SELECT user_id FROM h)),
        sg AS (SELECT r.src AS user_id, sum((b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon)) / (2 * count(*)) AS sigma FROM r JOIN x a ON a.user_id = r.src JOIN x b ON b.user_id = r.dst GROUP BY r.src),
        s AS (SELECT x.*, sigma FROM x JOIN sg USING (user_id) WHERE sigma > 0),
        mv AS (SELECT a.user_id, sum((1 / a.sigma + 1 / b.sigma) * b.lat) / sum(1 / a.sigma + 1 / b.sigma) AS lat, sum((1 / a.sigma + 1 / b.sigma) * b.lon) / sum(1 / a.sigma + 1 / b.sigma) AS lon
               FROM r JOIN s a ON a.user_id = r.src JOIN s b ON b.user_id = r.dst WHERE NOT a.fixed GROUP BY a.user_id)
        SELECT x.user_id, round(coalesce(mv.lat, x.lat), 6) AS lat, round(coalesce(mv.lon, x.lon), 6) AS lon FROM x LEFT JOIN mv ON mv.user_id = x.user_id""",
    "city_features": f"""WITH {_RECIP}, {_HOME}, {_CITIES}, {_DEG}, f AS (SELECT r.src, r.dst, c.city FROM r JOIN c ON c.user_id = r.dst),
        n AS (SELECT f.src, f.city, count(*) AS n, count(rec.src) AS b FROM f LEFT JOIN rec ON rec.src = f.src AND rec.dst = f.dst GROUP BY f.src, f.city),
        w AS (SELECT a.src, a.city, a.dst, count(b.dst) AS t FROM f a LEFT JOIN (f b JOIN r ON r.dst = b.dst) ON b.src = a.src AND b.city = a.city AND r.src = a.dst GROUP BY a.src, a.city, a.dst),
        q AS (SELECT src, city, CASE WHEN t < 5 THEN 0 WHEN t < 10 THEN 1 WHEN t < 20 THEN 2 WHEN t < 40 THEN 3 ELSE 4 END AS bin, count(*) AS k FROM w GROUP BY 1, 2, 3)
        SELECT src AS user_id, city * 7 AS feature, CAST(CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 12 THEN 3 ELSE 4 END AS DOUBLE) AS value FROM n
        UNION ALL SELECT src, city * 7 + 1, round(b / CAST(n AS DOUBLE), 6) FROM n
        UNION ALL SELECT q.src, city * 7 + 2 + bin, round(k / CAST(degree AS DOUBLE), 6) FROM q JOIN deg ON deg.user_id = q.src""",
    "prediction_errors": f"WITH {_ERRORS} SELECT post_id, user_id, round(km, 6) AS km FROM err",
    "coverage": f"WITH {_ERRORS} SELECT round((SELECT count(*) FROM err) / CAST(count(*) AS DOUBLE), 9) AS post_coverage, round((SELECT count(DISTINCT user_id) FROM err) / CAST(count(DISTINCT user_id) AS DOUBLE), 9) AS user_coverage FROM gold",
    "median_max_error": f"WITH {_ERRORS}, m AS (SELECT max(km) AS km FROM err GROUP BY user_id) SELECT round(list_sort(list(km))[count(*) // 2 + 1], 6) AS median_max FROM m",
    "median_median_error": f"WITH {_ERRORS}, m AS (SELECT list_sort(list(km))[count(*) // 2 + 1] AS km FROM err GROUP BY user_id) SELECT round(list_sort(list(km))[count(*) // 2 + 1], 6) AS median_median FROM m",
    "error_sample": f"WITH {_ERRORS} SELECT post_id, round(km, 6) AS km FROM err ORDER BY (post_id % 1000003 * 7919 + 104729) % 1000003, post_id LIMIT 10000",
    "validate_dist": f"WITH {_ERRORS} SELECT round(avg(km), 6) AS mean_km, round(list_sort(list(km))[count(*) // 2 + 1], 6) AS median_km FROM err",
    "validate_name": f"""WITH {_ERRORS}, {_GAZ}, pr AS (SELECT g.post_id, h.lat, h.lon FROM gold g JOIN h USING (user_id)), a AS ({_reverse('gold', 'post_id')}), b AS ({_reverse('pr', 'post_id')})
        SELECT count(*) AS compared, count(*) FILTER (WHERE a.city = b.city AND a.region = b.region AND a.country = b.country) AS same,
        round(count(*) FILTER (WHERE a.city = b.city AND a.region = b.region AND a.country = b.country) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS share FROM a JOIN b USING (post_id)""",
    "home_locations": f"""WITH {_GOLD}, cand AS (SELECT DISTINCT user_id FROM (SELECT a.user_id, a.post_id FROM gold a JOIN gold b ON a.user_id = b.user_id AND {_km('a', 'b')} <= 7.5 GROUP BY 1, 2 HAVING count(*) >= 5))
        SELECT user_id, lat, lon FROM (SELECT a.user_id, a.post_id, any_value(a.lat) AS lat, any_value(a.lon) AS lon FROM gold a JOIN gold b ON a.user_id = b.user_id WHERE a.user_id IN (SELECT user_id FROM cand) GROUP BY a.user_id, a.post_id
          QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY round(sum({_km('a', 'b')}), 6), a.post_id) = 1)""",
}
_TV_WHOLE = _TV.replace("<= 2000", "<= 100")
_LAST = f"""mine AS (SELECT TRY_CAST(user_id AS BIGINT) AS user_id, id, geo, place, location FROM posts WHERE id IS NOT NULL AND TRY_CAST(user_id AS BIGINT) IN (SELECT src FROM r)
          QUALIFY row_number() OVER (PARTITION BY TRY_CAST(user_id AS BIGINT), id ORDER BY delivery_id) = 1),
        lastp AS (SELECT *, len(geo.coordinates) = 2 AS pt, place.place_type = 'city' AS ct FROM mine QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 10),
        firsts AS (SELECT user_id, arg_min(geo.coordinates, id) FILTER (WHERE pt) AS point,
          arg_min(concat_ws(chr(9), lower(place.full_name), lower(place.country)), id) FILTER (WHERE ct) AS place, bool_or(coalesce(pt, false)) AS has_point, bool_or(coalesce(ct, false)) AS has_place FROM lastp GROUP BY user_id),
        bp AS (SELECT user_id, point[1] AS lat, point[2] AS lon FROM firsts WHERE point IS NOT NULL)"""
_GOLD_LOCATIONS = f"""{_RECIP}, {_HOME}, {_KEYS}, {_LAST}, gl AS ({_canonical('bp', 'user_id')}
        UNION ALL SELECT f.user_id, n.lat, n.lon FROM firsts f JOIN names n ON n.name = f.place WHERE f.point IS NULL AND f.place IS NOT NULL
        UNION ALL SELECT f.user_id, h.lat, h.lon FROM firsts f JOIN h USING (user_id) WHERE f.point IS NULL AND f.place IS NULL)"""
_NGRAMS = "[^\\p{L}\\p{N}''’-]+"


def _tightness(n: int) -> str:
    """CTEs loc0..locn: the located users after each round of social tightness."""
    out = ["loc0 AS (SELECT user_id, lat, lon FROM h)"]
    for i in range(n):
        out.append(f"lt{i} AS (SELECT cl.src, CAST({_half(_km('x', 'y'))} AS BIGINT) AS d, {_half('s', 2)} AS s FROM cl JOIN loc{i} x ON x.user_id = src JOIN loc{i} y ON y.user_id = dst)")
        out.append(f"sc{i} AS (SELECT src AS user_id, sum(p) AS score FROM lt{i} JOIN (SELECT d, s, count(*) / CAST((SELECT count(*) FROM lt{i}) AS DOUBLE) AS p FROM lt{i} GROUP BY d, s) USING (d, s) GROUP BY src)")
        out.append(f"""loc{i + 1} AS (SELECT user_id, lat, lon FROM loc{i} UNION ALL SELECT src, lat, lon FROM (
          SELECT r.src, r.dst, z.lat, z.lon, coalesce(round(sc{i}.score, 9), 0) AS best FROM r JOIN loc{i} z ON z.user_id = r.dst LEFT JOIN sc{i} ON sc{i}.user_id = r.dst
          WHERE r.src NOT IN (SELECT user_id FROM loc{i}) QUALIFY row_number() OVER (PARTITION BY r.src ORDER BY best DESC, r.dst) = 1))""")
    return ", ".join(out)


SQL |= {
    "parsed_coordinates": f"""WITH {_GOLD}, v AS (SELECT post_id, lat, lon, floor(abs(lat) * 3600) AS a, floor(abs(lon) * 3600) AS o FROM gold)
        SELECT post_id, round(CASE WHEN post_id % 2 = 0 THEN round(lat, 6) ELSE a / 3600.0 * CASE WHEN lat < 0 THEN -1 ELSE 1 END END, 6) AS lat,
        round(CASE WHEN post_id % 2 = 0 THEN round(lon, 6) ELSE o / 3600.0 * CASE WHEN lon < 0 THEN -1 ELSE 1 END END, 6) AS lon FROM v""",
    "random_neighbor_whole": SQL["random_neighbor"].split("est0 AS")[0] + _rounds(SQL["random_neighbor"].split("new0 AS (")[1].split("), est1 AS")[0].replace("near0", "{near}").replace("0 * 15485863", "{i} * 15485863"), 4) + " SELECT user_id, lat, lon FROM est4",
    "total_variation_whole": f"WITH {_RECIP}, {_HOME}, {_rounds(_TV_WHOLE, 4)} SELECT user_id, lat, lon FROM est4",
    "gold_locations": f"WITH {_GOLD_LOCATIONS} SELECT user_id, lat, lon FROM gl",
    "friend_vote_whole": f"""WITH {_GOLD_LOCATIONS}, v AS (SELECT r.src AS user_id, g.lat, g.lon, count(*) AS votes FROM r JOIN gl g ON g.user_id = r.dst WHERE r.src NOT IN (SELECT user_id FROM gl) GROUP BY 1, 2, 3
              QUALIFY row_number() OVER (PARTITION BY r.src ORDER BY count(*) DESC, g.lat, g.lon) = 1)
        SELECT user_id, lat, lon FROM gl UNION ALL SELECT user_id, lat, lon FROM v WHERE votes >= 2""",
    "social_tightness_whole": f"WITH {_CLOSE}, {_tightness(3)} SELECT user_id, lat, lon FROM loc3",
    "social_energy": f"""WITH {_RECIP}, {_TRI}, {_DEG}, {_HOME}, cl AS (SELECT t.src, t.dst, t.common / sqrt(CAST(x.degree * y.degree AS DOUBLE)) AS c FROM t JOIN deg x ON x.user_id = t.src JOIN deg y ON y.user_id = t.dst),
        lt AS (SELECT cl.src, cl.c, {_half('c', 1)} AS s, {_km('x', 'y')} AS km FROM cl JOIN h x ON x.user_id = src JOIN h y ON y.user_id = dst),
        g AS (SELECT src AS user_id, sum(-c * exp(-km / greatest(dr, 1e-6))) AS g FROM lt JOIN (SELECT s, avg(km) AS dr FROM lt GROUP BY s) USING (s) GROUP BY src),
        cc AS (SELECT user_id, CASE WHEN degree > 1 THEN 3 * closed / (3 * closed + degree * (degree - 1) / 2.0 - closed) ELSE 0.0 END AS c FROM deg JOIN (SELECT src, CAST(sum(common) AS DOUBLE) / 2 AS closed FROM t GROUP BY src) ON src = user_id),
        k AS (SELECT h.user_id, h.lat, h.lon, coalesce(g.g, 0) AS g, coalesce(cc.c, 0) AS c FROM h LEFT JOIN g USING (user_id) LEFT JOIN cc USING (user_id)),
        n AS (SELECT r.src, r.dst, k.lat, k.lon, rank() OVER (PARTITION BY r.src ORDER BY round(k.g, 9)) AS rg, rank() OVER (PARTITION BY r.src ORDER BY round(-k.c, 9)) AS rc FROM r JOIN k ON k.user_id = r.dst WHERE r.src NOT IN (SELECT user_id FROM h))
        SELECT user_id, lat, lon FROM h UNION ALL SELECT src, lat, lon FROM (SELECT *, round(exp(0.0 - rg - rc) / (1 + exp(0.0 - rg - rc)), 12) AS z FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY z DESC, dst) = 1)""",
    "toponym_ngrams": f"""WITH {_FIRST}, {_KEYS}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '{_NGRAMS}'), lambda x: x <> '') AS w FROM p WHERE text IS NOT NULL),
        g AS (SELECT id, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + n - 1 AS BIGINT)), ' ') AS name FROM w, range(1, 4) q(n), LATERAL (SELECT unnest(range(1, greatest(len(w) - n + 2, 1))) AS i))
        SELECT id, name, count(*) AS n FROM g WHERE name IN (SELECT name FROM names) GROUP BY id, name""",
    "score_report": f"SELECT auc, post_coverage, user_coverage, median_max FROM ({SQL['error_auc']}), (SELECT round(post_coverage, 6) AS post_coverage, round(user_coverage, 6) AS user_coverage FROM ({SQL['coverage']})), ({SQL['median_max_error']})",
}

_CV = "".join(
    f", m{k} AS (SELECT user_id, lat, lon FROM h WHERE user_id NOT IN (SELECT user_id FROM folds WHERE fold = {k})), nb{k} AS (SELECT r.src, r.dst, x.lat, x.lon FROM r JOIN m{k} x ON x.user_id = r.dst WHERE r.src NOT IN (SELECT user_id FROM m{k})), est{k} AS (SELECT * FROM m{k} UNION ALL "
    + _MEDOID.format(w="1.0").format(near=f"nb{k}")
    + ")"
    for k in (0, 1)
)
SQL["cross_validate"] = f"WITH {_GOLD}, {_FOLDS}, {_HOME}, {_RECIP}{_CV} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS fold, g.post_id, g.user_id, x.lat, x.lon FROM gold g JOIN folds f ON f.user_id = g.user_id AND f.fold = {k} JOIN est{k} x ON x.user_id = g.user_id" for k in (0, 1))
_CV_WHOLE = "".join(
    f", m{k} AS (SELECT user_id, lat, lon FROM h WHERE user_id NOT IN (SELECT user_id FROM folds WHERE fold = {k})), "
    + _rounds(_MEDOID.format(w="1.0"), 5).replace("FROM h)", f"FROM m{k})").replace("SELECT user_id FROM h", f"SELECT user_id FROM m{k}").replace("est", f"est_{k}_").replace("near", f"near_{k}_").replace("new", f"new_{k}_")
    for k in range(FOLDS)
)
SQL["cross_validate_whole"] = f"WITH {_GOLD}, {_FOLDS}, {_HOME}, {_RECIP}{_CV_WHOLE} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS fold, g.post_id, g.user_id, x.lat, x.lon FROM gold g JOIN folds f ON f.user_id = g.user_id AND f.fold = {k} JOIN est_{k}_5 x ON x.user_id = g.user_id" for k in range(FOLDS))
SQL |= {
    "stored_users": f"WITH {_RECIP} SELECT user_id, p.id AS id, md5(p.text) AS digest FROM (SELECT user_id, unnest(posts) AS p FROM users WHERE TRY_CAST(user_id AS BIGINT) IN (SELECT src FROM r))",
    "stored_sparse_users": f"""WITH {_FIRST} SELECT TRY_CAST(user_id AS BIGINT) AS user_id, id, {_SQUASHED.format("coalesce(text, '')", 'md5')} AS text, {_SQUASHED.format("coalesce(location, '')", 'md5')} AS location,
        CASE WHEN len(geo.coordinates) = 2 AND geo.coordinates[2] IS NOT NULL THEN geo.coordinates[1] END AS lat, CASE WHEN len(geo.coordinates) = 2 AND geo.coordinates[1] IS NOT NULL THEN geo.coordinates[2] END AS lon,
        coalesce(array_to_string(list_filter(list_transform(mentions, lambda m: TRY_CAST(m AS BIGINT)), lambda m: m IS NOT NULL), ' '), '') AS mentions, retweeted_status IS NOT NULL AS is_retweet, place IS NOT NULL AS has_place FROM p WHERE TRY_CAST(user_id AS BIGINT) IS NOT NULL""",
    "stored_edges": f"WITH {_NET} SELECT src, dst, weight FROM e",
    "stored_model": f"WITH {_HOME} SELECT user_id, lat, lon FROM h",
    "stored_homes": f"WITH {_GOLD}, {_FOLDS}, {_HOME} SELECT user_id, lat, lon FROM h WHERE user_id NOT IN (SELECT user_id FROM folds WHERE fold = 0)",
    "stored_folds": f"WITH {_GOLD}, {_FOLDS}, g AS (SELECT post_id, user_id, lat, lon, fold FROM gold JOIN folds USING (user_id)) SELECT g.*, n.posts, n.users FROM g JOIN (SELECT fold, count(*) AS posts, count(DISTINCT user_id) AS users FROM g GROUP BY fold) n USING (fold)",
    "stored_predictions": f"WITH {_GOLD}, {_FOLDS}, {_HOME} SELECT fold, post_id, round(h.lat, 6) AS lat, round(h.lon, 6) AS lon FROM gold JOIN folds USING (user_id) JOIN h USING (user_id)",
    "stored_gazetteer": "SELECT city || ', town' AS city, region, country, count(*) AS n, round(min(lat), 6) AS lat, round(min(lon), 6) AS lon FROM gazetteer WHERE city IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY city, region, country",
}
