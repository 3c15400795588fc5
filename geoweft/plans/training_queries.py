"""Queries of the general training-data operators (p2, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deliveries import excess_deliveries, keep_first, new_messages
from ..operators.nearby import pairs_within, regions_holding, valid_point
from ..operators.skew import keys_by_share, salted_aggregate
from ..session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users").select("record_id", "user_id")
    mentions = table(spark, d, "mention_network").select("batch", F.col("user_id").cast("string").alias("user_id"), "dst", "weight")
    found = [keys_by_share(t, "user_id", 0.03).select(F.lit(name).alias("source"), "user_id") for name, t in (("users", users), ("mention_network", mentions))]
    return found[0].unionByName(found[1])


def p2_user_posts(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users").select("record_id", "user_id", F.coalesce(F.array_size("posts"), F.lit(0)).alias("n"))
    each = table(spark, d, "users").select("user_id", F.explode("posts.id").alias("post_id"))
    totals = salted_aggregate(users, "user_id", {"records": ("count", None), "posts": ("sum", "n")}, salt_on=["record_id"])
    posts = salted_aggregate(each, "user_id", {"distinct_posts": ("count_distinct", "post_id")})
    posts = posts.select(F.col("user_id").alias("k"), "distinct_posts")
    out = totals.join(posts, F.col("user_id").eqNullSafe(F.col("k")), "left")
    return out.select("user_id", "records", "posts", F.coalesce("distinct_posts", F.lit(0)).cast("bigint").alias("distinct_posts"))


def p2_user_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mention_network")
    out = salted_aggregate(m, "user_id", {"edges": ("count", None), "weight": ("sum", "weight"), "heaviest": ("max", "weight"), "mentioned": ("count_distinct", "dst")})
    return out.select(F.col("user_id").cast("string").alias("user_id"), "edges", "weight", "heaviest", "mentioned")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return excess_deliveries(table(spark, d, "posts").select("id", "delivery_id"), "id", ["delivery_id"])


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts").select("id", "delivery_id", "user_id", "received_at")
    return keep_first(posts, "id", ["delivery_id"]).select("id", "delivery_id", "user_id")


def p4_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """The messages that the last batch adds to all earlier ones."""
    posts = table(spark, d, "posts").select("id", "delivery_id", "batch")
    last = posts.agg(F.max("batch")).head()[0]
    last = -1 if last is None else last
    return new_messages(posts.where(F.col("batch") == last), posts.where(F.col("batch") < last), "id", ["delivery_id"]).select("id", "delivery_id")


def post_point() -> tuple[Column, Column]:
    """The point of a post: ``geo`` if valid, else ``coordinates`` if it is a valid Point."""
    geo, other = F.col("geo.coordinates"), F.col("coordinates.coordinates")
    is_geo, is_other = valid_point(geo), valid_point(other) & F.coalesce(F.col("coordinates.type") == "Point", F.lit(False))
    point = F.when(is_geo, geo).when(is_other, other)
    return F.get(point, F.lit(0)), F.get(point, F.lit(1))


def post_points(spark: SparkSession, d: str) -> DataFrame:
    """One point per post id (all deliveries of an id hold the same one)."""
    lat, lon = post_point()
    posts = table(spark, d, "posts").where("id IS NOT NULL AND (geo IS NOT NULL OR coordinates IS NOT NULL)").select("id", lat.alias("lat"), lon.alias("lon"))
    return posts.where("lat IS NOT NULL").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(post_points(spark, d), 50.0).select("id_a", "id_b")


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of the gazetteer nearest to each post, within 10 km."""
    places = table(spark, d, "gazetteer").select(F.col("place_id").alias("region_id"), "lat", "lon")
    held = regions_holding(post_points(spark, d), places, 10_000.0)
    best = F.min(F.struct(F.round("meters", 3).alias("m"), "region_id")).alias("b")
    return held.groupBy("id").agg(best).select("id", F.col("b.region_id").alias("place_id"), F.round("b.m", 1).alias("meters"))


QUERIES = {
    "p2_found": p2_found,
    "p2_user_posts": p2_user_posts,
    "p2_user_mentions": p2_user_mentions,
    "p4_found": p4_found,
    "p4_kept": p4_kept,
    "p4_new_batch": p4_new_batch,
    "p5_found": p5_found,
    "p5_places": p5_places,
}

_POINTS = """points AS (
  SELECT id, min(lat) AS lat, min(lon) AS lon FROM (
    SELECT id,
      CASE WHEN len(geo.coordinates) = 2 AND abs(geo.coordinates[1]) <= 90 AND abs(geo.coordinates[2]) <= 180
                AND NOT (geo.coordinates[1] = 0 AND geo.coordinates[2] = 0) THEN geo.coordinates[1]
           WHEN coordinates.type = 'Point' AND len(coordinates.coordinates) = 2 AND abs(coordinates.coordinates[1]) <= 90
                AND abs(coordinates.coordinates[2]) <= 180 AND NOT (coordinates.coordinates[1] = 0 AND coordinates.coordinates[2] = 0)
           THEN coordinates.coordinates[1] END AS lat,
      CASE WHEN len(geo.coordinates) = 2 AND abs(geo.coordinates[1]) <= 90 AND abs(geo.coordinates[2]) <= 180
                AND NOT (geo.coordinates[1] = 0 AND geo.coordinates[2] = 0) THEN geo.coordinates[2]
           WHEN coordinates.type = 'Point' AND len(coordinates.coordinates) = 2 AND abs(coordinates.coordinates[1]) <= 90
                AND abs(coordinates.coordinates[2]) <= 180 AND NOT (coordinates.coordinates[1] = 0 AND coordinates.coordinates[2] = 0)
           THEN coordinates.coordinates[2] END AS lon
    FROM posts WHERE id IS NOT NULL) WHERE lat IS NOT NULL GROUP BY id)"""

_METERS = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"

SQL = {
    "p2_found": """
        SELECT 'users' AS source, user_id FROM users WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM users)
        UNION ALL
        SELECT 'mention_network' AS source, CAST(user_id AS VARCHAR) AS user_id FROM mention_network WHERE user_id IS NOT NULL
        GROUP BY user_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM mention_network)""",
    "p2_user_posts": """
        SELECT r.user_id, r.records, r.posts, coalesce(p.distinct_posts, 0) AS distinct_posts
        FROM (SELECT user_id, count(*) AS records, CAST(sum(coalesce(len(posts), 0)) AS BIGINT) AS posts FROM users GROUP BY user_id) r
        LEFT JOIN (SELECT user_id, count(DISTINCT p.id) AS distinct_posts FROM (SELECT user_id, unnest(posts) AS p FROM users) GROUP BY user_id) p
        ON r.user_id IS NOT DISTINCT FROM p.user_id""",
    "p2_user_mentions": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, max(weight) AS heaviest,
               count(DISTINCT dst) AS mentioned FROM mention_network GROUP BY user_id""",
    "p4_found": """
        SELECT id, delivery_id FROM posts WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery_id) > 1""",
    "p4_kept": """
        SELECT id, delivery_id, user_id FROM posts WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery_id) = 1""",
    "p4_new_batch": """
        SELECT id, min(delivery_id) AS delivery_id FROM posts WHERE id IS NOT NULL AND batch = (SELECT max(batch) FROM posts)
        AND id NOT IN (SELECT id FROM posts WHERE id IS NOT NULL AND batch < (SELECT max(batch) FROM posts)) GROUP BY id""",
    "p5_found": f"""
        WITH {_POINTS} SELECT a.id AS id_a, b.id AS id_b FROM points a JOIN points b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001
        WHERE {_METERS} <= 50""",
    "p5_places": f"""
        WITH {_POINTS} SELECT id, place_id, round(meters, 1) AS meters FROM (
          SELECT a.id, b.place_id, round({_METERS}, 3) AS meters FROM points a JOIN gazetteer b ON abs(a.lat - b.lat) < 0.2)
        WHERE meters <= 10000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY meters, place_id) = 1""",
}
