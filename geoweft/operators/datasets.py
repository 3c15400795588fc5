"""Building data sets from posts: user records, pruned posts, folds, hold-out, and inference joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash
from ..session import cut
from .skew import SALT, heavy_candidates, skew_safe_join, skew_safe_left, with_salt


def path(name: str) -> Column:
    """The column at a dotted path; over lists the path is taken of each element (missing: empty list)."""
    if "[]" not in name:
        return F.col(name)
    head, tail = name.split("[].", 1)
    return F.coalesce(F.transform(F.col(head), lambda x: x[tail].cast("string")), F.array().cast("array<string>"))


def user_records(posts: DataFrame, user: str, order: str, fields: list[str], *, per_record: int = 1000) -> DataFrame:
    """Posts grouped into records ``(user, part, posts)``, posts ordered by ``order``.

    A record holds about ``per_record`` posts, so an author of any size becomes many records of
    bounded size instead of one unbounded list. Posts without author or order value are left out.
    """
    posts = posts.where(F.col(user).isNotNull() & F.col(order).isNotNull())
    parts = posts.groupBy(user).agg(F.ceil(F.count(F.lit(1)) / per_record).cast("bigint").alias("parts"))
    each = skew_safe_join(posts, parts, user).withColumn("part", F.pmod(F.col(order), F.col("parts")))
    body = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in (order, *[f for f in fields if f != order])])))
    return each.groupBy(user, "part").agg(body.alias("posts"))


def flatten_records(records: DataFrame, user: str) -> DataFrame:
    return records.select(user, F.explode("posts").alias("p")).select(user, "p.*")


def sparse_posts(posts: DataFrame) -> DataFrame:
    """Posts with the eight columns the methods read, texts squashed, lists joined by spaces. A null point gives an empty string."""
    point = F.col("geo.coordinates")
    return posts.select(
        F.col("user_id").try_cast("bigint").alias("user_id"),
        F.col("id").alias("post_id"),
        squash(F.coalesce("text", F.lit(""))).alias("text"),
        squash(F.coalesce("location", F.lit(""))).alias("location"),
        F.coalesce(F.when(F.size(point) == 2, F.concat_ws(" ", point[0].cast("string"), point[1].cast("string"))), F.lit("")).alias("point"),
        F.array_join(F.coalesce("mentions", F.array()), " ").alias("mentions"),
        F.array_join(F.coalesce("hashtags", F.array()), " ").alias("hashtags"),
        F.col("retweeted_status").isNotNull().alias("is_retweet"),
        F.coalesce(F.to_json("place"), F.lit("")).alias("place"),
    )


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int, *, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; a heavy key is cut down per salt first."""
    heavy = heavy_candidates(df, key)
    salted = with_salt(df, key, heavy, salts)
    if heavy:
        local = Window.partitionBy(key, SALT).orderBy(*order)
        salted = salted.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= n).drop("__r")
    final = Window.partitionBy(key).orderBy(*order)
    return salted.withColumn("__r", F.row_number().over(final)).where(F.col("__r") <= n).drop("__r", SALT)


def _with_offsets(ranged: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """``ranged`` with the start of its range as ``__start``; one broadcast row for each range, that is for each shuffle partition."""
    starts = ranged.sparkSession.createDataFrame(list(offsets.items()), "__range int, __start bigint")
    return ranged.join(F.broadcast(starts), "__range")


def global_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """``df`` with the position of each row in the order of ``order`` (which must identify rows), from 0.

    Ranges are sorted apart; only the number of rows of each range goes to the driver.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()))
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    offsets, total = {}, 0
    for k in sorted(counts):
        offsets[k], total = total, total + counts[k]
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("bigint")).drop("__range")
    return _with_offsets(ranged.withColumn("__local", local), offsets).withColumn(name, (F.col("__local") + F.col("__start")).cast("bigint")).drop("__range", "__local", "__start")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with the sum of ``value`` over all rows up to each row in the order of ``order``, and the total.

    Ranges are summed apart; one number of each range goes to the driver.
    """
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("__range", F.spark_partition_id()))
    sums = {r["__range"]: r["s"] for r in ranged.groupBy("__range").agg(F.sum(value).alias("s")).collect()}
    offsets, total = {-1: 0}, 0
    for k in sorted(sums):
        offsets[k], total = total, total + sums[k]
    placed = _with_offsets(ranged.withColumn("__local", F.sum(value).over(Window.partitionBy("__range").orderBy(order))), offsets)
    return placed.withColumn(name, F.col("__local") + F.col("__start")).drop("__range", "__local", "__start"), total


def assign_folds(gold: DataFrame, folds: int) -> DataFrame:
    """``gold`` (user_id, ...) with ``fold``: located users are numbered by id and dealt out in turn."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    users = global_index(gold.where("user_id IS NOT NULL").select("user_id").distinct(), ["user_id"])
    numbered = users.select("user_id", F.pmod("index", F.lit(folds)).cast("int").alias("fold"))
    return skew_safe_join(gold.where("user_id IS NOT NULL"), numbered, "user_id")


def mask_holdout(posts: DataFrame, user: str, held_out: DataFrame, columns: tuple[str, ...] = ("geo", "place")) -> DataFrame:
    """``posts`` with the location columns of held-out users set to null; text and mentions stay."""
    flags = held_out.select(F.col("user_id").alias(user)).where(F.col(user).isNotNull()).distinct().withColumn("__held", F.lit(True))
    rest, held = skew_safe_left(posts, flags, user), F.coalesce("__held", F.lit(False))
    return rest.select(*[F.when(~held, F.col(c)).alias(c) if c in columns else F.col(c) for c in posts.columns], held.alias("held_out"))


def infer_posts(posts: DataFrame, model: DataFrame) -> DataFrame:
    """``posts`` (post_id, user_id) with the location of their author; posts of unknown users drop out."""
    return skew_safe_join(posts.where("user_id IS NOT NULL").select("post_id", "user_id"), model.select("user_id", "lat", "lon"), "user_id").select("post_id", "user_id", "lat", "lon")


def drop_null_island(located: DataFrame) -> DataFrame:
    return located.where("NOT (lat = 0 AND lon = 0)")


def homes(rows: DataFrame) -> DataFrame:
    """One home per user: the smallest (lat, lon) of the valid rows, without those at (0, 0)."""
    ok = drop_null_island(rows.where("user_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"))
    return ok.groupBy("user_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("user_id", "p.lat", "p.lon")
