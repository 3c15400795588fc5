"""Posts as a stream: exactly-once delivery, prediction, and mention counts in time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(posts: DataFrame, key: str = "id", arrived: str = "received_at", late: str = "7 days") -> DataFrame:
    """Each message once; state older than the watermark is dropped, so repeats later than that pass and are left to the batch anti-join."""
    return posts.where(F.col(key).isNotNull()).withWatermark(arrived, late).dropDuplicatesWithinWatermark([key])


def infer_stream(posts: DataFrame, model: DataFrame) -> DataFrame:
    """Stream-static join with a trained model; stateless."""
    asked = posts.select(F.col("id").alias("post_id"), F.col("user_id").try_cast("bigint").alias("user_id"))
    return asked.join(model.select("user_id", "lat", "lon"), "user_id").select("post_id", "user_id", "lat", "lon")


def mention_counts(posts: DataFrame, arrived: str = "received_at", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mentions of each pair per tumbling window."""
    each = posts.withWatermark(arrived, late).select(F.col(arrived).alias("at"), F.col("user_id").try_cast("bigint").alias("src"), F.explode("mentions").alias("m"))
    pairs = each.select("at", "src", F.col("m").try_cast("bigint").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    return pairs.groupBy(F.window("at", window).alias("w"), "src", "dst").agg(F.count(F.lit(1)).alias("weight")).select(F.col("w.start").alias("start"), "src", "dst", "weight")
