"""Mention graphs as edge tables: directed, weighted, reciprocal, and what is counted on them.

Self mentions stay in directed graphs and drop out of undirected ones. Undirected graphs are stored
in both directions, so that a join on ``src`` sees every neighbour. Edges with a null end drop out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import skew_safe_join, skew_safe_semi


def mentions(posts: DataFrame, author: str, mentioned: Column) -> DataFrame:
    """One row (src, dst) for each mention in each post; ids that are no numbers drop out."""
    out = posts.select(F.col(author).try_cast("bigint").alias("src"), F.explode(mentioned).alias("m")).select("src", F.col("m").try_cast("bigint").alias("dst"))
    return out.where("src IS NOT NULL AND dst IS NOT NULL")


def distinct_edges(rows: DataFrame) -> DataFrame:
    return rows.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def weighted_edges(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Edges with the number of rows, or the sum of ``weight`` (rows without weight drop out)."""
    rows = rows.where("src IS NOT NULL AND dst IS NOT NULL")
    if weight is None:
        return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return rows.where(weight.isNotNull()).groupBy("src", "dst").agg(F.sum(weight).cast("bigint").alias("weight"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight, back) that exist in both directions, self loops included.

    Both directions of a pair meet in one group by (smaller, larger) id, so no self join is needed.
    """
    pair = edges.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    both = pair.groupBy("lo", "hi").agg(F.max(F.when(F.col("src") == F.col("lo"), F.col("weight"))).alias("up"), F.max(F.when(F.col("src") == F.col("hi"), F.col("weight"))).alias("down"))
    both = both.where("up IS NOT NULL AND down IS NOT NULL")
    ways = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("up").alias("weight"), F.col("down").alias("back"))))
    ways = ways.otherwise(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("up").alias("weight"), F.col("down").alias("back")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"), F.col("down").alias("weight"), F.col("up").alias("back"))))
    return both.select(F.explode(ways).alias("e")).select("e.*")


def undirected(edges: DataFrame) -> DataFrame:
    """The reciprocal graph without self loops, both directions, weight the smaller of the two."""
    return reciprocal(edges).where("src <> dst").select("src", "dst", F.least("weight", "back").alias("weight"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("user_id")).agg(F.count(F.lit(1)).alias("degree"))


def triangle_list(edges: DataFrame) -> DataFrame:
    """(x, y, z): each triangle of an undirected graph once.

    A triangle is found at its end of lowest degree: every edge points to the end of higher degree, so a
    hub has few outgoing edges and is never paired with itself.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    degrees = degree(edges)
    # (user_id, dst) and (dst, src) meet their degree in one join: each edge is stored both ways, so its smaller id row knows one end and its larger the other
    ends = skew_safe_join(edges.withColumnRenamed("src", "user_id"), degrees, "user_id")
    pair = ends.groupBy(F.least("user_id", "dst").alias("lo"), F.greatest("user_id", "dst").alias("hi"))
    both = pair.agg(F.max(F.when(F.col("user_id") < F.col("dst"), F.col("degree"))).alias("ld"), F.max(F.when(F.col("user_id") > F.col("dst"), F.col("degree"))).alias("hd"))
    up = F.col("ld") <= F.col("hd")  # of equal degrees the smaller id
    out = cut(both.select(F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("src"), F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("dst")))
    wedge = out.alias("a").join(out.alias("b"), F.col("a.src") == F.col("b.src")).where("a.dst < b.dst").select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    return wedge.join(out.select(F.least("src", "dst").alias("y"), F.greatest("src", "dst").alias("z")), ["y", "z"])


def triangles(edges: DataFrame) -> DataFrame:
    """(src, dst, common): the number of common neighbours of each edge of an undirected graph."""
    ways = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in ("xy", "yx", "xz", "zx", "yz", "zy")])
    edges = cut(edges.select("src", "dst"))
    counts = triangle_list(edges).select(F.explode(ways).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("common"))
    ends = edges.select("src", "dst").where("src <> dst").distinct()
    return ends.join(counts, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"))


def neighbours(edges: DataFrame, located: DataFrame) -> DataFrame:
    """(src, dst, weight, lat, lon): every located neighbour of every node."""
    known = located.select(F.col("user_id").alias("dst"), "lat", "lon")
    return skew_safe_join(edges, known, "dst").select("src", "dst", "weight", "lat", "lon")


def in_network(users: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """The rows of ``users`` whose id has an edge."""
    return skew_safe_semi(users, edges.select(F.col("src").alias(key)), key)
