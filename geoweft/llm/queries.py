"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, encoding, garbled, packing, personal, splits

CAPACITY = 2048


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = encoding.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "tokens", CAPACITY).select("doc_id", "part", F.col("size").alias("tokens"), F.col("container").alias("container_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts").where("id IS NOT NULL AND text IS NOT NULL")
    return personal.find_details(posts, "id", "text", table(spark, d, "given_names"), table(spark, d, "gazetteer")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact_texts(table(spark, d, "posts"), "delivery_id", "text", table(spark, d, "given_names"), table(spark, d, "gazetteer"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts").where("id IS NOT NULL").where(F.col("location").rlike(r"(?U)\S"))
    first = posts.groupBy("id").agg(F.min_by("location", "delivery_id").alias("location"))
    return canonical.match_values(first, "id", "location", table(spark, d, "gazetteer"), table(spark, d, "region_codes"))


SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "users").where("user_id IS NOT NULL").select(F.col("user_id").alias("node"), F.explode("posts.id").alias("item"))
    return splits.components(splits.star_links(edges)).select(F.col("node").alias("user_id"), F.col("component").alias("group_id"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    out = splits.assign_splits(table(spark, d, "users"), "user_id", "record_id", F.col("posts.id"), SPLITS)
    return out.select("record_id", "user_id", F.col("component").alias("group_id"), "split")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents"), "doc_id", "text")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore_garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "restored", "lost")


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_GROUPS = """
    e AS (SELECT DISTINCT {node} AS n, p.id AS i FROM (SELECT user_id, record_id, unnest(posts) AS p FROM users) WHERE p.id IS NOT NULL AND {node} IS NOT NULL),
    s AS (SELECT i, min(n) AS m FROM e GROUP BY i HAVING min(n) < max(n)),
    l AS (SELECT DISTINCT n AS a, m AS b FROM e JOIN s USING (i) UNION SELECT DISTINCT m AS a, n AS b FROM e JOIN s USING (i)),
    r AS (SELECT a AS n, a AS g FROM l UNION SELECT r.n, l.b AS g FROM r JOIN l ON r.g = l.a),
    c AS (SELECT n, min(g) AS g FROM r GROUP BY n)"""
_SCORES = ", ".join(
    f"(-CAST({w} AS DOUBLE) / ln((CAST(('0x' || substr(md5('{s}:' || g), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0), '{s}')" for s, w in sorted(SPLITS.items())
)

SQL: dict[str, str] = {
    "p6_found": f"WITH RECURSIVE {_GROUPS.format(node='user_id')} SELECT n AS user_id, g AS group_id FROM c",
    "p6_splits": f"""WITH RECURSIVE {_GROUPS.format(node="coalesce(user_id, 'record:' || record_id)")}
        SELECT record_id, user_id, g AS group_id, list_max([{_SCORES.replace("(-", "row(-")}])[2] AS split
        FROM (SELECT record_id, user_id, coalesce(c.g, coalesce(user_id, 'record:' || record_id)) AS g
              FROM users LEFT JOIN c ON c.n = coalesce(user_id, 'record:' || record_id))""",
}
