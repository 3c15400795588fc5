"""Train, validation and test splits that keep related records together.

Records with the same owner, or with a common item, form one component. Components are found by
hash-to-min: each node tells its smallest known neighbour about its cluster and its cluster about
that smallest neighbour, until nothing changes. Clusters are rows (node, member), never one list, so
a component of any size spreads over many tasks; rounds are cut in the shared checkpoint folder.
Each component then goes to the split with the highest weighted rendezvous score, so a component
stays where it is when others come or go, or when a split is added.

Items with a null id link nothing. A record without owner is a node of its own (``record:<id>``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_safe_join, skew_safe_left
from ..session import cut

ANONYMOUS = "record:"


def star_links(edges: DataFrame) -> DataFrame:
    """``node, least``: each node with the smallest node of an item they share. ``edges``: node, item.

    This is hash-to-min's first exchange over the items; nodes that share nothing drop out here. An
    item of many nodes is never listed: its smallest node comes from a partial aggregate.
    """
    edges = edges.where("node IS NOT NULL AND item IS NOT NULL")
    shared = edges.groupBy("item").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("item", "least")
    return skew_safe_join(edges, shared, "item").where("node <> least").select("node", "least").distinct()


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of ``links`` (node, least); a component is named after its smallest node."""
    a, b = F.col("node"), F.col("least")
    rows = links.select(F.explode(F.array(F.struct(a.alias("v"), b.alias("u")), F.struct(b.alias("v"), a.alias("u")), F.struct(a.alias("v"), a.alias("u")), F.struct(b.alias("v"), b.alias("u")))).alias("x")).select("x.v", "x.u").distinct()
    rows, before = cut(rows), None
    for _ in range(most_rounds):
        state = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head()
        if state == before:
            return rows.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        before = state
        least = rows.groupBy("v").agg(F.min("u").alias("m"))
        joined = skew_safe_join(rows, least, "v")
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        rows = cut(joined.select(F.explode(sent).alias("x")).select("x.v", "x.u").distinct())
    raise RuntimeError("hash-to-min has not settled")


def rendezvous(component: Column, weights: dict[str, float], seed: str = "") -> Column:
    """The split of the highest score ``-weight / ln(u)``, u drawn in (0, 1) from component and split."""
    scores = []
    for split, weight in sorted(weights.items()):
        u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{split}:"), component)), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(split).alias("split")))
    return F.array_max(F.array(*scores))["split"]


def record_nodes(records: DataFrame, owner: str, record: str) -> DataFrame:
    """``records`` with ``node``: the owner, or the record itself where it has none."""
    return records.withColumn("node", F.coalesce(F.col(owner).cast("string"), F.concat(F.lit(ANONYMOUS), F.col(record).cast("string"))))


def assign_splits(records: DataFrame, owner: str, record: str, items: Column, weights: dict[str, float], seed: str = "") -> DataFrame:
    """``record, owner, component, split`` of each record; ``items`` is the column of the record's list of item ids."""
    nodes = record_nodes(records.select(record, owner, items.alias("__items")), owner, record)
    found = components(star_links(nodes.select("node", F.explode("__items").alias("item"))))
    owned = skew_safe_left(nodes.select(record, owner, "node"), found.select("node", "component"), "node")
    out = owned.withColumn("component", F.coalesce("component", "node"))
    return out.select(record, owner, "component", rendezvous(F.col("component"), weights, seed).alias("split"))
