"""Exactly one copy of each message that was delivered at least once.

Rows are partitioned by message identifier, ranked by arrival with a deterministic tie-break, and the
first is kept. An identifier that holds a large share of all rows is ranked per salt first; the
salts' firsts (at most ``salts`` per identifier, at most ``1 / support`` identifiers) then decide.

A null identifier names no message: such rows are neither copies nor kept copies (``ranked`` leaves
them out). Order columns must identify a row; equal order values would be cut by nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import SALT, heavy_candidates, with_salt

FIRST = "__is_first"


def ranked(df: DataFrame, key: str, order: list[str], *, salts: int = 64, support: float = 0.002) -> DataFrame:
    """The rows with a non-null ``key``, with the column ``FIRST``: whether the row is the first of its key by ``order``."""
    rows = df.where(F.col(f"`{key}`").isNotNull())
    heavy = heavy_candidates(rows, key, support)
    salted = with_salt(rows, key, heavy, salts, order)
    within = Window.partitionBy(f"`{key}`", SALT).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order])
    local = salted.withColumn("__rank", F.row_number().over(within))
    if not heavy:
        return local.withColumn(FIRST, F.col("__rank") == 1).drop("__rank", SALT)
    arrival = F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in order])
    firsts = (
        salted.where(F.col(f"`{key}`").isin(heavy)).groupBy(F.col(f"`{key}`").alias("__key"), SALT).agg(F.min(arrival).alias("__a"))
        .groupBy("__key").agg(F.min("__a").alias("__first"))
    )
    out = local.join(F.broadcast(firsts), F.col(f"`{key}`") == F.col("__key"), "left")
    first = (F.col("__rank") == 1) & (F.col("__first").isNull() | (F.col("__first") == arrival))
    return out.withColumn(FIRST, first).drop("__rank", "__key", "__first", SALT)


def excess_deliveries(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every row with a non-null ``key`` except the first of that key."""
    return ranked(df, key, order).where(~F.col(FIRST)).drop(FIRST)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each non-null ``key``."""
    return ranked(df, key, order).where(F.col(FIRST)).drop(FIRST)


def new_messages(batch: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of a new ``batch``, the first row of each key that is not stored yet.

    The batch is reduced to one row per key before the anti-join, so a key repeated in it cannot skew the join.
    """
    return keep_first(batch, key, order).join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
