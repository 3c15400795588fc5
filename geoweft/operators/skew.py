"""Two-stage salted aggregation and joins for tables in which a few keys hold most of the rows.

Heavy keys are found by one streaming pass of bounded size (a frequent-items sketch of ``TRACKED`` counters,
whatever the input). A key is heavy by its share of the rows or, in large tables, by its number of rows.
Only heavy keys get a salt, so light keys take the plain way: partial results per (key, salt), then one
merge per key over at most ``salts`` partials.

Null keys form a group of their own, as in SQL. Salts are drawn from the row's content, so a
recomputed task draws the same ones. Empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

SALT = "__salt"
TRACKED = 8192  # counters of the sketch of frequent keys
MOST_HEAVY = 2500  # keys above the sketch's error are fewer than TRACKED / 3.5
SMALL_BYTES = 32 << 20  # input below this is one task's work, however skewed
SCALES = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}  # larger units are never small
HEAVY_ROWS = 1_000_000  # a key of more rows is heavy, however large the table


def is_small(df: DataFrame) -> bool:
    """Whether the planner puts ``df`` below ``SMALL_BYTES``; joins are overstated, so this speaks for little data."""
    size, unit = re.search(r"sizeInBytes=(\S+) (\w+)", df._jdf.queryExecution().optimizedPlan().stats().simpleString()).groups()
    return unit in SCALES and float(size) * SCALES[unit] < SMALL_BYTES


def heavy_candidates(df: DataFrame, key: str, support: float = 0.005, rows: int = HEAVY_ROWS, *, always: bool = False) -> list:
    """Every value of ``key`` that holds more than ``support`` of the non-null rows, or more than ``rows`` rows; at most ``TRACKED`` values, some may be lighter.

    Tables that the planner puts below ``SMALL_BYTES`` have none, as one task can take them whole, unless ``always`` is set (where work grows faster than rows). The sketch overstates a count by at most 3.5 / TRACKED of the rows, so in tables above ``rows`` * TRACKED / 3.5 (2.3 billion) rows that share takes the place of ``rows``.
    """
    if not always and is_small(df):
        return []
    found = df.select(F.col(key).alias("k")).where("k IS NOT NULL").agg(F.count("k").alias("n"), F.expr(f"approx_top_k(k, {MOST_HEAVY}, {TRACKED})").alias("top")).head()
    least = min(support * found["n"], max(rows, found["n"] * 3.5 / TRACKED))
    return [r["item"] for r in found["top"] or () if r["count"] > least]


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A hash of the row's content, over ``columns`` or all columns that can be hashed cheaply."""
    nested = (ArrayType, MapType, StructType, VariantType)
    columns = columns or [f.name for f in df.schema if not isinstance(f.dataType, nested)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def with_salt(df: DataFrame, key: str, heavy: list, salts: int, salt_on: list[str] | None = None) -> DataFrame:
    """Add the salt column: 0 for light keys, one of ``salts`` numbers for heavy ones."""
    if not heavy:
        return df.withColumn(SALT, F.lit(0))
    salt = F.pmod(row_hash(df, salt_on), F.lit(salts)).cast("int")
    return df.withColumn(SALT, F.when(F.col(f"`{key}`").isin(heavy), salt).otherwise(F.lit(0)))


def salted_aggregate(
    df: DataFrame,
    key: str,
    aggregates: Mapping[str, tuple[str, str | None]],
    *,
    salts: int = 64,
    support: float = 0.005,
    salt_on: list[str] | None = None,
) -> DataFrame:
    """Group ``df`` by ``key`` without letting a heavy key fill one task.

    ``aggregates`` maps a result name to (function, column); functions are ``count`` (rows when the
    column is None, else non-null values), ``sum``, ``min``, ``max``, ``avg`` and ``count_distinct``.
    Distinct values are first reduced to one row per (key, value), which spreads a heavy key by its values.
    """
    heavy = heavy_candidates(df, key, support)
    salted = with_salt(df, key, heavy, salts, salt_on)
    partial: list[Column] = []
    merge: list[Column] = []
    distinct: dict[str, str] = {}
    for name, (kind, column) in aggregates.items():
        value = F.lit(1) if column is None else F.col(f"`{column}`")
        if kind == "count":
            partial.append(F.count(value).alias(f"{name}__n"))
            merge.append(F.sum(f"{name}__n").alias(name))
        elif kind in ("sum", "min", "max"):
            partial.append(getattr(F, kind)(value).alias(f"{name}__v"))
            merge.append(getattr(F, kind)(f"{name}__v").alias(name))
        elif kind == "avg":
            partial += [F.sum(value).alias(f"{name}__v"), F.count(value).alias(f"{name}__n")]
            merge.append(F.try_divide(F.sum(f"{name}__v"), F.sum(f"{name}__n")).alias(name))
        elif kind == "count_distinct":
            distinct[name] = str(column)
        else:
            raise ValueError(f"unknown aggregate: {kind}")
    if not partial:
        partial, merge = [F.count(F.lit(1)).alias("__rows__n")], [F.sum("__rows__n").alias("__rows")]
    k = F.col(f"`{key}`")
    out = salted.groupBy(k.alias(key), SALT).agg(*partial).groupBy(f"`{key}`").agg(*merge)
    for name, column in distinct.items():
        pairs = df.select(k.alias(key), F.col(f"`{column}`").alias("__value")).where("__value IS NOT NULL").distinct()
        counts = with_salt(pairs, key, heavy, salts, ["__value"]).groupBy(f"`{key}`", SALT).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.groupBy(k.alias("__key")).agg(F.sum("n").alias("__n"))
        out = out.join(counts, F.col(f"`{key}`").eqNullSafe(F.col("__key")), "left").withColumn(name, F.coalesce("__n", F.lit(0)).cast("bigint")).drop("__key", "__n")
    return out.select(F.col(f"`{key}`"), *[F.col(f"`{n}`") for n in aggregates])


def keys_by_share(df: DataFrame, key: str, share: float, *, salt_on: list[str] | None = None) -> DataFrame:
    """Each non-null key that holds at least ``share`` of all rows of ``df`` (rows with a null key count in the total)."""
    total = df.count()
    counts = salted_aggregate(df, key, {"rows": ("count", None)}, support=min(share, 0.5) / 4, salt_on=salt_on)
    return counts.where(F.col(f"`{key}`").isNotNull() & (F.col("rows") >= F.lit(share * total)))


def _salted_sides(left: DataFrame, right: DataFrame, key: str, heavy: list, salts: int, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: heavy left rows (and null keys, with ``nulls``) draw one, heavy right rows are copied to each."""
    spread = F.col(key).isin(heavy) if heavy else F.lit(False)
    drawn = F.pmod(row_hash(left), F.lit(salts)).cast("int")
    a = left.withColumn(SALT, F.when(F.col(key).isNull() if nulls else F.lit(False), drawn).when(spread, drawn).otherwise(F.lit(0)))
    return a, right.withColumn(SALT, F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, support: float = 0.005, *, salts: int = 64) -> DataFrame:
    """Inner join in which rows of heavy left keys never meet in one task; a ``right`` that holds each key once is copied ``salts`` times for heavy keys. Null keys match nothing.

    Both sides are read once, besides the pass over the left key that finds the heavy ones.
    """
    heavy = heavy_candidates(left, key, support)
    if not heavy:
        return left.join(right, key)
    a, b = _salted_sides(left, right, key, heavy, salts, False)
    return a.join(b, [key, SALT]).drop(SALT)


def skew_safe_left(left: DataFrame, right: DataFrame, key: str, support: float = 0.005, *, salts: int = 64) -> DataFrame:
    """Left join as :func:`skew_safe_join`; rows with a null key stay, unmatched, and are spread too."""
    a, b = _salted_sides(left, right, key, heavy_candidates(left, key, support), salts, True)
    return a.join(b, [key, SALT], "left").drop(SALT)


def skew_safe_semi(left: DataFrame, right: DataFrame, key: str, support: float = 0.005, *, anti: bool = False) -> DataFrame:
    """The rows of ``left`` whose key is (or, with ``anti``, is not) in ``right``; null keys are in nothing."""
    a, b = _salted_sides(left, right.select(key).where(F.col(key).isNotNull()).distinct(), key, heavy_candidates(left, key, support), 64, anti)
    return a.join(b, [key, SALT], "left_anti" if anti else "left_semi").drop(SALT).select(*left.columns)
