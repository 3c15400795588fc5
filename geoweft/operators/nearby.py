"""Points near other points or regions, by cells of a space-filling curve.

A point becomes the Morton code of its place in the cube around the sphere (three axes, 16 bits
each), so poles and the date line need no special case. A disc is covered by at most eight aligned
cells of a level whose cells are at least twice as wide as the disc's radius; a cell is a range of
codes, ``[c << k, (c + 1) << k)``. Because the ranges are aligned, the range-join is a merge join
on the codes' prefixes, which Spark sorts. Candidates are then refined by great-circle distance.

Cells with many points are split: queries of such a cell get a salt, its points one copy per salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import heavy_candidates

EARTH_M = 6_371_000.0
BITS = 16


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of radius 6,371 km (haversine)."""
    a = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a[0] * a[0] + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * a[1] * a[1]
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def valid_point(values: Column) -> Column:
    """Whether an array is a point: exactly two values, in range, not both 0. Null values make it none."""
    lat, lon = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    ok = (F.size(values) == 2) & F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def axes(lat: Column, lon: Column) -> list[Column]:
    """The point on the sphere, in metres, shifted so that all values are positive."""
    la, lo = F.radians(lat), F.radians(lon)
    return [EARTH_M * (F.cos(la) * F.cos(lo) + 1), EARTH_M * (F.cos(la) * F.sin(lo) + 1), EARTH_M * (F.sin(la) + 1)]


def _spread(v: Column) -> Column:
    """Move bit i of a 16-bit number to bit 3 i. A product stands for ``v | v << n``, as the bits never meet; each step names ``v`` once."""
    for shift, mask in ((16, 0xFF0000FF), (8, 0xF00F00F00F), (4, 0xC30C30C30C3), (2, 0x249249249249)):
        v = (v * F.lit((1 << shift) + 1)).bitwiseAND(F.lit(mask))
    return v


def morton(cells: list[Column]) -> Column:
    """Interleave three cell numbers into one code."""
    x, y, z = (_spread(c.cast("bigint")) for c in cells)
    return x + y * 2 + z * 4


def level_for(radius_m: float) -> int:
    """The finest level whose cells are at least twice as wide as ``radius_m``."""
    return max(0, min(BITS, math.floor(math.log2(2 * EARTH_M / (2 * radius_m)))))


def cell_of(lat: Column, lon: Column, level: int) -> Column:
    """Code prefix of the level's cell that holds the point."""
    width = 2 * EARTH_M * (1 + 1e-9) / (1 << level)
    return morton([F.floor(a / width) for a in axes(lat, lon)])


def with_disc_cells(df: DataFrame, radius_m: float, level: int) -> DataFrame:
    """One row for each of the level's cells that the disc around (lat, lon) may touch (at most eight), with its code as ``cell``."""
    width = 2 * EARTH_M * (1 + 1e-9) / (1 << level)
    top, reach = (1 << level) - 1, radius_m * (1 + 1e-9) + 1e-6
    for name, a in zip(("__x", "__y", "__z"), axes(F.col("lat"), F.col("lon")), strict=True):  # one Generate per axis keeps the code small
        low, high = F.greatest(F.lit(0), F.floor((a - reach) / width)), F.least(F.lit(top), F.floor((a + reach) / width))
        df = df.withColumn(name, F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return df.withColumn("cell", morton([F.col("__x"), F.col("__y"), F.col("__z")])).drop("__x", "__y", "__z")


def _spread_hot(queries: DataFrame, points: DataFrame, per_task: int) -> tuple[DataFrame, DataFrame]:
    """Split the cells that hold much of all points: a salt for each query, a copy of the point for each salt."""
    hot = heavy_candidates(points, "cell", 0.002, always=True)
    sizes = {}
    if hot:
        counts = points.where(F.col("cell").isin(hot)).groupBy("cell").count().where(F.col("count") > per_task).collect()  # at most 500 cells
        sizes = {r["cell"]: min(4096, math.ceil(r["count"] / per_task)) for r in counts}
    if not sizes:
        return queries.withColumn("salt", F.lit(0)), points.withColumn("salt", F.lit(0))
    n = F.coalesce(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("cell")], F.lit(1))
    return (
        queries.withColumn("salt", F.pmod(F.xxhash64("q_id"), n).cast("int")),
        points.withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))),
    )


def pairs_within(points: DataFrame, radius_m: float, *, per_task: int = 20_000) -> DataFrame:
    """Pairs ``(id_a, id_b, meters)``, id_a < id_b, of points at most ``radius_m`` apart. ``points``: id (unique), lat, lon.

    Each disc asks only its own cell and those with a larger code, so each pair of cells is looked at once.
    Points with a null coordinate or id have no neighbours.
    """
    level = level_for(radius_m)
    base = points.where("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    base = base.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), level))
    queries = with_disc_cells(base.withColumnRenamed("cell", "own"), radius_m, level).where("cell >= own")
    queries = queries.select(F.col("id").alias("q_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "own", "cell")
    queries, stored = _spread_hot(queries, base, per_task)
    near = queries.join(stored, ["cell", "salt"]).where((F.col("own") != F.col("cell")) | (F.col("q_id") < F.col("id")))
    near = near.withColumn("meters", great_circle_m(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))).where(F.col("meters") <= radius_m)
    return near.select(F.least("q_id", "id").alias("id_a"), F.greatest("q_id", "id").alias("id_b"), "meters")


def regions_holding(points: DataFrame, discs: DataFrame, radius_m: float) -> DataFrame:
    """Pairs ``(id, region_id, meters)``: the discs of ``radius_m`` around ``discs`` (region_id, lat, lon) that hold each point."""
    level = level_for(radius_m)
    base = points.where("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    base = base.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), level))
    regions = with_disc_cells(discs.where("lat IS NOT NULL AND lon IS NOT NULL").select("region_id", "lat", "lon"), radius_m, level)
    regions = regions.select(F.col("region_id").alias("q_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "cell")
    stored, asked = base.withColumn("salt", F.lit(0)), regions.withColumn("salt", F.lit(0))
    hot = heavy_candidates(base, "cell", 0.002, always=True)
    if hot:  # the points of a hot cell draw a salt, the discs over it are copied to each salt
        salts = 32
        stored = base.withColumn("salt", F.when(F.col("cell").isin(hot), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0))
        asked = regions.withColumn("salt", F.explode(F.when(F.col("cell").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    near = stored.join(asked, ["cell", "salt"]).withColumn("meters", great_circle_m(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")))
    return near.where(F.col("meters") <= radius_m).select("id", F.col("q_id").alias("region_id"), "meters")
