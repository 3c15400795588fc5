"""Aggregates of the methods and the evaluation: medoids, upper medians, modes, histograms, quantiles, error curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_km, np_distance
from ..session import cut
from .datasets import running_sum
from .skew import heavy_candidates, salted_aggregate

FARTHEST_KM = 20038
FALLBACK_KM, FALLBACK_FROM_KM = 100.0, 19_800.0  # the ellipsoidal distance may be the great circle from here on, and is off by less than that


def _near_antipodes(lat: np.ndarray, lon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each member, at least the weight of the members within 0.02 radians of its antipode: those in the 27 cells around it."""
    x, y = np.radians(lat), np.radians(lon)
    at = np.stack([np.cos(x) * np.cos(y), np.cos(x) * np.sin(y), np.sin(x)])
    near = np.zeros(len(lat))

    def code(v: np.ndarray) -> np.ndarray:
        return (v[0] * 128 + v[1]) * 128 + v[2]

    cells, where = np.unique(code(np.floor(at / 0.02).astype(int) + 60), return_inverse=True)
    held = np.bincount(where, weights=weight)
    opposite = np.floor(-at / 0.02).astype(int) + 60
    for step in np.ndindex(3, 3, 3):
        asked = code(opposite + np.reshape(step, (3, 1)) - 1)
        i = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
        near += np.where(cells[i] == asked, held[i], 0.0)
    return near


def np_medoid(lat: np.ndarray, lon: np.ndarray, weight: np.ndarray, order: np.ndarray, kind: str) -> tuple[int, float, np.ndarray]:
    """(index, cost, distances) of the member with the smallest weighted sum of distances; ties go to the smallest ``order``.

    Members are tried from the least lower bound on; |cost(x) - cost(y)| <= W d(x, y) rules most of them out, so time and memory
    stay far below all pairs. Members at one point never rule each other out: merge them first.
    """
    distance, n, total = np_distance(kind), len(lat), weight.sum()
    bound, best, at, away = np.zeros(n), np.inf, -1, np.zeros(n)
    # the computed distance is a metric up to a metre; near antipodes, where the ellipsoidal one gives way to the great circle, up to FALLBACK_KM
    loose = np.full(n, 1e-3 * total) + (FALLBACK_KM * _near_antipodes(lat, lon, weight) if kind == "vincenty" else 0.0)
    open_ = np.ones(n, dtype=bool)
    while open_.any():
        i = int(np.flatnonzero(open_)[np.argmin(bound[open_])])
        open_[i] = False
        if bound[i] > best + 1e-6:
            break
        d = distance(lat[i], lon[i], lat, lon)
        cost = float(round((weight * d).sum(), 6))
        if cost < best or (cost == best and order[i] < order[at]):
            best, at, away = cost, i, d
        least = np.abs(cost - total * d) - loose - loose[i]
        if kind == "vincenty":
            least -= np.where(d > FALLBACK_FROM_KM, total * FALLBACK_KM, 0.0)
        bound = np.maximum(bound, least)
        open_ &= bound <= best + 1e-6
    return at, best, away


def np_medoids(g: dict[str, np.ndarray], key: str, kind: str, near_km: float, plain: int = 48, pairs: int = 1 << 17) -> tuple[np.ndarray, ...]:
    """(row, cost, near, n) of the medoid of each group of the columns ``g`` (key, ord, lat, lon, weight, members), sorted by key and ord.

    Groups of at most ``plain`` points form all pairs, groups of one size at once, ``pairs`` of them in one call.
    """
    starts = np.flatnonzero(np.r_[True, g[key][1:] != g[key][:-1]])
    sizes = np.diff(np.r_[starts, len(g[key])])
    at, cost, n = starts.copy(), np.zeros(len(starts)), np.add.reduceat(g["members"], starts)
    near = n.copy()
    for m in np.unique(sizes[(sizes > 1) & (sizes <= plain)]).tolist():
        same = np.flatnonzero(sizes == m)
        for part in np.array_split(same, -(-len(same) * m * m // pairs)):
            rows = starts[part][:, None] + np.arange(m)
            lat, lon, each = g["lat"][rows], g["lon"][rows], np.arange(len(part))
            d = np_distance(kind)(lat[:, :, None], lon[:, :, None], lat[:, None, :], lon[:, None, :])
            costs = np.array([round(c, 6) for c in (g["weight"][rows][:, None, :] * d).sum(axis=2).ravel().tolist()]).reshape(rows.shape)
            best = costs.argmin(axis=1)  # the first of equal ones
            at[part], cost[part] = rows[each, best], costs[each, best]
            near[part] = np.where(d[each, best] <= near_km, g["members"][rows], 0).sum(axis=1)
    for i in np.flatnonzero(sizes > plain).tolist():
        x = {c: v[starts[i] : starts[i] + sizes[i]] for c, v in g.items()}
        best, cost[i], away = np_medoid(x["lat"], x["lon"], x["weight"], x["ord"], kind)
        at[i], near[i] = starts[i] + best, x["members"][away <= near_km].sum()
    return at, cost, near, n


def spread_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` sorted by ``key`` and ``order`` in as many partitions as a shuffle has, however few bytes they hold: the work on a group grows faster than its bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of sorted Arrow batches as numpy arrays, cut between groups: no group lies in two of them."""
    held: list[dict[str, np.ndarray]] = []

    def join() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in names} if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
        keys = columns[key]
        last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        if last:
            held.append({c: v[:last] for c, v in columns.items()})
        if held and held[-1][key][-1] != keys[-1]:
            yield join()
            held = []
        held.append({c: v[last:] for c, v in columns.items()})
    if held:
        yield join()


def by_group(df: DataFrame, key: str, order: list[str], schema: str, run: Callable[[dict[str, np.ndarray]], tuple | None]) -> DataFrame:
    """Apply ``run`` to the columns of each group, as numpy arrays, in the order of ``order``.

    Groups are cut out of sorted Arrow batches, so many small groups cost one pass instead of one call each.
    """
    names = df.columns
    fields = [f.split()[0] for f in schema.split(", ")]

    def one(parts: list[dict[str, np.ndarray]]) -> tuple | None:
        return run({c: np.concatenate([p[c] for p in parts]) for c in names} if len(parts) > 1 else parts[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        arrow = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            keys = columns[key]
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                piece = {c: v[a:b] for c, v in columns.items()}
                if held and held[0][key][0] != piece[key][0]:
                    rows.append(one(held))
                    held = []
                held.append(piece)
            rows = [r for r in rows if r is not None]
            if rows:
                arrow = [list(x) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrow], names=fields)
        if held and (last := one(held)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], names=fields)

    return spread_by(df, key, order).mapInArrow(scan, schema)


def medoids(points: DataFrame, key: str, *, kind: str = "haversine", near_km: float = 100.0, large: int = 200_000) -> DataFrame:
    """``key, ord, lat, lon, cost, near, n``: the medoid of each group of ``points`` (key, ord, lat, lon, weight).

    ``ord`` breaks ties (smallest wins) and is unique in its group; ``near`` counts the members within ``near_km`` of the medoid.
    Members at one point are merged first: where a hub's neighbours follow the hub, most of them share its point, and all have the same cost.
    Groups of more than ``large`` different points are solved by rounds over the whole cluster instead of in one task.
    """
    points = points.select(key, "ord", "lat", "lon", F.col("weight").cast("double").alias("weight")).where(f"`{key}` IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    merged = points.groupBy(key, "lat", "lon").agg(F.min(F.struct("ord", "lat", "lon")).alias("p"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("members"))
    points = merged.select(key, "p.ord", "p.lat", "p.lon", "weight", "members")
    hot = heavy_candidates(points, key)
    if hot:
        counts = points.where(F.col(key).isin(hot)).groupBy(key).count().where(F.col("count") > large).collect()
        hot = [r[0] for r in counts]
    schema = f"{key} bigint, ord bigint, lat double, lon double, cost double, near bigint, n bigint"
    small = points.where(~F.col(key).isin(hot)) if hot else points
    names = small.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, names, key):
            at, cost, near, n = np_medoids(g, key, kind, near_km)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[key][at], g["ord"][at], g["lat"][at], g["lon"][at], cost, near, n)], names=[f.split()[0] for f in schema.split(", ")])

    out = spread_by(small, key, ["ord"]).mapInArrow(scan, schema)
    return out.unionByName(_large_medoids(points.where(F.col(key).isin(hot)), key, kind, near_km)) if hot else out


def _large_medoids(points: DataFrame, key: str, kind: str, near_km: float, width: int = 64) -> DataFrame:
    """The medoids of few very large groups: in each round, the exact cost of the ``width`` most promising members of each group."""
    points = points if "members" in points.columns else points.withColumn("members", F.lit(1).cast("bigint"))
    spread = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ord")  # rows of one group lie in many tasks
    state = cut(spread.withColumn("bound", F.lit(0.0)))
    every = state.drop("bound")
    totals = {r[0]: r[1] for r in every.groupBy(key).agg(F.sum("weight")).collect()}
    best: dict = {}
    while True:
        ranked = F.row_number().over(Window.partitionBy(key).orderBy("bound", "ord"))
        local = F.row_number().over(Window.partitionBy(key, F.pmod(F.xxhash64("ord"), F.lit(64))).orderBy("bound", "ord"))
        tried = state.withColumn("r", local).where(F.col("r") <= width).withColumn("r", ranked).where(F.col("r") <= width)
        tried = tried.select(F.col(key).alias("k"), F.col("ord").alias("o"), F.col("lat").alias("la"), F.col("lon").alias("lo")).collect()  # at most width rows a group
        if not tried:
            break
        asked = F.broadcast(points.sparkSession.createDataFrame([tuple(r) for r in tried], f"k {dict(points.dtypes)[key]}, o bigint, la double, lo double"))
        d = distance_km(kind, F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
        costs = every.join(asked, F.col(key) == F.col("k")).groupBy("k", "o", "la", "lo").agg(F.round(F.sum(F.col("weight") * d), 6).alias("cost")).collect()
        for r in costs:
            if r["k"] not in best or (r["cost"], r["o"]) < (best[r["k"]][0], best[r["k"]][1]):
                best[r["k"]] = (r["cost"], r["o"], r["la"], r["lo"])
        known = F.broadcast(points.sparkSession.createDataFrame([(r["k"], r["o"], r["la"], r["lo"], r["cost"], best[r["k"]][0], totals[r["k"]]) for r in costs], f"k {dict(points.dtypes)[key]}, o bigint, la double, lo double, cost double, best double, total double"))
        bound = F.max(F.abs(F.col("cost") - F.col("total") * d) - F.lit(0.0 if kind == "haversine" else 0.01) * F.col("cost"))
        state = state.join(known, F.col(key) == F.col("k")).groupBy(key, "ord", "lat", "lon", "weight", "bound").agg(bound.alias("b"), F.max(F.col("ord") == F.col("o")).alias("done"), F.first("best").alias("best"))
        state = cut(state.where("NOT done").select(key, "ord", "lat", "lon", "weight", F.greatest("bound", "b").alias("bound"), "best").where("bound <= best + 1e-6").drop("best"))
    rows = [(k, o, la, lo, c) for k, (c, o, la, lo) in best.items()]
    found = F.broadcast(points.sparkSession.createDataFrame(rows, f"k {dict(points.dtypes)[key]}, o bigint, la double, lo double, cost double"))
    d = distance_km(kind, F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    counted = every.join(found, F.col(key) == F.col("k")).groupBy("k", "o", "la", "lo", "cost").agg(F.sum(F.when(d <= near_km, F.col("members")).otherwise(0)).alias("near"), F.sum("members").alias("n"))
    return counted.select(F.col("k").cast("bigint").alias(key), F.col("o").alias("ord"), F.col("la").alias("lat"), F.col("lo").alias("lon"), "cost", "near", "n")


def upper_median(df: DataFrame, key: str | None, value: str, name: str) -> DataFrame:
    """The element at position ``n div 2`` of each group's sorted values (the upper one of two middles).

    Values are counted first, so repeated values of a large group collapse before they are sorted; one global group is sorted in ranges.
    """
    keys = [key] if key else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    if not key:
        placed, total = running_sum(counts, value, "__n", "__to")
        return placed.where(F.col("__to") > total // 2).agg(F.min(value).alias(name))
    over = Window.partitionBy(key)
    placed = counts.withColumn("__to", F.sum("__n").over(over.orderBy(value))).withColumn("__half", F.floor(F.sum("__n").over(over) / 2))
    return placed.where(F.col("__to") > F.col("__half")).groupBy(key).agg(F.min(value).alias(name))


def modes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, the most frequent combination of ``columns`` and its count as ``votes``; ties go to the smallest combination."""
    counts = df.groupBy(key, *columns).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("__v"), *columns)).alias("b")
    return counts.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}") for c in columns], (-F.col("b.__v")).cast("bigint").alias("votes"))


def centroids(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Mean point of each key with at least ``least`` located rows. Sums are decimal, so the order of the rows never shows in the mean."""
    rows = df.where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180").withColumns({c: F.col(c).cast("decimal(24,20)") for c in ("lat", "lon")})
    out = salted_aggregate(rows, key, {"lat": ("sum", "lat"), "lon": ("sum", "lon"), "n": ("count", None)})
    return out.where(F.col("n") >= least).withColumns({c: F.col(c).cast("double") / F.col("n") for c in ("lat", "lon")})


def histogram(df: DataFrame, value: Column, name: str = "bin") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def error_histogram(errors: DataFrame, km: str) -> DataFrame:
    """``km, count`` over whole kilometres from 0 to the farthest distance; at most 20,039 rows."""
    spark = errors.sparkSession
    counts = errors.where(F.col(km).isNotNull()).groupBy(F.least(F.floor(F.col(km) + 0.5), F.lit(FARTHEST_KM)).cast("bigint").alias("km")).agg(F.count(F.lit(1)).alias("count"))
    return spark.range(FARTHEST_KM + 1).withColumnRenamed("id", "km").join(counts, "km", "left").select("km", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def error_cdf(errors: DataFrame, km: str) -> DataFrame:
    """``km, count, cdf``: share of errors of at most ``km`` kilometres. The window runs over 20,039 rows at most."""
    hist = error_histogram(errors, km)
    running, total = F.sum("count").over(Window.orderBy("km")), F.sum("count").over(Window.partitionBy())
    return hist.select("km", "count", F.when(total > 0, running / total).otherwise(F.lit(0.0)).alias("cdf"))


def error_auc(cdf: DataFrame) -> DataFrame:
    """Area under the error curve over a logarithmic distance axis, scaled to [0, 1]; the curve is a step function, so the area is a sum."""
    upper, lower = F.least(F.col("km") + 0.5, F.lit(float(FARTHEST_KM))), F.greatest(F.col("km") - 0.5, F.lit(1.0))
    width = (F.log10(upper) - F.log10(lower)) / F.log10(F.lit(float(FARTHEST_KM)))
    return cdf.where("km >= 1").agg(F.sum(F.col("cdf") * width).alias("auc"))


def quantile_bounds(df: DataFrame, value: str, parts: int) -> DataFrame:
    """``j, bound``: the value at position ``j n div parts`` of the sorted values, j from 0; values are counted before they are sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed, total = running_sum(counts, "v", "c", "to")
    wanted = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(j * total // parts).cast("bigint").alias("at")) for j in range(parts)])
    found = placed.select("v", "c", "to", F.explode(F.filter(wanted, lambda w: (F.col("to") > w["at"]) & (F.col("to") - F.col("c") <= w["at"]))).alias("w"))
    return found.select(F.col("w.j").alias("j"), F.col("v").alias("bound"))
