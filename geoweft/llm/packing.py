"""Filling containers of one fixed capacity, with as little unused space as possible.

Sizes are whole numbers, so an instance is a histogram of at most ``capacity`` sizes, whatever the
number of items. The driver solves that histogram and never sees an item:

1. Martello-Toth reduction, in bulk: a set of one, two or three items that dominates every other
   feasible set holding its largest item is fixed, as often as the counts allow.
2. Best-fit decreasing on what is left, again with counts.

The result is a list of (filling, times). Each item finds its container by its rank among the items
of its size, which needs no group in one task: a large size is ranked in buckets of bounded size.

An item above the capacity is cut into full containers and a rest, which is packed like any item.
Items of size 0 or null size take no room: their container is null.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

Filling = tuple[tuple[int, int], ...]  # (size, how many), largest first


def _filling(*sizes: int) -> Filling:
    return tuple(sorted(Counter(sizes).items(), reverse=True))


def _times(count: dict[int, int], filling: Filling) -> int:
    return min(count.get(s, 0) // n for s, n in filling)


def _best_pair(sizes: list[int], have: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two available items whose sum is largest within ``room``; ``sizes`` ascending."""
    best, i, j = None, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room:
            j -= 1
            continue
        if (i < j or have[sizes[i]] > 1) and (best is None or total > sum(best) or (total == sum(best) and sizes[j] > best[0])):
            best = (sizes[j], sizes[i])
        i += 1
    return best


def _dominating(j: int, count: dict[int, int], capacity: int) -> Filling | None:
    """The filling that dominates all feasible sets with an item of size ``j``, if one is provable."""
    room, have = capacity - j, dict(count)
    have[j] -= 1
    sizes = sorted(s for s, n in have.items() if n > 0 and s <= room)
    if not sizes:
        return _filling(j)
    least = [s for s in sizes for _ in range(min(3, have[s]))][:3]
    fit = sum(1 for i in range(len(least)) if sum(least[: i + 1]) <= room)  # 3 means three or more
    largest = sizes[-1]
    if largest == room or fit == 1:
        return _filling(j, largest)
    if fit == 2:
        pair = _best_pair(sizes, have, room)
        if largest >= sum(pair):
            return _filling(j, largest)
        # every feasible pair (x, y), x >= y, has x <= largest; if no y exceeds the pair's smaller item, the triple dominates
        second = max((y for y in sizes if 2 * y <= room and (have[y] > 1 or any(x > y and x + y <= room for x in sizes))), default=0)
        if pair[0] == largest and pair[1] >= second:
            return _filling(j, *pair)
    return None


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[tuple[Filling, int]], dict[int, int]]:
    """Fix dominating sets until none is left: (fillings with their number, the counts that remain)."""
    count, fixed, changed = {s: n for s, n in count.items() if n > 0}, [], True
    while changed:
        changed = False
        for j in sorted(count, reverse=True):
            while count.get(j, 0) > 0 and (filling := _dominating(j, count, capacity)):
                times = _times(count, filling)
                fixed.append((filling, times))
                for s, n in filling:
                    count[s] -= n * times
                    if not count[s]:
                        del count[s]
                changed = True
    return fixed, count


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing with counts: alike containers are filled together."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(filling: dict[int, int], times: int) -> None:
        room = capacity - sum(s * n for s, n in filling.items())
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([filling, times])

    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                filling, room, times = {}, capacity, left
            else:
                room = rooms[at]
                filling, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = min(room // size, left)
            full = min(times, left // each)
            put(filling | {size: each}, full)
            left -= each * full
            if filling and times > full:
                put(filling, times - full)
    return [(tuple(sorted(f.items(), reverse=True)), n) for g in groups.values() for f, n in g]


def plan(count: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, for a histogram of sizes between 1 and ``capacity``."""
    fixed, rest = reduce_instance(count, capacity)
    return fixed + best_fit(rest, capacity)


def pack(items: DataFrame, key: str, size: str, capacity: int, *, per_bucket: int = 100_000) -> DataFrame:
    """``key, part, size, container``: the container of each item (or part of an item above the capacity). ``key`` must be unique."""
    spark = items.sparkSession
    n = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint")
    items = cut(items.select(F.col(f"`{key}`").alias("__key"), n.alias("__n")))
    last = F.greatest(F.ceil(F.col("__n") / capacity) - 1, F.lit(0)).cast("int")
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    parts = parts.withColumn("s", F.least(F.lit(capacity), F.col("__n") - F.col("part").cast("bigint") * capacity).cast("int"))
    count = {r["s"]: r["n"] for r in parts.where("s > 0").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranges, begin, container = [], Counter(), 0
    for filling, times in plan(count, capacity):
        for s, each in filling:
            ranges.append((s, begin[s], begin[s] + each * times, each, container))
            begin[s] += each * times
        container += times
    where = spark.createDataFrame(ranges or [(0, 0, 0, 1, 0)], "s int, low bigint, high bigint, each int, base bigint")
    buckets = spark.createDataFrame([(s, -(-n // per_bucket)) for s, n in count.items()] or [(0, 1)], "s int, buckets int")
    # both tables follow from the plan: their size depends on the capacity, not on the items
    placed = parts.where("s > 0").join(F.broadcast(buckets), "s").withColumn("bucket", F.pmod(F.xxhash64("__key", "part"), F.col("buckets")).cast("int"))
    offsets = placed.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("s", "bucket").orderBy("__key", "part")))
    ranked = ranked.join(offsets, ["s", "bucket"]).withColumn("r", F.col("r") - 1 + F.col("before"))
    found = ranked.join(F.broadcast(where), "s").where("r >= low AND r < high")
    found = found.select("__key", "part", "s", (F.col("base") + F.floor((F.col("r") - F.col("low")) / F.col("each"))).cast("bigint").alias("container"))
    empty = parts.where("s <= 0").select("__key", "part", "s", F.lit(None).cast("bigint").alias("container"))
    return found.unionByName(empty).select(F.col("__key").alias(key), "part", F.col("s").cast("bigint").alias("size"), "container")
