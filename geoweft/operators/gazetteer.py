"""The gazetteer: names to points, noisy names to points, points to names.

A key joins a city with its region and country by tabs, in lower case. The gazetteer is a reference
list of bounded size; Spark broadcasts it when it is below the session's threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_km
from .skew import skew_safe_join

TAB = "\t"
NEAR_KM = 20.0


def standard(rows: DataFrame, seq: str = "place_id") -> DataFrame:
    """``seq, city, region, country, lat, lon`` in lower case; rows without a city or point drop out."""
    out = rows.select(F.col(seq).alias("seq"), *[F.lower(F.trim(c)).alias(c) for c in ("city", "region", "country")], F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return out.where("city IS NOT NULL AND city <> '' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")


def names(places: DataFrame, bare: bool = True) -> DataFrame:
    """``name, lat, lon``: every key of every place; of equal keys the place with the largest ``seq`` holds.

    With ``bare``, a city alone is a key when only one place bears the name.
    """
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    keys = F.array(
        F.when(full("region") & full("country"), F.concat_ws(TAB, "city", "region", "country")),
        F.when(full("region"), F.concat_ws(TAB, "city", "region")),
        F.when(full("country") & (F.col("city") != F.col("country")), F.concat_ws(TAB, "city", "country")),
        F.when(F.col("city") == F.col("country"), F.col("city")),
    )
    each = places.select("seq", "lat", "lon", F.explode(F.array_distinct(F.array_compact(keys))).alias("name"))
    if bare:
        each = each.unionByName(unambiguous(places).select("seq", "lat", "lon", F.col("city").alias("name")))
    return each.groupBy("name").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("p")).select("name", "p.lat", "p.lon")


def unambiguous(places: DataFrame) -> DataFrame:
    """Places whose city name occurs once."""
    return places.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("seq", "lat", "lon")).alias("p")).where("n = 1").select("city", "p.seq", "p.lat", "p.lon")


def geocode(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``rows`` with the point of the exact, lower-cased name; null where there is none."""
    return rows.withColumn("__name", F.lower(F.col(text))).join(known.withColumnRenamed("name", "__name"), "__name", "left").drop("__name")


def _swap_saint(c: Column) -> list[Column]:
    return [F.regexp_replace(c, r"\bst\. ?", "saint "), F.regexp_replace(c, r"\bsaint\b", "st.")]


def candidate_keys(text: Column, codes: dict[str, str] | None = None) -> Column:
    """The keys that a free-text place may stand for, the likeliest first.

    Prefixes such as "downtown" fall away, country and state abbreviations are written out, and the
    parts between commas, hyphens or bars (or two words) are read as city and region in either order.
    """
    t = F.trim(text)
    t = F.regexp_replace(t, r"^(?:the city of |downtown )", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\bUSA\b|\bUS\b", "United States"), r"\bUK\b", "United Kingdom")
    if codes:
        pattern = r"\b(" + "|".join(sorted(codes, key=lambda c: (-len(c), c))) + r")\b"
        first = F.regexp_extract(t, pattern, 1)  # only the first abbreviation is written out
        written = F.create_map(*[F.lit(x) for kv in sorted(codes.items()) for x in kv])[first]
        t = F.when(first != "", F.concat(F.regexp_extract(t, rf"^(.*?)(?:{pattern})", 1), written, F.regexp_replace(t, rf"^.*?(?:{pattern})", ""))).otherwise(t)
    t = F.lower(t)
    t = F.when(t == "nyc", F.lit("new york, new york")).otherwise(t)
    t = F.regexp_replace(t, r"(?U)^\W+|\W+$", "")
    split = F.filter(F.transform(F.split(t, r"[,\-|]+"), lambda p: F.trim(p)), lambda p: p != "")
    blank = F.split(t, r"\s+")
    parts = F.when(t.rlike(r"[,\-|]"), split).when(F.size(blank) == 2, blank).otherwise(F.array().cast("array<string>"))
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    two = [F.concat_ws(TAB, a, b), F.concat_ws(TAB, b, a), a]
    three = [F.concat_ws(TAB, a, b), F.concat_ws(TAB, a, c), a]
    swapped_two = [v for x, y in (_swap_saint(F.concat_ws(TAB, a, b)), _swap_saint(F.concat_ws(TAB, b, a)), _swap_saint(a)) for v in (x, y)]
    swapped_three = [_swap_saint(k)[i] for i in (0, 1) for k in three]
    chosen = F.when(F.size(parts) == 2, F.array(*two, *swapped_two)).when(F.size(parts) == 3, F.array(*three, *swapped_three)).otherwise(F.array().cast("array<string>"))
    return F.when(t != "", F.array_distinct(F.concat(chosen, F.array(t))))


def geocode_noisy(rows: DataFrame, key: str, text: str, known: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """``key, lat, lon`` of the rows whose text has a key in the gazetteer; the first key that is known decides. Each distinct text is read once."""
    asked = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    texts = asked.select("__text").distinct()
    each = texts.select("__text", F.posexplode(candidate_keys(F.col("__text"), codes)).alias("pos", "name"))
    found = each.join(known, "name").groupBy("__text").agg(F.min_by(F.struct("lat", "lon"), "pos").alias("p"))
    return skew_safe_join(asked, found, "__text").select(F.col("__key").alias(key), "p.lat", "p.lon")


def cells(lat: Column, lon: Column) -> list[Column]:
    """The cell of a hundredth of a degree, half away from zero."""
    return [(F.signum(v) * F.floor(F.abs(v) * 100 + 0.5)).cast("int") for v in (lat, lon)]


def reverse_geocode(points: DataFrame, key: str, places: DataFrame, kind: str = "vincenty") -> DataFrame:
    """``key, seq, city, region, country``: the nearest place in the point's cell, else in the eight cells around it.

    The few places are copied to the nine cells around each, so a point looks up one cell only. ``key`` must be unique.
    """
    x, y = cells(F.col("lat"), F.col("lon"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = places.withColumn("cx", x).withColumn("cy", y).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    around = around.select("seq", "city", "region", "country", F.col("lat").alias("plat"), F.col("lon").alias("plon"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), ((F.col("dx") != 0) | (F.col("dy") != 0)).alias("ring"))
    asked = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col(key).alias("__key"), "lat", "lon", x.alias("cx"), y.alias("cy"))
    near = asked.join(around, ["cx", "cy"]).withColumn("km", distance_km(kind, F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
    best = F.min(F.struct((F.col("ring") | (F.col("km") >= NEAR_KM)).alias("r"), F.round("km", 6).alias("km"), "seq", "city", "region", "country")).alias("b")
    return near.groupBy("__key").agg(best).select(F.col("__key").alias(key), "b.seq", "b.city", "b.region", "b.country")


def canonicalize(points: DataFrame, key: str, places: DataFrame, kind: str = "vincenty") -> DataFrame:
    """``key, lat, lon``: the point of the settlement at each point, or the point itself where there is none."""
    found = reverse_geocode(points, key, places, kind).select(F.col(key), F.concat_ws(TAB, "city", "region", "country").alias("name"))
    known = found.join(names(places), "name", "left").select(F.col(key), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return points.join(known, key, "left").select(key, F.coalesce("clat", "lat").alias("lat"), F.coalesce("clon", "lon").alias("lon"))


def level_name(name: Column, level: int) -> Column:
    """City, region or country (0, 1, 2) of a full key."""
    return F.get(F.split(name, TAB), F.lit(level))
