"""Distances and coordinates, as Column expressions; the ellipsoidal distance is an Arrow UDF over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MILES_PER_KM = 0.621371
#: The WGS-84 ellipsoid.
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres; null where a coordinate is null."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * F.lit(MILES_PER_KM)


def known_distance(distance: Column) -> Column:
    """The distance, or -1 where a side has no location."""
    return F.coalesce(distance, F.lit(-1.0))


def np_haversine_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, dtype=float)) for v in (lat1, lon1, lat2, lon2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def np_vincenty_km(lat1, lon1, lat2, lon2, rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Kilometres on the WGS-84 ellipsoid by Vincenty's inverse formula; the great circle where it does not converge (antipodes)."""
    lat1, lon1, lat2, lon2 = (np.asarray(v, dtype=float) for v in (lat1, lon1, lat2, lon2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1))), np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    span = np.radians(lon2 - lon1)
    span = (span + np.pi) % (2 * np.pi) - np.pi
    s1, c1, s2, c2, span = np.broadcast_arrays(np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), span)
    shape, far = span.shape, np_haversine_km(lat1, lon1, lat2, lon2).ravel()
    s1, c1, s2, c2, span = (v.ravel() for v in (s1, c1, s2, c2, span))
    lam, at = span, np.arange(len(span))  # pairs that have converged leave, so few slow ones don't hold up the rest
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sl / np.where(sin_s == 0, 1, sin_s))
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2_a == 0, 1, cos2_a))
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            new = span + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            done = np.abs(new - lam) < tolerance
            lam = new
            if not done.any():
                continue
            u = cos2_a[done] * (WGS84_A**2 - b**2) / b**2
            sin_s, cos_s, cos_m, sigma = sin_s[done], cos_s[done], cos_m[done], sigma[done]
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            delta = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
            out = b * big_a * (sigma - delta)
            far[at[done]] = np.where(np.isfinite(out), out, far[at[done]])
            at, lam, s1, c1, s2, c2, span = (v[~done] for v in (at, lam, s1, c1, s2, c2, span))
            if not len(at):
                break
    return far.reshape(shape)


def np_distance(kind: str):
    return {"haversine": np_haversine_km, "vincenty": np_vincenty_km}[kind]


def vincenty_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Ellipsoidal kilometres; null where a coordinate is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = np_vincenty_km(a, b, c, d)
        return pd.Series(np.where(a.isna() | b.isna() | c.isna() | d.isna(), np.nan, out)).astype(object).where(lambda s: s.notna(), None).astype("Float64")

    return run(lat1, lon1, lat2, lon2)


def distance_km(kind: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (vincenty_km if kind == "vincenty" else haversine_km)(lat1, lon1, lat2, lon2)


def valid_coord(lat: Column, lon: Column) -> Column:
    """Whether both values are in range; false where one is null."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def wrap_lon(lon: Column) -> Column:
    """Longitude brought into [-180, 180] by whole turns; values in range stay as they are."""
    turns = F.when(lon > 180, -F.ceil((lon - 180) / 360)).when(lon < -180, F.ceil((-180 - lon) / 360)).otherwise(F.lit(0))
    return lon + turns * F.lit(360.0)


def wrap_lat(lat: Column) -> Column:
    """Latitude brought into [-90, 90] by steps of 180; values in range stay as they are."""
    steps = F.when(lat > 90, -F.ceil((lat - 90) / 180)).when(lat < -90, F.ceil((-90 - lat) / 180)).otherwise(F.lit(0))
    return lat + steps * F.lit(180.0)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounding half away from zero on the binary value."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def parse_coordinates(text: Column) -> Column:
    """A point written in free text, as ``struct<lat, lon>``: two decimals, or degrees with minutes (and seconds) and N/S/E/W. Null if none."""
    dec = r"^\s*([+-]?\d{1,3}(?:\.\d+)?)[,;\s]+([+-]?\d{1,3}(?:\.\d+)?)\s*$"
    dms = r"""(?i)(\d{1,3})[°\s]+(\d{1,2})['’\s]*(?:(\d{1,2}(?:\.\d+)?)["”\s]*)?([NS])[,;\s]+(\d{1,3})[°\s]+(\d{1,2})['’\s]*(?:(\d{1,2}(?:\.\d+)?)["”\s]*)?([EW])"""

    def part(i: int) -> Column:
        degrees = F.try_to_number(F.regexp_extract(text, dms, i), F.lit("999")).cast("double")
        rest = F.coalesce(F.regexp_extract(text, dms, i + 1).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(F.regexp_extract(text, dms, i + 2).try_cast("double"), F.lit(0.0)) / 3600
        return (degrees + rest) * F.when(F.upper(F.regexp_extract(text, dms, i + 3)).isin("S", "W"), -1.0).otherwise(1.0)

    plain = [F.regexp_extract(text, dec, i).try_cast("double") for i in (1, 2)]
    point = F.when(text.rlike(dec), F.struct(plain[0].alias("lat"), plain[1].alias("lon"))).when(text.rlike(dms), F.struct(part(1).alias("lat"), part(5).alias("lon")))
    return F.when(valid_coord(point["lat"], point["lon"]), point)
