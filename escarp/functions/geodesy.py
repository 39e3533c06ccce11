"""Geodesics on the WGS84 ellipsoid by Vincenty's formulae, over columns and numpy arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ellipsoid.
A = 6378137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)
ROUNDS = 8


@F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("azimuth", T.DoubleType())]))
def inverse(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.DataFrame:
    """struct(distance in metres, azimuth in degrees within (-180, 180]); distance 0 and azimuth 180 if the points
    coincide, null if any coordinate is.  Arrow batches: some ten times faster than nested column expressions."""
    points = [x.to_numpy(dtype=float) for x in (lat1, lng1, lat2, lng2)]
    metres, degrees = inverse_np(*points)
    missing = np.isnan(points).any(axis=0)
    return pd.DataFrame({"distance": np.where(missing, np.nan, metres), "azimuth": np.where(missing, np.nan, degrees)})


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres; 0 where the formula has no finite value, null where a coordinate is."""
    return inverse(lat1, lng1, lat2, lng2)["distance"]


def azimuth(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return inverse(lat1, lng1, lat2, lng2)["azimuth"]


def turn_angle(b1: Column, b2: Column) -> Column:
    """The change of direction, within [0, 180] degrees."""
    turn = F.abs(b2 - b1) % 360
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def degrees_box(lat: float, metres: float) -> tuple[float, float]:
    """Half the height and width, in degrees, of a box that surely holds all points within some metres."""
    height = metres / 110_500 + 1e-9
    edge = min(89.9, abs(lat) + height)
    return height, min(360.0, metres / (111_000 * float(np.cos(np.radians(edge)))) + 1e-9)


def within(lat: Column, lng: Column, lat0: float, lng0: float, metres: float) -> Column:
    """Whether a point lies within some metres of a given one, both inclusive; a box that the scan can use first."""
    height, width = degrees_box(lat0, metres)
    box = lat.between(lat0 - height, lat0 + height)
    if width < 180 and -180 <= lng0 - width and lng0 + width <= 180:
        box &= lng.between(lng0 - width, lng0 + width)
    return box & (distance(lat, lng, F.lit(lat0), F.lit(lng0)) <= metres)


# --- numpy


def on_sphere(s1, c1, s2, c2, lam) -> tuple[np.ndarray, ...]:
    """What a round knows of points some longitude apart on the auxiliary sphere."""
    sl, cl = np.sin(lam), np.cos(lam)
    x, y = c2 * sl, c1 * s2 - s1 * c2 * cl
    sin, cos = np.hypot(x, y), s1 * s2 + c1 * c2 * cl
    alpha = np.where(sin == 0, 0.0, c1 * c2 * sl / sin)
    cos2 = 1 - alpha * alpha
    return x, y, sin, cos, np.arctan2(sin, cos), alpha, cos2, np.where(cos2 == 0, 0.0, cos - 2 * s1 * s2 / cos2)


def longitudes(s1, c1, s2, c2, l) -> np.ndarray:  # noqa: E741
    """Differences of longitude on the auxiliary sphere after ROUNDS rounds; those that a round leaves as they are, which
    no later one would change, take no part in the next."""
    parts = [np.array(v, dtype=float) for v in np.broadcast_arrays(s1, c1, s2, c2, l)]
    out = parts[4].copy()
    lam, at, shape = out.ravel(), None, out.shape
    s1, c1, s2, c2, l = (v.ravel() for v in parts)  # noqa: E741
    now = lam.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(ROUNDS):
            _, _, sin, cos, sigma, alpha, cos2, mid = on_sphere(s1, c1, s2, c2, now)
            c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
            new = l + (1 - c) * FLAT * alpha * (sigma + c * sin * (mid + c * cos * (-1 + 2 * mid * mid)))
            go = (new != now) & ~np.isnan(new)
            if at is None:
                at, lam = np.flatnonzero(go), new.copy()
            else:
                lam[at], at = new, at[go]
            if not at.size:
                break
            s1, c1, s2, c2, l, now = (v[go] for v in (s1, c1, s2, c2, l, new))  # noqa: E741
    return lam.reshape(shape)


def inverse_np(lat1, lng1, lat2, lng2) -> tuple[np.ndarray, np.ndarray]:
    """(metres, azimuth in degrees) of arrays of points."""
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    l = np.radians(np.asarray(lng2) - np.asarray(lng1))  # noqa: E741
    lam = longitudes(s1, c1, s2, c2, l)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y, sin, cos, sigma, _, cos2, mid = on_sphere(s1, c1, s2, c2, lam)
    q = cos2 * (A * A - B * B) / (B * B)
    big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    delta = small * sin * (mid + small / 4 * (cos * (-1 + 2 * mid * mid) - small / 6 * mid * (-3 + 4 * sin * sin) * (-3 + 4 * mid * mid)))
    metres = np.where(sin == 0, 0.0, B * big * (sigma - delta))
    return np.nan_to_num(metres), np.where(sin == 0, 180.0, np.degrees(np.arctan2(x, y)))


def direct_np(lat, lng, azimuth_, metres) -> tuple[np.ndarray, np.ndarray]:
    """Points some metres from others along azimuths: (lat, lng)."""
    a1, u1 = np.radians(azimuth_), np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    s1, c1 = np.sin(u1), np.cos(u1)
    alpha = c1 * np.sin(a1)
    cos2 = 1 - alpha * alpha
    q = cos2 * (A * A - B * B) / (B * B)
    big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    start = np.arctan2(np.tan(u1), np.cos(a1))
    sigma = base = metres / (B * big)
    for _ in range(ROUNDS):
        mid, sin, cos = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
        sigma = base + small * sin * (mid + small / 4 * (cos * (-1 + 2 * mid * mid) - small / 6 * mid * (-3 + 4 * sin * sin) * (-3 + 4 * mid * mid)))
    mid, sin, cos = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
    y = s1 * cos + c1 * sin * np.cos(a1)
    x = (1 - FLAT) * np.hypot(alpha, s1 * sin - c1 * cos * np.cos(a1))
    lam = np.arctan2(sin * np.sin(a1), c1 * cos - s1 * sin * np.cos(a1))
    c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    lon = lam - (1 - c) * FLAT * alpha * (sigma + c * sin * (mid + c * cos * (-1 + 2 * mid * mid)))
    return np.degrees(np.arctan2(y, x)), np.asarray(lng) + np.degrees(lon)


def cumulative_np(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Metres along a path at each of its points."""
    if len(lat) < 2:
        return np.zeros(len(lat))
    return np.concatenate(([0.0], np.cumsum(inverse_np(lat[:-1], lng[:-1], lat[1:], lng[1:])[0])))
