"""Projections and geodesic distance on the WGS84 ellipsoid, and point geometries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
_THIRD = FLATTENING / (2 - FLATTENING)


def utm_xy(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by the Krüger series to the third order in the third flattening."""
    n = _THIRD
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    waves = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    turn = np.radians(lon - (zone * 6 - 183))
    phi = np.radians(lat)
    q = 2 * math.sqrt(n) / (1 + n)
    conformal = np.sinh(np.arctanh(np.sin(phi)) - q * np.arctanh(q * np.sin(phi)))
    xi = np.arctan2(conformal, np.cos(turn))
    eta = np.arctanh(np.sin(turn) / np.hypot(1.0, conformal))
    x = eta + sum(w * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, w in enumerate(waves, 1))
    y = xi + sum(w * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, w in enumerate(waves, 1))
    return 500000.0 + 0.9996 * radius * x, (1e7 if south else 0.0) + 0.9996 * radius * y


def mercator_xy(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Web Mercator."""
    return SEMI_MAJOR * np.radians(lon), SEMI_MAJOR * np.arctanh(np.sin(np.radians(lat)))


def projected(lon: Column, lat: Column, crs: str) -> Column:
    """struct(x, y) in ``EPSG:4326``, ``EPSG:3857`` or a WGS84 UTM zone; another system is an error."""
    code = int(crs.upper().removeprefix("EPSG:"))
    if code == 4326:
        return F.struct(lon.alias("x"), lat.alias("y"))
    if code != 3857 and not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"no projection for {crs}")

    @pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    def project(lons: pd.Series, lats: pd.Series) -> pd.DataFrame:
        a, b = lons.to_numpy(float), lats.to_numpy(float)
        x, y = mercator_xy(a, b) if code == 3857 else utm_xy(a, b, code % 100, code > 32700)
        return pd.DataFrame({"x": x, "y": y})

    return project(lon, lat)


def geodesic_metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Vincenty's inverse formula; NaN where it does not settle (nearly antipodal points)."""
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    difference = np.radians(lon2 - lon1)
    lam = difference.copy()
    for _ in range(200):
        sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        with np.errstate(all="ignore"):
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            middle = np.where(cos2_a > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a, 0.0)
        c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
        new = difference + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (middle + c * cos_s * (2 * middle**2 - 1)))
        settled = np.abs(new - lam) < 1e-12
        lam = new
        if np.all(settled):
            break
    g = cos2_a * (SEMI_MAJOR**2 / SEMI_MINOR**2 - 1)
    a = 1 + g / 16384 * (4096 + g * (g * (320 - 175 * g) - 768))
    b = g / 1024 * (256 + g * (g * (74 - 47 * g) - 128))
    shift = b * sin_s * (middle + b / 4 * (cos_s * (2 * middle**2 - 1) - b / 6 * middle * (4 * sin_s**2 - 3) * (4 * middle**2 - 3)))
    return np.where(settled, SEMI_MINOR * a * (sigma - shift), np.nan)


@pandas_udf(T.DoubleType())
def geodesic_distance(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Metres between points in degrees."""
    return pd.Series(geodesic_metres(*(x.to_numpy(float) for x in (lon1, lat1, lon2, lat2))))


@pandas_udf(T.BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """Little-endian well-known binary of points; NULL where a coordinate is missing."""
    cells = np.zeros(len(x), dtype=[("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
    cells["order"], cells["kind"], cells["x"], cells["y"] = 1, 1, x.to_numpy(float), y.to_numpy(float)
    missing = (x.isna() | y.isna()).to_numpy()
    return pd.Series([None if gone else cell.tobytes() for gone, cell in zip(missing, cells)])
