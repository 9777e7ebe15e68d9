"""UTM and geographic coordinates by Krueger's series on WGS 84: as Column expressions, and for arrays in kernels.

From zone to zone only arrays are changed: both series in one expression would be a quarter of a million characters.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Arrays:
    """NumPy under the names that Spark's functions have."""

    sin, cos, sinh, cosh, asin, atan2, sqrt, ln, degrees, radians = np.sin, np.cos, np.sinh, np.cosh, np.arcsin, np.arctan2, np.sqrt, np.log, np.degrees, np.radians


# The ellipsoid and the projection's scale and offsets.
A, FLATTENING, K0, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def zone_of(crs: str) -> tuple[int, bool]:
    """(zone, whether south) of EPSG:326zz and EPSG:327zz."""
    m = re.fullmatch(r"(?i)epsg:32([67])(\d\d)", crs.strip())
    if not m or not 1 <= int(m[2]) <= 60:
        raise ValueError(f"{crs} isn't a UTM zone")
    return int(m[2]), m[1] == "7"


def utm_to_wgs84(easting, northing, crs: str, m=F) -> tuple:
    """(latitude, longitude) in degrees; m: the functions, of Columns or Arrays."""
    zone, south = zone_of(crs)
    xi = (northing - (FALSE_NORTHING if south else 0.0)) / (K0 * RADIUS)
    eta = (easting - FALSE_EASTING) / (K0 * RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        eta1 = eta1 - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * m.sin(2 * j * chi)
    return m.degrees(phi), m.degrees(m.atan2(m.sinh(eta1), m.cos(xi1))) + (zone * 6 - 183)


ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)


def wgs84_to_utm(latitude, longitude, crs: str, m=F) -> tuple:
    """(easting, northing) of degrees."""
    zone, south = zone_of(crs)
    phi, lam = m.radians(latitude), m.radians(longitude - (zone * 6 - 183))
    e = 2 * math.sqrt(N) / (1 + N)
    atanh = lambda v: 0.5 * m.ln((1 + v) / (1 - v))
    t = m.sinh(atanh(m.sin(phi)) - e * atanh(e * m.sin(phi)))
    xi1, eta1 = m.atan2(t, m.cos(lam)), atanh(m.sin(lam) / m.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * m.sin(2 * j * xi1) * m.cosh(2 * j * eta1)
        eta = eta + a * m.cos(2 * j * xi1) * m.sinh(2 * j * eta1)
    return FALSE_EASTING + K0 * RADIUS * eta, (FALSE_NORTHING if south else 0.0) + K0 * RADIUS * xi


def supported(crs: str) -> bool:
    return crs.upper() == "EPSG:4326" or bool(re.fullmatch(r"(?i)epsg:32[67]\d\d", crs))


def transformed(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """World coordinates in another system: from a UTM zone to geographic (x is the longitude) or back."""
    if source.upper() == target.upper():
        return x, y
    if "EPSG:4326" not in (source.upper(), target.upper()):
        raise ValueError("from zone to zone arrays are changed, by converted()")
    lat, lon = (y, x) if source.upper() == "EPSG:4326" else utm_to_wgs84(x, y, source)
    return (lon, lat) if target.upper() == "EPSG:4326" else wgs84_to_utm(lat, lon, target)


def converted(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for arrays, between any two of geographic coordinates and UTM zones."""
    if source.upper() == target.upper():
        return x, y
    lat, lon = (y, x) if source.upper() == "EPSG:4326" else utm_to_wgs84(x, y, source, Arrays)
    return (lon, lat) if target.upper() == "EPSG:4326" else wgs84_to_utm(lat, lon, target, Arrays)


def sql(easting: str, northing: str, zone: int) -> tuple[str, str]:
    """The same formulas as SQL text, for the northern hemisphere."""
    xi, eta = f"({northing} / {K0 * RADIUS!r})", f"(({easting} - {FALSE_EASTING}) / {K0 * RADIUS!r})"
    xi1 = xi + "".join(f" - {b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(BETA, 1))
    eta1 = eta + "".join(f" - {b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(BETA, 1))
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    phi = chi + "".join(f" + {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(DELTA, 1))
    return f"degrees({phi})", f"degrees(atan2(sinh({eta1}), cos({xi1}))) + {zone * 6 - 183}"


assert math.isclose(RADIUS, 6367449.1458, rel_tol=1e-9)
