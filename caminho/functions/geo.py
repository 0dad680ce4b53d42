"""Distances, the map projection, and points, as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equatorial radius in metres.
RADIUS = 6378137.0
# UTM zone 23 south on the GRS80 ellipsoid: central meridian, scale, false easting and northing, flattening.
MERIDIAN, SCALE, EAST, NORTH, FLATTENING = -45.0, 0.9996, 500_000.0, 10_000_000.0, 1 / 298.257222101


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(a))


def _series() -> tuple[float, list[float], float]:
    n = FLATTENING / (2 - FLATTENING)
    rectifying = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return rectifying, alpha, 2 * math.sqrt(n) / (1 + n)


def utm_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres by the third-order Krüger series."""
    size, alpha, e = _series()
    phi, lam = F.radians(lat), F.radians(lon - MERIDIAN)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * size * x, NORTH + SCALE * size * y


def utm_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of projected metres, by the inverse series of the same order."""
    size, _, _ = _series()
    n = FLATTENING / (2 - FLATTENING)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = (y - NORTH) / (SCALE * size), (x - EAST) / (SCALE * size)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(q), F.cos(p))) + MERIDIAN


def renumber(address: Column, number: Column) -> Column:
    """The address with its first ``, <digits> -`` changed to ``number``; unchanged without one."""
    split = F.regexp_extract(address, "^(.*?), \\d+ -", 1)
    rest = F.regexp_extract(address, "^.*?, \\d+ -(.*)$", 1)
    return F.when(address.rlike(", \\d+ -"), F.concat(split, F.lit(", "), F.coalesce(number.cast("string"), F.lit("")), F.lit(" -"), rest)).otherwise(address)


def point_text(lon: Column, lat: Column) -> Column:
    """Well-known text of a point, null without coordinates."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))
