"""Map projections of an ellipsoid as column expressions, both ways: transverse Mercator and polar stereographic.

Series in the third flattening n, to its fourth power: for n of a planet errors are far below a millimetre.
"""

from __future__ import annotations

from math import asin, cos, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of n, n**2, n**3 and n**4 in the Krueger series, by multiple of the angle.
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
#: Geodetic latitude from conformal latitude.
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


def series(table: tuple, flattening: float) -> list[float]:
    n = flattening / (2 - flattening)
    return [sum(c * n**k for k, c in enumerate(row, 1)) for row in table]


def rectifying_radius(a: float, flattening: float) -> float:
    """The radius of a sphere whose meridians are as long."""
    n = flattening / (2 - flattening)
    return a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _conformal(lat: Column, flattening: float) -> Column:
    """The tangent of the conformal latitude."""
    e = sqrt(flattening * (2 - flattening))
    return F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))


def _geodetic(conformal: Column, flattening: float) -> Column:
    return sum((d * F.sin(2.0 * j * conformal) for j, d in enumerate(series(LATITUDE, flattening), 1)), conformal)


def to_transverse_mercator(lat: Column, lon: Column, centre: float, a: float, flattening: float, scale: float = 0.9996) -> tuple[Column, Column]:
    """East and north of the equator's crossing with the central meridian, of degrees within some 80 of that."""
    radius, along = scale * rectifying_radius(a, flattening), F.radians(lon - centre)
    t = _conformal(F.radians(lat), flattening)
    x, y = F.atan2(t, F.cos(along)), F.atanh(F.sin(along) / F.sqrt(1.0 + t * t))
    terms = list(enumerate(series(FORWARD, flattening), 1))
    east = sum((c * F.cos(2.0 * j * x) * F.sinh(2.0 * j * y) for j, c in terms), y)
    north = sum((c * F.sin(2.0 * j * x) * F.cosh(2.0 * j * y) for j, c in terms), x)
    return radius * east, radius * north


def from_transverse_mercator(east: Column, north: Column, centre: float, a: float, flattening: float, scale: float = 0.9996) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    radius = scale * rectifying_radius(a, flattening)
    u, v = north / radius, east / radius
    terms = list(enumerate(series(INVERSE, flattening), 1))
    x = sum((-c * F.sin(2.0 * j * u) * F.cosh(2.0 * j * v) for j, c in terms), u)
    y = sum((-c * F.cos(2.0 * j * u) * F.sinh(2.0 * j * v) for j, c in terms), v)
    lat = _geodetic(F.asin(F.sin(x) / F.cosh(y)), flattening)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + centre


def _polar_scale(true_at: float, a: float, flattening: float) -> float:
    """Distance from the pole per tangent of half the conformal distance from it, for a true scale at a latitude."""
    e = sqrt(flattening * (2 - flattening))
    s = sin(radians(abs(true_at)))
    if abs(true_at) >= 90:
        return 2 * a / sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    half = tan(radians(45 - abs(true_at) / 2)) * ((1 + e * s) / (1 - e * s)) ** (e / 2)
    return a * cos(radians(abs(true_at))) / sqrt(1 - (e * s) ** 2) / half


def to_polar_stereographic(lat: Column, lon: Column, centre: float, a: float, flattening: float, true_at: float = 90.0) -> tuple[Column, Column]:
    """East and north of the pole whose side ``true_at`` is on; its meridian ``centre`` points down at the north pole, up at
    the south pole."""
    side = 1.0 if true_at >= 0 else -1.0
    t = _conformal(F.radians(side * lat), flattening)
    half = 1.0 / (t + F.sqrt(1.0 + t * t))
    r, along = _polar_scale(true_at, a, flattening) * half, F.radians(side * (lon - centre))
    return side * r * F.sin(along), -side * r * F.cos(along)


def from_polar_stereographic(east: Column, north: Column, centre: float, a: float, flattening: float, true_at: float = 90.0) -> tuple[Column, Column]:
    """Latitude and longitude in degrees, the latter within 180 of ``centre``; the pole has the longitude ``centre``."""
    side = 1.0 if true_at >= 0 else -1.0
    half = F.sqrt(east * east + north * north) / _polar_scale(true_at, a, flattening)
    lat = _geodetic(F.lit(asin(1.0)) - 2.0 * F.atan(half), flattening)
    flat = (east == 0) & (north == 0)
    along = F.when(flat, 0.0).otherwise(F.atan2(side * east, -side * north))
    return side * F.degrees(lat), side * F.degrees(along) + centre
