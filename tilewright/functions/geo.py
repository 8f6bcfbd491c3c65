"""Columns over coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
RADIUS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
MERIDIAN = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def utm_to_wgs84(easting: Column, northing: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """``latitude, longitude`` in degrees of a UTM position, by the series of the transverse Mercator projection.

    Three terms of the series: exact to a few millimetres inside a zone.
    """
    xi = (northing - F.when(north, F.lit(0.0)).otherwise(F.lit(SOUTH))) / F.lit(SCALE * MERIDIAN)
    eta = (easting - F.lit(EAST)) / F.lit(SCALE * MERIDIAN)
    xi1, eta1 = xi, eta
    for k, b in enumerate(BETA, 1):
        xi1 = xi1 - F.lit(b) * F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k))
        eta1 = eta1 - F.lit(b) * F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    latitude = chi
    for k, d in enumerate(DELTA, 1):
        latitude = latitude + F.lit(d) * F.sin(chi * (2 * k))
    middle = F.radians(zone * 6 - 183)
    return latitude * F.lit(180 / math.pi), (middle + F.atan2(F.sinh(eta1), F.cos(xi1))) * F.lit(180 / math.pi)


def wgs84_to_utm(latitude: Column, longitude: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """``easting, northing`` of a position in degrees on the grid of a UTM zone, which it may lie outside of, by the same series."""
    phi, away = F.radians(latitude), F.radians(longitude - (zone * 6 - 183))
    root = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(root) * F.atanh(F.lit(root) * F.sin(phi)))
    xi1, eta1 = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for k, a in enumerate(ALPHA, 1):
        xi = xi + F.lit(a) * F.sin(xi1 * (2 * k)) * F.cosh(eta1 * (2 * k))
        eta = eta + F.lit(a) * F.cos(xi1 * (2 * k)) * F.sinh(eta1 * (2 * k))
    far = F.lit(SCALE * MERIDIAN)
    return F.lit(EAST) + far * eta, F.when(north, F.lit(0.0)).otherwise(F.lit(SOUTH)) + far * xi
