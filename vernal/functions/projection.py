"""Transverse Mercator (UTM) as column expressions, sixth-order series in the third flattening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLAT / (2 - FLAT)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _zone_lon(epsg: Column) -> Column:
    return (epsg % 100) * 6 - 183


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing."""
    phi, lam = F.radians(lat), F.radians(lon - _zone_lon(epsg))
    e = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)
    return 500_000.0 + K0 * _R * x, south + K0 * _R * y


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi = (y - F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)) / (K0 * _R)
    eta = (x - 500_000.0) / (K0 * _R)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + _zone_lon(epsg), F.degrees(lat)
