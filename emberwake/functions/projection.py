"""EPSG:6933 (cylindrical equal-area) and WGS84 as column expressions: x depends on longitude only, y on latitude only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
QP = (1 - E2) * (1 / (1 - E2) - math.log((1 - E1) / (1 + E1)) / (2 * E1))
#: Series of the inverse, by sin(2b), sin(4b), sin(6b).
SERIES = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)


def to_x(lon: Column) -> Column:
    return F.lit(A * K0) * F.radians(lon)


def to_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) * (1 - E2)
    return q * (A / (2 * K0))


def to_lon(x: Column) -> Column:
    return F.degrees(x / (A * K0))


def to_lat(y: Column) -> Column:
    b = F.asin(y * (2 * K0 / (A * QP)))
    return F.degrees(b + sum((F.sin(b * (2 * k)) * c for k, c in enumerate(SERIES, 1)), F.lit(0.0)))


def project(lon: float, lat: float) -> tuple[float, float]:
    """The same for plain numbers."""
    s = math.sin(math.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    return A * K0 * math.radians(lon), A * q / (2 * K0)


def project_arrays(xy):
    """Projects an (n, 2) numpy array of lon, lat."""
    import numpy as np

    s = np.sin(np.radians(xy[:, 1]))
    q = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    return np.stack([A * K0 * np.radians(xy[:, 0]), A * q / (2 * K0)], 1)
