"""Lambert conformal conic projection with two standard parallels on WGS84.

Standard closed forms of map-projection textbooks; lengths in metres, angles in degrees.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemap.constants import LAT_RANGE, LON_RANGE, WGS84_A, WGS84_F

_E = math.sqrt(WGS84_F * (2 - WGS84_F))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) * math.exp(_E * math.atanh(_E * math.sin(phi)))


@dataclass(frozen=True)
class Cone:
    """Constants of one conic; the first parallel is also the latitude of origin."""

    n: float
    scale: float  # a * F
    rho0: float
    lon0: float

    @classmethod
    def between(cls, lon_range=LON_RANGE, lat_range=LAT_RANGE) -> "Cone":
        phi1, phi2 = (math.radians(v) for v in lat_range)
        n = math.log(_m(phi1) / _m(phi2)) / math.log(_t(phi1) / _t(phi2))
        scale = WGS84_A * _m(phi1) / (n * _t(phi1) ** n)
        return cls(n, scale, scale * _t(phi1) ** n, sum(lon_range) / 2)


CONE = Cone.between()


def lcc_xy(lon: Column, lat: Column, cone: Cone = CONE) -> tuple[Column, Column]:
    """Longitude and latitude to metres east and north of the origin."""
    phi = F.radians(lat)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) * F.exp(F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    rho = F.lit(cone.scale) * F.pow(t, F.lit(cone.n))
    theta = F.lit(cone.n) * F.radians(lon - F.lit(cone.lon0))
    return rho * F.sin(theta), F.lit(cone.rho0) - rho * F.cos(theta)


def lcc_lonlat(x: Column, y: Column, cone: Cone = CONE) -> tuple[Column, Column]:
    """Inverse of :func:`lcc_xy`; six fixed-point steps reach double precision."""
    north = F.lit(cone.rho0) - y
    t = F.pow(F.hypot(x, north) / F.lit(cone.scale), F.lit(1 / cone.n))
    lon = F.degrees(F.atan2(x, north) / F.lit(cone.n)) + F.lit(cone.lon0)
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(6):
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.exp(F.lit(-_E) * F.atanh(F.lit(_E) * F.sin(phi))))
    return lon, F.degrees(phi)
