"""Coordinate reference systems: a registry, and projections that run on floats, numpy or Columns alike.

There is no EPSG database here. Known are geographic 84, 4326 and 4258; UTM zones on WGS 84 (32601-32660,
32701-32760) and ETRS89 (25828-25838, 3046-3048, 3067); the Finnish GK zones 3873-3885; Web Mercator 3857. Any other
transverse Mercator, Lambert conformal conic or geographic system can be registered by its proj4 text. ETRS89 and WGS 84
are taken as one.
Transverse Mercator uses the Krueger series to the fourth order of the third flattening, with an own series
back from conformal latitude, so that both directions are closed expressions without a loop over rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np

# The GRS 80 ellipsoid.
AXIS = 6378137.0
FLATTENING = 1 / 298.257222101

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Sums over powers of the third flattening: the first row starts at its first power, the next at its second, ..."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


# The coefficients of the Krueger series, and of the series from conformal to geodetic latitude.
_TO_PLANE = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
_FROM_PLANE = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
_TO_LATITUDE = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))

_NUMPY = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, tanh=np.tanh, asin=np.arcsin, atan=np.arctan,
    asinh=np.arcsinh, atanh=np.arctanh, log=np.log, exp=np.exp, atan2=np.arctan2, sqrt=np.sqrt, pow=np.power,
)

_MATH = SimpleNamespace(sin=math.sin, tan=math.tan, sinh=math.sinh, asinh=math.asinh, atan=math.atan, atanh=math.atanh)


def columns() -> Any:
    """The functions that the projections need, on Columns."""
    from pyspark.sql import functions as F

    return F


@dataclass(frozen=True)
class Srid:
    code: int
    lat_lon: bool = False
    degrees: bool = False
    wrap: tuple[float, float] | None = None


@dataclass(frozen=True)
class Zone:
    """A transverse Mercator zone."""

    meridian: float
    scale: float
    easting: float
    northing: float = 0


@dataclass(frozen=True)
class Cone:
    """A Lambert conformal conic projection with two standard parallels (or one, twice)."""

    meridian: float
    origin: float
    first: float
    second: float
    easting: float = 0
    northing: float = 0

    @property
    def shape(self) -> tuple[float, float, float]:
        """(exponent, radius factor, radius at the origin)."""
        wide = lambda lat: math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)
        away = lambda lat: math.tan(math.pi / 4 - _conformal(lat, _MATH) / 2)
        one, two, origin = map(math.radians, (self.first, self.second, self.origin))
        n = math.sin(one) if one == two else math.log(wide(one) / wide(two)) / math.log(away(one) / away(two))
        factor = AXIS * wide(one) / (n * away(one) ** n)
        return n, factor, factor * away(origin) ** n


CONES: dict[int, Cone] = {}
ZONES = {
    3046: Zone(21, 0.9996, 500_000),
    3047: Zone(27, 0.9996, 500_000),
    3048: Zone(33, 0.9996, 500_000),
    3067: Zone(27, 0.9996, 500_000),
    **{3873 + i: Zone(19 + i, 1.0, (19 + i) * 1_000_000 + 500_000) for i in range(13)},
    **{25800 + i: Zone(6 * i - 183, 0.9996, 500_000) for i in range(28, 39)},
    **{32600 + i: Zone(6 * i - 183, 0.9996, 500_000) for i in range(1, 61)},
    **{32700 + i: Zone(6 * i - 183, 0.9996, 500_000, 10_000_000) for i in range(1, 61)},
}
GEOGRAPHIC = {84, 4326, 4258}
SRIDS: dict[int, Srid] = {
    84: Srid(84, degrees=True, wrap=(-180.0, 180.0)),
    4326: Srid(4326, lat_lon=True, degrees=True, wrap=(-180.0, 180.0)),
    4258: Srid(4258, lat_lon=True, degrees=True, wrap=(-180.0, 180.0)),
    3857: Srid(3857),
    **{code: Srid(code) for code in ZONES},
}


def register(code: int, proj4: str, lat_lon: bool = False, degrees: bool | None = None, wrap: tuple[float, float] | None = None) -> Srid:
    """Make a system known by its proj4 text: longlat, utm or tmerc, on GRS 80 or WGS 84. ValueError for others."""
    said = dict((*x.split("=", 1), "")[:2] for x in proj4.replace("+", " ").split())
    kind = said.get("proj")
    if said.get("ellps", said.get("datum", "WGS84")) not in ("WGS84", "GRS80") or kind not in ("longlat", "utm", "tmerc", "lcc"):
        raise ValueError(f"srid {code}: not longlat, utm, tmerc or lcc on GRS 80 or WGS 84: {proj4!r}")
    if any(float(v) for v in said.get("towgs84", "0").split(",")) or said.get("units", "m") != "m" or kind == "tmerc" and float(said.get("lat_0", 0)):
        raise ValueError(f"srid {code}: shifts, units other than m and the lat_0 of tmerc are not supported")
    number = lambda k, default: float(said.get(k, default))
    if kind == "lcc":
        if float(said.get("k_0", said.get("k", 1))) != 1 or "lat_1" not in said:
            raise ValueError(f"srid {code}: lcc needs lat_1, and a scale of 1")
        first = number("lat_1", 0)
        CONES[code] = Cone(number("lon_0", 0), number("lat_0", 0), first, number("lat_2", first), number("x_0", 0), number("y_0", 0))
        if abs(first + CONES[code].second) < 1e-9:
            raise ValueError(f"srid {code}: the parallels of lcc must not lie opposite")
    elif kind == "longlat":
        GEOGRAPHIC.add(code)
    elif kind == "utm":
        ZONES[code] = Zone(6 * int(said["zone"]) - 183, 0.9996, 500_000, 10_000_000 if "south" in said else 0)
    else:
        ZONES[code] = Zone(number("lon_0", 0), number("k", said.get("k_0", 1)), number("x_0", 0), number("y_0", 0))
    SRIDS[code] = Srid(code, lat_lon, kind == "longlat" if degrees is None else degrees, wrap)
    return SRIDS[code]


def to_uri(code: int) -> str:
    return "http://www.opengis.net/def/crs/OGC/1.3/CRS84" if code == 84 else f"http://www.opengis.net/def/crs/EPSG/0/{code}"


def parse_uri(uri: str | None, name: str = "crs") -> int:
    """The code of a CRS URI; nothing means CRS84. ValueError for other forms and unknown systems."""
    if not uri or uri == to_uri(84):
        return 84
    tail = uri.removeprefix("http://www.opengis.net/def/crs/").split("/")
    if tail[0] == uri or len(tail) != 3:
        raise ValueError(f"'{name}' must be like http://www.opengis.net/def/crs/authority/version/code")
    if not tail[2].isdigit() or int(tail[2]) not in SRIDS:
        raise ValueError(f"'{name}': unknown coordinate reference system")
    return int(tail[2])


def _conformal(lat, m):
    return m.atan(m.sinh(m.asinh(m.tan(lat)) - _E * m.atanh(_E * m.sin(lat))))


def _geodetic(chi, m):
    lat = chi
    for j, c in enumerate(_TO_LATITUDE, 1):
        lat = lat + c * m.sin(2 * j * chi)
    return lat


def _to_cone(lon, lat, cone: Cone, m):
    n, factor, top = cone.shape
    radius = m.pow(m.tan(math.pi / 4 - _conformal(lat, m) / 2), n) * factor
    turn = (lon - math.radians(cone.meridian)) * n
    return radius * m.sin(turn) + cone.easting, top - radius * m.cos(turn) + cone.northing


def _from_cone(x, y, cone: Cone, m):
    n, factor, top = cone.shape
    side = math.copysign(1, n)
    east, south = (x - cone.easting) * side, (top - (y - cone.northing)) * side
    chi = math.pi / 2 - m.atan(m.pow(m.sqrt(east * east + south * south) * side / factor, 1 / n)) * 2
    return m.atan2(east, south) / n + math.radians(cone.meridian), _geodetic(chi, m)


def _to_zone(lon, lat, zone: Zone, m):
    chi, away = _conformal(lat, m), lon - math.radians(zone.meridian)
    eta = m.atanh(m.cos(chi) * m.sin(away))
    xi = m.asin(m.sin(chi) * m.cosh(eta))
    north, east = xi, eta
    for j, c in enumerate(_TO_PLANE, 1):
        north = north + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        east = east + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    return east * (zone.scale * _RADIUS) + zone.easting, north * (zone.scale * _RADIUS) + zone.northing


def _from_zone(x, y, zone: Zone, m):
    north, east = (y - zone.northing) / (zone.scale * _RADIUS), (x - zone.easting) / (zone.scale * _RADIUS)
    xi, eta = north, east
    for j, c in enumerate(_FROM_PLANE, 1):
        xi = xi - c * m.sin(2 * j * north) * m.cosh(2 * j * east)
        eta = eta - c * m.cos(2 * j * north) * m.sinh(2 * j * east)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    away = m.asin(m.tanh(eta) / m.cos(chi))
    return away + math.radians(zone.meridian), _geodetic(chi, m)


def project(x, y, source: int, target: int, m: Any = _NUMPY):
    """Positions (x, y; longitude first) from one system to another. The same code serves numpy and Columns."""
    if source == target or source in GEOGRAPHIC and target in GEOGRAPHIC:
        return x, y
    half = math.pi / 180
    if source in GEOGRAPHIC:
        lon, lat = x * half, y * half
    elif source == 3857:
        lon, lat = x / AXIS, m.atan(m.exp(y / AXIS)) * 2 - math.pi / 2
    elif source in ZONES:
        lon, lat = _from_zone(x, y, ZONES[source], m)
    elif source in CONES:
        lon, lat = _from_cone(x, y, CONES[source], m)
    else:
        raise ValueError(f"no way from {source}")
    if target in GEOGRAPHIC:
        return lon / half, lat / half
    if target == 3857:
        return lon * AXIS, m.log(m.tan(lat / 2 + math.pi / 4)) * AXIS
    if target in ZONES:
        return _to_zone(lon, lat, ZONES[target], m)
    if target in CONES:
        return _to_cone(lon, lat, CONES[target], m)
    raise ValueError(f"no way to {target}")


def is_identity(source: int, target: int) -> bool:
    return source == target or source in GEOGRAPHIC and target in GEOGRAPHIC


def reproject(geometry, target: int):
    """A geometry in another system; itself where both are the same."""
    from dataclasses import replace

    if geometry.srid == target:
        return geometry
    if is_identity(geometry.srid, target):
        return replace(geometry, srid=target)
    moved = geometry.mapped(lambda x, y: tuple(map(float, project(x, y, geometry.srid, target))))
    return replace(moved, srid=target)
