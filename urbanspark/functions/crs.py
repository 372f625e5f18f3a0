"""Map projections as Column expressions: conformal cones, transverse Mercator by Krueger's series, web Mercator, and shifts between datums.

Coordinates in degrees are on WGS84 (EPSG 4326, taken as RGF93 and ETRS89). A projection on another datum is reached by way of
geocentric coordinates and its published seven parameters, at height 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import CC46, LAMBERT93, WGS84
from .geometry import bound, envelope, point


@dataclass(frozen=True)
class Datum:
    """An ellipsoid (axis, flattening) and its shift to WGS84: metres, arc seconds (position vector), parts per million."""

    axis: float
    flattening: float
    shift: tuple[float, float, float, float, float, float, float] = (0.0,) * 7

    @property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))


# Ellipsoids and datum shifts as published (metres, seconds, parts per million).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
GRS80 = Datum(AXIS, FLATTENING)
NTF = Datum(6378249.2, 1 / 293.4660212936269, (-168.0, -60.0, 320.0, 0.0, 0.0, 0.0, 0.0))
OSGB36 = Datum(6377563.396, 1 / 299.3249646, (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489))

# The cones' two parallels, origin (degrees) and false origin (metres).
PARAMETERS = {LAMBERT93: (49.0, 44.0, 46.5, 3.0, 700000.0, 6600000.0), CC46: (45.25, 46.75, 46.0, 3.0, 1700000.0, 5200000.0)}
#: The nine conical zones, 3942 to 3950, by their rule: parallels three quarters of a degree about the zone's latitude.
PARAMETERS |= {3900 + z: (z - 0.75, z + 0.75, float(z), 3.0, 1700000.0, (z - 41) * 1e6 + 200000.0) for z in range(42, 51)}
# Cones with one parallel: latitude (also the origin's), longitude, scale, false origin, datum.
ONE_PARALLEL = {27572: (46.8, 2.33722916666667, 0.99987742, 600000.0, 2200000.0, NTF)}
# Transverse projections: latitude, longitude, scale, false origin, datum.
TRANSVERSE = {27700: (49.0, -2.0, 0.9996012717, 400000.0, -100000.0, OSGB36)}
#: UTM by its rule: zones of six degrees, on WGS84 north and south, and on ETRS89.
TRANSVERSE |= {base + z: (0.0, 6.0 * z - 183.0, 0.9996, 500000.0, north, GRS80) for base, zones, north in ((32600, range(1, 61), 0.0), (32700, range(1, 61), 1e7), (25800, range(28, 39), 0.0)) for z in zones}
WEB = 3857
_E = GRS80.e


def known() -> list[int]:
    return sorted({WGS84, WEB, *PARAMETERS, *ONE_PARALLEL, *TRANSVERSE})


@dataclass(frozen=True)
class Cone:
    """n, a F, rho0 and the origin of a projection."""

    n: float
    scale: float
    rho0: float
    lon0: float
    x0: float
    y0: float
    datum: Datum = GRS80

    @staticmethod
    def of(srid: int) -> Cone:
        if srid in ONE_PARALLEL:
            lat0, lon0, k0, x0, y0, datum = ONE_PARALLEL[srid]
            return Cone.at(lat0, lon0, k0, x0, y0, datum)
        if srid not in PARAMETERS:
            raise ValueError(f"no cone for EPSG:{srid}; known are {sorted([*PARAMETERS, *ONE_PARALLEL])}")
        lat1, lat2, lat0, lon0, x0, y0 = PARAMETERS[srid]
        t, m = _parallel(GRS80)
        n = (math.log(m(lat1)) - math.log(m(lat2))) / (math.log(t(lat1)) - math.log(t(lat2)))
        scale = AXIS * m(lat1) / (n * t(lat1) ** n)
        return Cone(n, scale, scale * t(lat0) ** n, lon0, x0, y0)

    @staticmethod
    def at(lat0: float, lon0: float, k0: float, x0: float, y0: float, datum: Datum) -> Cone:
        t, m = _parallel(datum)
        n = math.sin(math.radians(lat0))
        scale = datum.axis * k0 * m(lat0) / (n * t(lat0) ** n)
        return Cone(n, scale, scale * t(lat0) ** n, lon0, x0, y0, datum)


def _parallel(d: Datum):
    s = lambda lat: d.e * math.sin(math.radians(lat))
    t = lambda lat: math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - s(lat)) / (1 + s(lat))) ** (d.e / 2)
    return t, lambda lat: math.cos(math.radians(lat)) / math.sqrt(1 - s(lat) ** 2)


@dataclass(frozen=True)
class Transverse:
    """Krueger's series to the fourth power of the third flattening: below a millimetre within some thousand kilometres of the meridian."""

    radius: float  # of the rectifying sphere, times the scale
    alpha: tuple[float, ...]
    beta: tuple[float, ...]
    lon0: float
    x0: float
    y0: float
    datum: Datum = GRS80

    @staticmethod
    def of(srid: int) -> Transverse:
        if srid not in TRANSVERSE:
            raise ValueError(f"no transverse projection for EPSG:{srid}")
        return Transverse.at(*TRANSVERSE[srid])

    @staticmethod
    def at(lat0: float, lon0: float, k0: float, x0: float, y0: float, datum: Datum) -> Transverse:
        n = datum.flattening / (2 - datum.flattening)
        # The series' coefficients.
        alpha = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
        )
        beta = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280,
        )
        radius = k0 * datum.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        phi = math.radians(lat0)
        chi = math.atan(math.sinh(math.asinh(math.tan(phi)) - datum.e * math.atanh(datum.e * math.sin(phi))))
        arc = radius * (chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(alpha)))
        return Transverse(radius, alpha, beta, lon0, x0, y0 - arc, datum)


def _isometric(lat: Column, d: Datum) -> Column:
    """Isometric latitude of degrees."""
    s = F.sin(F.radians(lat))
    return F.atanh(s) - F.atanh(s * d.e) * d.e


def _geodetic(psi: Column, d: Datum, rounds: int = 7) -> Column:
    """Degrees of an isometric latitude: fixed-point rounds inside one lambda, so that the expression doesn't grow."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.tanh(psi), lambda s, _: F.tanh(psi + F.atanh(s * d.e) * d.e))
    return F.degrees(F.asin(s))


def _pair(a: Column, b: Column) -> Column:
    return point(a, b)


def _cone_forward(lon: Column, lat: Column, c: Cone) -> Column:
    rho = F.lit(c.scale) * F.exp(-_isometric(lat, c.datum) * c.n)
    theta = F.radians(lon - c.lon0) * c.n
    return bound(rho, lambda r: _pair(F.lit(c.x0) + r * F.sin(theta), F.lit(c.y0 + c.rho0) - r * F.cos(theta)))


def _cone_inverse(x: Column, y: Column, c: Cone) -> Column:
    dx, dy = x - c.x0, F.lit(c.rho0) - (y - c.y0)
    psi = F.log(F.sqrt(dx * dx + dy * dy) / c.scale) * (-1 / c.n)
    return bound(psi, lambda p: _pair(F.degrees(F.atan2(dx, dy) / c.n) + c.lon0, _geodetic(p, c.datum)))


def _transverse_forward(lon: Column, lat: Column, t: Transverse) -> Column:
    both = F.struct(F.sinh(_isometric(lat, t.datum)).alias("t"), F.radians(lon - t.lon0).alias("l"))
    flat = lambda v: F.struct(F.atan2(v["t"], F.cos(v["l"])).alias("xi"), F.asinh(F.sin(v["l"]) / F.sqrt(v["t"] * v["t"] + F.cos(v["l"]) * F.cos(v["l"]))).alias("eta"))

    def grid(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        north = sum((F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a for j, a in enumerate(t.alpha, 1)), xi)
        east = sum((F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a for j, a in enumerate(t.alpha, 1)), eta)
        return _pair(F.lit(t.x0) + east * t.radius, F.lit(t.y0) + north * t.radius)

    return bound(both, lambda v: bound(flat(v), grid))


def _transverse_inverse(x: Column, y: Column, t: Transverse) -> Column:
    both = F.struct(((y - t.y0) / t.radius).alias("xi"), ((x - t.x0) / t.radius).alias("eta"))

    def sphere(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        north = sum((F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * -b for j, b in enumerate(t.beta, 1)), xi)
        east = sum((F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * -b for j, b in enumerate(t.beta, 1)), eta)
        return F.struct(north.alias("xi"), east.alias("eta"))

    def back(v: Column) -> Column:
        sine = F.sin(v["xi"]) / F.cosh(v["eta"])
        return _pair(F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))) + t.lon0, _geodetic(F.atanh(sine), t.datum))

    return bound(both, lambda v: bound(sphere(v), back))


def _web_forward(lon: Column, lat: Column) -> Column:
    return _pair(F.radians(lon) * AXIS, F.atanh(F.sin(F.radians(lat))) * AXIS)


def _web_inverse(x: Column, y: Column) -> Column:
    return _pair(F.degrees(x / AXIS), F.degrees(F.asin(F.tanh(y / AXIS))))


def _projection(srid: int) -> Cone | Transverse | None:
    if srid in TRANSVERSE:
        return Transverse.of(srid)
    if srid == WEB:
        return None
    if srid in PARAMETERS or srid in ONE_PARALLEL:
        return Cone.of(srid)
    raise ValueError(f"no projection for EPSG:{srid}; known are {known()}")


def _datum(srid: int) -> Datum:
    p = None if srid in (WGS84, WEB) else _projection(srid)
    return GRS80 if p is None else p.datum


def shifted(lon: Column, lat: Column, source: Datum, target: Datum) -> Column:
    """Degrees on another datum, for a point on the ellipsoid: geocentric coordinates, seven parameters, and back."""
    if source == target:
        return _pair(lon, lat)

    def geocentric(v: Column, d: Datum) -> Column:
        s, c = F.sin(F.radians(v["y"])), F.cos(F.radians(v["y"]))
        n = F.lit(d.axis) / F.sqrt(1 - s * s * d.e**2)
        return F.struct((n * c * F.cos(F.radians(v["x"]))).alias("x"), (n * c * F.sin(F.radians(v["x"]))).alias("y"), (n * s * (1 - d.e**2)).alias("z"))

    def moved(v: Column, d: Datum, sign: int) -> Column:
        if not any(d.shift):
            return v
        tx, ty, tz, *turns, ppm = d.shift
        rx, ry, rz = (math.radians(r / 3600) for r in turns)
        m = 1 + ppm * 1e-6
        x, y, z = v["x"], v["y"], v["z"]
        if sign > 0:
            return F.struct((F.lit(tx) + (x - y * rz + z * ry) * m).alias("x"), (F.lit(ty) + (x * rz + y - z * rx) * m).alias("y"), (F.lit(tz) + (z - x * ry + y * rx) * m).alias("z"))
        # The inverse of the turns, to the second order of their smallness.
        a, b, c = (x - tx) / m, (y - ty) / m, (z - tz) / m
        once = lambda w: F.struct((a + w["y"] * rz - w["z"] * ry).alias("x"), (b - w["x"] * rz + w["z"] * rx).alias("y"), (c + w["x"] * ry - w["y"] * rx).alias("z"))
        return bound(bound(bound(F.struct(a.alias("x"), b.alias("y"), c.alias("z")), once), once), once)

    def back(v: Column, d: Datum) -> Column:
        p = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        start = F.atan2(v["z"], p * (1 - d.e**2))
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda f, _: F.atan2(v["z"] + F.sin(f) * (d.e**2 * d.axis) / F.sqrt(1 - F.sin(f) * F.sin(f) * d.e**2), p))
        return _pair(F.degrees(F.atan2(v["y"], v["x"])), F.degrees(phi))

    both = bound(_pair(lon, lat), lambda v: geocentric(v, source))
    return bound(bound(bound(both, lambda v: moved(v, source, 1)), lambda v: moved(v, target, -1)), lambda v: back(v, target))


def _forward(lon: Column, lat: Column, srid: int) -> Column:
    p = _projection(srid)
    if p is None:
        return _web_forward(lon, lat)
    make = lambda v: _cone_forward(v["x"], v["y"], p) if isinstance(p, Cone) else _transverse_forward(v["x"], v["y"], p)
    return bound(shifted(lon, lat, GRS80, p.datum), make)


def _inverse(x: Column, y: Column, srid: int) -> Column:
    p = _projection(srid)
    if p is None:
        return _web_inverse(x, y)
    found = _cone_inverse(x, y, p) if isinstance(p, Cone) else _transverse_inverse(x, y, p)
    return bound(found, lambda v: shifted(v["x"], v["y"], p.datum, GRS80))


def forward(lon: Column, lat: Column, srid: int = LAMBERT93) -> tuple[Column, Column]:
    v = _forward(lon, lat, srid)
    return v["x"], v["y"]


def inverse(x: Column, y: Column, srid: int = LAMBERT93) -> tuple[Column, Column]:
    v = _inverse(x, y, srid)
    return v["x"], v["y"]


def transform_point(x: Column, y: Column, source: int, target: int) -> Column:
    """(x, y) as one value, computed once; null where either is null."""
    if source == target:
        return _pair(x, y)
    if source == WGS84:
        return _forward(x, y, target)
    if target == WGS84:
        return _inverse(x, y, source)
    return bound(_inverse(x, y, source), lambda v: _forward(v["x"], v["y"], target))


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    if source == target:
        return x, y
    v = transform_point(x, y, source, target)
    return v["x"], v["y"]


def transform_ring(ring: Column, source: int, target: int) -> Column:
    return F.transform(ring, lambda p: transform_point(p["x"], p["y"], source, target))


def transform_box(box: Column, source: int, target: int, steps: int = 16) -> Column:
    """The envelope (min_x ... max_y) of a box's outline in another system; sides are bent, so points along them count too."""
    part = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: a + (b - a) * i / steps)
    xs, ys = part(box["min_x"], box["max_x"]), part(box["min_y"], box["max_y"])
    along_x = lambda y: F.transform(xs, lambda x: _pair(x, y))
    along_y = lambda x: F.transform(ys, lambda y: _pair(x, y))
    outline = F.concat(along_x(box["min_y"]), along_x(box["max_y"]), along_y(box["min_x"]), along_y(box["max_x"]))
    return bound(transform_ring(outline, source, target), envelope)
