"""Coordinate systems: transverse Mercator, Lambert's conic, Albers' conic, polar stereographic and Mercator on any
ellipsoid, and the step between datums; as Column expressions, and for arrays in kernels.

A system is an EPSG code of the table below or a text such as "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3
+x_0=700000 +y_0=6600000 +ellps=GRS80". Latitudes of other kinds (conformal, rectifying, authalic) are turned back by sine
series, whose coefficients are worked out for the ellipsoid by quadrature. Datums meet in geocentric coordinates, at height 0
(so that there and back differ by the height that is dropped, about a millimetre); systems without a datum step are taken to
lie on WGS 84's. Places that a projection can't show are NaN in arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geodesy


class Arrays(geodesy.Arrays):
    atan, exp, tan, power, mod = np.arctan, np.exp, np.tan, np.power, np.mod


class Columns:
    sin, cos, sinh, cosh, asin, atan2, sqrt, ln, degrees, radians = F.sin, F.cos, F.sinh, F.cosh, F.asin, F.atan2, F.sqrt, F.ln, F.degrees, F.radians
    atan, exp, tan, power, mod = F.atan, F.exp, F.tan, F.pow, F.pmod


# Half axes and flattenings, and published definitions by EPSG code.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 1 / 298.257223563),
    "GRS80": (6378137.0, 1 / 298.257222101),
    "airy": (6377563.396, 1 / 299.3249646),
    "bessel": (6377397.155, 1 / 299.1528128),
    "clrk66": (6378206.4, 1 / 294.978698214),
    "intl": (6378388.0, 1 / 297.0),
    "krass": (6378245.0, 1 / 298.3),
}
CODES = {
    2154: "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80",
    2193: "+proj=tmerc +lat_0=0 +lon_0=173 +k=0.9996 +x_0=1600000 +y_0=10000000 +ellps=GRS80",
    3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0",
    3034: "+proj=lcc +lat_0=52 +lon_0=10 +lat_1=35 +lat_2=65 +x_0=4000000 +y_0=2800000 +ellps=GRS80",
    3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45",
    3577: "+proj=aea +lat_0=0 +lon_0=132 +lat_1=-18 +lat_2=-36 +ellps=GRS80",
    3857: "+proj=webmerc",
    3976: "+proj=stere +lat_0=-90 +lat_ts=-70 +lon_0=0",
    3995: "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=0",
    4258: "+proj=longlat +ellps=GRS80",
    4269: "+proj=longlat +ellps=GRS80",
    4326: "+proj=longlat",
    5070: "+proj=aea +lat_0=23 +lon_0=-96 +lat_1=29.5 +lat_2=45.5 +ellps=GRS80",
    27700: "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +towgs84=446.448,-125.157,542.06,0.15,0.247,0.842,-20.489",
}
TERMS, POINTS = 8, 64


def definition(crs: str) -> str:
    """The text of a code; UTM zones on WGS 84, ETRS89 and NAD83 by rule."""
    m = re.fullmatch(r"(?i)epsg:(\d+)", crs.strip())
    if not m:
        return crs
    code = int(m[1])
    zone, group = code % 100, code // 100
    if code in CODES:
        return CODES[code]
    if group in (326, 327) and 1 <= zone <= 60 or group == 258 and 28 <= zone <= 38 or group == 269 and 1 <= zone <= 23:
        return f"+proj=tmerc +lon_0={zone * 6 - 183} +k=0.9996 +x_0=500000 +y_0={10000000 if group == 327 else 0} +ellps={'WGS84' if group in (326, 327) else 'GRS80'}"
    raise ValueError(f"unknown coordinate system {crs}")


def sines(f: Callable[[np.ndarray], np.ndarray]) -> tuple[float, ...]:
    """Coefficients of sin 2v, sin 4v, ... of an odd function of period pi."""
    v = (np.arange(POINTS) + 0.5) * math.pi / 2 / POINTS
    return tuple(float(2 / POINTS * (f(v) * np.sin(2 * j * v)).sum()) for j in range(1, TERMS + 1))


def solved(f: Callable[[np.ndarray], np.ndarray], v: np.ndarray) -> np.ndarray:
    """The latitudes at which f, which is near the latitude itself, has the values v."""
    phi = v
    for _ in range(30):
        phi = phi + v - f(phi)
    return phi


@dataclass(frozen=True)
class Ellipsoid:
    """radius: of the circle as long as a meridian; series from one kind of latitude to another."""

    a: float
    f: float
    e: float
    radius: float
    conformal_to_geographic: tuple[float, ...]
    conformal_to_rectifying: tuple[float, ...]
    rectifying_to_conformal: tuple[float, ...]
    authalic_to_geographic: tuple[float, ...]

    def rectifying(self, phi: float) -> float:
        return float(meridian(self.e, np.array([phi]))[0] * self.a / self.radius)


def meridian(e: float, phi: np.ndarray) -> np.ndarray:
    """Length of the meridian from the equator, for a = 1."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    at = np.multiply.outer(phi / 2, nodes + 1)
    return (weights * (1 - e * e) / (1 - (e * np.sin(at)) ** 2) ** 1.5).sum(axis=-1) * phi / 2


def authalic_q(phi, e: float, m=Arrays):
    s = m.sin(phi)
    if e == 0:
        return 2 * s
    return (1 - e * e) * (s / (1 - e * e * s * s) + m.ln((1 + e * s) / (1 - e * s)) / (2 * e))


def isometric_t(phi, e: float, m=Arrays):
    """exp(-isometric latitude): 0 at the north pole."""
    s = e * m.sin(phi)
    return m.tan(math.pi / 4 - phi / 2) / m.power((1 - s) / (1 + s), e / 2)


@lru_cache(None)
def ellipsoid(a: float, f: float) -> Ellipsoid:
    e = math.sqrt(f * (2 - f))
    quarter = float(meridian(e, np.array([math.pi / 2]))[0])
    conformal = lambda phi: math.pi / 2 - 2 * np.arctan(isometric_t(phi, e))
    rectifying = lambda phi: meridian(e, phi) / quarter * math.pi / 2
    authalic = lambda phi: np.arcsin(authalic_q(phi, e) / authalic_q(math.pi / 2, e))
    return Ellipsoid(
        a, f, e, a * quarter * 2 / math.pi,
        sines(lambda v: solved(conformal, v) - v), sines(lambda v: rectifying(solved(conformal, v)) - v),
        sines(lambda v: conformal(solved(rectifying, v)) - v), sines(lambda v: solved(authalic, v) - v),
    )


@dataclass(frozen=True)
class System:
    kind: str
    ellipsoid: Ellipsoid
    values: dict[str, float]
    #: geocentric coordinates on WGS 84 are matrix * own + shift
    matrix: tuple[tuple[float, ...], ...]
    shift: tuple[float, ...]

    def __getitem__(self, name: str) -> float:
        return self.values.get(name, 0.0)


KINDS = ("longlat", "tmerc", "lcc", "aea", "stere", "merc", "webmerc")


@lru_cache(None)
def system(crs: str) -> System:
    """The system of a code or text; ValueError for others."""
    given = dict(re.findall(r"\+(\w+)(?:=(\S+))?", definition(crs)))
    kind = given.pop("proj", "")
    if kind == "utm":
        kind, given = "tmerc", given | {"lon_0": str(int(given["zone"]) * 6 - 183), "k": "0.9996", "x_0": "500000", "y_0": "10000000" if "south" in given else "0"}
    kind = {"latlong": "longlat", "latlon": "longlat"}.get(kind, kind)
    if kind not in KINDS:
        raise ValueError(f"unknown coordinate system {crs}")
    if given.get("units", "m") != "m" or "to_meter" in given or given.get("pm", "greenwich") not in ("greenwich", "0") or "nadgrids" in given or given.get("axis", "enu") != "enu":
        raise ValueError(f"only metres, Greenwich, east and north, and steps of seven values are known: {crs}")
    a, f = ELLIPSOIDS[given.get("ellps") or {"NAD83": "GRS80"}.get(given.get("datum", ""), "WGS84")] if given.get("ellps", "WGS84") in ELLIPSOIDS else (0.0, 0.0)
    if "a" in given:
        a = float(given["a"])
        f = 1 / float(given["rf"]) if "rf" in given else 1 - float(given["b"]) / a if "b" in given else f
    if not a:
        raise ValueError(f"unknown ellipsoid {given.get('ellps')}")
    values = {k: float(v) for k, v in given.items() if k in ("lat_0", "lat_1", "lat_2", "lat_ts", "lon_0", "x_0", "y_0", "k", "k_0")}
    values["k"] = values.get("k", values.get("k_0", 1.0))
    if kind in ("lcc", "aea"):
        values.setdefault("lat_1", values.get("lat_0", 0.0))
        values.setdefault("lat_2", values["lat_1"])
        if abs(values["lat_1"] + values["lat_2"]) < 1e-9:
            raise ValueError("the parallels of a cone must not be opposite")
    if kind == "stere" and abs(values.get("lat_0", 0.0)) != 90:
        raise ValueError("stereographic systems are known at the poles only")
    step = [float(v) for v in given.get("towgs84", "0,0,0").split(",")] + [0.0] * 4
    rx, ry, rz = (math.radians(v / 3600) for v in step[3:6])
    scale = 1 + step[6] * 1e-6
    turn = ((1.0, -rz, ry), (rz, 1.0, -rx), (-ry, rx, 1.0))
    return System(kind, ellipsoid(a, f), values, tuple(tuple(scale * v for v in row) for row in turn), tuple(step[:3]))


def supported(crs: str) -> bool:
    try:
        system(crs)
    except ValueError:
        return False
    return True


def _added(v, series: tuple[float, ...], m):
    """v with a sine series of it."""
    out = v
    for j, c in enumerate(series, 1):
        out = out + c * m.sin(2 * j * v)
    return out


def _complex(x, y, series: tuple[float, ...], m) -> tuple:
    """The same for x + iy."""
    u, v = x, y
    for j, c in enumerate(series, 1):
        u, v = u + c * m.sin(2 * j * x) * m.cosh(2 * j * y), v + c * m.cos(2 * j * x) * m.sinh(2 * j * y)
    return u, v


def _parallel(lat: float, e: float) -> float:
    """Radius of a parallel, for a = 1."""
    phi = math.radians(lat)
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _cone(s: System) -> tuple[float, float, float]:
    """(n, factor, radius at lat_0) of a conic system; the radius is factor * t ** n, or sqrt(factor - n * q) / n."""
    e = s.ellipsoid.e
    p1, p2, p0 = (math.radians(s[k]) for k in ("lat_1", "lat_2", "lat_0"))
    m1, m2 = _parallel(s["lat_1"], e), _parallel(s["lat_2"], e)
    if s.kind == "lcc":
        t1, t2, t0 = (float(isometric_t(p, e)) for p in (p1, p2, p0))
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(m1 / m2) / math.log(t1 / t2)
        factor = s.ellipsoid.a * s["k"] * m1 / (n * t1**n)
        return n, factor, factor * max(t0, 0.0) ** n
    q1, q2, q0 = (float(authalic_q(p, e)) for p in (p1, p2, p0))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (m1 * m1 - m2 * m2) / (q2 - q1)
    factor = m1 * m1 + n * q1
    return n, factor, s.ellipsoid.a * math.sqrt(factor - n * q0) / n


def _polar(s: System) -> tuple[float, float]:
    """(1 at the north pole or -1, radius for t = 1)."""
    e, lat = s.ellipsoid.e, abs(s.values.get("lat_ts", 90.0))
    if lat == 90:
        scale = 2 * s["k"] / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        scale = _parallel(lat, e) / float(isometric_t(math.radians(lat), e))
    return math.copysign(1.0, s["lat_0"]), s.ellipsoid.a * scale


def forward(latitude, longitude, s: System, m=Columns) -> tuple:
    """(x, y) of degrees on the system's own datum; longlat: (longitude, latitude)."""
    if s.kind == "longlat":
        return longitude, latitude
    ell, e = s.ellipsoid, s.ellipsoid.e
    phi = m.radians(latitude)
    lam = m.radians(m.mod(longitude - (s["lon_0"] - 540.0), _number(360.0, m)) - 180.0)
    if s.kind == "tmerc":
        chi = math.pi / 2 - 2 * m.atan(isometric_t(phi, e, m))
        side = m.cos(chi) * m.sin(lam)
        xi, eta = _complex(m.atan2(m.sin(chi), m.cos(chi) * m.cos(lam)), 0.5 * m.ln((1 + side) / (1 - side)), ell.conformal_to_rectifying, m)
        return s["x_0"] + s["k"] * ell.radius * eta, s["y_0"] + s["k"] * ell.radius * (xi - ell.rectifying(math.radians(s["lat_0"])))
    if s.kind in ("merc", "webmerc"):
        e = 0.0 if s.kind == "webmerc" else e
        scale = ell.a * (_parallel(s["lat_ts"], e) if "lat_ts" in s.values else s["k"])
        return s["x_0"] + scale * lam, s["y_0"] - scale * m.ln(isometric_t(phi, e, m))
    if s.kind == "stere":
        pole, scale = _polar(s)
        rho = scale * isometric_t(pole * phi, e, m)
        return s["x_0"] + rho * m.sin(lam), s["y_0"] - pole * rho * m.cos(lam)
    n, factor, rho0 = _cone(s)
    rho = factor * m.power(isometric_t(phi, e, m), n) if s.kind == "lcc" else ell.a / n * m.sqrt(factor - n * authalic_q(phi, e, m))
    return s["x_0"] + rho * m.sin(n * lam), s["y_0"] + rho0 - rho * m.cos(n * lam)


def _number(v: float, m):
    return F.lit(v) if m is Columns else v


def inverse(x, y, s: System, m=Columns) -> tuple:
    """(latitude, longitude) in degrees on the system's own datum, longitudes from -180 on."""
    if s.kind == "longlat":
        return y, x
    ell, e = s.ellipsoid, s.ellipsoid.e
    dx, dy = x - s["x_0"], y - s["y_0"]
    t = None
    if s.kind == "tmerc":
        scale = s["k"] * ell.radius
        xi, eta = _complex(dy / scale + ell.rectifying(math.radians(s["lat_0"])), dx / scale, ell.rectifying_to_conformal, m)
        chi, lam = m.asin(m.sin(xi) / m.cosh(eta)), m.atan2(m.sinh(eta), m.cos(xi))
        phi = _added(chi, ell.conformal_to_geographic, m)
    elif s.kind in ("merc", "webmerc"):
        scale = ell.a * (_parallel(s["lat_ts"], e) if "lat_ts" in s.values else s["k"])
        t, lam = m.exp(-dy / scale), dx / scale
    elif s.kind == "stere":
        pole, scale = _polar(s)
        t, lam = m.sqrt(dx * dx + dy * dy) / scale, m.atan2(dx, -pole * dy)
    else:
        n, factor, rho0 = _cone(s)
        side = math.copysign(1.0, n)
        rho2 = dx * dx + (rho0 - dy) * (rho0 - dy)
        lam = m.atan2(side * dx, side * (rho0 - dy)) / n
        if s.kind == "lcc":
            t = m.power(m.sqrt(rho2) / abs(factor), 1 / n)
        else:
            sine = (factor - rho2 * (n / ell.a) ** 2) / n / float(authalic_q(math.pi / 2, e))
            phi = _added(m.asin(sine), ell.authalic_to_geographic, m)
    if t is not None:
        chi = math.pi / 2 - 2 * m.atan(t)
        phi = chi if s.kind == "webmerc" else _added(chi, ell.conformal_to_geographic, m)
        phi = pole * phi if s.kind == "stere" else phi
    return m.degrees(phi), m.mod(m.degrees(lam) + (s["lon_0"] + 540.0), _number(360.0, m)) - 180.0


def step(source: System, target: System) -> tuple[list[list[float]], list[float]] | None:
    """(matrix, shift) from one datum's geocentric coordinates to another's; None where nothing moves."""
    if (source.matrix, source.shift) == (target.matrix, target.shift):
        return None
    back = np.linalg.inv(np.array(target.matrix))
    return (back @ np.array(source.matrix)).tolist(), (back @ (np.array(source.shift) - np.array(target.shift))).tolist()


def geocentric(latitude, longitude, ell: Ellipsoid, m=Columns) -> tuple:
    phi, lam = m.radians(latitude), m.radians(longitude)
    sine = m.sin(phi)
    normal = ell.a / m.sqrt(1 - ell.e**2 * sine * sine)
    return normal * m.cos(phi) * m.cos(lam), normal * m.cos(phi) * m.sin(lam), normal * (1 - ell.e**2) * sine


def geographic(x, y, z, ell: Ellipsoid, m=Columns) -> tuple:
    """(latitude, longitude) in degrees, by the reduced latitude; exact to 1e-11 degrees near the ground."""
    e2, b = ell.e**2, ell.a * (1 - ell.f)
    p = m.sqrt(x * x + y * y)
    beta = m.atan2(z, p * (1 - ell.f))
    up, out = z + e2 / (1 - e2) * b * m.power(m.sin(beta), _number(3.0, m)), p - e2 * ell.a * m.power(m.cos(beta), _number(3.0, m))
    return m.degrees(m.atan2(up, out)), m.degrees(m.atan2(y, x))


def applied(xyz: tuple, move: tuple[list[list[float]], list[float]]) -> tuple:
    return tuple(sum((c * v for c, v in zip(row, xyz)), t) for row, t in zip(*move))


def converted(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """World coordinates of arrays in another system (x is the longitude in geographic ones)."""
    if source.upper() == target.upper() or geodesy.supported(source) and geodesy.supported(target):
        return geodesy.converted(x, y, source, target)
    a, b = system(source), system(target)
    move = step(a, b)
    with np.errstate(all="ignore"):
        lat, lon = inverse(x, y, a, Arrays)
        if move:
            lat, lon = geographic(*applied(geocentric(lat, lon, a.ellipsoid, Arrays), move), b.ellipsoid, Arrays)
        return forward(lat, lon, b, Arrays)


def reprojected(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """df with world coordinates x and y in another system. Every step is a projection of its own, so that no expression
    holds another one many times."""
    if source.upper() == target.upper():
        return df
    a, b = system(source), system(target)
    move = step(a, b)
    free = [f"_{i}_{''.join(df.columns)}" for i in range(6)]

    def put(df: DataFrame, names: list[str], values: tuple[Column, ...]) -> DataFrame:
        return df.withColumns(dict(zip(names, values)))

    out = put(df, free[:2], inverse(F.col(x).cast("double"), F.col(y).cast("double"), a))
    if move:
        out = put(out, free[2:5], applied(geocentric(F.col(free[0]), F.col(free[1]), a.ellipsoid), move))
        out = put(out, free[:2], geographic(*(F.col(c) for c in free[2:5]), b.ellipsoid))
    return put(out, [x, y], forward(F.col(free[0]), F.col(free[1]), b)).drop(*free)
