"""Planar geometry and map projections as column expressions.

Rings are arrays of struct<x, y>; the last vertex repeats the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))


def signed_area(ring: Column) -> Column:
    """Shoelace; positive when counter-clockwise.  One pass that carries the vertex before."""
    first = F.get(ring, F.lit(0))
    start = F.struct(F.lit(0.0).alias("s"), first["x"].alias("x"), first["y"].alias("y"))
    step = lambda a, p: F.struct((a["s"] + (a["x"] * p["y"] - p["x"] * a["y"])).alias("s"), p["x"].alias("x"), p["y"].alias("y"))
    return F.aggregate(ring, start, step, lambda a: a["s"]) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; what points on the edge give is not defined, see ``on_ring``."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay > y) != (by > y)
        return spans & (x < (bx - ax) * (y - ay) / F.when(by == ay, 1.0).otherwise(by - ay) + ax)

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        flat = (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0
        return flat & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(_edges(ring), touches)


def intersects(ring: Column, x: Column, y: Column) -> Column:
    return on_ring(ring, x, y) | in_ring(ring, x, y)


def within(ring: Column, x: Column, y: Column) -> Column:
    return in_ring(ring, x, y) & ~on_ring(ring, x, y)


def in_region(rings: Column, x: Column, y: Column) -> Column:
    """Strictly inside a region of several rings: an odd number of them holds the point, none touches it."""
    return (F.size(F.filter(rings, lambda r: in_ring(r, x, y))) % 2 == 1) & ~F.exists(rings, lambda r: on_ring(r, x, y))


def polygon_area(rings: Column) -> Column:
    """The first ring's area without that of the others, its holes; whatever way they turn."""
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)


def polygon_centroid(rings: Column) -> tuple[Column, Column]:
    """(x, y) of a first ring and its holes; null without area."""

    def moment(k: str) -> Column:
        def of(ring: Column) -> Column:
            terms = F.transform(_edges(ring), lambda e: (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
            return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 6 * F.signum(signed_area(ring))

        parts = F.transform(rings, of)
        return 2 * parts[0] - F.aggregate(parts, F.lit(0.0), lambda s, a: s + a)

    area = F.nullif(polygon_area(rings), F.lit(0.0))
    return moment("x") / area, moment("y") / area


def to_utm(rings: Column, zone: Column) -> Column:
    """Rings in degrees as rings in metres.

    The series of ``utm_forward`` in steps over the ring, since functions of
    array elements work out each mention of a subexpression anew."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    steps = (
        lambda p: F.struct(F.sin(F.radians(p["y"])).alias("s"), F.radians(p["x"] - (zone * 6 - 183)).alias("lam")),
        lambda p: F.struct(F.sinh(F.atanh(p["s"]) - k * F.atanh(k * p["s"])).alias("t"), p["lam"].alias("lam")),
        lambda p: F.struct(F.atan2(p["t"], F.cos(p["lam"])).alias("xi"), F.atanh(F.sin(p["lam"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta")),
        lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", _utm_series(p["xi"], p["eta"]))]),
    )

    def ring(r: Column) -> Column:
        for step in steps:
            r = F.transform(r, step)
        return r

    return F.transform(rings, ring)


def degrees_to_km2(area_deg2: Column, lat: Column) -> Column:
    """Square degrees at a latitude, with 12391 square kilometres to one at the equator."""
    return area_deg2 * 12391.0 * F.cos(F.radians(lat))


def mercator_y(lat: Column) -> Column:
    return F.lit(6378137.0) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_x(lon: Column) -> Column:
    return F.lit(6378137.0) * F.radians(lon)


# WGS 84 and the Krueger series to third order (public formulas).
_A, _FLAT, _SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres, northern hemisphere."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    return _utm_series(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)))


def _utm_series(xi: Column, eta: Column) -> tuple[Column, Column]:
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + _SCALE * _RECT * e, _SCALE * _RECT * n


def utm_forward_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """The series of ``utm_forward`` as SQL text, for the twin."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = f"radians({lat})", f"radians({lon}-({zone * 6 - 183}))"
    t = f"sinh(atanh(sin({phi}))-{k!r}*atanh({k!r}*sin({phi})))"
    xi, eta = f"atan2({t},cos({lam}))", f"atanh(sin({lam})/sqrt(1+{t}*{t}))"
    e = "+".join([eta] + [f"{a!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, a in enumerate(_ALPHA, 1)])
    n = "+".join([xi] + [f"{a!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, a in enumerate(_ALPHA, 1)])
    return f"500000.0E0+{_SCALE * _RECT!r}*({e})", f"{_SCALE * _RECT!r}*({n})"


def utm_inverse(easting: Column, northing: Column, zone: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = northing / (_SCALE * _RECT), (easting - 500000.0) / (_SCALE * _RECT)
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + (zone * 6 - 183), F.degrees(phi)


def utm_inverse_sql(easting: str, northing: str, zone: int) -> tuple[str, str]:
    """The series of ``utm_inverse`` as SQL text, for the twin."""
    xi, eta = f"({northing}/{_SCALE * _RECT!r})", f"(({easting}-500000.0E0)/{_SCALE * _RECT!r})"
    x = xi + "".join(f"-({b!r})*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, b in enumerate(_BETA, 1))
    e = eta + "".join(f"-({b!r})*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, b in enumerate(_BETA, 1))
    chi = f"asin(sin({x})/cosh({e}))"
    phi = chi + "".join(f"+({d!r})*sin({2 * j}*{chi})" for j, d in enumerate(_DELTA, 1))
    return f"degrees(atan2(sinh({e}),cos({x})))+({zone * 6 - 183})", f"degrees({phi})"
