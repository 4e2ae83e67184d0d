"""Geohash, distances and simple WKT predicates."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_M = 6_371_008.8


def geohash(lat: Column, lon: Column, length: int) -> Column:
    """Interleaved bits of the cell numbers of longitude and latitude, in base 32."""
    bits = 5 * length
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * 2**n_lon), F.lit(2**n_lon - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * 2**n_lat), F.lit(2**n_lat - 1)).cast("long")
    out = []
    for c in range(length):
        value = F.lit(0)
        for k in range(5):
            i = 5 * c + k
            bit = F.shiftright(x, n_lon - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, n_lat - 1 - i // 2)
            value = value * 2 + bit.bitwiseAND(F.lit(1))
        out.append(F.substr(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash_neighbours(lat: Column, lon: Column, length: int) -> Column:
    """The eight cells around, clockwise from the north."""
    bits = 5 * length
    dlon, dlat = 360 / 2 ** ((bits + 1) // 2), 180 / 2 ** (bits // 2)
    wrap = lambda x: F.pmod(x + 180, F.lit(360.0)) - 180
    steps = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
    return F.array(*[geohash(lat + a * dlat, wrap(lon + b * dlon), length) for a, b in steps])


def wkt_point_from_latlng(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def distance_sphere_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


@lru_cache(maxsize=4096)
def _points(wkt: str) -> list[list[tuple[float, float]]]:
    """Rings of a POINT, LINESTRING or POLYGON."""
    body = wkt[wkt.index("(") :].strip()
    rings = re.findall(r"\(([^()]*)\)", body)
    return [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in rings]


def _is_polygon(wkt: str) -> bool:
    return wkt.lstrip().upper().startswith("POLYGON")


def _edges(rings: list) -> list:
    return [e for r in rings for e in zip(r, r[1:])]


def _turn(p: tuple, q: tuple, r: tuple) -> float:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _on(p: tuple, q: tuple, r: tuple) -> bool:
    """Whether r lies on the segment from p to q, but for rounding."""
    size = max(abs(q[0] - p[0]), abs(q[1] - p[1]))
    near = abs(_turn(p, q, r)) <= 1e-12 * max(size, 1e-300) * max(1.0, *map(abs, (*p, *q, *r)))
    slack = 1e-12 * max(1.0, *map(abs, (*p, *q)))
    return near and min(p[0], q[0]) - slack <= r[0] <= max(p[0], q[0]) + slack and min(p[1], q[1]) - slack <= r[1] <= max(p[1], q[1]) + slack


def _place(at: tuple, rings: list) -> int:
    """1 inside a polygon, 0 on its boundary, -1 outside."""
    x, y = at
    hit = False
    for p, q in _edges(rings):
        if _on(p, q, at):
            return 0
        if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
            hit = not hit
    return 1 if hit else -1


def _cuts(p: tuple, q: tuple, edges: list) -> list[float]:
    """Where a segment meets edges, as shares of its length; 0 and 1 included."""
    dx, dy = q[0] - p[0], q[1] - p[1]
    out = {0.0, 1.0}
    for s, t in edges:
        ex, ey = t[0] - s[0], t[1] - s[1]
        cross = dx * ey - dy * ex
        if cross:
            u = ((s[0] - p[0]) * ey - (s[1] - p[1]) * ex) / cross
            w = ((s[0] - p[0]) * dy - (s[1] - p[1]) * dx) / cross
            if 0 <= u <= 1 and 0 <= w <= 1:
                out.add(u)
        else:
            length = dx * dx + dy * dy
            out |= {u for c in (s, t) if length and _on(p, q, c) and 0 <= (u := ((c[0] - p[0]) * dx + (c[1] - p[1]) * dy) / length) <= 1}
    return sorted(out)


def _middles(rings: list, edges: list) -> list[tuple[float, float]]:
    """One point of every piece that ``edges`` cut the lines of ``rings`` into."""
    out = []
    for p, q in _edges(rings):
        cuts = _cuts(p, q, edges)
        out += [(p[0] + (q[0] - p[0]) * (u + w) / 2, p[1] + (q[1] - p[1]) * (u + w) / 2) for u, w in zip(cuts, cuts[1:]) if p != q]
    return out


def _contains(a: str, b: str) -> bool:
    """No point of b outside a, and the interiors meet; a is a polygon, else it holds only points on it."""
    u, v = _points(a), _points(b)
    corners = [p for r in v for p in r]
    if not _is_polygon(a):
        ends = set() if len(u[0]) == 1 or u[0][0] == u[0][-1] else {u[0][0], u[0][-1]}
        inner = [p for p in corners if p in u[0] and p not in ends or any(_on(*e, p) for e in _edges(u)) and p not in ends] + _middles(v, _edges(u))
        return bool(inner) and not _is_polygon(b) and all(p in u[0] or any(_on(*e, p) for e in _edges(u)) for p in corners + inner)
    places = [_place(p, u) for p in corners]
    pieces = [_place(p, u) for p in _middles(v, _edges(u))]
    if min(places + pieces) < 0:
        return False
    if not _is_polygon(b):
        return max(pieces or places) > 0
    # the outline is in a: nothing of b is outside unless a hole of a reaches into b
    return all(_place(p, v) <= 0 for hole in u[1:] for p in [*hole, *_middles([hole], _edges(v))]) and (len(u) == 1 or _solid(u, v))


def _solid(u: list, v: list) -> bool:
    """Whether b's interior is none of a's holes: a hole with the very outline of b leaves nothing."""
    return not any(all(_place(p, v[:1]) == 0 for p in [*hole, *_middles([hole], _edges(v[:1]))]) for hole in u[1:])


@F.pandas_udf(T.BooleanType())
def st_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether a holds every point of b, and not on its boundary only."""
    return pd.Series([None if x is None or y is None else _contains(x, y) for x, y in zip(a, b)], dtype=object)


def st_within(a: Column, b: Column) -> Column:
    return st_contains(b, a)


def _meet(a: str, b: str) -> bool:
    u, v = _points(a), _points(b)
    if _is_polygon(a) and any(_place(p, u) >= 0 for r in v for p in r) or _is_polygon(b) and any(_place(p, v) >= 0 for r in u for p in r):
        return True
    if {p for r in u for p in r} & {p for r in v for p in r} or any(_on(*e, p) for e in _edges(u) for r in v for p in r) or any(_on(*e, p) for e in _edges(v) for r in u for p in r):
        return True
    return any(_turn(p, q, s) * _turn(p, q, t) < 0 and _turn(s, t, p) * _turn(s, t, q) < 0 for p, q in _edges(u) for s, t in _edges(v))


@F.pandas_udf(T.BooleanType())
def st_intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two shapes share a point, boundaries included."""
    return pd.Series([None if x is None or y is None else _meet(x, y) for x, y in zip(a, b)], dtype=object)


def _area(wkt: str) -> float:
    size = [abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:]))) / 2 for r in _points(wkt)] if _is_polygon(wkt) else [0.0]
    return size[0] - sum(size[1:])


@F.pandas_udf(T.DoubleType())
def st_area(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _area(x) for x in a], dtype=float)
