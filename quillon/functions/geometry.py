"""Geometry in WKT text: points, line strings and polygons without holes, in the plane."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(wkt: str) -> tuple[str, np.ndarray]:
    m = re.fullmatch(r"\s*(POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)+\s*", wkt.upper())
    if not m:
        raise ValueError(f"no geometry: {wkt!r}")
    return m[1], np.array([[float(v) for v in p.split()] for p in m[2].split(",")])


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())) / 2


def _segments(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(p[0], p[0])] if len(p) == 1 else list(zip(p[:-1], p[1:], strict=True))


def _cross(o, a, b) -> float:
    return float((a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]))


def _on(p, a, b) -> bool:
    return abs(_cross(a, b, p)) < 1e-12 and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12


def _meet(s, t) -> bool:
    (a, b), (c, d) = s, t
    if any((_on(a, c, d), _on(b, c, d), _on(c, a, b), _on(d, a, b))):
        return True
    return (_cross(a, b, c) > 0) != (_cross(a, b, d) > 0) and (_cross(c, d, a) > 0) != (_cross(c, d, b) > 0) and not np.array_equal(a, b) and not np.array_equal(c, d)


def _point_distance(p, a, b) -> float:
    d = b - a
    n = float(d @ d)
    t = 0.0 if n == 0 else min(1.0, max(0.0, float((p - a) @ d) / n))
    return float(np.hypot(*(p - a - t * d)))


def locate(p: np.ndarray, ring: np.ndarray) -> int:
    """1 inside a polygon, 0 on its boundary, -1 outside."""
    if any(_on(p, a, b) for a, b in _segments(ring)):
        return 0
    inside = False
    for a, b in _segments(ring):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return 1 if inside else -1


def intersects(g, h) -> bool:
    (kind, p), (other, q) = g, h
    if any(_meet(s, t) for s in _segments(p) for t in _segments(q)):
        return True
    return (kind == "POLYGON" and locate(q[0], p) >= 0) or (other == "POLYGON" and locate(p[0], q) >= 0)


def covers(g, h) -> bool:
    """No point of h lies outside g; g is a polygon, or a point or line h lies on."""
    (kind, p), (_, q) = g, h
    middle = (q[:-1] + q[1:]) / 2 if len(q) > 1 else q
    points = [*q, *middle]
    if kind == "POLYGON":
        return all(locate(x, p) >= 0 for x in points)
    return all(any(_on(x, a, b) for a, b in _segments(p)) for x in points)


def contains(g, h) -> bool:
    """covers, and an inner point of h lies inside g."""
    if not covers(g, h):
        return False
    (kind, p), (_, q) = g, h
    return kind != "POLYGON" or any(locate(x, p) > 0 for x in ([*q, *((q[:-1] + q[1:]) / 2), q[:-1].mean(0)] if len(q) > 1 else q))


def touches(g, h) -> bool:
    """They meet, in boundary points only."""
    (kind, p), (other, q) = g, h
    if not intersects(g, h):
        return False
    inner = any(locate(x, p) > 0 for x in [*q, *((q[:-1] + q[1:]) / 2)]) if kind == "POLYGON" else False
    outer = any(locate(x, q) > 0 for x in [*p, *((p[:-1] + p[1:]) / 2)]) if other == "POLYGON" else False
    return not inner and not outer and not (kind == other == "POINT")


def distance(g, h) -> float:
    if intersects(g, h):
        return 0.0
    (_, p), (_, q) = g, h
    return min(min(_point_distance(x, a, b) for x in p for a, b in _segments(q)), min(_point_distance(x, a, b) for x in q for a, b in _segments(p)))


def _binary(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(parse(x), parse(y)) for x, y in zip(a, b, strict=True)])

    return run


st_intersects = _binary(intersects, T.BooleanType())
st_covers = _binary(covers, T.BooleanType())
st_contains = _binary(contains, T.BooleanType())
st_touches = _binary(touches, T.BooleanType())
st_equals = _binary(lambda g, h: covers(g, h) and covers(h, g), T.BooleanType())
st_distance = _binary(distance, T.DoubleType())


@F.pandas_udf(T.DoubleType())
def st_area(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _area(parse(x)[1]) if parse(x)[0] == "POLYGON" else 0.0 for x in a])


def st_dwithin(a, b, d: float):
    return st_distance(a, b) <= d
