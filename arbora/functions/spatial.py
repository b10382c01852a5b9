"""Planar geometry: points by expressions, other shapes as WKT texts by Arrow-batched functions.

A latitude is the first coordinate and a longitude the second, as in ``POINT (lat lon)``. A geometry is a ``string`` column in
well-known text; NULL stays NULL, and a text that is no geometry raises an error, as a wrong literal should.
"""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAT_BITS, LON_BITS = 28, 29
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
_NAME = {k.upper(): k for k in KINDS}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|" + _NUMBER.pattern + r")")


class Geometry:
    """A kind, and coordinates nested as the kind asks: a point, a list of points, a list of rings, or parts."""

    def __init__(self, kind: str, body: list) -> None:
        self.kind, self.body = kind, body

    def points(self) -> list[tuple[float, float]]:
        return {"Point": lambda: [self.body], "LineString": lambda: self.body, "Polygon": lambda: [p for r in self.body for p in r]}.get(self.kind, lambda: [p for g in self.body for p in g.points()])()

    def segments(self) -> list[tuple]:
        if self.kind == "LineString":
            return list(zip(self.body, self.body[1:], strict=False))
        if self.kind == "Polygon":
            return [s for r in self.body for s in zip(r, r[1:], strict=False)]
        return [] if self.kind == "Point" else [s for g in self.body for s in g.segments()]

    def areas(self) -> list[list]:
        """Ring lists of all polygons."""
        if self.kind == "Polygon":
            return [self.body]
        return [] if self.kind in ("Point", "LineString") else [a for g in self.body for a in g.areas()]

    def dimension(self) -> int:
        return 2 if self.areas() else 1 if self.segments() else 0


@lru_cache(4096)
def parse_wkt(text: str) -> Geometry:
    """The geometry of a text; a constant is parsed once in a worker."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a geometry: {text!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def need(t: str) -> None:
        if not tokens or tokens.pop() != t:
            raise ValueError(f"not a geometry: {text!r}")

    def several(one) -> list:
        if tokens and tokens[-1].upper() == "EMPTY":
            tokens.pop()
            return []
        need("(")
        out = [one()]
        while tokens and tokens[-1] == ",":
            tokens.pop()
            out.append(one())
        need(")")
        return out

    def point() -> tuple[float, float]:
        try:
            return float(tokens.pop()), float(tokens.pop())
        except (IndexError, ValueError) as e:
            raise ValueError(f"not a geometry: {text!r}") from e

    line = lambda: several(point)
    rings = lambda: several(line)

    def any_kind() -> Geometry:
        kind = _NAME.get(tokens.pop().upper() if tokens else "")
        if kind == "Point":
            found = several(point)
            if len(found) != 1:
                raise ValueError(f"not a geometry: {text!r}")
            return Geometry(kind, found[0])
        if kind in ("LineString", "Polygon"):
            return Geometry(kind, line() if kind == "LineString" else rings())
        if kind == "MultiPoint":
            bare = lambda: several(point)[0] if tokens[-1] == "(" else point()
            return Geometry(kind, [Geometry("Point", p) for p in several(bare)])
        if kind in ("MultiLineString", "MultiPolygon"):
            inner = kind.removeprefix("Multi")
            return Geometry(kind, [Geometry(inner, b) for b in several(line if inner == "LineString" else rings)])
        if kind == "GeometryCollection":
            return Geometry(kind, several(any_kind))
        raise ValueError(f"not a geometry: {text!r}")

    out = any_kind()
    if tokens:
        raise ValueError(f"not a geometry: {text!r}")
    return out


def to_wkt(g: Geometry) -> str:
    number = lambda x: str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
    point = lambda p: f"{number(p[0])} {number(p[1])}"
    line = lambda ps: "(" + ", ".join(map(point, ps)) + ")"
    rings = lambda rs: "(" + ", ".join(map(line, rs)) + ")"
    if g.kind != "Point" and not g.body:
        return f"{g.kind.upper()} EMPTY"
    inner = {"Point": lambda: f"({point(g.body)})", "LineString": lambda: line(g.body), "Polygon": lambda: rings(g.body)}
    several = lambda: "(" + ", ".join(to_wkt(x) if g.kind == "GeometryCollection" else to_wkt(x).split(" ", 1)[1] for x in g.body) + ")"
    return f"{g.kind.upper()} {inner.get(g.kind, several)()}"


def to_wkb(g: Geometry) -> bytes:
    out = struct.pack(">BI", 0, KINDS.index(g.kind) + 1)
    line = lambda ps: struct.pack(">I", len(ps)) + b"".join(struct.pack(">dd", *p) for p in ps)
    if g.kind == "Point":
        return out + struct.pack(">dd", *g.body)
    if g.kind == "LineString":
        return out + line(g.body)
    return out + struct.pack(">I", len(g.body)) + b"".join(map(line if g.kind == "Polygon" else to_wkb, g.body))


def parse_wkb(data: bytes) -> Geometry:
    at = 0

    def take(order: str, shape: str):
        nonlocal at
        out = struct.unpack_from(order + shape, data, at)
        at += struct.calcsize(order + shape)
        return out

    def any_kind() -> Geometry:
        order = "<" if take(">", "B")[0] else ">"
        number = take(order, "I")[0]
        if not 1 <= number <= len(KINDS):
            raise ValueError("not a geometry")
        kind = KINDS[number - 1]
        line = lambda: [take(order, "dd") for _ in range(take(order, "I")[0])]
        if kind == "Point":
            return Geometry(kind, take(order, "dd"))
        if kind == "LineString":
            return Geometry(kind, line())
        return Geometry(kind, [line() if kind == "Polygon" else any_kind() for _ in range(take(order, "I")[0])])

    return any_kind()


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p) -> bool:
    return _side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def place(g: Geometry, p) -> int:
    """1 inside a polygon, 0 on a boundary, a line or a point, -1 outside."""
    best = -1
    for rings in g.areas():
        if any(_on(a, b, p) for r in rings for a, b in zip(r, r[1:], strict=False)):
            best = max(best, 0)
            continue
        inside = False
        for r in rings:
            for a, b in zip(r, r[1:], strict=False):
                if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                    inside = not inside
        best = max(best, 1 if inside else -1)
    if best < 0 and not g.areas():
        best = 0 if p in g.points() or any(_on(a, b, p) for a, b in g.segments()) else -1
    return best


def _cross(s, t) -> bool:
    """True if two segments cross at one inner point of both."""
    (a, b), (c, d) = s, t
    return _side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0


def _probes(g: Geometry, other: Geometry) -> list:
    """Points of ``g`` that decide how it lies to ``other``: corners, and middles between places where boundaries meet."""
    out = list(g.points())
    for a, b in g.segments():
        cuts = {0.0, 1.0}
        for c, d in other.segments():
            down = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if down:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / down
                if 0 < t < 1:
                    cuts.add(t)
            else:
                for p in (c, d):
                    if _on(a, b, p):
                        cuts.add(math.dist(a, p) / math.dist(a, b) if a != b else 0.0)
        order = sorted(cuts)
        out += [(a[0] + (b[0] - a[0]) * (x + y) / 2, a[1] + (b[1] - a[1]) * (x + y) / 2) for x, y in zip(order, order[1:], strict=False)]
    return out


def covers(a: Geometry, b: Geometry) -> bool:
    """Every point of ``b`` is in ``a``, boundary included."""
    return all(place(a, p) >= 0 for p in _probes(b, a)) and not (b.areas() and not a.areas())


def _inner(g: Geometry) -> list:
    """A point inside of each polygon."""
    out = []
    for rings in g.areas():
        ring = rings[0]
        corners = ring[:-1]
        n = len(corners)
        for i in range(n):
            a, b, c = corners[i - 1], corners[i], corners[(i + 1) % n]
            middle = ((a[0] + b[0] + c[0]) / 3, (a[1] + b[1] + c[1]) / 3)
            if place(Geometry("Polygon", rings), middle) == 1:
                out.append(middle)
                break
    return out


def contains(a: Geometry, b: Geometry) -> bool:
    """``a`` covers ``b``, and their interiors meet: ``b`` does not lie on the boundary alone."""
    if not covers(a, b):
        return False
    return not a.areas() or any(place(a, p) == 1 for p in [*_probes(b, a), *_inner(b)])


def overlaps(a: Geometry, b: Geometry) -> bool:
    """Shapes of one dimension whose interiors meet in that dimension, and neither covers the other."""
    if a.dimension() != b.dimension() or covers(a, b) or covers(b, a):
        return False
    if a.dimension() == 0:
        return bool({*a.points()} & {*b.points()})
    if a.dimension() == 1:
        corners = [{*x.points()} for x in (a, b)]
        return any(place(b, p) == 0 for p in _probes(a, b) if p not in corners[0] | corners[1])
    return any(_cross(s, t) for s in a.segments() for t in b.segments()) or any(place(y, p) == 1 for x, y in ((a, b), (b, a)) for p in [*_probes(x, y), *_inner(x)])


def shape_distance(a: Geometry, b: Geometry) -> float:
    """Least planar distance; 0 where shapes meet."""
    if any(place(x, p) >= 0 for x, y in ((a, b), (b, a)) for p in y.points()) or any(_cross(s, t) for s in a.segments() for t in b.segments()):
        return 0.0

    def to_segment(p, s) -> float:
        (ax, ay), (bx, by) = s
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / size)) if size else 0.0
        return math.dist(p, (ax + t * (bx - ax), ay + t * (by - ay)))

    return min([math.dist(p, q) for p in a.points() for q in b.points()] + [to_segment(p, s) for x, y in ((a, b), (b, a)) for p in x.points() for s in y.segments()])


def envelope(g: Geometry, by: float) -> Geometry:
    """The bounding box, wider by a distance on each side."""
    xs, ys = zip(*g.points(), strict=True)
    x0, x1, y0, y1 = min(xs) - by, max(xs) + by, min(ys) - by, max(ys) + by
    return Geometry("Polygon", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])


def _in_range(lat: float, lon: float) -> tuple[float, float]:
    if abs(lat) > 90 or abs(lon) > 180:
        raise ValueError(f"out of range: latitude {lat}, longitude {lon}")
    return lat, lon


#: Result type and meaning of each function over geometries, by its SQL name.
GEOMETRIC = {
    "geo_wkt": ("string", lambda t: to_wkt(parse_wkt(t))),
    "geo_wkb": ("string", lambda b: to_wkt(parse_wkb(bytes(b)))),
    "geo_as_wkb": ("binary", lambda t: to_wkb(parse_wkt(t))),
    "geo_lat_lon": ("string", lambda y, x: to_wkt(Geometry("Point", _in_range(float(y), float(x))))),
    "geo_type_string": ("string", lambda t: parse_wkt(t).kind),
    "geo_overlaps": ("boolean", lambda s, t: overlaps(parse_wkt(s), parse_wkt(t))),
    "geo_contains": ("boolean", lambda s, t: contains(parse_wkt(s), parse_wkt(t))),
    "geo_covers": ("boolean", lambda s, t: covers(parse_wkt(s), parse_wkt(t))),
    "geo_within_distance": ("boolean", lambda s, t, d: shape_distance(parse_wkt(s), parse_wkt(t)) <= float(d)),
    "geo_expanded_envelope": ("string", lambda t, d: to_wkt(envelope(parse_wkt(t), float(d)))),
}


def geometric(name: str):
    """A function over geometries that takes Arrow batches; NULL where an argument is."""
    kind, function = GEOMETRIC[name]

    def run(*parts: pd.Series) -> pd.Series:
        rows = zip(*parts, strict=True)
        return pd.Series([None if any(x is None or x != x for x in r) else function(*r) for r in rows], dtype=object)

    return F.pandas_udf(run, kind)


def geo_wkt(text: Column) -> Column:
    """A well-known text, checked and in normal form."""
    return geometric("geo_wkt")(text)


def geo_wkb(data: Column) -> Column:
    """The geometry of well-known binary data."""
    return geometric("geo_wkb")(data)


def geo_as_wkb(g: Column) -> Column:
    return geometric("geo_as_wkb")(g)


def geo_lat_lon(lat: Column, lon: Column) -> Column:
    """A point; an error for coordinates out of range."""
    return geometric("geo_lat_lon")(lat, lon)


def geo_type_string(g: Column) -> Column:
    return geometric("geo_type_string")(g)


def geo_overlaps(a: Column, b: Column) -> Column:
    return geometric("geo_overlaps")(a, b)


def geo_contains(a: Column, b: Column) -> Column:
    return geometric("geo_contains")(a, b)


def geo_covers(a: Column, b: Column) -> Column:
    return geometric("geo_covers")(a, b)


def geo_within_distance(a: Column, b: Column, distance: Column) -> Column:
    return geometric("geo_within_distance")(a, b, distance)


def geo_expanded_envelope(g: Column, distance: Column) -> Column:
    return geometric("geo_expanded_envelope")(g, distance)


def distance_lat_lon(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance in degrees, the short way round; an error for a coordinate out of range."""
    dx = F.abs(lon1 - lon2)
    dx = F.when(dx > 180, 360 - dx).otherwise(dx)
    bad = (F.abs(lat1) > 90) | (F.abs(lat2) > 90) | (F.abs(lon1) > 180) | (F.abs(lon2) > 180)
    return F.when(bad, F.raise_error(F.lit("coordinate out of range")).cast("double")).otherwise(F.sqrt(dx * dx + (lat1 - lat2) * (lat1 - lat2)))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inside a box, which crosses the date line if west is above east. The bounds are plain ranges, so scans prune by them."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return (lat >= south) & (lat <= north) & across


def z_value(lat: Column, lon: Column) -> Column:
    """Interleaved bits of a point, a longitude's first: near points mostly get near values.

    A table sorted by it keeps boxes in few files, whose minima and maxima of latitude and longitude then prune scans.
    """
    y = F.least(((lat + 90) / 180 * 2**LAT_BITS).cast("long"), F.lit(2**LAT_BITS - 1))
    x = F.least(((lon + 180) / 360 * 2**LON_BITS).cast("long"), F.lit(2**LON_BITS - 1))

    def spread(v: Column) -> Column:
        """Every bit moved to twice its place."""
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def clustered(df: DataFrame, lat: str, lon: str, partitions: int) -> DataFrame:
    """Rows dealt and sorted by their place, for writing a table that box queries read little of."""
    z = z_value(F.col(lat), F.col(lon))
    return df.withColumn("_z", z).repartitionByRange(partitions, "_z").sortWithinPartitions("_z").drop("_z")


def nearest(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, k: int, tie: str) -> DataFrame:
    """The ``k`` rows nearest to a point, ties by ``tie``; each task keeps ``k`` rows at most."""
    far = distance_lat_lon(F.col(lat), F.col(lon), F.lit(float(to_lat)), F.lit(float(to_lon)))
    return df.withColumn("far", far).orderBy("far", tie).limit(k)
