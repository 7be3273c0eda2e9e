"""Planar and spherical geometry as column expressions.  Rings are arrays of (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6371008.7714


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def edges(ring: Column) -> Column:
    """Pairs (p, q) of neighbours in a ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + value(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), _cross) / 2


def polygon_centroid(ring: Column) -> Column:
    """Area-weighted; the mean of the corners if the area is nothing."""
    area, n = signed_area(ring), F.greatest(F.size(ring) - 1, F.lit(1))
    part = lambda c: _sum(edges(ring), lambda e: (e["p"][c] + e["q"][c]) * _cross(e)) / (6 * area)
    mean = lambda c: _sum(F.slice(ring, 1, n), lambda p: p[c]) / n
    return F.struct(*[F.when(F.abs(area) > 0, part(c)).otherwise(mean(c)).alias(c) for c in "xy"])


def multi_area(rings: Column) -> Column:
    return _sum(rings, lambda r: F.abs(signed_area(r)))


def multi_centroid(rings: Column) -> Column:
    """Middles of the rings weighted by area; that of the first if they have none."""
    total = multi_area(rings)
    mean = lambda c: _sum(rings, lambda r: F.abs(signed_area(r)) * polygon_centroid(r)[c]) / total
    return F.struct(*[F.when(total > 0, mean(c)).otherwise(polygon_centroid(rings[0])[c]).alias(c) for c in "xy"])


def line_length(line: Column) -> Column:
    return _sum(edges(line), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def line_centroid(line: Column) -> Column:
    """Midpoints weighted by length."""
    size = lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    part = lambda c: _sum(edges(line), lambda e: (e["p"][c] + e["q"][c]) / 2 * size(e)) / line_length(line)
    return F.struct(*[F.when(line_length(line) > 0, part(c)).otherwise(line[0][c]).alias(c) for c in "xy"])


def bounds(points: Column) -> Column:
    at = lambda c: F.transform(points, lambda p: p[c])
    return F.struct(F.array_min(at("x")).alias("min_x"), F.array_min(at("y")).alias("min_y"), F.array_max(at("x")).alias("max_x"), F.array_max(at("y")).alias("max_y"))


def is_closed(line: Column) -> Column:
    return (F.size(line) >= 4) & (line[0] == F.element_at(line, -1))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside: an odd number of edges to the right, and on none of them."""

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    def touches(e: Column) -> Column:
        p, q = e["p"], e["q"]
        flat = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return flat & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return (F.size(F.filter(edges(ring), crosses)) % 2 == 1) & ~F.exists(edges(ring), touches)
