"""Positions: distances, boxes, travel times, middles of lines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
# Metres an hour by means of travel, and the detour of roads.
SPEEDS = {"walk": 4800, "car": 20000}
DETOUR = 1.3


def haversine(lat: Column, lon: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    """Great-circle metres between two positions in degrees."""
    a, b = F.radians(lat.cast("double")), F.radians(lat2.cast("double"))
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    h = half(b - a) + F.cos(a) * F.cos(b) * half(F.radians(lon2.cast("double")) - F.radians(lon.cast("double")))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_box(lat: Column, lon: Column, at_lat: float, at_lon: float, metres: float) -> Column:
    """The box around a point that a circle of the given radius fills; Parquet's statistics can use it."""
    high = metres / METRES_PER_DEGREE
    wide = high / max(math.cos(math.radians(at_lat)), 1e-6)
    return lat.between(at_lat - high, at_lat + high) & lon.between(at_lon - wide, at_lon + wide)


def travel_minutes(metres: Column, mode: str) -> Column:
    """Whole minutes, rounded up, for a distance as the crow flies."""
    return F.ceil(metres * (DETOUR * 60) / SPEEDS[mode]).cast("int")


def line_middle(points: Column) -> Column:
    """struct<lon, lat> halfway along a line of [lon, lat] points; the first point if the line has no length, null without points."""
    lon, lat = (lambda p: F.element_at(p, 1)), (lambda p: F.element_at(p, 2))
    first = F.get(points, F.lit(0))
    scale = F.cos(F.radians(lat(first)))
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    measured = F.transform(
        pairs,
        lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.hypot((lon(p["b"]) - lon(p["a"])) * scale, lat(p["b"]) - lat(p["a"])).alias("n")),
    )
    half = F.aggregate(measured, F.lit(0.0), lambda s, p: s + p["n"]) / 2
    none = F.lit(None).cast("struct<lon:double,lat:double>")
    begin = F.struct(half.alias("left"), none.alias("at"))

    def step(s: Column, p: Column) -> Column:
        here = s["at"].isNull() & (p["n"] > 0) & (s["left"] <= p["n"])
        share = s["left"] / p["n"]
        point = F.struct((lon(p["a"]) + (lon(p["b"]) - lon(p["a"])) * share).alias("lon"), (lat(p["a"]) + (lat(p["b"]) - lat(p["a"])) * share).alias("lat"))
        return F.struct((s["left"] - p["n"]).alias("left"), F.when(here, point).otherwise(s["at"]).alias("at"))

    start = F.struct(lon(first).alias("lon"), lat(first).alias("lat"))
    found = F.when(F.size(points) > 1, F.coalesce(F.aggregate(measured, begin, step, lambda s: s["at"]), start)).otherwise(start)
    return F.when(F.size(points) > 0, found)
