"""Geometry helpers over GeoJSON coordinates kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohort.functions.text import _col

_POINTS = "array<array<double>>"


def vertices(geom_type, coords_text) -> Column:
    """All [lon, lat] vertices of a Polygon / MultiPolygon (closing vertex included)."""
    t = _col(geom_type)
    poly = F.flatten(F.from_json(_col(coords_text), "array<array<array<double>>>"))
    multi = F.flatten(F.flatten(F.from_json(_col(coords_text), "array<array<array<array<double>>>>")))
    return F.when(t == "Polygon", poly).when(t == "MultiPolygon", multi)


def vertex_centroid(geom_type, coords_text) -> Column:
    """Mean latitude / longitude over all vertices; Point passes through; other types NULL."""
    t = _col(geom_type)
    pts = vertices(geom_type, coords_text)
    n = F.size(pts)
    lat = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p[1]) / n
    lon = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p[0]) / n
    point = F.from_json(_col(coords_text), "array<double>")
    has = pts.isNotNull() & (n > 0)
    return (F.when(t == "Point", F.struct(point[1].alias("lat"), point[0].alias("lon")))
            .when(has, F.struct(lat.alias("lat"), lon.alias("lon"))))
