"""Distances and polygon tests as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6367.0
KM_PER_DEGREE = 111.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlon, dlat = F.radians(lon2 - lon1), F.radians(lat2 - lat1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar_degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lon_scale: Column | float = 1.0) -> Column:
    k = lon_scale if isinstance(lon_scale, Column) else F.lit(float(lon_scale))
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow((lon2 - lon1) * k, 2))


def closed_ring(ring: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = [(float(a), float(b)) for a, b in ring]
    return pts if pts[0] == pts[-1] else [*pts, pts[0]]


def in_ring(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test of a point against one ring of (lat, lon) corners.

    The ring is configuration, so it becomes a literal array of edges: a narrow expression without any join.
    """
    pts = closed_ring(ring)
    edges = F.array(*[
        F.struct(F.lit(a[0]).alias("y1"), F.lit(a[1]).alias("x1"), F.lit(b[0]).alias("y2"), F.lit(b[1]).alias("x2"))
        for a, b in zip(pts[:-1], pts[1:]) if a[0] != b[0]
    ])
    crossings = F.size(F.filter(
        edges,
        lambda e: ((e.y1 > lat) != (e.y2 > lat))
        & (lon < F.try_divide((e.x2 - e.x1) * (lat - e.y1), e.y2 - e.y1) + e.x1),
    ))
    return crossings % 2 == 1


def first_domain(lat: Column, lon: Column, domains: dict[str, Sequence[tuple[float, float]]]) -> Column:
    """Name of the first domain that holds the point, in the order given; NULL when none does."""
    out: Column | None = None
    for name, ring in domains.items():
        hit = in_ring(lat, lon, ring)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")
