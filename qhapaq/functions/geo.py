"""Distances and projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The radii of routing (metres) and of reporting (kilometres), and metres in a degree.
EARTH_M, EARTH_KM = 6_371_000.0, 6371.0088
DEGREE_LON_M, DEGREE_LAT_M = 111_320.0, 110_540.0
MERCATOR_M = 6_378_137.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance, in the radius's unit."""
    north, east = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    chord = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return F.asin(F.sqrt(chord)) * (2 * radius)


def local_xy(lon: Column, lat: Column, at_lat: Column | float) -> tuple[Column, Column]:
    """Metres in a flat plane that fits around the latitude at_lat; differences of coordinates give distances along the axes."""
    scale = F.lit(math.cos(math.radians(at_lat))) if isinstance(at_lat, float) else F.cos(F.radians(at_lat))
    return lon * scale * DEGREE_LON_M, lat * DEGREE_LAT_M


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR_M


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(F.atan(F.exp(y / MERCATOR_M)) * 2 - math.pi / 2)


def node(value: Column) -> Column:
    """A coordinate as a whole number of 1e-7 degrees: points that agree to seven decimals are one node."""
    return F.round(value * 1e7).cast("long")
