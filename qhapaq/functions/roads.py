"""Road tags, speeds and travel times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings
from qhapaq.functions.text import NUMBER

#: Road classes and their speeds by car in km/h where no limit is tagged; classes by profile.
CAR_KMH = {
    "motorway": 90, "motorway_link": 45, "trunk": 70, "trunk_link": 40, "primary": 60, "primary_link": 35,
    "secondary": 50, "secondary_link": 30, "tertiary": 40, "tertiary_link": 25, "unclassified": 30,
    "residential": 30, "living_street": 15, "service": 20, "road": 30, "track": 20}
OTHER_KMH = 30
MPH = 1.60934
NO_SPEED = ("none", "", "signals", "walk", "variable")
CAR_ROADS = frozenset(CAR_KMH) - {"service", "track"}
SLOW_ROADS = CAR_ROADS - {"motorway", "motorway_link"} | {"cycleway", "track", "path", "service"}
ROADS = {"car": CAR_ROADS, "bike": SLOW_ROADS, "foot": SLOW_ROADS | {"footway", "pedestrian", "steps", "bridleway"}}
CLOSED = ("private", "no")


def max_speed(tag: Column) -> Column:
    """km/h of one maxspeed text; null for words, empty and unreadable ones."""
    low = F.lower(F.trim(tag))
    miles = F.trim(F.replace(low, F.lit("mph"), F.lit("")))
    first = F.split(low, r"\s+")[0]
    read = lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(low.isin(*NO_SPEED), None).when(F.contains(low, F.lit("mph")), read(miles) * MPH).otherwise(read(first))


def max_speed_of_any(tags: Column) -> Column:
    """The least readable speed other than 0 of an array of tags."""
    return F.array_min(F.filter(F.transform(tags, max_speed), lambda v: v != 0))


def car_speed(highway: Column, limit: Column) -> Column:
    """km/h by car: the limit unless null or 0, else the class's speed. highway is a text or the first of an array."""
    table = F.create_map(*[F.lit(x) for pair in CAR_KMH.items() for x in pair])
    return F.coalesce(F.nullif(limit, F.lit(0.0)), F.element_at(table, F.coalesce(highway, F.lit("")) ).cast("double"), F.lit(float(OTHER_KMH)))


def speed(profile: Column, highway: Column, limit: Column, settings: Settings = SETTINGS) -> Column:
    return F.when(profile == "bike", settings.bike_kmh).when(profile == "foot", settings.foot_kmh).otherwise(car_speed(highway, limit))


def travel_seconds(metres: Column, kmh: Column) -> Column:
    """Null where nothing moves: unreachable is never a number here."""
    return F.when(kmh > 0, metres / (kmh * 1000.0 / 3600.0))
