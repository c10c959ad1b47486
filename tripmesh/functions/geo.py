"""Bearings and Web Mercator (EPSG:3857)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0


def bearing_degrees(delta_lat: Column, delta_lon: Column) -> Column:
    """Direction in the lon/lat plane: 0 is east, 90 is north."""
    return F.degrees(F.atan2(delta_lat, delta_lon))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * EARTH_RADIUS_M
