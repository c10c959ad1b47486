"""Where flights are: airport coordinates, bearings, jitter, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.functions.geo import bearing_degrees, mercator_x, mercator_y
from tripmesh.functions.noise import centred, uniform_pair
from tripmesh.operators.lookup import Lookup, attach


def airport_join(flights: DataFrame, airports: Lookup, settings: Settings) -> DataFrame:
    """Add coordinates of both ends; flights with an unknown end are dropped."""
    for end in ("dep", "arr"):
        side = airports.df.select(
            F.col("airport").alias(f"{end}_airport"),
            F.col("latitude").alias(f"{end}_lat"),
            F.col("longitude").alias(f"{end}_lon"),
        )
        flights = attach(flights, airports.derive(side), [f"{end}_airport"], settings, how="inner")
    return flights


def route_bearing(flights: DataFrame) -> DataFrame:
    """Add ``delta_lat``, ``delta_lon`` and ``bearing`` from departure to arrival."""
    return flights.withColumns(
        {
            "delta_lat": F.col("arr_lat") - F.col("dep_lat"),
            "delta_lon": F.col("arr_lon") - F.col("dep_lon"),
        }
    ).withColumn("bearing", bearing_degrees(F.col("delta_lat"), F.col("delta_lon")))


def jittered_endpoints(flights: DataFrame, settings: Settings) -> DataFrame:
    """Move both ends a little and add ``mid_lat_jitter``, ``mid_lon_jitter`` for the path between.

    Keyed on vehicle and departure, so a flight moves the same way in every run.
    """
    key = F.concat_ws("|", "icao24", "dep_s")
    added = {}
    for place, scale in (
        ("dep", settings.jitter_end),
        ("arr", settings.jitter_end),
        ("mid", settings.jitter_mid),
    ):
        lat, lon = uniform_pair(key, place)
        added[f"{place}_lat_jitter"] = centred(lat, scale)
        added[f"{place}_lon_jitter"] = centred(lon, scale)
    ends = ["dep_lat", "dep_lon", "arr_lat", "arr_lon"]
    return (
        flights.withColumns(added)
        .withColumns({c: F.col(c) + F.col(f"{c}_jitter") for c in ends})
        .drop(*[f"{c}_jitter" for c in ends])
    )


def project_positions(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add Web Mercator metres ``x`` and ``y``."""
    return df.withColumns({"x": mercator_x(F.col(lon)), "y": mercator_y(F.col(lat))})
