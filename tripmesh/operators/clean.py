"""Flight records: completed, deduplicated, on local clocks, on the routes of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.functions.time import day_start, local_wall


def completed(raw: DataFrame) -> DataFrame:
    """Raw records of finished flights, renamed. Copies are still in."""
    return raw.filter(F.col("estArrivalAirport").isNotNull()).select(
        "icao24",
        F.col("firstSeen").alias("dep_s"),
        F.col("lastSeen").alias("arr_s"),
        F.col("estDepartureAirport").alias("dep_airport"),
        F.col("estArrivalAirport").alias("arr_airport"),
    )


def with_clock(flights: DataFrame, settings: Settings) -> DataFrame:
    """Duration, local clocks and ``day``, the local date of arrival."""
    tz = settings.timezone
    return flights.withColumns(
        {
            "duration_s": F.col("arr_s") - F.col("dep_s"),
            "dep_local": local_wall(F.col("dep_s"), tz),
            "arr_local": local_wall(F.col("arr_s"), tz),
        }
    ).withColumn("day", F.to_date("arr_local"))


def flights_clean(raw: DataFrame, settings: Settings) -> DataFrame:
    """Completed flights, each once.

    Deduplication comes before the derived columns, so the shuffle carries the
    five raw columns, and copies collapse inside each map task first.
    """
    return with_clock(completed(raw).distinct(), settings)


def landed_on(raw: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    """Raw records that arrive on the date held by the one-row frame ``chosen``.

    The date becomes bounds on ``lastSeen``, and a partition value where records are landed by
    ``arrival_day``: scalar subqueries, which are known when the scan lists its files and row groups.
    """
    start, end = (day_start(d, settings.timezone) for d in (F.col("day"), F.date_add("day", 1)))
    bounds = chosen.select("day", start.alias("start_s"), end.alias("end_s"))
    first, behind = (bounds.select(c).scalar() for c in ("start_s", "end_s"))
    wanted = (F.col("lastSeen") >= first) & (F.col("lastSeen") < behind)
    if "arrival_day" in raw.columns:
        wanted = (F.col("arrival_day") == bounds.select("day").scalar()) & wanted
    return raw.filter(wanted)


def arrivals(raw: DataFrame, settings: Settings) -> DataFrame:
    """Completed flights with clocks but with their copies: enough for min, max and dates."""
    return with_clock(completed(raw), settings)


def route_filter(flights: DataFrame, settings: Settings) -> DataFrame:
    """Flights between two different airports of interest."""
    airports = list(settings.airports)
    return flights.filter(
        F.col("dep_airport").isin(airports)
        & F.col("arr_airport").isin(airports)
        & (F.col("dep_airport") != F.col("arr_airport"))
    )


def route_list(flights: DataFrame) -> DataFrame:
    return flights.select("dep_airport", "arr_airport").distinct()
