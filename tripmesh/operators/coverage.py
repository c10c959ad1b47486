"""Which days and windows the landed records cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.functions.time import utc_wall


def arrivals_per_hour(flights: DataFrame) -> DataFrame:
    """Arrivals per local date and hour."""
    return (
        flights.groupBy("day", F.hour("arr_local").alias("hour"))
        .agg(F.count("*").alias("flights"))
    )


def hourly_coverage(flights: DataFrame, settings: Settings) -> DataFrame:
    """Arrivals per date and hour around midday, where a UTC day boundary would show as a gap."""
    first, last = settings.coverage_hours
    return arrivals_per_hour(flights.filter(F.hour("arr_local").between(first, last)))


def coverage_pivot(hourly: DataFrame, days: list[str] | None = None) -> DataFrame:
    """One row per hour, one column per date: each date of the data, or those named.

    The dates are looked up in the grouped counts, 24 rows per calendar day.
    """
    return hourly.groupBy("hour").pivot("day", days).agg(F.first("flights"))


def coverage_cells(hourly: DataFrame) -> DataFrame:
    """The pivot as rows: ``flights`` of each hour and each date of the data, null where there are none.

    Its columns are the dates found, so the shape is the same whatever they are.
    """
    wide = coverage_pivot(hourly.withColumn("day", F.col("day").cast("string")))
    days = [c for c in wide.columns if c != "hour"]
    if not days:
        return wide.select("hour", F.lit(None).cast("string").alias("day"), F.lit(None).cast("long").alias("flights"))
    return wide.unpivot(["hour"], days, "day", "flights")


def interior_dates(hourly: DataFrame) -> DataFrame:
    """Date and hour counts strictly between the first and the last date.

    The window spans the grouped counts, 24 rows per calendar day. Comparing with
    a subquery instead would push the comparison below the deduplication of the
    flights and shuffle them a second time.
    """
    every = Window.partitionBy(F.lit(0))
    return (
        hourly.withColumns({"_first": F.min("day").over(every), "_last": F.max("day").over(every)})
        .filter((F.col("day") > F.col("_first")) & (F.col("day") < F.col("_last")))
        .drop("_first", "_last")
    )


def date_completeness(hourly: DataFrame) -> DataFrame:
    """Per date: is every hourly count present?"""
    return hourly.groupBy("day").agg(F.bool_and(F.col("flights").isNotNull()).alias("complete"))


def choose_date(flights: DataFrame) -> DataFrame:
    """One row: the earliest date that is neither the first nor the last, else null.

    One scan: dates collapse before they are gathered, so the array holds
    calendar dates, never rows.
    """
    days = flights.select("day").distinct().agg(F.sort_array(F.collect_set("day")).alias("days"))
    return days.select(F.when(F.size("days") > 2, F.get("days", F.lit(1))).alias("day"))


def flights_on_date(flights: DataFrame, chosen: DataFrame) -> DataFrame:
    """Flights that arrive on the date held by the one-row frame ``chosen``.

    A scalar subquery, so the date reaches the scan as a filter and prunes
    partitions of a table stored by day.
    """
    return flights.filter(F.col("day") == chosen.scalar())


def time_extent(flights: DataFrame) -> DataFrame:
    """First and last arrival and departure."""
    return flights.agg(
        F.min("arr_s").alias("arr_min_s"),
        F.max("arr_s").alias("arr_max_s"),
        F.min("dep_s").alias("dep_min_s"),
        F.max("dep_s").alias("dep_max_s"),
        F.min("arr_local").alias("arr_min"),
        F.max("arr_local").alias("arr_max"),
        F.min("dep_local").alias("dep_min"),
        F.max("dep_local").alias("dep_max"),
    )


def grid_extent(totals: DataFrame) -> DataFrame:
    """First and last instant of a timeline, per day."""
    return totals.groupBy("day").agg(F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"))


def first_departures(flights: DataFrame) -> DataFrame:
    """Per arrival day and airport: the first departure after the day's first departure date.

    Departures collapse to (day, airport, date) first, so the window sees a
    handful of rows per day, never flights.
    """
    firsts = flights.groupBy("day", "dep_airport", F.to_date("dep_local").alias("dep_date")).agg(
        F.min("dep_s").alias("dep_s"), F.min("dep_local").alias("dep_local")
    )
    lowest = F.min("dep_date").over(Window.partitionBy("day"))
    return (
        firsts.withColumn("lowest", lowest)
        .filter(F.col("dep_date") > F.col("lowest"))
        .groupBy("day", "dep_airport")
        .agg(F.min("dep_s").alias("dep_s"), F.min("dep_local").alias("dep_local"))
    )


def overlap_windows(flights: DataFrame, settings: Settings) -> DataFrame:
    """Departures per airport in each window of two UTC days, windows one day apart.

    A flight lies in two windows unless it departs on the first or last date.
    Flights are counted per date before a date is put into its windows.
    """
    daily = (
        flights.filter(F.col("dep_airport").isin(list(settings.airports)))
        .groupBy("dep_airport", F.to_date(utc_wall(F.col("dep_s"))).alias("utc_date"))
        .agg(F.count("*").alias("flights"))
    )
    first = daily.agg(F.min("utc_date")).scalar()
    last = daily.agg(F.max("utc_date")).scalar()
    starts = F.array(F.date_sub("utc_date", 1), F.col("utc_date"))
    return (
        daily.withColumn("window_start", F.explode(starts))
        .filter((F.col("window_start") >= first) & (F.col("window_start") < last))
        .groupBy("window_start", "dep_airport")
        .agg(F.sum("flights").alias("flights"))
    )
