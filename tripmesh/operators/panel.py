"""The flight by minute panel. It has 1441 rows per flight, so ask only for the minutes in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmesh.config import POLLUTANTS, Settings
from tripmesh.functions.time import day_start, grid_times, local_wall
from tripmesh.operators.lookup import attach, per_day


def grid_bounds(settings: Settings) -> tuple[Column, Column]:
    """Instants of the midnights around ``day``."""
    tz = settings.timezone
    return day_start(F.col("day"), tz), day_start(F.date_add("day", 1), tz)


def time_grid(days: DataFrame, settings: Settings) -> DataFrame:
    """Grid of each ``day``: one row per step from midnight to midnight, both included."""
    start, end = grid_bounds(settings)
    grid = days.select("day", F.explode(grid_times(start, end, settings.step_s)).alias("t_s"))
    return grid.withColumn("t_local", local_wall(F.col("t_s"), settings.timezone))


def with_grid(flights: DataFrame, settings: Settings) -> DataFrame:
    """Add ``start_s`` and ``end_s`` of the arrival day."""
    start, end = grid_bounds(settings)
    return flights.withColumns({"start_s": start, "end_s": end})


def spread(flights: DataFrame, settings: Settings) -> DataFrame:
    """Flights over ``panel_tasks`` partitions, before each becomes many rows.

    Adaptive execution merges shuffle partitions by their own size, which says
    nothing about the size after an expansion. A shuffle of flights costs little
    beside that. The hash of the flight keeps a retried task on the same rows.
    """
    if settings.panel_tasks is None:
        return flights
    key = [c for c in ("icao24", "dep_s", "arr_s", "dep_airport", "arr_airport") if c in flights.columns]
    return flights.repartition(settings.panel_tasks, *key)


def at_times(flights: DataFrame, times: Column) -> DataFrame:
    """One row per time for flights that depart inside their arrival day, none for the others.

    The condition sits in the exploded array and not in a filter. A filter would
    sink below the deduplication of the flights, and branches with and without
    it could no longer read the same shuffle.
    """
    inside = F.when(F.col("dep_s") >= F.col("start_s"), times)
    return flights.withColumn("t_s", F.explode(inside)).drop("start_s", "end_s")


def days_with_flights(flights: DataFrame, settings: Settings) -> DataFrame:
    """Arrival days on which a flight also departs: those that have a timeline."""
    latest = flights.groupBy("day").agg(F.max("dep_s").alias("latest"))
    start, _ = grid_bounds(settings)
    return latest.filter(F.col("latest") >= start).select("day")


def timeline_expand(flights: DataFrame, settings: Settings) -> DataFrame:
    """Each flight at each minute of its arrival day."""
    times = grid_times(F.col("start_s"), F.col("end_s"), settings.step_s)
    return at_times(with_grid(spread(flights, settings), settings), times)


def expand_at(flights: DataFrame, times: DataFrame, settings: Settings, few: bool = False) -> DataFrame:
    """Each flight at the given times (``day``, ``t_s``) of its arrival day.

    The times of a day become one array, at most a grid long, so only wanted
    minutes are ever made. With ``few`` times a day the flights stay where they are.
    """
    per = times.groupBy("day").agg(F.collect_list("t_s").alias("times"))
    spread_ = flights if few else spread(flights, settings)
    joined = attach(spread_, per_day(per, settings), ["day"], settings, how="inner")
    return at_times(with_grid(joined, settings), F.col("times")).drop("times")


def expand_airborne(flights: DataFrame, times: DataFrame, settings: Settings) -> DataFrame:
    """Each flight at those sampled times of its arrival day at which it is in the air.

    Sampled times (see ``sampled_times``) are ``stride`` grid steps apart from the first one of a day, with the
    last one added. The first and the last say all, so a flight makes its own
    times from two numbers and no array of the day's times goes through the join.
    """
    per = times.groupBy("day").agg(F.min("t_s").alias("first_t"), F.max("t_s").alias("last_t"))
    joined = attach(spread(flights, settings), per_day(per, settings), ["day"], settings, how="inner")
    apart = settings.step_s * settings.stride
    low = f"ceil((greatest(dep_s, first_t) - first_t) / {apart})"
    high = f"floor((least(arr_s, last_t) - first_t) / {apart})"
    regular = f"if({low} <= {high}, sequence(first_t + {low} * {apart}, first_t + {high} * {apart}, {apart}L), cast(array() AS array<bigint>))"
    beside = f"last_t BETWEEN dep_s AND arr_s AND (last_t - first_t) % {apart} <> 0"
    wanted = F.expr(f"if({beside}, array_append({regular}, last_t), {regular})")
    return at_times(with_grid(joined, settings), wanted).drop("first_t", "last_t")


def flight_states(panel: DataFrame, settings: Settings) -> DataFrame:
    """Flags and progress of each flight at ``t_s``.

    Taxiing out is the quarter hour before departure, taxiing in the one after
    arrival; both leave out the instant that counts as in the air.
    """
    taxi = settings.taxi_s
    share = "(t_s - dep_s) / nullif(arr_s - dep_s, 0)"
    no_length = "cast(t_s >= dep_s AS double)"
    return panel.selectExpr(
        "*",
        "t_s >= dep_s AS has_departed",
        "t_s >= arr_s AS has_arrived",
        "t_s BETWEEN dep_s AND arr_s AS in_air",
        f"t_s >= dep_s - {taxi} AND t_s < dep_s AS taxiing_departure",
        f"t_s > arr_s AND t_s <= arr_s + {taxi} AS taxiing_arrival",
        f"if(arr_s = dep_s, {no_length}, least(greatest({share}, 0D), 1D)) AS progress",
    )


def cumulative_emissions(panel: DataFrame) -> DataFrame:
    """Mass emitted so far: all of LTO at departure, CCD in proportion to progress."""
    return panel.selectExpr(
        "*",
        *[f"progress * {p}_ccd + cast(has_departed AS double) * {p}_lto AS {p}" for p in POLLUTANTS],
    )


def positions(panel: DataFrame) -> DataFrame:
    """Add ``longitude`` and ``latitude``: a line between the ends plus a parabola.

    The parabola of one axis is scaled by the noise drawn for the other.
    """
    def along(axis: str, bump: str) -> str:
        line = f"dep_{axis} + progress * (arr_{axis} - dep_{axis})"
        return f"{line} + mid_{bump}_jitter * progress * (1 - progress)"

    return panel.selectExpr(
        "*", f"{along('lon', 'lat')} AS longitude", f"{along('lat', 'lon')} AS latitude"
    )


def timeline(flights: DataFrame, settings: Settings) -> DataFrame:
    """Flights with emissions, coordinates and jitter, at each minute: flags, masses, position.

    On a day of 24 hours the wall clock is the time since midnight, so only
    minutes of days on which the clock is changed are converted one by one.
    """
    start, end = grid_bounds(settings)
    flights = flights.withColumn("midnight_s", F.when(end - start == 86400, start))
    panel = flight_states(timeline_expand(flights, settings), settings)
    placed = positions(cumulative_emissions(panel))
    elapsed = F.timestamp_add("SECOND", F.col("t_s") - F.col("midnight_s"), F.col("day").cast("timestamp_ntz"))
    converted = local_wall(F.col("t_s"), settings.timezone)
    return placed.withColumn("t_local", F.when(F.col("midnight_s").isNotNull(), elapsed).otherwise(converted)).drop("midnight_s")


PATH_COLUMNS = (
    "dep_lat",
    "dep_lon",
    "arr_lat",
    "arr_lon",
    "mid_lat_jitter",
    "mid_lon_jitter",
    "bearing",
)

POSITION_COLUMNS = (
    "day",
    "t_s",
    "latitude",
    "longitude",
    "bearing",
    "in_air",
    "taxiing_arrival",
    "taxiing_departure",
)


def position_table(panel: DataFrame) -> DataFrame:
    """The result columns of a panel of positions."""
    return panel.select(*POSITION_COLUMNS)
