"""What one picture needs: the planes at a moment and the totals so far.

A snapshot stays as rows keyed by its time. At a busy minute it has as many rows
as there are planes, so it is never packed into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.operators.geometry import project_positions
from tripmesh.operators.lookup import attach, per_day
from tripmesh.operators.panel import (
    PATH_COLUMNS,
    POSITION_COLUMNS,
    expand_airborne,
    expand_at,
    flight_states,
    positions,
)
from tripmesh.operators.sampling import samples_per_day


def sampled_positions(flights: DataFrame, times: DataFrame, settings: Settings, few: bool = False) -> DataFrame:
    """Positions and flags of all flights at the given times only."""
    placed = positions(flight_states(expand_at(flights, times, settings, few=few), settings))
    return placed.select("icao24", "dep_s", *POSITION_COLUMNS)


def minute_snapshots(flights: DataFrame, totals: DataFrame, times: DataFrame, settings: Settings) -> DataFrame:
    """Each plane in the air at each time of the sampled ``totals``, projected, beside its totals.

    ``times`` (``day``, ``t_s``) are the times of ``totals``, of which a flight is
    only put at those while it is in the air. A time without any plane keeps one
    row with a null plane. Both frames hold flights of known airports only, so
    those times are known from the totals, and the planes need no outer join.
    """
    plane = flights.select("day", "icao24", "dep_s", "arr_s", "dep_airport", "arr_airport", *PATH_COLUMNS)
    side = per_day(totals, settings, rows_per_day=samples_per_day(settings))
    busy = expand_airborne(plane, times, settings)
    placed = project_positions(positions(flight_states(busy, settings)))
    joined = attach(placed, side, ["day", "t_s"], settings, how="inner")
    rows = joined.select("icao24", "dep_s", "x", "y", "bearing", *totals.columns)
    empty = totals.filter(F.col("planes_in_air") == 0)
    return rows.unionByName(empty, allowMissingColumns=True)


def peak_positions(flights: DataFrame, peaks: DataFrame, settings: Settings) -> DataFrame:
    """Projected positions of all flights of a day at its busiest time."""
    placed = sampled_positions(flights, peaks.select("day", "t_s"), settings, few=True)
    return project_positions(placed)
