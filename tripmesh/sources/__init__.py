"""Readers for landed inputs and for our own result files."""

from tripmesh.sources.readers import (
    read_aircraft_map,
    read_airports,
    read_curve,
    read_flights,
    read_flights_json,
    read_results,
)

__all__ = [
    "read_aircraft_map",
    "read_airports",
    "read_curve",
    "read_flights",
    "read_flights_json",
    "read_results",
]
