"""Inputs of one analysis and the compositions the queries and the batch job share."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.operators import clean, coverage, emissions, geometry, panel, sampling, totals
from tripmesh.operators.emissions import Tables
from tripmesh.operators.lookup import Lookup, attach


def measured_settings(raw: DataFrame, settings: Settings) -> Settings:
    """Settings with a proven bound on the number of arrival days and tasks enough for a panel.

    One pass over two columns, which brings one row back.
    """
    done = clean.completed(raw)
    span = done.agg(
        F.min("arr_s").alias("lo"), F.max("arr_s").alias("hi"), F.count("*").alias("flights")
    ).first()
    days = 1 if span.lo is None else (span.hi - span.lo) // 86400 + 3
    cores = raw.sparkSession.sparkContext.defaultParallelism
    return replace(settings, day_bound=days, panel_tasks=panel_tasks(span.flights, cores, settings))


def panel_tasks(flights: int, cores: int, settings: Settings) -> int:
    """Tasks that expand flights: enough for their number, but bounded by the cluster.

    Expansion streams, so beyond that bound a task is longer, not larger.
    """
    return min(max(cores, flights // settings.flights_per_task + 1), cores * settings.tasks_per_core)


def measured_tables(
    register: DataFrame, curve: DataFrame, airports: DataFrame, raw: DataFrame | None = None, settings: Settings | None = None
) -> Tables:
    """Lookups with their sizes; a register too large to broadcast also with the vehicles that fly most of ``raw``."""
    vehicles = Lookup.measured(register)
    if raw is not None:
        vehicles = vehicles.with_hot_keys(raw, "icao24", settings or Settings())
    return Tables(vehicles, Lookup.measured(curve), Lookup.measured(airports))


@dataclass(frozen=True)
class Analysis:
    """Everything computed from landed records. ``one_day`` limits it to the chosen date.

    Each frame is put together once, so that its uses share one plan.
    """

    raw: DataFrame
    tables: Tables
    settings: Settings
    one_day: bool = False

    @cached_property
    def chosen_date(self) -> DataFrame:
        return coverage.choose_date(clean.arrivals(self.raw, self.settings))

    @cached_property
    def flights(self) -> DataFrame:
        """Clean flights, of all days or of the chosen date."""
        raw = clean.landed_on(self.raw, self.chosen_date, self.settings) if self.one_day else self.raw
        return clean.flights_clean(raw, self.settings)

    @cached_property
    def route_flights(self) -> DataFrame:
        return clean.route_filter(self.flights, self.settings)

    @cached_property
    def matched_flights(self) -> DataFrame:
        return emissions.matched_flights(self.route_flights, self.tables, self.settings)

    @cached_property
    def emissions(self) -> DataFrame:
        return emissions.complete_emissions(self.matched_flights, self.tables, self.settings)

    @cached_property
    def passengers(self) -> DataFrame:
        return totals.passengers_per_flight(self.route_flights, self.settings)

    @cached_property
    def placed_emissions(self) -> DataFrame:
        """Emissions of flights whose airports the directory knows: totals and positions count the same ones."""
        return self.locate(self.emissions)

    @cached_property
    def known_emissions(self) -> DataFrame:
        """The same flights without coordinates: totals need none, and a semi join leaves the lookups prunable."""
        known = self.emissions
        for end in ("dep_airport", "arr_airport"):
            side = self.tables.airports.derive(self.tables.airports.df.select(F.col("airport").alias(end)))
            known = attach(known, side, [end], self.settings, how="left_semi")
        return known

    @cached_property
    def planes(self) -> DataFrame:
        """Flights, fanned out as in ``emissions``, with their paths: positions need no masses."""
        return self.locate(self.matched_flights)

    def locate(self, flights: DataFrame) -> DataFrame:
        """Add coordinates, bearing and jitter."""
        placed = geometry.airport_join(flights, self.tables.airports, self.settings)
        return geometry.jittered_endpoints(geometry.route_bearing(placed), self.settings)

    @cached_property
    def minute_totals(self) -> DataFrame:
        return totals.emissions_timeline(self.known_emissions, self.passengers, self.settings)

    @cached_property
    def sampled_totals(self) -> DataFrame:
        return sampling.sampled_totals(self.minute_totals, self.settings)

    @cached_property
    def sampled_times(self) -> DataFrame:
        """Times shown. They follow from the days that have flights; no masses are needed."""
        days = panel.days_with_flights(self.route_flights, self.settings)
        return sampling.sampled_times(panel.time_grid(days, self.settings), self.settings)
