"""Registered queries: name -> function of (session, folder of the driver tables).

Dates and clocks leave as text and doubles leave rounded, so that another SQL
engine can be compared value by value. Every query runs on all days. Those that
make the flight by minute panel compute all its rows and return them summed up
per flight; the rows themselves, of the chosen date, are queries ``..._on_date``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.config import POLLUTANTS, PRICED, Settings, suffixed
from tripmesh.operators import (
    clean,
    coverage,
    damages,
    emissions,
    geometry,
    panel,
    sampling,
    snapshots,
    totals,
)
from tripmesh.plans import fixtures
from tripmesh.plans.compose import Analysis, measured_settings, measured_tables
from tripmesh.schemas import FLIGHTS_RAW
from tripmesh.session import scratch_path
from tripmesh.sinks import write_csv, write_json, write_sorted_parquet
from tripmesh.sources import (
    read_aircraft_map,
    read_airports,
    read_curve,
    read_flights,
    read_flights_json,
    read_results,
)
from tripmesh.sources.landing import land, read_landed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Decimals kept in registered outputs, by kind of column.
MASS, SUM, DEGREES, METRES, MONEY = 3, 3, 5, 3, 2

_OPENED: dict[str, tuple[SparkSession, dict[bool, Analysis]]] = {}


def query(f: Query) -> Query:
    return query_as(f.__name__)(f)


def query_as(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def analysis(spark: SparkSession, sf_dir: str, one_day: bool = False) -> Analysis:
    """The analysis of one data folder. Inputs are opened and measured once per session and folder."""
    session, opened = _OPENED.get(sf_dir, (None, {}))
    if session is not spark:
        events = fixtures.events(spark, sf_dir)
        raw = fixtures.flights_raw(events)
        tables = measured_tables(
            fixtures.aircraft_map(events), fixtures.emission_curve(spark), fixtures.airports(spark), raw, Settings()
        )
        settings = measured_settings(raw, Settings())
        opened = {one: Analysis(raw, tables, settings, one) for one in (False, True)}
        _OPENED[sf_dir] = (spark, opened)
    return opened[one_day]


def shown(df: DataFrame, digits: int = MASS, **by_column: int) -> DataFrame:
    """Text for dates and clocks, rounded doubles.

    A tiny shift before rounding keeps values that sit exactly on a rounding
    boundary on the same side in every engine. Doubles are scaled, rounded and
    scaled back, as the SQL's engine does: ``round`` makes a decimal of each value,
    which took most of the time of a panel. The added zero turns -0 into 0.
    """
    columns = []
    for field in df.schema.fields:
        c = name = f"`{field.name}`"
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            c = f"cast({name} AS string)"
        elif isinstance(field.dataType, T.DoubleType):
            n = by_column.get(field.name, digits)
            c = f"rint(({name} + 1e-{n + 4}D) * 1e{n}D) / 1e{n}D + 0D"
        columns.append(f"{c} AS {name}")
    return df.selectExpr(*columns)


# --- sources ----------------------------------------------------------------


@query
def landing_scan(spark, sf_dir):
    path = scratch_path(spark, "landing")
    analysis(spark, sf_dir).raw.write.parquet(path)
    return read_flights(spark, path)


@query
def landing_json_scan(spark, sf_dir):
    path = scratch_path(spark, "landing-json")
    write_json(analysis(spark, sf_dir).raw, path)
    return read_flights_json(spark, path)


def _landed(spark, sf_dir) -> str:
    """The records landed in two batches that overlap by the flights of every second vehicle, and once more whole."""
    base, settings = scratch_path(spark, "landed"), analysis(spark, sf_dir).settings
    raw = analysis(spark, sf_dir).raw
    second = F.pmod(F.xxhash64("icao24"), F.lit(2)) == 0
    for k, part in enumerate((raw.where(second), raw.where(~second | (F.col("firstSeen") % 2 == 0)), raw)):
        write_json(part, f"{base}/batch-{k}")
        land(spark, f"{base}/batch-{k}", f"{base}/days", f"{base}/rejects-{k}", settings)
    return f"{base}/days"


@query
def landing_incremental(spark, sf_dir):
    """Overlapping batches leave each record once, in the partition of its day."""
    landed = read_landed(spark, _landed(spark, sf_dir))
    return shown(landed.select("arrival_day", *FLIGHTS_RAW.fieldNames()))


@query
def flights_on_date_landed(spark, sf_dir):
    """The chosen date out of the landed table: one partition is read."""
    a = analysis(spark, sf_dir)
    return shown(Analysis(read_landed(spark, _landed(spark, sf_dir)), a.tables, a.settings, one_day=True).flights)


@query
def aircraft_map_scan(spark, sf_dir):
    path = scratch_path(spark, "register")
    register = fixtures.aircraft_map(fixtures.events(spark, sf_dir))
    blank = spark.sql("SELECT '' AS icao24, '' AS typecode")
    write_csv(blank.union(register), path, compression="gzip")
    return read_aircraft_map(spark, path)


@query
def curve_load(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    write_csv(fixtures.emission_sheet(fixtures.events(spark, sf_dir)), path)
    return shown(read_curve(spark, path))


@query
def airports_load(spark, sf_dir):
    """The directory, with the flights that leave from and arrive at each airport."""
    path = scratch_path(spark, "airports")
    spark.range(1).select(F.lit(fixtures.airport_document()).alias("value")).write.text(path)
    flights = analysis(spark, sf_dir).flights
    ends = flights.select(
        F.explode(
            F.array(
                F.struct(F.col("dep_airport").alias("airport"), F.lit(1).alias("out")),
                F.struct(F.col("arr_airport").alias("airport"), F.lit(0).alias("out")),
            )
        ).alias("e")
    )
    traffic = ends.groupBy("e.airport").agg(
        F.count_if(F.col("e.out") == 1).alias("departures"),
        F.count_if(F.col("e.out") == 0).alias("arrivals"),
    )
    directory = read_airports(spark, path)
    placed = geometry.project_positions(directory).join(traffic, "airport", "left")
    return shown(placed, DEGREES, x=3, y=3)


@query
def overlap_windows(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return shown(coverage.overlap_windows(a.flights, a.settings))


# --- cleaning and coverage --------------------------------------------------


@query
def flights_clean(spark, sf_dir):
    return shown(analysis(spark, sf_dir).flights)


@query
def hourly_coverage(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return shown(coverage.hourly_coverage(a.flights, a.settings))


@query
def coverage_pivot(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return coverage.coverage_cells(coverage.hourly_coverage(a.flights, a.settings))


@query
def interior_dates(spark, sf_dir):
    return shown(coverage.interior_dates(coverage.arrivals_per_hour(analysis(spark, sf_dir).flights)))


@query
def date_completeness(spark, sf_dir):
    hourly = coverage.arrivals_per_hour(analysis(spark, sf_dir).flights)
    return shown(coverage.date_completeness(coverage.interior_dates(hourly)))


@query
def choose_date(spark, sf_dir):
    return shown(analysis(spark, sf_dir).chosen_date)


@query
def flights_on_date(spark, sf_dir):
    return shown(analysis(spark, sf_dir, one_day=True).flights)


@query
def time_extent(spark, sf_dir):
    return shown(coverage.time_extent(analysis(spark, sf_dir).flights))


@query
def grid_extent(spark, sf_dir):
    return shown(coverage.grid_extent(analysis(spark, sf_dir).minute_totals))


@query
def route_filter(spark, sf_dir):
    return shown(analysis(spark, sf_dir).route_flights)


@query
def route_list(spark, sf_dir):
    return clean.route_list(analysis(spark, sf_dir).route_flights)


@query
def first_departures(spark, sf_dir):
    return shown(coverage.first_departures(analysis(spark, sf_dir).route_flights))


# --- emissions per flight ---------------------------------------------------

FLIGHT = ("day", "icao24", "dep_s", "arr_s", "dep_airport", "arr_airport")


@query
def aircraft_type_join(spark, sf_dir):
    a = analysis(spark, sf_dir)
    typed = emissions.aircraft_type_join(a.route_flights, a.tables.register, a.settings)
    return shown(typed.select(*FLIGHT, "typecode"))


def _named(a: Analysis) -> DataFrame:
    typed = emissions.aircraft_type_join(a.route_flights, a.tables.register, a.settings)
    return emissions.aircraft_id_join(typed, a.tables.curve, a.settings)


@query
def aircraft_id_join(spark, sf_dir):
    return shown(_named(analysis(spark, sf_dir)).select(*FLIGHT, "typecode", "aircraft_id"))


@query
def lto_join(spark, sf_dir):
    a = analysis(spark, sf_dir)
    joined = emissions.lto_join(_named(a), a.tables.curve, a.settings)
    return shown(joined.select(*FLIGHT, "typecode", "aircraft_id", *suffixed("lto")))


@query
def curve_candidates(spark, sf_dir):
    a = analysis(spark, sf_dir)
    candidates = emissions.curve_candidates(_named(a), a.tables.curve, a.settings)
    return shown(
        candidates.select(*FLIGHT, "aircraft_id", "duration_s", "ref_phase", "ref_s", *suffixed("ref"))
    )


BRACKET = ("ref_hi_s", "ref_lo_s", *suffixed("hi"), *suffixed("lo"))


def _bracketed(a: Analysis) -> DataFrame:
    return emissions.ccd_bracket(_named(a), a.tables.curve, a.settings)


@query
def ccd_bracket(spark, sf_dir):
    bracketed = _bracketed(analysis(spark, sf_dir))
    return shown(bracketed.select(*FLIGHT, "aircraft_id", "duration_s", *BRACKET))


@query
def ccd_bracket_groupfirst(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return shown(emissions.ccd_bracket_groupfirst(_named(a), a.tables.curve, a.settings))


@query
def ccd_interpolate(spark, sf_dir):
    values = emissions.ccd_interpolate(_bracketed(analysis(spark, sf_dir)))
    columns = ("aircraft_id", "duration_s", "ref_hi_s", "ref_lo_s", "factor", *suffixed("ccd"))
    return shown(values.select(*FLIGHT, *columns), factor=6)


@query
def fill_with_mean(spark, sf_dir):
    filled = analysis(spark, sf_dir).emissions
    return shown(filled.select(*FLIGHT, "aircraft_id", *suffixed("lto"), *suffixed("ccd")))


@query
def flight_emissions(spark, sf_dir):
    return shown(analysis(spark, sf_dir).emissions, factor=6)


@query
def daily_totals(spark, sf_dir):
    return shown(emissions.daily_totals(analysis(spark, sf_dir).emissions), SUM)


# --- geometry and timeline --------------------------------------------------


@query
def airport_join(spark, sf_dir):
    a = analysis(spark, sf_dir)
    placed = geometry.airport_join(a.route_flights, a.tables.airports, a.settings)
    return shown(placed.select(*FLIGHT, "dep_lat", "dep_lon", "arr_lat", "arr_lon"), 6)


@query
def route_bearing(spark, sf_dir):
    a = analysis(spark, sf_dir)
    placed = geometry.airport_join(a.route_flights, a.tables.airports, a.settings)
    turned = geometry.route_bearing(placed)
    return shown(turned.select(*FLIGHT, "delta_lat", "delta_lon", "bearing"), 6)


@query
def jittered_endpoints(spark, sf_dir):
    a = analysis(spark, sf_dir)
    moved = a.locate(a.route_flights)
    ends = ("dep_lat", "dep_lon", "arr_lat", "arr_lon", "mid_lat_jitter", "mid_lon_jitter")
    return shown(moved.select(*FLIGHT, *ends), 6)


@query
def time_grid(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return shown(panel.time_grid(a.route_flights.select("day").distinct(), a.settings))


STATES = ("has_departed", "has_arrived", "in_air", "taxiing_departure", "taxiing_arrival")
SEEN = STATES[2:]


def summed(panel_: DataFrame, keys, flags=(), sums=(), digits: int = MASS, **by_column: int) -> DataFrame:
    """Rows of a panel per key: how many, from when to when, with each flag, and sums.

    Sums are taken in whole millionths: sums of doubles depend on the order of the rows,
    by more than the shift of ``shown`` makes up for.
    """
    return shown(panel_.groupBy(*keys).agg(*_sums(flags, sums)), digits, **by_column)


def _sums(flags, sums) -> list[Column]:
    columns = [F.count("*").alias("n"), F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s")]
    return columns + [F.count_if(f).alias(f) for f in flags] + [F.expr(f"sum(floor({c} * 1e6D + 0.5D)) / 1e6D AS {c}") for c in sums]


TRIP = ("trip_a", "trip_b")


def numbered(flights: DataFrame, keys) -> DataFrame:
    """Add ``trip_a`` and ``trip_b``, a hash of 128 bits of the keys; a null is told apart from a missing value."""
    parts = [part for k in keys for part in (F.col(k).isNull(), F.col(k))]
    return flights.withColumns({t: F.xxhash64(F.lit(n), *parts) for n, t in enumerate(TRIP)})


def summed_trips(flights: DataFrame, expand: Callable[[DataFrame], DataFrame], keys, flags=(), sums=()) -> DataFrame:
    """``summed`` by the columns ``keys`` of the flights that ``expand`` makes a panel of.

    Each of a trip's 1441 rows looks its group up. Two numbers made before the expansion cost
    less than half of dates and texts there; the columns come back by a join, one row a trip.
    """
    marked = numbered(flights, keys)
    totals_ = expand(marked).groupBy(*TRIP).agg(*_sums(flags, sums))
    named = marked.select(*TRIP, *keys).distinct()
    return shown(named.join(totals_, [*TRIP]).drop(*TRIP))


COPY = ("day", "icao24", "dep_s", "arr_s", "aircraft_id")


def _expanded(a: Analysis, flights: DataFrame) -> DataFrame:
    return panel.timeline_expand(flights, a.settings)


def _states(a: Analysis, flights: DataFrame) -> DataFrame:
    return panel.flight_states(_expanded(a, flights), a.settings)


def _masses(a: Analysis, flights: DataFrame) -> DataFrame:
    return panel.cumulative_emissions(_states(a, flights))


def _positions(a: Analysis) -> DataFrame:
    states = panel.flight_states(panel.timeline_expand(a.planes, a.settings), a.settings)
    return panel.position_table(panel.positions(states))


def _timeline(a: Analysis, flights: DataFrame) -> DataFrame:
    return panel.timeline(flights, a.settings)


def _sampled(a: Analysis) -> DataFrame:
    return snapshots.sampled_positions(a.planes, a.sampled_times, a.settings)


@query
def timeline_expand(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return summed_trips(a.emissions, partial(_expanded, a), COPY)


@query
def timeline_expand_on_date(spark, sf_dir):
    a = analysis(spark, sf_dir, one_day=True)
    return _expanded(a, a.emissions).select("icao24", "dep_s", "arr_s", "aircraft_id", "t_s")


@query
def flight_states(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return summed_trips(a.route_flights, partial(_states, a), COPY[:4], STATES, ["progress"])


@query
def flight_states_on_date(spark, sf_dir):
    a = analysis(spark, sf_dir, one_day=True)
    states = _states(a, a.route_flights)
    return shown(states.select("icao24", "dep_s", "arr_s", "t_s", *STATES, "progress"), 6)


@query
def cumulative_emissions(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return summed_trips(a.emissions, partial(_masses, a), COPY, sums=POLLUTANTS)


@query
def cumulative_emissions_on_date(spark, sf_dir):
    a = analysis(spark, sf_dir, one_day=True)
    masses = _masses(a, a.emissions)
    return shown(masses.select("icao24", "dep_s", "arr_s", "t_s", *POLLUTANTS))


@query
def positions(spark, sf_dir):
    """All positions, summed up per minute, as the table has no flights."""
    return summed(_positions(analysis(spark, sf_dir)), ["day", "t_s"], SEEN, ["latitude", "longitude", "bearing"])


@query
def positions_on_date(spark, sf_dir):
    return shown(_positions(analysis(spark, sf_dir, one_day=True)), DEGREES)


@query
def timeline(spark, sf_dir):
    sums = ("progress", *POLLUTANTS, "longitude", "latitude", "bearing")
    a = analysis(spark, sf_dir)
    return summed_trips(a.placed_emissions, partial(_timeline, a), COPY, STATES, sums)


@query
def timeline_on_date(spark, sf_dir):
    a = analysis(spark, sf_dir, one_day=True)
    columns = ("icao24", "dep_s", "arr_s", "aircraft_id", "t_s", "t_local")
    return shown(
        _timeline(a, a.placed_emissions).select(
            *columns, *STATES, "progress", *POLLUTANTS, "longitude", "latitude", "bearing"
        ),
        MASS,
        progress=6,
        longitude=DEGREES,
        latitude=DEGREES,
        bearing=DEGREES,
    )


@query
def passengers_per_flight(spark, sf_dir):
    return shown(analysis(spark, sf_dir).passengers, 6)


@query
def emissions_timeline(spark, sf_dir):
    return shown(analysis(spark, sf_dir).minute_totals, SUM)


@query
def emissions_timeline_exploded(spark, sf_dir):
    a = analysis(spark, sf_dir)
    whole = totals.emissions_timeline_exploded(a.placed_emissions, a.passengers, a.settings)
    return shown(whole, SUM)


# --- view and pricing -------------------------------------------------------


@query
def sampled_times(spark, sf_dir):
    return shown(analysis(spark, sf_dir).sampled_times)


@query
def sampled_positions(spark, sf_dir):
    return summed(_sampled(analysis(spark, sf_dir)), COPY[:3], SEEN, ["latitude", "longitude", "bearing"])


@query
def sampled_positions_on_date(spark, sf_dir):
    return shown(_sampled(analysis(spark, sf_dir, one_day=True)), DEGREES)


@query
def project_positions(spark, sf_dir):
    projected = geometry.project_positions(_sampled(analysis(spark, sf_dir)))
    return summed(projected, COPY[:3], sums=["x", "y"], digits=1)


@query
def project_positions_on_date(spark, sf_dir):
    projected = geometry.project_positions(_sampled(analysis(spark, sf_dir, one_day=True)))
    return shown(projected.select("icao24", "dep_s", "t_s", "x", "y"), METRES)


DAMAGES = tuple(f"{p}_damage" for p in PRICED) + ("total_damage",)


@query_as("damages")
def _damages(spark, sf_dir):
    priced = damages.damages(analysis(spark, sf_dir).sampled_totals)
    return shown(priced.select("day", "t_s", *DAMAGES), MONEY)


@query
def damages_by_scenario(spark, sf_dir):
    priced = damages.damages_by_scenario(analysis(spark, sf_dir).sampled_totals)
    return shown(priced.select("scenario", "day", "t_s", *DAMAGES), MONEY)


@query
def flight_count_total(spark, sf_dir):
    return shown(sampling.flight_count_total(analysis(spark, sf_dir).sampled_totals))


def _last_rows(a: Analysis) -> DataFrame:
    return damages.damages(sampling.final_record(a.minute_totals))


@query
def final_totals(spark, sf_dir):
    return shown(damages.final_totals(_last_rows(analysis(spark, sf_dir))), MONEY, kg=SUM)


@query
def planes_in_air(spark, sf_dir):
    return shown(sampling.planes_in_air(analysis(spark, sf_dir).sampled_totals))


@query
def peak_positions(spark, sf_dir):
    a = analysis(spark, sf_dir)
    placed = snapshots.peak_positions(a.planes, sampling.peak_times(a.sampled_totals), a.settings)
    columns = ("day", "t_s", "icao24", "dep_s", "in_air", "bearing", "x", "y")
    return shown(placed.select(*columns), DEGREES, x=METRES, y=METRES)


@query
def minute_snapshots(spark, sf_dir):
    a = analysis(spark, sf_dir)
    priced = damages.damages(a.sampled_totals)
    rows = snapshots.minute_snapshots(a.planes, priced, a.sampled_times, a.settings)
    columns = ("day", "t_s", "icao24", "dep_s", "x", "y", "bearing", "num_flights")
    return shown(
        rows.select(*columns, "passengers_arrived", *PRICED.values(), "total_damage"),
        SUM,
        bearing=DEGREES,
        total_damage=MONEY,
    )


# --- sinks ------------------------------------------------------------------


@query
def sink_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "totals")
    write_sorted_parquet(analysis(spark, sf_dir).minute_totals, path, "day", "t_s")
    return shown(read_results(spark, path), SUM)


@query
def sink_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "landing-csv")
    raw = analysis(spark, sf_dir).raw
    write_csv(raw, path)
    return spark.read.schema(raw.schema).option("header", True).csv(path)


@query
def sink_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "last-rows")
    last = _last_rows(analysis(spark, sf_dir)).withColumn("t_local", F.col("t_local").cast("string"))
    write_json(last, path)
    rounding = dict.fromkeys(DAMAGES, MONEY)
    return shown(spark.read.schema(last.schema).json(path), SUM, **rounding)


@query
def rates_records(spark, sf_dir):
    """Rates written as JSON records and read back, beside what they make of the last row of each day."""
    path = scratch_path(spark, "rates")
    rates = damages.rate_table(spark)
    write_json(rates, path)
    rates = spark.read.schema(rates.schema).json(path)
    records = rates.agg(F.collect_list(F.struct("*")).alias("r")).scalar()  # three records
    last = sampling.final_record(analysis(spark, sf_dir).minute_totals).withColumn("rates", F.explode(records))
    lines = ", ".join(f"'{p}', rates.{p}_rate, rates.{p}_rate * {mass}" for p, mass in PRICED.items())
    priced = last.selectExpr("day", "rates.scenario", f"stack({len(PRICED)}, {lines}) AS (pollutant, rate, cost)")
    return shown(priced, MONEY, rate=6)
