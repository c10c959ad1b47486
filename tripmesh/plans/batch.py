"""The whole batch job: landed records in, result tables out.

    python -m tripmesh.plans.batch --flights ... --register ... --curve ...
        --airports ... --out ... [--all-days] [--records new.json]

Flights with emissions are written once and read back for every result. That
table cuts the lineage: a lost executor costs its own tasks, not the joins.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.operators import clean, coverage, damages, panel, sampling, snapshots, totals
from tripmesh.operators.emissions import Tables
from tripmesh.plans.compose import Analysis, measured_settings, measured_tables, panel_tasks
from tripmesh.session import build
from tripmesh.sinks import write_json, write_sorted_parquet
from tripmesh.sources import read_aircraft_map, read_airports, read_curve, read_flights, read_results
from tripmesh.sources.landing import land


def run(raw: DataFrame, tables: Tables, settings: Settings, out: str, all_days: bool = False) -> None:
    """Write every result under ``out``.

    flights/    flights with emissions, paths and jitter, partitioned by day
    passengers/ passengers per flight of each day
    emissions/  per-minute totals in order of time
    planes/     positions in order of flight and time, partitioned by day
    damages/    sampled totals with their prices under every scenario
    numbers/    the last row of each day, priced, as JSON records
    totals/     the same as pollutant, mass and cost rows
    rates/      damage rates as JSON records
    snapshots/  what a picture of each sampled minute shows
    peaks/      positions at the busiest sampled minute of each day
    audit/      what the landed records cover: arrivals per hour and date, extents, routes, first departures
    """
    spark = raw.sparkSession
    analysis = Analysis(raw, tables, settings, one_day=not all_days)
    audit(raw, settings, f"{out}/audit")

    write_sorted_parquet(
        analysis.placed_emissions,
        f"{out}/flights",
        "icao24",
        "dep_s",
        range_by=("day", "icao24", "dep_s"),
        partition_by=("day",),
    )
    flights = read_results(spark, f"{out}/flights")
    analysis.passengers.write.parquet(f"{out}/passengers")
    passengers = read_results(spark, f"{out}/passengers")

    minute = totals.emissions_timeline(flights, passengers, settings)
    write_sorted_parquet(minute, f"{out}/emissions", "day", "t_s")
    minute = read_results(spark, f"{out}/emissions")

    # Ranges are made of flights, before each becomes a day of minutes. Their number is set
    # by the rows to come: by its own size one shuffle partition would hold a million flights.
    tasks = panel_tasks(flights.count(), spark.sparkContext.defaultParallelism, settings)
    ranged = flights.repartitionByRange(tasks, "day", "icao24", "dep_s")
    as_ranged = replace(settings, panel_tasks=None)
    states = panel.flight_states(panel.timeline_expand(ranged, as_ranged), settings)
    placed = panel.positions(states).select("icao24", "dep_s", *panel.POSITION_COLUMNS)
    write_sorted_parquet(
        placed, f"{out}/planes", "icao24", "dep_s", "t_s", range_by=(), partition_by=("day",)
    )

    sampled = sampling.sampled_totals(minute, settings)
    priced = damages.damages(sampled)
    damages.damages_by_scenario(sampled).write.parquet(f"{out}/damages")
    last = sampling.final_record(priced).withColumn("t_local", F.col("t_local").cast("string"))
    write_json(last, f"{out}/numbers")
    write_json(damages.final_totals(last), f"{out}/totals")
    write_json(damages.rate_table(spark), f"{out}/rates")

    snapshots.minute_snapshots(flights, priced, sampled.select("day", "t_s"), settings).write.parquet(f"{out}/snapshots")
    peaks = snapshots.peak_positions(flights, sampling.peak_times(sampled), settings)
    peaks.write.parquet(f"{out}/peaks")


def audit(raw: DataFrame, settings: Settings, out: str) -> None:
    """Coverage of everything landed, whatever days the run is about."""
    flights = clean.flights_clean(raw, settings)
    routes = clean.route_filter(flights, settings)
    coverage.coverage_cells(coverage.hourly_coverage(flights, settings)).write.parquet(f"{out}/hours")
    coverage.time_extent(flights).write.parquet(f"{out}/extent")
    clean.route_list(routes).write.parquet(f"{out}/routes")
    coverage.first_departures(routes).write.parquet(f"{out}/first_departures")
    coverage.overlap_windows(flights, settings).write.parquet(f"{out}/windows")


def open_inputs(
    spark: SparkSession, flights: str, register: str, curve: str, airports: str, settings: Settings
) -> tuple[DataFrame, Tables, Settings]:
    """Read landed files and measure what may be broadcast."""
    raw = read_flights(spark, flights)
    directory = read_airports(spark, airports)
    tables = measured_tables(read_aircraft_map(spark, register), read_curve(spark, curve), directory, raw, settings)
    return raw, tables, measured_settings(raw, settings)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--records", help="JSON records to land under --flights by arrival day before the run")
    parser.add_argument("--rejects", help="folder for lines of --records that are no records")
    for name in ("flights", "register", "curve", "airports", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--all-days", action="store_true")
    parser.add_argument("--airport-ids", nargs="+", help="airports of interest, default as in Settings")
    parser.add_argument("--passenger-ids", nargs="+", help="airports the passenger figure counts")
    parser.add_argument("--timezone", default=Settings.timezone)
    # Names of settings and how they are read; the default stands in Settings.
    for name, kind in (("taxi_s", int), ("stride", int), ("first_hour", int), ("jitter_end", float), ("jitter_mid", float), ("bracket_phase", str)):
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind, default=getattr(Settings, name))
    parser.add_argument("--dedupe", action="store_true", help="one row per flight instead of fan-out copies")
    args = parser.parse_args()

    settings = Settings(
        timezone=args.timezone,
        taxi_s=args.taxi_s,
        stride=args.stride,
        first_hour=args.first_hour,
        jitter_end=args.jitter_end,
        jitter_mid=args.jitter_mid,
        bracket_phase=args.bracket_phase,
        dedupe=args.dedupe,
    )
    if args.airport_ids:
        settings = replace(settings, airports=tuple(args.airport_ids))
    if args.passenger_ids:
        settings = replace(settings, passenger_airports=tuple(args.passenger_ids))
    spark = build()
    if args.records:
        done = land(spark, args.records, args.flights, args.rejects or f"{args.out}/rejects", settings)
        print(f"landed {done.fresh} new records on {done.days} days, {done.rejected} lines rejected")
    raw, tables, settings = open_inputs(
        spark, args.flights, args.register, args.curve, args.airports, settings
    )
    run(raw, tables, settings, args.out, args.all_days)


if __name__ == "__main__":
    main()
