"""Per-minute totals over all flights of an arrival day.

``emissions_timeline`` never builds the flight by minute panel. The mass a flight
has emitted is piecewise linear in time, so the total of a day is described by
the minutes where a flight starts, lands or leaves the air, and by how slope and
offset change there. Each flight makes a few such changes, map tasks add them up
per (day, minute), and a running sum over at most one grid of rows per day turns
them into totals. Only the keys of the flights are shuffled, to count each once.
``emissions_timeline_exploded`` gets the same numbers from the panel and serves
as a check. Both expect that no flight lands before it departs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmesh.config import POLLUTANTS, Settings, suffixed
from tripmesh.functions.time import local_wall
from tripmesh.operators.lookup import attach, per_day
from tripmesh.operators.panel import (
    cumulative_emissions,
    flight_states,
    grid_bounds,
    timeline_expand,
    with_grid,
)

_COUNTS = ("num_flights", "arrived", "planes_in_air")


def passengers_per_flight(flights: DataFrame, settings: Settings) -> DataFrame:
    """Per arrival day: daily passengers over the flights between passenger airports.

    Only flights that also depart on the day count. Without any the value is null.
    """
    airports = list(settings.passenger_airports)
    counted = (
        (F.to_date("dep_local") == F.col("day"))
        & F.col("dep_airport").isin(airports)
        & F.col("arr_airport").isin(airports)
    )
    daily = settings.yearly_passengers / settings.days_per_year
    per = flights.groupBy("day").agg(F.count_if(counted).alias("passenger_flights"))
    share = F.lit(daily) / F.nullif(F.col("passenger_flights"), F.lit(0))
    return per.withColumn("passengers_per_flight", share)


def _change_columns() -> list[str]:
    return [*suffixed("slope"), *suffixed("offset"), *_COUNTS]


def _known_masses() -> list[str]:
    """The masses, zero for a copy with either one missing: its minute values would be null."""
    known = "{p}_ccd IS NOT NULL AND {p}_lto IS NOT NULL"
    return [
        f"if({known.format(p=p)}, {p}_{part}, 0D) AS {p}_{part}"
        for p in POLLUTANTS
        for part in ("ccd", "lto")
    ]


def _mass_changes(gridded: DataFrame, step: int) -> DataFrame:
    """Changes of masses, arrivals and planes in the air, three rows per flight and fan-out copy."""
    flight = gridded.selectExpr(
        "day", "dep_s - start_s AS rel_dep", "arr_s - start_s AS rel_arr", *_known_masses()
    ).selectExpr(
        "*",
        *[f"coalesce({p}_ccd / nullif(rel_arr - rel_dep, 0), 0D) AS {p}_slope" for p in POLLUTANTS],
    )

    def change(k: str, slope: str, offset: str, **counts: int) -> str:
        values = [f"{slope.format(p=p)} AS {p}_slope" for p in POLLUTANTS]
        values += [f"{offset.format(p=p)} AS {p}_offset" for p in POLLUTANTS]
        values += [f"{counts.get(name, 0)}L AS {name}" for name in _COUNTS]
        return f"struct(cast({k} AS bigint) AS k, rel_dep >= 0 AS inside, {', '.join(values)})"

    takes_off = change(
        f"ceil(rel_dep / {step})", "{p}_slope", "{p}_lto - {p}_slope * rel_dep", planes_in_air=1
    )
    lands = change(
        f"ceil(rel_arr / {step})", "-{p}_slope", "{p}_ccd + {p}_slope * rel_dep", arrived=1
    )
    leaves_air = change(f"floor(rel_arr / {step}) + 1", "0D", "0D", planes_in_air=-1)
    changes = flight.selectExpr("day", f"inline(array({takes_off}, {lands}, {leaves_air}))")
    return changes.filter("inside").drop("inside")


def _flight_changes(gridded: DataFrame, step: int) -> DataFrame:
    """Departures, each flight once however often it fans out.

    Deduplication needs the keys only, so the shuffle is narrow and the lookup
    joins behind ``gridded`` fall away.
    """
    flights = gridded.select("day", "icao24", "dep_s", "arr_s", "start_s").distinct()
    return (
        flights.selectExpr(
            "day",
            f"cast(ceil((dep_s - start_s) / {step}) AS bigint) AS k",
            "dep_s >= start_s AS inside",
        )
        .groupBy("day", "k")
        .agg(F.count_if("inside").alias("num_flights"))
        .filter("num_flights > 0")
    )


def minute_changes(emissions: DataFrame, settings: Settings) -> DataFrame:
    """Change of slope, offset and counts per (``day``, ``k``), the k-th grid minute.

    Flights from the day before are left out after the expansion or after the
    count, so that all branches read one shuffle of the flights (see ``at_times``).
    """
    gridded = with_grid(emissions, settings)
    masses = _mass_changes(gridded, settings.step_s)
    flights = _flight_changes(gridded, settings.step_s)
    return (
        masses.unionByName(
            flights.selectExpr(
                "day",
                "k",
                *[f"0D AS {v}" for v in suffixed("slope") + suffixed("offset")],
                "num_flights",
                "0L AS arrived",
                "0L AS planes_in_air",
            )
        )
        .groupBy("day", "k")
        .agg(*[F.expr(f"sum({v}) AS {v}") for v in _change_columns()])
    )


def emissions_timeline(
    emissions: DataFrame, passengers: DataFrame, settings: Settings
) -> DataFrame:
    """Per day and minute: cumulative masses, flights departed, passengers arrived, planes in the air."""
    step = settings.step_s
    start, end = grid_bounds(settings)
    changes = minute_changes(emissions, settings).withColumns(
        {"start_s": start, "last_k": F.floor((end - start) / step)}
    )
    by_minute = "PARTITION BY day ORDER BY k"
    running = changes.selectExpr(
        "day",
        "k",
        "start_s",
        "last_k",
        f"if(row_number() OVER ({by_minute}) = 1, 0, k) AS from_k",
        f"least(lead(k) OVER ({by_minute}) - 1, last_k) AS to_k",
        *[f"sum({v}) OVER ({by_minute} ROWS UNBOUNDED PRECEDING) AS {v}" for v in _change_columns()],
    )
    # Each change holds until the next one; the first also stands for the empty minutes before it.
    minutes = "if(k <= last_k, sequence(from_k, to_k), cast(array() AS array<bigint>))"
    filled = running.selectExpr("*", f"explode({minutes}) AS grid_k")
    totals = filled.selectExpr(
        "day",
        f"start_s + grid_k * {step} AS t_s",
        *[
            f"if(grid_k < k, 0D, {p}_slope * (grid_k * {step}) + {p}_offset) AS {p}"
            for p in POLLUTANTS
        ],
        *[f"if(grid_k < k, 0, {c}) AS {c}" for c in _COUNTS],
    )
    return _with_passengers(totals, passengers, settings)


def emissions_timeline_exploded(
    emissions: DataFrame, passengers: DataFrame, settings: Settings
) -> DataFrame:
    """The same totals by grouping the whole panel.

    Fan-out copies are summed before the expansion, so counting flights needs no
    distinct over the panel and all of it is combined inside the map tasks.
    """
    masses = suffixed("ccd") + suffixed("lto")
    flights = (
        emissions.selectExpr("day", "icao24", "dep_s", "arr_s", *_known_masses())
        .groupBy("day", "icao24", "dep_s", "arr_s")
        .agg(F.count("*").alias("copies"), *[F.expr(f"sum({m}) AS {m}") for m in masses])
    )
    panel = cumulative_emissions(flight_states(timeline_expand(flights, settings), settings))
    totals = panel.groupBy("day", "t_s").agg(
        *[F.expr(f"sum({p}) AS {p}") for p in POLLUTANTS],
        F.count_if("has_departed").alias("num_flights"),
        F.expr("sum(if(has_arrived, copies, 0L)) AS arrived"),
        F.expr("sum(if(in_air, copies, 0L)) AS planes_in_air"),
    )
    return _with_passengers(totals, passengers, settings)


def _with_passengers(totals: DataFrame, passengers: DataFrame, settings: Settings) -> DataFrame:
    share = per_day(passengers.select("day", "passengers_per_flight"), settings)
    arrived = F.round(F.col("arrived") * F.col("passengers_per_flight")).cast("bigint")
    return attach(totals, share, ["day"], settings).select(
        "day",
        "t_s",
        local_wall(F.col("t_s"), settings.timezone).alias("t_local"),
        *POLLUTANTS,
        "num_flights",
        arrived.alias("passengers_arrived"),
        "planes_in_air",
    )
