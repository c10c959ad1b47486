"""Parameters of the analysis. Every operator takes a ``Settings``."""

from __future__ import annotations

from dataclasses import dataclass

# The nine pollutants, in table order, all in kg.
POLLUTANTS = (
    "co2",
    "nox",
    "sox",
    "h2o",
    "co",
    "hc",
    "pm_non_volatile",
    "pm_volatile",
    "pm_total",
)

# The six priced pollutants in report order, with the mass each price applies to.
PRICED = {
    "co2": "co2",
    "co": "co",
    "sox": "sox",
    "nox": "nox",
    "hc": "hc",
    "pm": "pm_total",
}


def suffixed(suffix: str) -> list[str]:
    """The nine pollutant columns with a suffix, e.g. ``co2_lto``."""
    return [f"{p}_{suffix}" for p in POLLUTANTS]


@dataclass(frozen=True)
class Settings:
    timezone: str = "Australia/Sydney"
    airports: tuple[str, ...] = ("YMML", "YMAV", "YSSY", "YSCB")
    passenger_airports: tuple[str, ...] = ("YMML", "YMAV", "YSSY")
    taxi_s: int = 15 * 60
    step_s: int = 60
    coverage_hours: tuple[int, int] = (8, 13)
    jitter_end: float = 0.1
    jitter_mid: float = 1.5
    yearly_passengers: float = 8.04e6
    days_per_year: int = 365
    first_hour: int = 5
    stride: int = 4
    # Curve rows of this phase only may bracket a flight; None lets every phase in.
    bracket_phase: str | None = None
    # True keeps one type, one aircraft id and one LTO row per flight instead of fanning out.
    dedupe: bool = False
    # Largest bytes and rows a lookup may be broadcast at; larger or unmeasured ones are shuffled.
    broadcast_bytes: int = 64 << 20
    broadcast_rows: int = 4_000_000
    # Buckets a shuffled lookup join spreads each hot key over.
    salts: int = 32
    # Seconds of duration in one sorted group where a curve too large to broadcast is merged with the flights.
    bracket_range_s: int = 3600
    # Flights one task expands to a day of minutes each (here 72 million rows).
    flights_per_task: int = 50_000
    # Most tasks of an expansion for each core of the cluster.
    tasks_per_core: int = 32
    # Tasks that expand flights to minutes, or None to keep the partitions as they come.
    panel_tasks: int | None = None
    # Proven upper bound on the number of arrival days, or None if not measured.
    day_bound: int | None = None
