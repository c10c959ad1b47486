"""Instants are BIGINT epoch seconds, wall clocks are TIMESTAMP_NTZ.

Nothing here depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(wall: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ, read as UTC."""
    days = F.datediff(wall, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def utc_wall(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def local_wall(seconds: Column, timezone: str) -> Column:
    """Wall clock of an instant in ``timezone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc_wall(seconds))


def day_start(day: Column, timezone: str) -> Column:
    """Instant of local midnight at the start of ``day``."""
    midnight = day.cast("timestamp_ntz")
    return epoch_seconds(F.convert_timezone(F.lit(timezone), F.lit("UTC"), midnight))


def grid_times(start_s: Column, end_s: Column, step_s: int) -> Column:
    """Array of instants from start to end, both included.

    Built on epoch seconds so that clock-change days get 23 or 25 hours.
    """
    return F.sequence(start_s, end_s, F.lit(step_s).cast("bigint"))
