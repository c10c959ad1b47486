"""Fewer minutes: the hours shown and every n-th row, the last one always kept.

These operators work on one row per minute, so a window over a day holds one
grid, whatever the number of flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmesh.config import Settings


def samples_per_day(settings: Settings) -> int:
    """Most rows ``sampled_totals`` can leave of one day: the longest has 25 hours."""
    return 25 * 3600 // settings.step_s // settings.stride + 2


def sampled_totals(totals: DataFrame, settings: Settings) -> DataFrame:
    """Rows of a per-minute table from ``first_hour`` on, thinned by ``stride``.

    The last row of a day is the next midnight, which the hour alone would drop.
    """
    whole_day = Window.partitionBy("day")
    shown = (
        totals.withColumn("_is_last", F.col("t_s") == F.max("t_s").over(whole_day))
        .filter((F.hour("t_local") >= settings.first_hour) | F.col("_is_last"))
        .withColumn("_rank", F.row_number().over(whole_day.orderBy("t_s")))
    )
    kept = ((F.col("_rank") - 1) % settings.stride == 0) | F.col("_is_last")
    return shown.filter(kept).drop("_is_last", "_rank")


def sampled_times(totals: DataFrame, settings: Settings) -> DataFrame:
    return sampled_totals(totals.select("day", "t_s", "t_local"), settings)


def flight_count_total(totals: DataFrame) -> DataFrame:
    """Highest flight count of each day."""
    return totals.groupBy("day").agg(F.max("num_flights").alias("num_flights"))


def final_record(totals: DataFrame) -> DataFrame:
    """The last row of each day."""
    columns = [c for c in totals.columns if c != "day"]
    last = totals.groupBy("day").agg(F.max_by(F.struct(*columns), "t_s").alias("last"))
    return last.select("day", "last.*")


def planes_in_air(totals: DataFrame) -> DataFrame:
    """Planes in the air at each time that has any."""
    return totals.filter(F.col("planes_in_air") > 0).select("day", "t_s", "planes_in_air")


def peak_times(totals: DataFrame) -> DataFrame:
    """Busiest time of each day; the earliest one if several tie."""
    best = F.max(F.struct("planes_in_air", (-F.col("t_s")).alias("neg"))).alias("best")
    return (
        planes_in_air(totals)
        .groupBy("day")
        .agg(best)
        .select("day", (-F.col("best.neg")).alias("t_s"), F.col("best.planes_in_air"))
    )
