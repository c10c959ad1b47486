"""Emissions per flight: type, aircraft id, LTO masses, interpolated CCD masses, gap filling.

LTO is the fixed part at the airports, CCD the part in between that grows with
the duration. Flights meet four lookups in a row; with broadcast lookups that is
one stage without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmesh.config import POLLUTANTS, Settings, suffixed
from tripmesh.operators.lookup import Lookup, attach, per_day


@dataclass(frozen=True)
class Tables:
    """The lookups of an analysis: vehicle register, emission curve, airport directory."""

    register: Lookup
    curve: Lookup
    airports: Lookup


# --- type, aircraft id, LTO -------------------------------------------------


def aircraft_type_join(flights: DataFrame, register: Lookup, settings: Settings) -> DataFrame:
    """Add ``typecode``. A vehicle registered twice yields two rows unless ``dedupe``."""
    if settings.dedupe:
        register = register.derive(
            register.df.groupBy("icao24").agg(F.min("typecode").alias("typecode"))
        )
    return attach(flights, register, ["icao24"], settings)


def aircraft_id_join(flights: DataFrame, curve: Lookup, settings: Settings) -> DataFrame:
    """Add ``aircraft_id``, the name under which the curve lists a type. May fan out."""
    if settings.dedupe:
        ids = curve.df.groupBy("typecode").agg(F.min("aircraft_id").alias("aircraft_id"))
    else:
        ids = curve.df.select("typecode", "aircraft_id").distinct()
    return attach(flights, curve.derive(ids), ["typecode"], settings)


def lto_join(flights: DataFrame, curve: Lookup, settings: Settings) -> DataFrame:
    """Add the nine ``*_lto`` masses. Types that share an aircraft id fan out."""
    lto = curve.df.filter(F.col("phase") == "LTO")
    lto = lto.selectExpr("aircraft_id", *[f"{p} AS {p}_lto" for p in POLLUTANTS])
    if settings.dedupe:
        masses = ", ".join(suffixed("lto"))
        one = lto.groupBy("aircraft_id").agg(F.expr(f"min(struct({masses})) AS m"))
        lto = one.select("aircraft_id", "m.*")
    return attach(flights, curve.derive(lto), ["aircraft_id"], settings)


def curve_candidates(flights: DataFrame, curve: Lookup, settings: Settings) -> DataFrame:
    """Every curve row of a flight's aircraft id: ``ref_phase``, ``ref_s`` and nine ``*_ref``."""
    masses = [f"{p} AS {p}_ref" for p in POLLUTANTS]
    rows = curve.df.selectExpr("aircraft_id", "phase AS ref_phase", "ref_s", *masses)
    return attach(flights, curve.derive(rows), ["aircraft_id"], settings)


# --- bracketing reference points --------------------------------------------


def curve_points(curve: DataFrame, settings: Settings) -> DataFrame:
    """One point per aircraft id and duration: ``ref_s`` and struct ``m`` of the masses.

    Rows may tie, as types share aircraft ids; the smallest masses win, which
    makes the choice repeatable.
    """
    rows = curve.filter(F.col("ref_s").isNotNull())
    if settings.bracket_phase is not None:
        rows = rows.filter(F.col("phase") == settings.bracket_phase)
    return rows.groupBy("aircraft_id", "ref_s").agg(F.min(F.struct(*POLLUTANTS)).alias("m"))


def curve_segments(points: DataFrame) -> DataFrame:
    """Cut the duration axis of each aircraft id into half-open segments.

    n points make n + 1 segments ``[from_s, to_s)``. The outer two are open to
    one side and lack that end point. Each duration lies in exactly one.
    """
    by_duration = Window.partitionBy("aircraft_id").orderBy("ref_s")
    linked = points.select(
        "aircraft_id",
        F.col("ref_s").alias("from_s"),
        F.col("m").alias("m_lo"),
        F.lead("ref_s").over(by_duration).alias("to_s"),
        F.lead("m").over(by_duration).alias("m_hi"),
        (F.row_number().over(by_duration) == 1).alias("is_first"),
    )
    after = F.struct("from_s", "m_lo", "to_s", "m_hi")
    before = F.struct(
        F.lit(None).cast("bigint").alias("from_s"),
        F.lit(None).cast(points.schema["m"].dataType).alias("m_lo"),
        F.col("from_s").alias("to_s"),
        F.col("m_lo").alias("m_hi"),
    )
    pieces = F.when(F.col("is_first"), F.array(before, after)).otherwise(F.array(after))
    return linked.select("aircraft_id", F.explode(pieces).alias("s")).select("aircraft_id", "s.*")


def ccd_bracket(flights: DataFrame, curve: Lookup, settings: Settings) -> DataFrame:
    """Add the nearest reference at or above (``ref_hi_s``, ``*_hi``) and at or below (``*_lo``).

    A range join against the curve's segments: one row in, one row out, where a
    join to all curve rows would multiply the flights first. On an exact hit
    both ends are the hit. A curve measured as too large to broadcast is merged
    instead; one of unknown size stays here, with its segments salted.
    """
    segments = curve.derive(curve_segments(curve_points(curve.df, settings)), factor=2)
    if curve.rows is not None and not segments.fits(settings):
        return ccd_bracket_merge(flights, curve, settings)
    d = F.col("duration_s")
    inside = (F.col("from_s").isNull() | (d >= F.col("from_s"))) & (
        F.col("to_s").isNull() | (d < F.col("to_s"))
    )
    joined = attach(flights, segments, ["aircraft_id"], settings, also=inside)
    exact = "duration_s = from_s"
    return joined.selectExpr(
        *flights.columns,
        f"if({exact}, from_s, to_s) AS ref_hi_s",
        "from_s AS ref_lo_s",
        *[f"if({exact}, m_lo.{p}, m_hi.{p}) AS {p}_hi" for p in POLLUTANTS],
        *[f"m_lo.{p} AS {p}_lo" for p in POLLUTANTS],
    )


def ccd_bracket_merge(flights: DataFrame, curve: Lookup, settings: Settings) -> DataFrame:
    """The same brackets by merging durations and reference points in sorted order.

    Each distinct (aircraft id, duration) is one row beside the points, so how many
    flights share it does not matter. Rows are sorted within ranges of
    ``bracket_range_s`` seconds, and a group holds at most one row a second; the last
    point below a range and the first one above come from a window over the ranges.
    No flight meets more than the one row of its duration.
    """
    known = F.col("aircraft_id").isNotNull() & F.col("duration_s").isNotNull()
    points = curve_points(curve.df, settings).where(F.col("aircraft_id").isNotNull())
    asked = flights.where(known).select("aircraft_id", F.col("duration_s").alias("at_s"), F.lit(None).alias("point"))
    given = points.select("aircraft_id", F.col("ref_s").alias("at_s"), F.struct("ref_s", "m").alias("point"))
    merged = (
        given.unionByName(asked.withColumn("point", F.col("point").cast(given.schema["point"].dataType)))
        .groupBy("aircraft_id", "at_s")
        .agg(F.max("point").alias("point"))
        .withColumn("range", F.floor(F.col("at_s") / settings.bracket_range_s))
    )
    within = Window.partitionBy("aircraft_id", "range").orderBy("at_s")
    found = merged.select(
        "aircraft_id",
        "range",
        "at_s",
        F.last("point", True).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("lo"),
        F.first("point", True).over(within.rowsBetween(0, Window.unboundedFollowing)).alias("hi"),
    )
    ranges = Window.partitionBy("aircraft_id").orderBy("range")
    edges = (
        merged.groupBy("aircraft_id", "range")
        .agg(F.min("point").alias("least"), F.max("point").alias("most"))
        .select(
            "aircraft_id",
            "range",
            F.last("most", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
            F.first("least", True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("above"),
        )
    )
    brackets = found.join(edges, ["aircraft_id", "range"]).select(
        "aircraft_id", F.col("at_s").alias("duration_s"), F.coalesce("lo", "below").alias("lo"), F.coalesce("hi", "above").alias("hi")
    )
    joined = attach(flights, Lookup(brackets), ["aircraft_id", "duration_s"], settings)
    return joined.selectExpr(
        *flights.columns,
        "hi.ref_s AS ref_hi_s",
        "lo.ref_s AS ref_lo_s",
        *[f"hi.m.{p} AS {p}_hi" for p in POLLUTANTS],
        *[f"lo.m.{p} AS {p}_lo" for p in POLLUTANTS],
    )


def ccd_bracket_groupfirst(flights: DataFrame, curve: Lookup, settings: Settings) -> DataFrame:
    """The same brackets per distinct (aircraft id, duration), by grouping candidates.

    Only distinct pairs meet the curve, so the work depends on how many durations
    occur, not on how many flights share them.
    """
    pairs = flights.select("aircraft_id", "duration_s").filter("aircraft_id IS NOT NULL").distinct()
    points = curve.derive(curve_points(curve.df, settings))
    d, ref = F.col("duration_s"), F.col("ref_s")
    point = F.struct("ref_s", "m")
    best = (
        attach(pairs, points, ["aircraft_id"], settings)
        .groupBy("aircraft_id", "duration_s")
        .agg(
            F.min_by(F.when(ref >= d, point), F.when(ref >= d, ref)).alias("hi"),
            F.max_by(F.when(ref <= d, point), F.when(ref <= d, ref)).alias("lo"),
        )
    )
    return best.selectExpr(
        "aircraft_id",
        "duration_s",
        "hi.ref_s AS ref_hi_s",
        "lo.ref_s AS ref_lo_s",
        *[f"hi.m.{p} AS {p}_hi" for p in POLLUTANTS],
        *[f"lo.m.{p} AS {p}_lo" for p in POLLUTANTS],
    )


def ccd_interpolate(bracketed: DataFrame) -> DataFrame:
    """Add ``factor`` and the nine ``*_ccd`` masses; drop the bracket masses.

    The factor runs from 0 at the upper reference to 1 at the lower one. An exact
    hit is factor 0; with one reference missing both are null.
    """
    dropped = {*suffixed("hi"), *suffixed("lo")}
    kept = [c for c in bracketed.columns if c not in dropped]
    share = "(duration_s - ref_hi_s) / nullif(ref_lo_s - ref_hi_s, 0)"
    return bracketed.selectExpr(
        "*", f"if(ref_hi_s = ref_lo_s, 0D, {share}) AS factor"
    ).selectExpr(
        *kept, "factor", *[f"{p}_hi + factor * ({p}_lo - {p}_hi) AS {p}_ccd" for p in POLLUTANTS]
    )


# --- gaps and totals --------------------------------------------------------


def fill_with_mean(flights: DataFrame, settings: Settings) -> DataFrame:
    """Replace null masses by the mean of their column over the arrival day.

    The mean is a grouped aggregate joined back, so no day is gathered in one task.
    """
    columns = suffixed("lto") + suffixed("ccd")
    means = flights.groupBy("day").agg(*[F.expr(f"avg({c}) AS {c}_mean") for c in columns])
    joined = attach(flights, per_day(means, settings), ["day"], settings)
    filled = {c: f"coalesce({c}, {c}_mean) AS {c}" for c in columns}
    return joined.selectExpr(*[filled.get(c, c) for c in flights.columns])


def matched_flights(flights: DataFrame, tables: Tables, settings: Settings) -> DataFrame:
    """Flights with type, aircraft id and LTO masses: all the joins that may fan out."""
    typed = aircraft_type_join(flights, tables.register, settings)
    named = aircraft_id_join(typed, tables.curve, settings)
    return lto_join(named, tables.curve, settings)


def complete_emissions(matched: DataFrame, tables: Tables, settings: Settings) -> DataFrame:
    """Add interpolated CCD masses and fill the gaps; one row in, one row out."""
    bracketed = ccd_bracket(matched, tables.curve, settings)
    return fill_with_mean(ccd_interpolate(bracketed), settings)


def flight_emissions(flights: DataFrame, tables: Tables, settings: Settings) -> DataFrame:
    """Route flights with complete ``*_lto`` and ``*_ccd`` masses."""
    return complete_emissions(matched_flights(flights, tables, settings), tables, settings)


def daily_totals(emissions: DataFrame) -> DataFrame:
    """LTO plus CCD per arrival day and departure date."""
    sums = [
        F.expr(f"coalesce(sum({p}_lto), 0D) + coalesce(sum({p}_ccd), 0D) AS {p}") for p in POLLUTANTS
    ]
    return emissions.groupBy("day", F.to_date("dep_local").alias("dep_date")).agg(*sums)
