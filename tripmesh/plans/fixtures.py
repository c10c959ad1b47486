"""Analysis inputs derived from the ``events`` table.

The driver tables hold no flights, so flights, the vehicle register and the
emission sheet are computed from events by integer rules that any SQL engine can
repeat (see FIXTURES.md).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmesh.config import POLLUTANTS
from tripmesh.functions.time import epoch_seconds
from tripmesh.sources.readers import SHEET_HEADERS

# The airports of interest.
AIRPORTS = [
    # name, IATA, ICAO, WMO, latitude, longitude
    ("Melbourne", "MEL", "YMML", 94866, -37.673333, 144.843333),
    ("Avalon", "AVV", "YMAV", 94854, -38.040556, 144.470833),
    ("Sydney", "SYD", "YSSY", 94767, -33.946111, 151.177222),
    ("Canberra", "CBR", "YSCB", 94926, -35.306944, 149.195),
]

# Ends a derived flight may have; YBBN is not of interest, NULL is in progress.
DEPARTURES = ["YMML", "YMAV", "YSSY", "YSCB", "YBBN"]
ARRIVALS = ["YMML", "YMAV", "YSSY", "YSCB", "YBBN", None]

CCD_DURATIONS = [3000, 4200, 5400, 7200]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _padded(number: Column, width: int) -> Column:
    """Digits padded to ``width``; longer numbers stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _vehicle(user_id: Column) -> Column:
    return F.concat(F.lit("ac"), _padded(user_id, 4))


def flights_raw(events: DataFrame) -> DataFrame:
    """Departure records; every tenth event yields an exact copy, as overlapping fetches do."""
    e, u = F.col("event_id"), F.col("user_id")
    first = epoch_seconds(F.col("ts"))
    departures = F.array(*[F.lit(a) for a in DEPARTURES])
    arrivals = F.array(*[F.lit(a) for a in ARRIVALS])
    copies = F.when(e % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.withColumn("copy", F.explode(copies)).select(
        _vehicle(u).alias("icao24"),
        first.alias("firstSeen"),
        (first + 2400 + (e * 37) % 6000).alias("lastSeen"),
        F.get(departures, ((u * 7 + e) % 5).cast("int")).alias("estDepartureAirport"),
        F.get(arrivals, ((e * 5 + F.floor(e / 7)) % 6).cast("int")).alias("estArrivalAirport"),
    )


def aircraft_map(events: DataFrame) -> DataFrame:
    """Vehicle register: gaps, null types and a few vehicles listed twice."""
    u = F.col("user_id")

    def type_of(number: Column) -> Column:
        return F.concat(F.lit("T"), _padded(number % 12, 2))

    main = F.when(u % 13 == 0, F.lit(None)).otherwise(type_of(u))
    types = F.when(u % 19 == 18, F.array(main, type_of(u + 1))).otherwise(F.array(main))
    users = events.select("user_id").distinct().filter(u % 17 != 16)
    return users.select(_vehicle(u).alias("icao24"), F.explode(types).alias("typecode"))


def curve_of_types(types: DataFrame) -> DataFrame:
    """Sheet rows of the type numbers ``n``: 0..9 have curves, 10 an empty id, 11 none."""
    n = F.col("n")
    aircraft = F.when(n == 3, F.array(F.lit(3), F.lit(7))).otherwise(F.array((n % 8).cast("int")))
    durations = [F.lit(d).cast("bigint") for d in CCD_DURATIONS]
    lto = F.lit(None).cast("bigint")
    rows = types.select("n", F.explode(aircraft).alias("j"))
    rows = rows.select("n", "j", F.explode(F.array(*durations, lto)).alias("ref_s"))
    rows = rows.filter(F.col("ref_s").isNotNull() | (F.col("j") != 6))
    ccd = "(1 + j) * ((ref_s / 3600) * (ref_s / 3600))"
    masses = [
        F.expr(f"if(ref_s IS NULL, {25 + 2.5 * k}D + j, {100 + 10 * k} * {ccd}) AS {p}")
        for k, p in enumerate(POLLUTANTS)
    ]
    code = F.concat(F.lit("T"), _padded(n, 2))
    return rows.select(
        F.when(n < 10, code).when(n == 10, F.lit("")).alias("typecode"),
        F.concat(F.lit("A"), F.col("j")).alias("aircraft_id"),
        F.when(F.col("ref_s").isNull(), F.lit("LTO")).otherwise(F.lit("CCD")).alias("phase"),
        "ref_s",
        *masses,
    )


def emission_curve(spark: SparkSession) -> DataFrame:
    """The loaded curve: types T00 to T09, 54 rows."""
    return curve_of_types(spark.range(0, 10, 1, 1).withColumnRenamed("id", "n"))


def emission_sheet(events: DataFrame) -> DataFrame:
    """The sheet as it is landed, for the types that occur: odd headers, ``H:MM:SS`` text."""
    types = events.select((F.col("user_id") % 12).alias("n")).distinct()
    s = F.col("ref_s")
    clock = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    sheet = curve_of_types(types).withColumn("ref_s", F.when(s.isNotNull(), clock))
    return sheet.select(*[F.col(ours).alias(header) for header, ours in SHEET_HEADERS.items()])


def airport_document() -> str:
    """The directory as one JSON object keyed by airport name."""
    return json.dumps(
        {
            name: {"IATA": iata, "ICAO": icao, "WMO": wmo, "location": {"latitude": lat, "longitude": lon}}
            for name, iata, icao, wmo, lat, lon in AIRPORTS
        }
    )


def airports(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a[0]}', '{a[2]}', {a[4]!r}D, {a[5]!r}D)" for a in AIRPORTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, airport, latitude, longitude)")
