from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmesh.config import POLLUTANTS
from tripmesh.schemas import AIRPORT_DOCUMENT, CURVE, FLIGHTS_RAW

# Headers of the emission sheet, odd spaces included, and our names.
SHEET_HEADERS = {
    "ICAO_ID": "typecode",
    "AIRCRAFT ID": "aircraft_id",
    "LTO or CCD": "phase",
    "FORECAST  DURATION": "ref_s",
    "FORECAST CO2 (3,15 for JET-A or 3,10 for AvGAS) ": "co2",
    "FORECAST  NOX": "nox",
    "FORECAST  SOX": "sox",
    "FORECAST  H20": "h2o",
    "FORECAST  CO": "co",
    "FORECAST  HC": "hc",
    " PM Non Volatile": "pm_non_volatile",
    "PM VOLATILE (all)": "pm_volatile",
    "PM TOTAL": "pm_total",
}


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """Landed departures; only the five columns in use are read."""
    return spark.read.schema(FLIGHTS_RAW).parquet(path)


def read_flights_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed departures as JSON records, one per line."""
    return spark.read.schema(FLIGHTS_RAW).json(path)


def read_aircraft_map(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle register from (gzipped) CSV: ``icao24``, ``typecode``.

    The row after the header carries no vehicle id. It is dropped by that, not
    by position: rows have none once a scan is split over tasks, and a row
    without an id can match no flight anyway.
    """
    rows = spark.read.option("header", True).csv(path)
    return rows.select("icao24", "typecode").filter(F.col("icao24") != "")


def duration_seconds(text: Column) -> Column:
    """``H:MM:SS`` as seconds; null when the text is null or empty."""
    parts = F.split(F.nullif(F.trim(text), F.lit("")), ":")
    return (
        F.get(parts, F.lit(0)).cast("bigint") * 3600
        + F.get(parts, F.lit(1)).cast("bigint") * 60
        + F.get(parts, F.lit(2)).cast("bigint")
    )


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """Emission curve from the sheet landed as CSV; rows without a type are dropped.

    Spaces inside headers are significant; those at the ends may be lost when
    the sheet is landed, so headers are matched without them.
    """
    sheet = spark.read.option("header", True).csv(path)
    names = {header.strip(): ours for header, ours in SHEET_HEADERS.items()}
    found = {c: names[c.strip()] for c in sheet.columns if c.strip() in names}
    named = sheet.withColumnsRenamed(found).select(*CURVE.fieldNames())
    return (
        named.filter(F.col("typecode").isNotNull() & (F.col("typecode") != ""))
        .withColumn("ref_s", duration_seconds(F.col("ref_s")))
        .withColumns({p: F.col(p).cast("double") for p in POLLUTANTS})
    )


def read_airports(spark: SparkSession, path: str, id_kind: str = "ICAO") -> DataFrame:
    """Airport directory: one JSON object keyed by name, as one row per airport."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", AIRPORT_DOCUMENT).alias("doc"))
    return parsed.select(F.explode("doc").alias("name", "info")).select(
        "name",
        F.col(f"info.{id_kind}").cast("string").alias("airport"),
        F.col("info.location.latitude").alias("latitude"),
        F.col("info.location.longitude").alias("longitude"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result written by ``tripmesh.sinks``."""
    return spark.read.parquet(path)
