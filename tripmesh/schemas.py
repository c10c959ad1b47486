"""Declared schemas of landed inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from tripmesh.config import POLLUTANTS

FLIGHTS_RAW = T.StructType(
    [
        T.StructField("icao24", T.StringType()),
        T.StructField("firstSeen", T.LongType()),
        T.StructField("lastSeen", T.LongType()),
        T.StructField("estDepartureAirport", T.StringType()),
        T.StructField("estArrivalAirport", T.StringType()),
    ]
)

# All fields of a departure record.
RECORD = T.StructType(
    [
        *FLIGHTS_RAW.fields,
        T.StructField("callsign", T.StringType()),
        T.StructField("estDepartureAirportHorizDistance", T.LongType()),
        T.StructField("estDepartureAirportVertDistance", T.LongType()),
        T.StructField("estArrivalAirportHorizDistance", T.LongType()),
        T.StructField("estArrivalAirportVertDistance", T.LongType()),
        T.StructField("departureAirportCandidatesCount", T.LongType()),
        T.StructField("arrivalAirportCandidatesCount", T.LongType()),
    ]
)

AIRPORT_DOCUMENT = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("wikipedia", T.StringType()),
            T.StructField("IATA", T.StringType()),
            T.StructField("ICAO", T.StringType()),
            T.StructField("WMO", T.IntegerType()),
            T.StructField(
                "location",
                T.StructType(
                    [
                        T.StructField("latitude", T.DoubleType()),
                        T.StructField("longitude", T.DoubleType()),
                    ]
                ),
            ),
        ]
    ),
)

CURVE = T.StructType(
    [
        T.StructField("typecode", T.StringType()),
        T.StructField("aircraft_id", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("ref_s", T.LongType()),
    ]
    + [T.StructField(p, T.DoubleType()) for p in POLLUTANTS]
)
