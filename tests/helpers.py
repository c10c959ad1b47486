"""Hand-made inputs. Times are minutes after local midnight of 2024-03-05 in Sydney."""

from pyspark.sql import functions as F

from tripmesh.config import POLLUTANTS, Settings
from tripmesh.operators import clean
from tripmesh.operators.emissions import Tables
from tripmesh.operators.lookup import Lookup
from tripmesh.plans import fixtures
from tripmesh.schemas import CURVE, FLIGHTS_RAW

MIDNIGHT = 1709557200  # 2024-03-05 00:00 in Sydney
SETTINGS = Settings(day_bound=400)
UNMEASURED = Settings(day_bound=None, broadcast_rows=0, salts=3)


def minute(m: float) -> int:
    return int(MIDNIGHT + m * 60)


def raw(spark, *flights):
    """Flights as (vehicle, departure minute, arrival minute, from, to)."""
    rows = [(v, minute(d), minute(a), f, t) for v, d, a, f, t in flights]
    return spark.createDataFrame(rows, FLIGHTS_RAW)


def flights(spark, *rows, settings=SETTINGS):
    return clean.route_filter(clean.flights_clean(raw(spark, *rows), settings), settings)


def curve_row(typecode, aircraft_id, phase, ref_s, first):
    """A curve row whose k-th mass is ``first + k``; a null first makes all masses null."""
    masses = [None if first is None else float(first + k) for k in range(len(POLLUTANTS))]
    return (typecode, aircraft_id, phase, ref_s, *masses)


CURVE_ROWS = [
    curve_row("B1", "X1", "CCD", 3600, 100.0),
    curve_row("B1", "X1", "CCD", 7200, 300.0),
    curve_row("B1", "X1", "LTO", None, 10.0),
    curve_row("B2", "X2", "CCD", 3600, 50.0),
    curve_row("B3", "X3", "LTO", None, 20.0),
    curve_row("B4", "X1", "LTO", None, 30.0),
]


def tables(spark, register, curve=CURVE_ROWS, measured=True):
    frames = (
        spark.createDataFrame(register, "icao24 string, typecode string"),
        spark.createDataFrame(curve, CURVE),
        fixtures.airports(spark),
    )
    return Tables(*[Lookup.measured(f) if measured else Lookup(f) for f in frames])


def rows(df, *columns):
    """Rows as sorted tuples; nulls sort first."""
    chosen = df.select(*columns) if columns else df.select(*sorted(df.columns))
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is not None, v) for v in r])


def rounded(df, digits=6):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})
