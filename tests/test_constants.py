import pytest
from pyspark.sql import functions as F

from tripmesh.config import Settings
from tripmesh.functions.noise import uniform_pair
from tripmesh.operators import damages, emissions, geometry, panel
from tripmesh.operators.lookup import Lookup
from tripmesh.plans import fixtures


def test_damage_rates():
    published = damages.damage_rates()
    assert published["co2"] == pytest.approx(0.5956503245946143, abs=1e-12)
    assert published["co"] == pytest.approx(1.1317356167297672, abs=1e-12)
    assert published["sox"] == pytest.approx(49.95197985252, abs=1e-9)
    assert published["nox"] == published["pm"] == pytest.approx(32.74826854608, abs=1e-9)
    assert published["hc"] == pytest.approx(6.54038945424345, abs=1e-9)
    assert damages.damage_rates("pm_corrected")["pm"] == pytest.approx(279.84970715452, abs=1e-9)
    official = damages.damage_rates("official_price")
    assert official["co2"] == 0.08
    assert official["co"] == pytest.approx(0.152)
    assert official["hc"] == pytest.approx(1.126061046)
    with pytest.raises(ValueError):
        damages.damage_rates("free")


def test_projection(spark):
    projected = geometry.project_positions(fixtures.airports(spark))
    at = {r.airport: r for r in projected.collect()}
    assert at["YMML"].x == pytest.approx(16123886.074360557, abs=1e-5)
    assert at["YMML"].y == pytest.approx(-4533380.948431648, abs=1e-5)
    assert at["YSSY"].x == pytest.approx(16828971.372581672, abs=1e-5)
    assert at["YSCB"].y == pytest.approx(-4205672.238914773, abs=1e-5)


def test_bearings(spark):
    pairs = spark.sql(
        "SELECT * FROM VALUES ('YMML','YSSY'), ('YSSY','YMML'), ('YMAV','YMML'), ('YSCB','YSSY'),"
        " ('YSSY','YSCB'), ('YMML','NONE') AS t(dep_airport, arr_airport)"
    )
    airports = Lookup.measured(fixtures.airports(spark))
    turned = geometry.route_bearing(geometry.airport_join(pairs, airports, Settings()))
    found = {(r.dep_airport, r.arr_airport): r.bearing for r in turned.collect()}
    assert found == {
        ("YMML", "YSSY"): pytest.approx(30.474986, abs=1e-6),
        ("YSSY", "YMML"): pytest.approx(-149.525014, abs=1e-6),
        ("YMAV", "YMML"): pytest.approx(44.591273, abs=1e-6),
        ("YSCB", "YSSY"): pytest.approx(34.470337, abs=1e-6),
        ("YSSY", "YSCB"): pytest.approx(-145.529663, abs=1e-6),
    }


@pytest.mark.parametrize(
    "day, points", [("2024-03-05", 1441), ("2025-10-05", 1381), ("2026-04-05", 1501)]
)
def test_grid_length(spark, day, points):
    days = spark.range(1).select(F.lit(day).cast("date").alias("day"))
    grid = panel.time_grid(days, Settings())
    ends = grid.agg(F.count("*"), F.min("t_local"), F.max("t_local")).first()
    assert ends[0] == points
    assert ends[1].strftime("%H:%M") == ends[2].strftime("%H:%M") == "00:00"
    assert (ends[2] - ends[1]).days == 1


def test_noise_is_uniform_and_repeatable(spark):
    one, two = uniform_pair(F.col("id").cast("string"), "x")
    df = spark.range(20000).select(one.alias("a"), two.alias("b"))
    stats = df.agg(F.min("a"), F.max("a"), F.avg("a"), F.avg("b"), F.corr("a", "b")).first()
    assert 0 <= stats[0] < 0.001 and 0.999 < stats[1] < 1
    assert abs(stats[2] - 0.5) < 0.01 and abs(stats[3] - 0.5) < 0.01 and abs(stats[4]) < 0.03
    assert df.exceptAll(df.repartition(3)).count() == 0


def test_fixture_counts(spark, small):
    """Counts published with the fixtures."""
    from tripmesh.operators import coverage
    from tripmesh.plans.catalogue import analysis

    every, chosen = analysis(spark, small), analysis(spark, small, one_day=True)
    assert every.raw.count() == 1100
    assert every.raw.filter("estArrivalAirport IS NULL").count() == 157
    assert every.flights.count() == 857
    assert every.route_flights.count() == 415
    assert str(every.chosen_date.first().day) == "2024-01-02"
    assert chosen.route_flights.count() == 19
    assert chosen.route_flights.filter("to_date(dep_local) < day").count() == 1
    assert chosen.passengers.first().passenger_flights == 7
    assert chosen.matched_flights.count() == 31
    assert every.matched_flights.count() == 625
    typed = emissions.aircraft_type_join(every.route_flights, every.tables.register, every.settings)
    named = emissions.aircraft_id_join(typed, every.tables.curve, every.settings)
    assert named.filter("aircraft_id IS NULL").count() == 97
    assert named.filter("aircraft_id IS NOT NULL AND duration_s < 3000").count() == 42
    assert named.filter("aircraft_id IS NOT NULL AND duration_s > 7200").count() == 74
    assert coverage.grid_extent(chosen.minute_totals).first().end_s == 1704200400
