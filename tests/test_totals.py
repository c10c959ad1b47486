import pytest
from pyspark.sql import functions as F

from helpers import SETTINGS, flights, minute, rounded, rows, tables
from test_emissions import LEGS, REGISTER
from tripmesh.operators import coverage, damages, emissions, sampling, snapshots, totals
from tripmesh.plans.catalogue import analysis

EDGES = [
    ("a", 0, 1439.5, "YMML", "YSSY"),  # all day
    ("b", 700, 700, "YMML", "YSSY"),  # no length
    ("b", 710.2, 710.4, "YMML", "YSSY"),  # between two minutes
    ("b", 720.5, 780.25, "YSSY", "YMML"),
    ("f", 720.5, 790, "YSSY", "YMML"),  # registered twice
    ("a", -5, 30, "YMML", "YSSY"),  # from the day before
    ("a", 2000, 2060, "YMML", "YSSY"),  # next day
    ("a", 4300, 4330, "YMML", "YSSY"),  # arrives a day after it departs: no timeline for that day
]


def both(spark, *legs, curve=None):
    f = flights(spark, *legs)
    t = tables(spark, REGISTER) if curve is None else tables(spark, REGISTER, curve)
    e = emissions.flight_emissions(f, t, SETTINGS)
    p = totals.passengers_per_flight(f, SETTINGS)
    return (
        f,
        e,
        totals.emissions_timeline(e, p, SETTINGS),
        totals.emissions_timeline_exploded(e, p, SETTINGS),
    )


@pytest.mark.parametrize("legs", [EDGES, LEGS, EDGES + LEGS])
def test_running_sums_equal_the_panel(spark, legs):
    _, _, swept, exploded = both(spark, *legs)
    assert rows(rounded(swept)) == rows(rounded(exploded))


def test_last_minute_is_the_sum_of_the_flights_inside_the_day(spark, small):
    a = analysis(spark, small)
    last = sampling.final_record(a.minute_totals)
    inside = a.emissions.filter("to_date(dep_local) = day")
    sums = inside.groupBy("day").agg(F.sum(F.expr("co2_lto + co2_ccd")).alias("total"))
    joined = last.join(sums, "day")
    assert joined.count() == last.count()
    assert joined.filter("abs(co2 - total) > 1e-6").count() == 0


def test_all_null_masses_total_zero(spark):
    _, _, swept, exploded = both(spark, *LEGS, curve=[])
    extremes = swept.agg(F.max("co2"), F.min("co2"), F.max("num_flights")).first()
    assert tuple(extremes) == (0.0, 0.0, 5)
    assert rows(rounded(swept)) == rows(rounded(exploded))


def test_fan_out_counts_flights_once_and_passengers_per_copy(spark):
    _, e, swept, _ = both(spark, ("f", 600, 660, "YMML", "YSSY"))
    assert e.count() == 3
    last = sampling.final_record(swept).first()
    share = SETTINGS.yearly_passengers / SETTINGS.days_per_year
    assert (last.num_flights, last.passengers_arrived) == (1, round(3 * share))


def test_day_without_passenger_flights(spark):
    f, _, swept, _ = both(spark, ("a", 600, 660, "YMML", "YSCB"))
    assert rows(totals.passengers_per_flight(f, SETTINGS), "passenger_flights", "passengers_per_flight") == [
        (0, None)
    ]
    assert rows(swept.select("passengers_arrived").distinct()) == [(None,)]


def test_day_without_route_flights(spark):
    _, _, swept, exploded = both(spark, ("a", 600, 660, "YMML", "YBBN"))
    assert swept.count() == exploded.count() == 0


def test_peak_is_the_earliest_of_the_busiest(spark):
    _, _, swept, _ = both(
        spark, ("a", 600, 630, "YMML", "YSSY"), ("b", 620, 640, "YSSY", "YMML"), ("c", 900, 950, "YMML", "YSCB"),
        ("d", 940, 960, "YMML", "YSCB"),
    )
    # a comes twice (two LTO rows), so it and b make three planes
    assert rows(sampling.peak_times(swept), "t_s", "planes_in_air") == [(minute(620), 3)]


def test_snapshots_keep_quiet_minutes(spark, small):
    a = analysis(spark, small)
    shown = snapshots.minute_snapshots(a.planes, a.sampled_totals, a.sampled_times, a.settings)
    per_time = shown.groupBy("day", "t_s").agg(F.count("icao24").alias("n"), F.max("planes_in_air").alias("m"))
    assert per_time.count() == a.sampled_totals.count()
    assert per_time.filter("n <> m").count() == 0


@pytest.mark.parametrize("stride, first_hour", [(4, 5), (7, 0), (1, 23), (1441, 3)])
def test_times_made_from_two_numbers_are_the_sampled_ones(spark, stride, first_hour):
    from dataclasses import replace

    from tripmesh.operators import panel

    settings = replace(SETTINGS, stride=stride, first_hour=first_hour)
    legs = [("a1", 1, 1439, "YMML", "YSSY"), ("a2", 1430, 1440, "YSSY", "YMML"), ("a3", 301.5, 302.5, "YMML", "YSSY"), ("a4", 700, 700, "YMML", "YSSY")]
    f = flights(spark, *legs, settings=settings)
    times = sampling.sampled_times(panel.time_grid(f.select("day").distinct(), settings), settings).select("day", "t_s")
    want = f.where("to_date(dep_local) = day").join(times, "day").where("t_s BETWEEN dep_s AND arr_s").select("icao24", "t_s")
    assert rows(panel.expand_airborne(f, times, settings), "icao24", "t_s") == rows(want)


def test_damages(spark):
    df = spark.sql("SELECT 2D AS co2, 3D AS co, CAST(NULL AS DOUBLE) AS sox, 1D AS nox, 1D AS hc, 1D AS pm_total")
    rates = damages.damage_rates()
    priced = damages.damages(df).first()
    assert priced.co2_damage == 2 * rates["co2"] and priced.sox_damage is None
    expected = 2 * rates["co2"] + 3 * rates["co"] + rates["nox"] + rates["hc"] + rates["pm"]
    assert priced.total_damage == pytest.approx(expected)
    by = {r.scenario: r for r in damages.damages_by_scenario(df).collect()}
    assert by["as_published"].total_damage == pytest.approx(expected)
    assert by["official_price"].co2_damage == pytest.approx(0.16)
    assert by["pm_corrected"].pm_damage == pytest.approx(279.84970715452)


def test_pivot_takes_the_dates_of_the_data(spark):
    from tripmesh.operators import coverage

    cells = [(f"2023-{m:02d}-{d:02d}", h, m + d + h) for m in (5, 11) for d in (3, 28) for h in (9, 12)]
    hourly = spark.createDataFrame(cells, "day string, hour int, flights long")
    wide = coverage.coverage_pivot(hourly).collect()
    assert sum(v for r in wide for k, v in r.asDict().items() if k != "hour") == sum(c[2] for c in cells)
    assert len(wide[0]) == 5


def test_pivot_cells_over_two_other_months(spark):
    cells = [("2023-11-30", 8, 5), ("2023-12-01", 9, 2), ("2023-12-01", 8, 1)]
    hourly = spark.createDataFrame(cells, "day string, hour int, flights long").withColumn("day", F.to_date("day"))
    got = rows(coverage.coverage_cells(hourly), "day", "hour", "flights")
    assert got == [("2023-11-30", 8, 5), ("2023-11-30", 9, None), ("2023-12-01", 8, 1), ("2023-12-01", 9, 2)]
    assert coverage.coverage_cells(hourly.limit(0)).collect() == []


def test_tasks_of_an_expansion_are_bounded_by_the_cluster():
    from tripmesh.config import Settings
    from tripmesh.plans.compose import panel_tasks

    assert panel_tasks(10**12, 4000, Settings()) == 4000 * 32
    assert panel_tasks(10, 8, Settings()) == 8


def test_unknown_airport_is_in_neither_totals_nor_snapshots(spark, small):
    from dataclasses import replace

    from tripmesh.operators import snapshots
    from tripmesh.plans.catalogue import analysis
    from tripmesh.plans.compose import Analysis

    a = analysis(spark, small)
    settings = replace(a.settings, airports=(*a.settings.airports, "YBBN"))
    b = Analysis(a.raw, a.tables, settings)
    totals = b.sampled_totals.cache()
    shots = snapshots.minute_snapshots(b.planes, totals, b.sampled_times, settings).cache()
    assert shots.select("day", "t_s").distinct().count() == totals.count()
    planes = totals.agg({"planes_in_air": "sum"}).first()[0]
    assert shots.where("icao24 IS NOT NULL").count() == planes > 0


def test_peaks_do_not_shuffle_flights_again(spark, small):
    from tripmesh.plans.catalogue import QUERIES

    plan = QUERIES["peak_positions"](spark, small)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" not in plan
