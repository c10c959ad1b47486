import pytest
from pyspark.sql import functions as F

from helpers import MIDNIGHT, SETTINGS, flights, minute, rows
from tripmesh.operators import geometry, panel, sampling, snapshots
from tripmesh.operators.lookup import Lookup
from tripmesh.plans import fixtures
from tripmesh.plans.catalogue import COPY, QUERIES, STATES, analysis, shown, summed, summed_trips

FLAGS = ("has_departed", "has_arrived", "in_air", "taxiing_departure", "taxiing_arrival", "progress")


def states(spark, *legs):
    return panel.flight_states(panel.timeline_expand(flights(spark, *legs), SETTINGS), SETTINGS)


def test_boundary_minutes(spark):
    panel_rows = states(spark, ("a", 600, 660, "YMML", "YSSY"))
    at = {(r.t_s - MIDNIGHT) // 60: tuple(r[c] for c in FLAGS) for r in panel_rows.collect()}
    assert len(at) == 1441
    no, yes = False, True
    assert at[584] == (no, no, no, no, no, 0.0)
    assert at[585] == (no, no, no, yes, no, 0.0)
    assert at[599] == (no, no, no, yes, no, 0.0)
    assert at[600] == (yes, no, yes, no, no, 0.0)
    assert at[630] == (yes, no, yes, no, no, 0.5)
    assert at[660] == (yes, yes, yes, no, no, 1.0)
    assert at[661] == (yes, yes, no, no, yes, 1.0)
    assert at[675] == (yes, yes, no, no, yes, 1.0)
    assert at[676] == (yes, yes, no, no, no, 1.0)


def test_zero_length_flight(spark):
    panel_rows = states(spark, ("a", 600, 600, "YMML", "YSSY"))
    steps = rows(panel_rows.groupBy("progress").agg(F.count("*"), F.min("t_s")))
    assert [r[2] for r in steps] == [0.0, 1.0]
    assert rows(panel_rows.filter("in_air"), "t_s") == [(minute(600),)]


def test_flight_from_the_day_before_has_no_minutes(spark):
    legs = [("a", -10, 60, "YMML", "YSSY"), ("b", 0, 60, "YMML", "YSSY")]
    assert rows(states(spark, *legs).select("icao24").distinct()) == [("b",)]


def test_states_exclude_each_other_and_masses_never_fall(spark, small):
    a = analysis(spark, small, one_day=True)
    whole = panel.timeline(a.locate(a.emissions), a.settings)
    flags = ["in_air", "taxiing_departure", "taxiing_arrival"]
    several = whole.filter(" + ".join(f"cast({f} AS int)" for f in flags) + " > 1")
    assert several.count() == 0
    assert whole.filter("progress NOT BETWEEN 0 AND 1").count() == 0
    key = "PARTITION BY icao24, dep_s, aircraft_id, co2_lto ORDER BY t_s"
    falls = whole.selectExpr(f"co2 - lag(co2) OVER ({key}) AS step").filter("step < -1e-9")
    assert falls.count() == 0


def test_path_runs_between_the_jittered_ends(spark):
    airports = Lookup.measured(fixtures.airports(spark))
    placed = geometry.airport_join(flights(spark, ("a", 600, 660, "YMML", "YSSY")), airports, SETTINGS)
    moved = geometry.jittered_endpoints(geometry.route_bearing(placed), SETTINGS)
    before, after = placed.first(), moved.first()
    for end in ("dep_lat", "dep_lon", "arr_lat", "arr_lon"):
        assert 0 < abs(after[end] - before[end]) <= SETTINGS.jitter_end
    times = spark.createDataFrame([(minute(m),) for m in (600, 630, 660)], "t_s long")
    times = times.crossJoin(moved.select("day"))
    found = snapshots.sampled_positions(moved, times, SETTINGS)
    r = moved.first()
    ends = rows(found, "t_s", "latitude", "longitude")
    assert ends[0][1:] == (r.dep_lat, r.dep_lon)
    assert abs(ends[2][1] - r.arr_lat) < 1e-9 and abs(ends[2][2] - r.arr_lon) < 1e-9
    # halfway: the bump of each axis is a quarter of the other axis' draw
    assert abs(ends[1][1] - ((r.dep_lat + r.arr_lat) / 2 + r.mid_lon_jitter / 4)) < 1e-9
    assert abs(ends[1][2] - ((r.dep_lon + r.arr_lon) / 2 + r.mid_lat_jitter / 4)) < 1e-9


def test_sampling_keeps_the_last_midnight(spark):
    days = spark.sql("SELECT DATE '2024-03-05' AS day UNION ALL SELECT DATE '2026-04-05'")
    times = sampling.sampled_times(panel.time_grid(days, SETTINGS), SETTINGS)
    counts = rows(times.groupBy("day").agg(F.count("*"), F.min(F.hour("t_local"))), "count(1)")
    assert counts == [(286,), (286,)]  # the repeated hour of the second day is before 5:00
    last = times.groupBy("day").agg(F.max("t_local").alias("t"))
    assert last.filter("date_format(t, 'HH:mm') = '00:00'").count() == 2


def test_shown_doubles_are_rounded_without_decimals(spark):
    values = [0.0005, -0.0005, 1.2344999, 1.2345, -1.2345, -1e-9, 0.0, 123456789.0125, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    plan = shown(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.replace("rounded", "")
    decimals = [r.x for r in df.selectExpr("round(x + 1e-7D, 3) AS x").collect()]
    assert [str(r.x) for r in shown(df).collect()] == [str(x) for x in decimals]


def test_wall_clocks_of_a_timeline_are_those_of_each_minute(spark, small):
    from tripmesh.functions.time import local_wall

    a = analysis(spark, small, one_day=True)
    days = [("2024-03-05", 0), ("2024-04-07", 33 * 86400), ("2024-10-06", 215 * 86400 + 3600)]  # 24, 25 and 23 hours
    first = a.locate(a.emissions).limit(1)
    legs = first.crossJoin(spark.createDataFrame(days, "d string, later long"))
    legs = legs.withColumns({"day": F.to_date("d"), "dep_s": F.lit(MIDNIGHT + 8 * 3600) + F.col("later")})
    legs = legs.withColumn("arr_s", F.col("dep_s") + 3600).drop("d", "later")
    whole = panel.timeline(legs, a.settings)
    assert rows(whole.groupBy("day").agg(F.count("*").alias("n")).select("n")) == [(1381,), (1441,), (1501,)]
    assert whole.filter(~F.col("t_local").eqNullSafe(local_wall(F.col("t_s"), a.settings.timezone))).count() == 0
    plan = whole.select("t_local")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnotnull(midnight_s" in plan  # not every minute is converted


def test_trips_are_summed_by_two_numbers_and_keep_their_columns(spark):
    from pyspark.sql import Row

    legs = flights(spark, ("a", 600, 660, "YMML", "YSSY"), ("b", 600, 660, "YMML", "YSSY"), ("b", -10, 60, "YMML", "YSSY"))
    ids = spark.createDataFrame([("a", None), ("a", None), ("a", ""), ("a", "X"), ("b", "X")], "icao24 string, aircraft_id string")
    copies = legs.join(ids, "icao24")  # one trip twice under a null id; a trip of the day before has no minutes

    def expand(f):
        return panel.flight_states(panel.timeline_expand(f, SETTINGS), SETTINGS)

    found = summed_trips(copies, expand, COPY, STATES, ["progress"])
    assert rows(found) == rows(summed(expand(copies), COPY, STATES, ["progress"]))
    assert rows(found, "icao24", "aircraft_id", "n") == [("a", None, 2882), ("a", "", 1441), ("a", "X", 1441), ("b", "X", 1441)]
    assert found.where("aircraft_id = 'X' AND icao24 = 'a'").select("first_s", "last_s").first() == Row(minute(0), minute(1440))


@pytest.mark.parametrize("name", ["timeline", "cumulative_emissions", "flight_states", "timeline_expand"])
def test_no_row_of_a_panel_is_grouped_by_text(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "explode(CASE" in line and "t_s" in line)
    groups = [line for line in plan[:explode] if "Aggregate [" in line and "min(t_s" in line]
    assert len(groups) == 1 and groups[0].split("Aggregate ")[1].startswith("[trip_a#")
