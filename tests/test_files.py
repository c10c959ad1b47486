"""Sources, sinks, the batch job and what reaches the scans."""

from pyspark.sql import functions as F

from helpers import SETTINGS, rounded, rows
from tripmesh.config import Settings
from tripmesh.operators import clean, coverage
from tripmesh.plans import batch, fixtures
from tripmesh.plans.catalogue import analysis
from tripmesh.sinks import write_csv, write_sorted_parquet
from tripmesh.sources import read_aircraft_map, read_airports, read_curve, read_flights
from tripmesh.sources.readers import duration_seconds


def test_duration_text(spark):
    df = spark.sql("SELECT * FROM VALUES (1, '0:50:00'), (2, '12:00:07'), (3, ''), (4, NULL) AS t(n, d)")
    assert rows(df.select("n", duration_seconds(F.col("d")).alias("s")), "n", "s") == [
        (1, 3000),
        (2, 43207),
        (3, None),
        (4, None),
    ]


def test_airport_directory(spark, tmp_path):
    path = tmp_path / "airports.json"
    path.write_text(fixtures.airport_document())
    columns = ("name", "airport", "latitude", "longitude")
    assert rows(read_airports(spark, str(path)), *columns) == rows(fixtures.airports(spark), *columns)
    assert {r.airport for r in read_airports(spark, str(path), "IATA").collect()} == {"MEL", "AVV", "SYD", "CBR"}


def test_landed_scan_is_pruned_and_filtered(spark, small, tmp_path):
    a = analysis(spark, small)
    path = str(tmp_path / "raw")
    a.raw.withColumn("callsign", F.lit("x")).write.parquet(path)
    flights = clean.route_filter(clean.flights_clean(read_flights(spark, path), SETTINGS), SETTINGS)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = flights._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "callsign" not in plan
    assert "IsNotNull(estArrivalAirport)" in plan and "In(estArrivalAirport" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows(flights) == rows(a.route_flights)


def test_chosen_date_reaches_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "by-day")
    a = analysis(spark, small)
    a.flights.write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    chosen = coverage.flights_on_date(stored, coverage.choose_date(stored))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "Subquery" in plan
    assert chosen.count() == 37


def test_branches_read_one_shuffle_of_the_flights(spark, small):
    emissions = analysis(spark, small).emissions
    emissions.write.format("noop").mode("overwrite").save()
    emissions.collect()
    plan = emissions._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [event_id") == 1
    assert "SortMergeJoin" not in plan


def test_sorted_sink_is_in_global_order(spark, tmp_path):
    path = str(tmp_path / "sorted")
    df = spark.range(5000).selectExpr("id % 7 AS day", "(id * 7919) % 5000 AS t_s")
    write_sorted_parquet(df.repartition(5), path, "day", "t_s")
    ranges = (
        spark.read.parquet(path)
        .groupBy(F.input_file_name().alias("file"))
        .agg(F.min(F.struct("day", "t_s")).alias("lo"), F.max(F.struct("day", "t_s")).alias("hi"))
        .orderBy("file")
        .collect()
    )
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))


def landed(spark, small, folder):
    """Landed inputs as files."""
    events = fixtures.events(spark, small)
    paths = {n: f"{folder}/{n}" for n in ("flights", "register", "curve", "airports")}
    fixtures.flights_raw(events).write.parquet(paths["flights"])
    write_csv(fixtures.aircraft_map(events), paths["register"], compression="gzip")
    write_csv(fixtures.emission_sheet(events), paths["curve"])
    spark.range(1).select(F.lit(fixtures.airport_document()).alias("value")).write.text(paths["airports"])
    return paths


def test_batch_job(spark, small, tmp_path):
    paths = landed(spark, small, tmp_path)
    raw, tables, settings = batch.open_inputs(spark, **paths, settings=Settings())
    assert tables.curve.rows == 54 and tables.airports.rows == 4
    assert 30 <= settings.day_bound <= 34
    out = str(tmp_path / "out")
    batch.run(raw, tables, settings, out)

    a = analysis(spark, small, one_day=True)
    read = spark.read.parquet
    assert read(f"{out}/flights").count() == 31
    assert rows(rounded(read(f"{out}/emissions"))) == rows(rounded(a.minute_totals))
    planes = read(f"{out}/planes")
    assert planes.count() == 29 * 1441
    assert planes.filter("in_air").count() == a.minute_totals.agg(F.sum("planes_in_air")).first()[0]
    assert read(f"{out}/snapshots").select("t_s").distinct().count() == 286
    assert read(f"{out}/damages").count() == 3 * 286
    assert spark.read.json(f"{out}/numbers").first().t_local == "2024-01-03 00:00:00"
    assert spark.read.json(f"{out}/totals").count() == 7
    assert spark.read.json(f"{out}/rates").count() == 3
    assert read(f"{out}/peaks").count() == 29
    assert read(f"{out}/passengers").first().passenger_flights == 7
    whole = analysis(spark, small)
    assert rows(read(f"{out}/audit/hours")) == rows(coverage.coverage_cells(coverage.hourly_coverage(whole.flights, whole.settings)))
    assert rows(read(f"{out}/audit/routes")) == rows(clean.route_list(whole.route_flights))
    assert read(f"{out}/audit/extent").count() == 1


def test_register_and_curve_files(spark, small, tmp_path):
    paths = landed(spark, small, tmp_path)
    events = fixtures.events(spark, small)
    assert rows(read_aircraft_map(spark, paths["register"])) == rows(fixtures.aircraft_map(events))
    assert rows(rounded(read_curve(spark, paths["curve"]))) == rows(rounded(fixtures.emission_curve(spark)))


def test_landing_twice_changes_nothing_and_bad_lines_are_counted(spark, tmp_path):
    from tripmesh.config import Settings
    from tripmesh.sources import landing

    lines = [
        '{"icao24": "a", "firstSeen": 1709557260, "lastSeen": 1709560860, "estArrivalAirport": "YSSY", "callsign": "QF1"}',
        '{"icao24": "a", "firstSeen": 1709557260, "lastSeen": 1709560860, "estArrivalAirport": "YSSY", "callsign": "QF1"}',
        '{"icao24": "b", "firstSeen": 1709657260, "lastSeen": 1709660860}',
        '{"icao24": "c", "firstSeen": 1709657260}',
        '{"icao24": "d", "firstSeen": "soon"}',
        "no record",
    ]
    path, rejects = str(tmp_path / "days"), str(tmp_path / "rejects")
    (tmp_path / "one.json").write_text("\n".join(lines))
    (tmp_path / "two.json").write_text("\n".join([lines[2], lines[0].replace("QF1", "QF2")]))
    (tmp_path / "none.json").write_text("")

    def landed():
        return rows(landing.read_landed(spark, path), "icao24", "callsign", "lastSeen", "arrival_day")

    def again(name):
        return landing.land(spark, str(tmp_path / name), path, rejects, Settings())

    assert again("one.json") == landing.Landed(rejected=2, fresh=3, days=3)
    first = landed()
    assert [r[0] for r in first] == ["a", "b", "c"] and first[2][3] is None
    assert again("one.json") == landing.Landed(rejected=2, fresh=0, days=3)
    assert landed() == first
    assert again("two.json") == landing.Landed(rejected=0, fresh=1, days=2)
    assert len(landed()) == 4 and set(first) < set(landed())
    assert again("none.json") == landing.Landed(0, 0, 0)
    days = [d for _, _, _, d in first[:1]]
    plan = landing.on_days(landing.read_landed(spark, path), days)._jdf.queryExecution().executedPlan().toString()
    assert "arrival_day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_one_day_reads_the_partition_of_that_day(spark, small, tmp_path):
    from tripmesh.plans.catalogue import analysis
    from tripmesh.plans.compose import Analysis
    from tripmesh.sources import landing

    a, path = analysis(spark, small), str(tmp_path / "days")
    landing.with_day(a.raw.selectExpr("*", *[f"cast(null AS {f.dataType.simpleString()}) AS {f.name}" for f in landing.RECORD.fields[5:]]), a.settings).write.partitionBy("arrival_day").parquet(path)
    landed = Analysis(landing.read_landed(spark, path), a.tables, a.settings, one_day=True)
    assert rows(landed.flights) == rows(analysis(spark, small, one_day=True).flights)
    plan = landed.flights._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "arrival_day" in line.split("PartitionFilters")[1].split("]")[0]]
    assert filters and "lastSeen" in plan.split("PushedFilters")[1]
