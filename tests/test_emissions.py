import pytest
from dataclasses import replace

from helpers import CURVE_ROWS, SETTINGS, UNMEASURED, curve_row, flights, rounded, rows, tables
from tripmesh.config import POLLUTANTS
from tripmesh.operators import emissions
from tripmesh.operators.lookup import Lookup

REGISTER = [("a", "B1"), ("b", "B2"), ("c", "B3"), ("d", None), ("f", "B1"), ("f", "B2")]


def bracketed(spark, minutes, settings=SETTINGS, curve=CURVE_ROWS):
    legs = [("a", 600, 600 + m, "YMML", "YSSY") for m in minutes]
    t = tables(spark, REGISTER, curve)
    typed = emissions.aircraft_type_join(flights(spark, *legs), t.register, settings)
    named = emissions.aircraft_id_join(typed, t.curve, settings)
    return named, t, emissions.ccd_bracket(named, t.curve, settings)


def test_bracket_and_interpolation(spark):
    _, _, found = bracketed(spark, [30, 60, 75, 120, 150])
    values = emissions.ccd_interpolate(found)
    assert rows(values, "duration_s", "ref_hi_s", "ref_lo_s", "factor", "co2_ccd", "pm_total_ccd") == [
        (1800, 3600, None, None, None, None),  # below the curve: no extrapolation
        (3600, 3600, 3600, 0.0, 100.0, 108.0),  # exact hit on the first point
        (4500, 7200, 3600, 0.75, 150.0, 158.0),
        (7200, 7200, 7200, 0.0, 300.0, 308.0),  # exact hit on the last point
        (9000, None, 7200, None, None, None),  # above
    ]


def test_bracket_equals_group_first(spark):
    minutes = [1, 30, 59, 60, 61, 75, 119, 120, 121, 500]
    named, t, found = bracketed(spark, minutes)
    other = emissions.ccd_bracket_groupfirst(named, t.curve, SETTINGS)
    assert rows(found.select(*other.columns)) == rows(other)


def test_ties_pick_the_same_row_on_both_sides(spark):
    tied = CURVE_ROWS + [curve_row("B4", "X1", "CCD", 3600, 90.0)]
    _, _, found = bracketed(spark, [60, 75], curve=tied)
    assert rows(found, "duration_s", "co2_hi", "co2_lo") == [(3600, 90.0, 90.0), (4500, 300.0, 90.0)]


def test_lto_row_with_a_duration_may_bracket_unless_a_phase_is_set(spark):
    curve = CURVE_ROWS + [curve_row("B1", "X1", "LTO", 1200, 10.0)]
    assert rows(bracketed(spark, [30], curve=curve)[2], "ref_hi_s", "ref_lo_s") == [(3600, 1200)]
    only_ccd = replace(SETTINGS, bracket_phase="CCD")
    assert rows(bracketed(spark, [30], only_ccd, curve)[2], "ref_hi_s", "ref_lo_s") == [(3600, None)]


LEGS = [
    ("a", 600, 675, "YMML", "YSSY"),
    ("b", 610, 670, "YMML", "YSSY"),  # no LTO row
    ("c", 620, 690, "YSSY", "YSCB"),  # no CCD row
    ("d", 630, 700, "YMML", "YSCB"),  # type unknown
    ("e", 640, 700, "YSCB", "YMML"),  # not registered
]


def test_gaps_get_the_mean_of_the_day(spark):
    t = tables(spark, REGISTER)
    next_day = ("a", 1500, 1560, "YMML", "YSSY")
    filled = emissions.flight_emissions(flights(spark, *LEGS, next_day), t, SETTINGS)
    # a: LTO rows of B1 and B4 share X1, so it comes twice
    assert rows(filled, "day", "icao24", "co2_lto", "co2_ccd")[:6] == [
        (d, v, lto, pytest.approx(ccd))
        for d in [filled.selectExpr("min(day)").first()[0]]
        for v, lto, ccd in [
            ("a", 10.0, 150.0),
            ("a", 30.0, 150.0),
            ("b", 20.0, 50.0),
            ("c", 20.0, 350 / 3),
            ("d", 20.0, 350 / 3),
            ("e", 20.0, 350 / 3),
        ]
    ]
    assert rows(filled.filter("dep_s > 1709640000"), "co2_lto", "co2_ccd") == [(10.0, 100.0), (30.0, 100.0)]


def test_duplicate_register_rows_fan_out_unless_deduped(spark):
    t = tables(spark, REGISTER)
    leg = flights(spark, ("f", 600, 660, "YMML", "YSSY"))
    assert len(rows(emissions.matched_flights(leg, t, SETTINGS))) == 3
    one = emissions.matched_flights(leg, t, replace(SETTINGS, dedupe=True))
    assert rows(one, "typecode", "aircraft_id", "co2_lto") == [("B1", "X1", 10.0)]


def test_empty_curve_leaves_everything_null_and_sums_to_zero(spark):
    t = tables(spark, REGISTER, curve=[])
    filled = emissions.flight_emissions(flights(spark, *LEGS), t, SETTINGS)
    assert rows(filled, "icao24", "co2_lto", "h2o_ccd") == [(v, None, None) for v in "abcde"]
    assert rows(emissions.daily_totals(filled), "co2", "pm_total") == [(0.0, 0.0)]


def test_shuffled_lookups_give_the_same_rows(spark):
    """Unmeasured lookups go through the bucketed shuffle join, with a hot vehicle."""
    hot = [("a", 600 + i, 680 + i, "YMML", "YSSY") for i in range(200)]
    leg = flights(spark, *LEGS, *hot)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    expected = rows(rounded(emissions.flight_emissions(leg, tables(spark, REGISTER), SETTINGS)))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set(adaptive, "-1")
        shuffled = emissions.flight_emissions(leg, tables(spark, REGISTER, measured=False), UNMEASURED)
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert rows(rounded(shuffled)) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset(adaptive)


def test_bucketed_join_spreads_a_hot_key(spark):
    from pyspark.sql import functions as F
    from tripmesh.operators.lookup import Lookup, attach

    facts = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', string(id)) AS k")
    lookup = Lookup(spark.sql("SELECT 'hot' AS k, 1 AS v UNION ALL SELECT '7', 2"))
    settings = replace(UNMEASURED, salts=8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = attach(facts, lookup, ["k"], settings)
        hot = joined.filter("v = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(hot) > 1 and sum(r[1] for r in hot) == 334
        assert joined.count() == 1000 and joined.filter("v = 2").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_register_is_gated_by_bytes_and_only_hot_vehicles_are_spread(spark):
    from dataclasses import replace

    from tripmesh.operators import emissions
    from tripmesh.operators.lookup import Lookup

    register = spark.range(600_000).selectExpr("concat('v', id) AS icao24", "concat('t', id % 40) AS typecode")
    facts = spark.range(4000).selectExpr("if(id % 3 = 0, 'v7', if(id % 50 = 1, null, concat('v', id * 151))) AS icao24", "id AS dep_s")
    small = Lookup.measured(register)
    assert small.fits(SETTINGS) and small.with_hot_keys(facts, "icao24", SETTINGS).hot is None
    large = replace(SETTINGS, broadcast_bytes=1 << 20)
    measured = small.with_hot_keys(facts, "icao24", large)
    assert measured.hot == ("v7",)
    plain = replace(measured, hot=())

    def joined(lookup, settings):
        return emissions.aircraft_type_join(facts, lookup, settings)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    want = sorted(map(str, joined(small, SETTINGS).collect()))
    assert "strategy=broadcast" in plan(joined(small, SETTINGS))
    assert sorted(map(str, joined(measured, large).collect())) == want and "xxhash64" in plan(joined(measured, large))
    assert sorted(map(str, joined(plain, large).collect())) == want and "xxhash64" not in plan(joined(plain, large))


MERGED = replace(SETTINGS, broadcast_bytes=0, bracket_range_s=600)


def test_merge_equals_range_join_on_a_long_curve(spark):
    """10,000 points of one aircraft id; flights below, above, on and between them, and one that a third share."""
    curve = [*CURVE_ROWS, curve_row("B9", "X9", "LTO", None, 1.0)]
    t = tables(spark, [*REGISTER, ("g", "B9")], curve)
    long = spark.range(10_000).selectExpr("'B9' AS typecode", "'X9' AS aircraft_id", "'CCD' AS phase", "100 + 7 * id AS ref_s", *[f"id * 1D + {k} AS {p}" for k, p in enumerate(POLLUTANTS)])
    points = t.curve.df.unionByName(long.select(*t.curve.df.columns))
    asked = spark.sql("""
        SELECT id, nullif(element_at(array('X9', 'X1', 'X2', 'X3', '?'), int(id % 5) + 1), '?') AS aircraft_id,
               if(id % 3 = 0, 4500, if(id % 97 = 1, NULL, id * 37)) AS duration_s FROM range(3000)
    """)
    measured = Lookup.measured(points)
    broadcast = emissions.ccd_bracket(asked, measured, SETTINGS)
    merged = emissions.ccd_bracket(asked, measured, MERGED)
    assert rows(merged) == rows(broadcast) and merged.columns == broadcast.columns
    assert rows(merged.where("ref_hi_s = ref_lo_s").limit(1), "aircraft_id") and rows(merged.where("ref_hi_s IS NULL AND ref_lo_s > 60000").limit(1), "id")
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("<" not in line and ">=" not in line for line in joins), joins


def test_emissions_by_merge(spark):
    leg = flights(spark, *LEGS, *[("a", 600 + i, 680 + i, "YMML", "YSSY") for i in range(200)])
    t = tables(spark, REGISTER)
    want = rows(rounded(emissions.flight_emissions(leg, t, SETTINGS)))
    assert rows(rounded(emissions.flight_emissions(leg, t, replace(MERGED, salts=3)))) == want


def test_merge_on_few_points_and_empty_tables(spark):
    minutes = [1, 30, 59, 60, 61, 75, 119, 120, 121, 500]
    named, t, found = bracketed(spark, minutes)
    assert rows(emissions.ccd_bracket_merge(named, t.curve, MERGED)) == rows(found)
    bare = Lookup(t.curve.df.limit(0))
    assert rows(emissions.ccd_bracket_merge(named, bare, MERGED), "ref_hi_s", "co2_lo") == [(None, None)] * named.count()
    assert rows(emissions.ccd_bracket_merge(named.limit(0), t.curve, MERGED)) == []
