"""Answers must not depend on the session zone, the partition count or the join strategy."""

import pytest

from helpers import rounded, rows
from tripmesh.plans.catalogue import QUERIES

NAMES = (
    "flight_emissions",
    "first_departures",
    "flights_on_date",
    "final_totals",
    "overlap_windows",
    "ccd_bracket",
    "coverage_pivot",
    "cumulative_emissions",
    "emissions_timeline",
    "sampled_positions",
    "minute_snapshots",
    "peak_positions",
)


@pytest.fixture(scope="module")
def expected(spark):
    from conftest import SMALL

    return {n: rows(QUERIES[n](spark, SMALL)) for n in NAMES}


@pytest.mark.parametrize("zone, parts", [("UTC", "1"), ("Australia/Sydney", "7"), ("America/New_York", "64")])
def test_zone_and_partitions(spark, small, expected, zone, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for name in NAMES:
            again = spark.newSession()
            for k, v in (("spark.sql.session.timeZone", zone), ("spark.sql.shuffle.partitions", parts)):
                again.conf.set(k, v)
            assert rows(QUERIES[name](again, small)) == expected[name], name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_unmeasured_lookups_give_the_same_totals(spark, small):
    from dataclasses import replace

    from tripmesh.operators import damages, sampling
    from tripmesh.operators.emissions import Tables
    from tripmesh.operators.lookup import Lookup
    from tripmesh.plans.catalogue import analysis
    from tripmesh.plans.compose import Analysis

    a = analysis(spark, small)
    loose = Tables(*[Lookup(t.df) for t in (a.tables.register, a.tables.curve, a.tables.airports)])
    settings = replace(a.settings, day_bound=None, broadcast_rows=0, salts=3)
    other = Analysis(a.raw, loose, settings)

    def last(x):
        return rows(rounded(damages.damages(sampling.final_record(x.minute_totals)), 4))

    assert last(other) == last(a)


def test_plan_with_every_lookup_shuffled_leaves_the_optimizer(spark, small):
    import time
    from dataclasses import replace

    from tripmesh.operators.emissions import Tables
    from tripmesh.operators.lookup import Lookup
    from tripmesh.plans.catalogue import analysis
    from tripmesh.plans.compose import Analysis

    a = analysis(spark, small)
    loose = Tables(*[Lookup(t.df) for t in (a.tables.register, a.tables.curve, a.tables.airports)])
    other = Analysis(a.raw, loose, replace(a.settings, day_bound=None, broadcast_rows=0))
    start = time.time()
    for df in (other.emissions, other.minute_totals, other.placed_emissions):
        df._jdf.queryExecution().optimizedPlan()
    assert time.time() - start < 30
