"""Every registered query that has SQL against it."""

import pytest

from __spark_entry__ import MORE, entry, oracle_sql, queries
from check import compare, connect
from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_of_the_analysis_has_sql():
    assert queries().keys() - MORE.keys() <= oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = queries()[name](spark, SMALL).toPandas()
    assert compare(ours, duck.execute(oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry(spark).count() == 625
