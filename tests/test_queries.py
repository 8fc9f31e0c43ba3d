"""Named queries against their SQL on the small tables.

The reports, streams and headline queries run by default and reach most operators;
TICKLOOM_ALL=1 runs every query (about a quarter of an hour).
"""

import os

import pytest

import __spark_entry__ as entry
from bench import HEADLINE
from check import compare, connect
from tests.conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()
ALL = os.environ.get("TICKLOOM_ALL") == "1"
SAME = {"X1_arrow_pricing_udf", "X2_grouped_episode_fold", "X3_stateful_features"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", [
    n for n in QUERIES if n not in SAME and (ALL or n in HEADLINE or n[0] in "CT")])
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMALL, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
