"""Registered queries equal their SQL on the smallest tables."""

import pytest
from check_oracle import compare, connect

from fieldpulse.plans.oracle import ORACLE
from fieldpulse.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLE[name]) is None
