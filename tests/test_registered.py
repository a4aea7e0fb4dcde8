"""Every registered query against its checking SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    found = contract.queries()[name](spark, FOLDER).toArrow()
    check = contract.oracle_sql().get(name)
    if check is None:
        assert found.num_rows >= 0
        return
    expected = duck.sql(check).to_arrow_table()
    assert differences(found, expected) is None


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns[:4] == ["pos", "column", "type_name", "role"]
    assert result.count() > 0
