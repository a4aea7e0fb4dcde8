from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tallyscope import Session
from tallyscope.functions.bins import DateBins, NumberBins, date_bins, number_bins


@pytest.mark.parametrize(
    ("lo", "hi", "step"),
    [(1, 50, 5.0), (0, 1, 0.1), (-994.28, 9997.41, 1000.0), (900, 999.9, 10.0), (0, 0.08, 0.005),
     (1, 7, 0.5), (0, 18, 1.0), (0, 1e300, 1e299)],
)
def test_number_step(lo, hi, step):
    assert number_bins(float(lo), float(hi)) == NumberBins(step)


@given(st.floats(-1e12, 1e12), st.floats(1e-6, 1e12))
@settings(max_examples=300, deadline=None)
def test_number_step_is_nice_and_small_enough(lo, span):
    hi = lo + span
    if hi == lo:
        return
    rule = number_bins(lo, hi)
    assert (hi - lo) / rule.step <= 18 * (1 + 1e-9)
    lead = rule.step / 10 ** math.floor(math.log10(rule.step) + 1e-9)
    assert any(math.isclose(lead, n, rel_tol=1e-9) for n in (1, 2, 5, 10))


def test_degenerate_extents():
    assert number_bins(None, None) == NumberBins(1.0)
    assert number_bins(7.25, 7.25) == NumberBins(1.0, 7.25)
    assert number_bins(-1.7e308, 1.7e308).step == 2e307
    assert number_bins(0.0, 5e-324).step == 5e-324
    assert date_bins(None, None) == DateBins(micros=1000)


S = 1_000_000
DAY = 86_400 * S


@pytest.mark.parametrize(
    ("span", "rule"),
    [
        (31 * DAY, DateBins(micros=2 * DAY)),
        (2404 * DAY, DateBins(months=3)),
        (24 * 3600 * S, DateBins(micros=3600 * S)),
        (18 * 60 * S, DateBins(micros=60 * S)),
        (18 * S, DateBins(micros=S)),
        (9_000, DateBins(micros=1000)),
        (36_000, DateBins(micros=2000)),
        (540 * DAY, DateBins(months=1)),
        (18 * 365 * DAY, DateBins(months=12)),
        (180 * 365 * DAY, DateBins(months=120)),
        (3000 * 365 * DAY, DateBins(months=2400)),
    ],
)
def test_date_step(span, rule):
    assert date_bins(0, span) == rule


NUMS = [
    (1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, -0.0), (6, 0.0),
    (7, 1e-5), (8, 1e10), (9, 5e9), (10, None),
]


def test_edge_numbers_have_bins_of_their_own(spark):
    s = Session.of(spark, spark.createDataFrame(NUMS, "id bigint, x double"), "nums_edge")
    rows = {(r.kind, r.x1): r.n for r in s.histogram("x").collect()}
    assert rows == {
        ("null", None): 2, ("nonfinite", None): 3, ("value", 0.0): 3,
        ("value", 5e9): 1, ("value", 1e10): 1,
    }


def test_constant_column_has_one_bin(spark):
    s = Session.of(spark, spark.createDataFrame([(3.5,)] * 4, "x double"), "nums_const")
    rows = s.histogram("x").where("kind = 'value'").collect()
    assert [(r.x1, r.x2, r.n) for r in rows] == [(3.5, 4.5, 4)]


def test_all_null_and_empty_tables(spark):
    s = Session.of(spark, spark.createDataFrame([(None,)] * 3, "x double"), "nums_all_null")
    assert [tuple(r) for r in s.histogram("x").collect()] == [("null", None, None, 3)]
    empty = Session.of(spark, spark.createDataFrame([], "id bigint, x double, s string"), "empty")
    assert [tuple(r) for r in empty.histogram("x").collect()] == [("null", None, None, 0)]
    assert empty.value_counts("s").collect() == []
    assert empty.status().head().label == "0 rows"
    assert {r.kind for r in empty.profile().collect()} == {"null"}


def test_every_number_type(spark):
    df = spark.createDataFrame(
        [(-128, -32768, -(2**31), -(2**63), "-9999999999.99"), (127, 32767, 2**31 - 1, 2**63 - 1, "1.5")],
        "b byte, h short, i int, l bigint, t string",
    ).selectExpr("b", "h", "i", "l", "CAST(t AS DECIMAL(18,2)) AS d", "CAST(b AS FLOAT) AS f")
    s = Session.of(spark, df, "ints_wide")
    for c in df.columns:
        rows = s.histogram(c).collect()
        assert sum(r.n for r in rows) == 2
        assert sum(r.n for r in rows if r.kind == "value") == 2


def _brute(value: dt.datetime, rule: DateBins) -> dt.datetime:
    if rule.months:
        month = (value.year * 12 + value.month - 1) // rule.months * rule.months
        return dt.datetime(month // 12, month % 12 + 1, 1)
    micros = (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros // rule.micros * rule.micros)


@pytest.mark.parametrize("days", [0.00001, 0.01, 0.5, 3, 40, 900, 9000, 60000])
def test_date_bins_against_brute_force(spark, days):
    random.seed(int(days * 1000))
    start = dt.datetime(1960, 2, 29, 23, 59, 59, 999_000)
    values = [start + dt.timedelta(days=random.random() * days) for _ in range(200)] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "n timestamp_ntz")
    s = Session.of(spark, df, "dates")
    rule = s.bins("n")["n"]
    expected: dict = {}
    for v in values:
        key = None if v is None else _brute(v, rule)
        expected[key] = expected.get(key, 0) + 1
    assert {r.x1: r.n for r in s.histogram("n").collect()} == expected


def test_dates_do_not_depend_on_the_session_time_zone(spark):
    df = spark.sql(
        "SELECT timestamp_seconds(1577836799 + id * 3600) AS t, "
        "timestampadd(HOUR, CAST(id AS INT), timestamp_ntz'2019-12-31 23:59:59') AS n, "
        "date_add(date'2019-12-31', CAST(id AS INT)) AS d FROM range(60)"
    )

    def look():
        s = Session.of(spark, df, "zones")
        return [sorted(map(str, s.histogram(c).collect())) for c in ("t", "n", "d")]

    utc = look()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert look() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc[0] == utc[1]


def test_bins_are_fixed_by_the_unfiltered_table(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x", "id % 10 AS k")
    s = Session.of(spark, df, "fixed")
    edges = {(r.x1, r.x2) for r in s.histogram("x").where("kind = 'value'").collect()}
    some = s.where_range("k", 0, 3).histogram("x").where("kind = 'value'").collect()
    assert {(r.x1, r.x2) for r in some} <= edges
    assert sum(r.n for r in some) == 400


def test_exact_index_follows_the_edges(spark):
    rule = NumberBins(0.1)
    edges = [rule.edge(k) for k in range(-60, 60)]
    near = [(k, x) for k, x in zip(range(-60, 60), edges)]
    near += [(k - 1, math.nextafter(x, -math.inf)) for k, x in zip(range(-60, 60), edges)]
    df = spark.createDataFrame(near, "k int, x double")
    sql = rule.index_sql("x", T.DoubleType(), exact=True)
    assert df.where(f"{sql} <> k").count() == 0
