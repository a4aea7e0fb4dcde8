from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyscope import Session


def ties(spark, n=457, name="ties"):
    random.seed(1)
    rows = [
        (random.choice([None, 1, 2, 3]), random.choice([None, "x", "y"]), random.random() if i % 5 else None,
         dt.datetime(2020, 1, 1 + i % 28), float("nan") if i % 9 == 0 else float(i % 4))
        for i in range(n)
    ]
    rows += [(1, "x", 0.5, dt.datetime(2020, 1, 1), 1.0)] * 30
    df = spark.createDataFrame(rows, "k int, s string, r double, t timestamp_ntz, x double")
    return Session.of(spark, df.repartition(5), name)


def order(rows, sorts):
    """Brute force: stable sorts from the last key to the first, NULLs last, NaN above numbers."""

    def key(v):
        return (1, 0) if isinstance(v, float) and v != v else (0, v)

    names = [c for c in ("k", "s", "r", "t", "x") if c in sorts]
    names += [c for c in ("k", "s", "r", "t", "x") if c not in sorts]
    for c in reversed(names):
        down = sorts.get(c) == "desc"
        some = sorted((r for r in rows if r[c] is not None), key=lambda r: key(r[c]), reverse=down)
        rows = some + [r for r in rows if r[c] is None]
    return rows


def text(rows):
    return [repr(tuple(r)[:5]) for r in rows]


@pytest.mark.parametrize("sorts", [{"k": "asc"}, {"s": "desc", "k": "desc"}, {"x": "desc"}, {"t": "asc", "r": "desc"}])
def test_pages_and_seeks_and_numbers_agree(spark, sorts):
    s = ties(spark)
    for c, d in reversed(sorts.items()):
        s = s.sort(c, d)
    expected = text(order(s.base.collect(), sorts))

    pages = list(s.pages(100))
    assert [len(p.rows) for p in pages] == [100, 100, 100, 100, 87]
    assert [p.first for p in pages] == [0, 100, 200, 300, 400]
    assert [p.last for p in pages] == [False] * 4 + [True]
    assert text(r for p in pages for r in p.rows) == expected
    assert text(s.page(2).collect()) == expected[200:300]
    assert text(s.page(4).collect()) == expected[400:]

    numbered = s.numbered().collect()
    assert sorted(r["row"] for r in numbered) == list(range(487))
    assert text(sorted(numbered, key=lambda r: r["row"])) == expected
    one = s.numbered_page(3).collect()
    assert text(sorted(one, key=lambda r: r["row"])) == expected[300:400]
    assert sorted(r["row"] for r in one) == list(range(300, 400))


@pytest.mark.parametrize("sorts", [{"k": "asc"}, {"s": "desc"}, {"x": "desc", "r": "asc"}])
def test_seeking_walks_all_rows(spark, sorts):
    s = ties(spark, name="seek")
    s = Session.of(spark, s.base.union(s.base).union(s.base.where("r > 0.9")).cache(), "seek")
    for c, d in sorts.items():
        s = s.sort(c, d)
    expected = text(order(s.base.collect(), sorts))
    found, page, given = [], s.page(0, 120).collect(), []
    while page:
        found += text(page)
        given += page
        page = s.page_after(page[-1], 120, sum(repr(r) == repr(page[-1]) for r in given)).collect()
    assert found == expected
    assert text(r for p in s.pages(50) for r in p.rows) == expected


def test_pages_of_one_row_many_times(spark):
    s = Session.of(spark, spark.range(1000).selectExpr("id % 2 AS k"), "few").sort("k", "asc")
    assert [r["k"] for p in s.pages() for r in p.rows] == [0] * 500 + [1] * 500


def test_seeking_by_timestamp_on_a_driver_outside_utc(spark, monkeypatch):
    import time

    df = spark.range(60).selectExpr("timestamp_micros(1704067200000000 + id * 3600000000) AS t", "id")
    s = Session.of(spark, df, "zones").sort("t", "asc")
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        last = s.page(0, 10).tail(1)[0]
        assert [r["id"] for r in s.page_after(last, 10).collect()] == list(range(10, 20))
    finally:
        monkeypatch.undo()
        time.tzset()


def test_sort_keys_follow_the_schema_not_the_clicks(spark):
    s = ties(spark, 20, "clicks").sort("t", "asc").sort("k", "desc")
    assert s.sql().endswith("ORDER BY `k` DESC NULLS LAST, `t` ASC NULLS LAST")
    assert s.sort("k", None).sql().endswith("ORDER BY `t` ASC NULLS LAST")
    assert "ORDER BY" not in s.sort("k", None).sort("t", None).sql()
    with pytest.raises(ValueError):
        s.sort("k", "up")


@pytest.mark.parametrize(("n", "sizes"), [(250, [100, 100, 50]), (200, [100, 100]), (0, [0]), (1, [1])])
def test_last_page(spark, n, sizes):
    s = Session.of(spark, spark.range(n).toDF("id"), "paged").sort("id", "desc")
    pages = list(s.pages())
    assert [len(p.rows) for p in pages] == sizes
    assert [p.last for p in pages] == [False] * (len(sizes) - 1) + [True]


def test_unsorted_pages_keep_the_order_of_the_table(spark):
    s = Session.of(spark, spark.range(0, 250, 1, 3).toDF("id"), "natural")
    assert [r.id for r in s.page(1).collect()] == list(range(100, 200))
    assert [r.id for p in s.pages() for r in p.rows] == list(range(250))


def test_numbering_runs_no_job_before_an_action(spark, monkeypatch):
    rng = random.Random(7)
    values = [None, float("nan"), -0.0, 0.0, 1.5, -2.0]
    rows = [(rng.choice(values), rng.choice(["", "b", None, "é"]), i % 97) for i in range(3000)]
    s = Session.of(spark, spark.createDataFrame(rows, "x double, `s p` string, i int").repartition(7), "lazy")
    state = s.sort("x", "desc").sort("i", "asc")
    spark.sparkContext.setJobGroup("numbering", "")
    numbered = state.numbered("row")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("numbering")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    ordered = [tuple(map(repr, r)) for r in state.page(0, 3000).collect()]
    plain = lambda r: tuple(repr(0.0 if x == 0 else x) for x in r)
    found = sorted(numbered.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in found] == list(range(3000))
    assert [plain(r[:3]) for r in found] == [plain(r) for r in state.page(0, 3000).collect()] and len(ordered) == 3000
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" in plan  # of the sums over one row a range
    for n in (0, 1, 3):
        few = Session.of(spark, spark.range(n).toDF("id"), "few").sort("id", "desc").numbered("row")
        assert sorted((r.id, r.row) for r in few.collect()) == [(i, n - 1 - i) for i in range(n)]
    monkeypatch.setattr("tallyscope.operators.rows.THINNED", 1)  # a bound at nearly every row
    again = sorted(state.numbered("row").collect(), key=lambda r: r["row"])
    assert [plain(r) for r in again] == [plain(r) for r in found]


def test_numbering_of_equal_rows(spark):
    s = Session.of(spark, spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END k"), "same")
    numbered = s.sort("k", "asc").numbered()
    assert numbered.selectExpr("min(row)", "max(row)", "count(DISTINCT row)").head()[0:3] == (0, 19_999, 20_000)
    assert numbered.where("k = 0").selectExpr("max(row)").head()[0] == numbered.where("k = 0").count() - 1


def test_maps_and_arrays_in_the_order(spark):
    df = spark.sql("SELECT id % 2 AS k, map('a', id) AS m, array(id) AS a FROM range(10)")
    s = Session.of(spark, df, "nested_order").sort("k", "asc")
    assert s.numbered().count() == 10
    assert len(s.page(0, 4).collect()) == 4
    whole = [str(r) for r in s.page(0, 10).collect()]
    assert [str(r) for r in s.page_after(s.page(0, 4).tail(1)[0], 6).collect()] == whole[4:]


@pytest.mark.parametrize("sorts", [{}, {"a": "desc"}, {"s": "asc", "m": "desc"}])
def test_seeks_by_arrays_structs_and_maps(spark, sorts):
    df = spark.sql(
        "SELECT CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array(id % 4, IF(id % 3 = 0, NULL, double('NaN'))) END AS a, "
        "named_struct('odd `name', concat('it''s ', id % 3), 't', timestamp_micros(id % 2), 'in', array(named_struct('x', IF(id % 2 = 0, NULL, id)))) AS s, "
        "map('k', id % 3, 'z', NULL) AS m, X'00FF' AS b FROM range(60)"
    )
    state = Session.of(spark, df, "seek_nested")
    for c, d in sorts.items():
        state = state.sort(c, d)
    whole = [str(r) for r in state.page(0, 60).collect()]
    assert len(whole) == 60
    assert [str(r) for p in state.pages(9) for r in p.rows] == whole


def test_bounds_of_row_numbers_are_no_column(spark):
    """As a column, all bounds are copied for each row."""
    numbered = ties(spark, name="ties_bounds").sort("k", "desc").sort("s", "asc").numbered("row")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" in plan and "bounds#" not in plan


def test_pages_beyond_the_sought_ones_are_sorted_once(spark, monkeypatch):
    import tallyscope.operators.rows as module

    seeks = []
    sought = module.rows_after
    monkeypatch.setattr(module, "rows_after", lambda *a: seeks.append(1) or sought(*a))
    s = ties(spark, name="ties_many").sort("k", "desc").sort("x", "asc")
    pages = list(s.pages(9))
    assert len(seeks) <= module.SOUGHT
    expected = text(order(s.base.collect(), {"k": "desc", "x": "asc"}))
    assert text(r for p in pages for r in p.rows) == expected
    assert [(p.first, len(p.rows), p.last) for p in pages] == [(i, min(9, 487 - i), i == 486) for i in range(0, 487, 9)]
    # copies on both sides of the place where the seeks end
    same = Session.of(spark, spark.sql("SELECT id DIV 60 AS k FROM range(120)"), "same_many").sort("k", "asc")
    assert [r.k for p in same.pages(6) for r in p.rows] == [0] * 60 + [1] * 60


def test_ends_of_pages(spark):
    from pyspark.sql import functions as F

    s = ties(spark, name="ties_ends").sort("k", "desc")
    for size in (9, 487, 500):
        ends = sorted(tuple(r) for r in s.page_ends(size, F.count("k").alias("ks")).collect())
        pages = [(p.first, len(p.rows), p.last, sum(r.k is not None for r in p.rows)) for p in s.pages(size)]
        assert ends == pages
