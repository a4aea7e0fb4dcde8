from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyscope import Between, IsNull, Session, ValueIs
from tallyscope.operators.extent import column_overview
from tallyscope.operators.histogram import bins_compared
from tallyscope.operators.seen import seen_values


@pytest.fixture(scope="module")
def s(spark):
    df = spark.range(5000).selectExpr(
        "CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id % 97 AS DOUBLE) END AS x",
        "CASE WHEN id % 17 = 0 THEN double('NaN') ELSE id * 0.1D END AS y",
        "CAST(id AS INT) AS `odd name.x`",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 40) END AS `q``t`",
        "CAST(id AS STRING) AS u",
        "id % 3 = 0 AS f",
        "timestampadd(HOUR, CAST(id AS INT), timestamp_ntz'2020-01-01 00:00:00') AS t",
        "array(id % 2) AS a",
    )
    return Session.of(spark, df, "wide")


def shape(rows):
    return {(r.kind, r.x1, r.x2, r.n) for r in rows}


def test_profile_equals_the_single_views(s):
    state = s.where_range("x", 5.0, 60.0).where_value("f", "false").where_value("q`t", None)
    rows = state.profile().collect()
    assert {r.column for r in rows} == set(s.columns)
    for c in s.columns:
        mine = [r for r in rows if r.column == c]
        if mine[0].role == "category":
            found = {(r.kind, r["rank"], r.key, r.n_values, r.total, r.filtered) for r in mine}
            assert found == {tuple(r) for r in state.top_values(c).collect()}
        else:
            lo, hi = ("t1", "t2") if mine[0].role == "date" else ("x1", "x2")
            found = {(r.kind, r[lo], r[hi], r.total, r.filtered) for r in mine}
            assert found == {tuple(r) for r in state.histogram_compare(c).collect()}
    assert {r.column: r.role for r in rows} == {r.column: r.role for r in s.roles().collect()}


def test_sums_are_whole(s):
    state = s.where_range("x", 5.0, 60.0)
    left = state.count().head()[0]
    for r in state.profile().groupBy("column").agg(F.sum("total"), F.sum("filtered")).collect():
        assert r[1] == 5000
        assert r[2] == (left if r[0] != "x" else 5000)
    assert sum(r.total for r in s.value_counts("u").collect()) == 5000
    bins = {r.kind: r.n for r in s.histogram("y").where("kind <> 'value'").collect()}
    assert bins == {"null": 0, "nonfinite": 295}


def test_profile_in_batches_gives_the_same_rows(s, monkeypatch):
    from tallyscope.operators import longform

    whole = {tuple(r) for r in s.where_value("f", "true").profile().collect()}
    monkeypatch.setattr(longform, "BATCH", 2)
    assert {tuple(r) for r in s.where_value("f", "true").profile().collect()} == whole


def test_profile_of_chosen_columns(s):
    rows = s.profile(["u", "x"]).collect()
    assert {(r.pos, r.column) for r in rows} == {(0, "u"), (1, "x")}
    assert [(r.kind, r.total) for r in rows if r.column == "u"] == [("unique", 5000)]


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("== Initial Plan ==")]


def test_category_columns_take_two_scans_however_many_have_long_texts(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    path = str(tmp_path / "t.parquet")
    long = [f"concat(repeat('long text ', 5), id % {n}) AS u{n}" for n in (3, 500, 1000)]
    spark.range(1000).selectExpr("id", "id % 7 k", "CAST(id % 5 AS STRING) s", *long).write.parquet(path)
    state = Session.of_file(spark, path, table="scans").where_range("id", 10, 500)
    columns = {p: c for p, c in enumerate(state.columns) if c not in ("id", "k")}
    final = final_plan(seen_values(state.base, columns, state.selection))
    assert final.count("FileScan") == 2
    assert "ReusedExchange" in final and "BroadcastHashJoin" in final
    assert "CartesianProduct" not in final and "NestedLoop" not in final
    # no long text comes twice: the second scan is left out
    final = final_plan(seen_values(state.base, {0: "s", 1: "u1000"}))
    assert final.count("FileScan") == 1
    # the bins of all other columns are one scan more
    bins = state.bins()
    counted = bins_compared(state.base, {0: "id", 1: "k"}, bins, state.selection, state._baseline)
    counted.collect()
    assert "ReadSchema: struct<id:bigint,k:bigint>" in counted._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in state.profile()._jdf.queryExecution().executedPlan().toString()


def test_overview(s):
    rows = {r.column: r for r in column_overview(s.base).collect()}
    assert [rows["x"][c] for c in ("n_rows", "n_null", "n_nonfinite", "lo", "hi")] == [5000, 385, 0, 0.0, 96.0]
    assert rows["y"].n_nonfinite == 295 and rows["y"].hi == 4999 * 0.1
    assert rows["t"].t_lo == dt.datetime(2020, 1, 1) and rows["t"].lo is None
    assert rows["q`t"].n_null == 1000


def test_extents_are_measured_once(s, monkeypatch):
    from tallyscope.plans import session as module

    state = Session(s.base, "again")
    calls = []
    real = module.extents
    monkeypatch.setattr(module, "extents", lambda df, cols: calls.append(cols) or real(df, cols))
    state.histogram("x")
    other = state.where_value("f", "true")
    other.histogram("x")
    other.bins("x", "t")
    other.where_range("x", 1, 2).profile()
    assert calls == [["x"], ["t"], ["y", "odd name.x"]]


# -- cube --------------------------------------------------------------------


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize(
    ("active", "clause"),
    [
        ("x", None),
        ("x", Between("x", 10.0, 30.0, include_hi=False)),
        ("x", Between("x", -5, 40, include_hi=False)),
        ("x", Between("x", 50.0, 96.0)),
        ("x", Between("x", 50.0, 1000.0)),
        ("x", IsNull("x")),
        ("y", Between("y", 50.0, 200.0, include_hi=False)),
        ("f", ValueIs("f", "true")),
        ("q`t", ValueIs("q`t", "k7")),
        ("q`t", IsNull("q`t")),
        ("t", Between("t", dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 7))),
        ("odd name.x", Between("odd name.x", 500, 2500, include_hi=False)),
    ],
)
def test_cube_equals_direct_queries(s, active, clause):
    state = s.where_range("odd name.x", 100, 4000) if active != "odd name.x" else s
    cube = state.cube(active, [c for c in ("x", "y", "f", "u", "q`t", "t") if c != active])
    direct = state.where(clause) if clause else state
    if not cube.answers(clause):
        # the range does not follow the bins: asked directly instead
        assert active == "t"
        with pytest.raises(ValueError):
            cube.histogram("x", clause)
        return
    for c in ("x", "y", "t"):
        if c != active:
            assert same(cube.histogram(c, clause), direct.histogram(c))
    for c in ("f", "u", "q`t"):
        if c != active:
            assert same(cube.value_counts(c, clause), direct.value_counts(c))
    whole = cube.refresh(clause).collect()
    for c in cube.targets.values():
        mine = [r for r in whole if r.column == c]
        if c in ("f", "u", "q`t"):
            found = {(r.kind, r.key, r.total) for r in mine}
            assert found == {tuple(r) for r in direct.value_counts(c).collect()}
        else:
            found = {(r.kind, *((r.t1, r.t2) if c == "t" else (r.x1, r.x2)), r.total) for r in mine}
            assert found == {tuple(r) for r in direct.histogram(c).collect()}
    cube.close()


def test_cube_of_a_near_unique_target_has_few_rows_and_a_brush_no_shuffle_of_cells(s):
    cube = s.cube("x", ["u", "y", "q`t"])
    assert cube._listed.where("pos = 0").count() == 1  # u: all its values are single
    clause = Between("x", 10.0, 30.0, include_hi=False)
    assert same(cube.value_counts("u", clause), s.where(clause).value_counts("u"))
    plan = cube.histogram("y", clause)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    outside = text[: text.index("InMemoryRelation")] if "InMemoryRelation" in text else text
    assert outside.count("Exchange") <= 2  # of the bins, at most as many rows as there are bins
    cube.close()
    assert not cube._listed.is_cached


def test_cube_over_date_bins(s):
    rule = s.bins("t")["t"]
    start = dt.datetime(1970, 1, 1)
    width = dt.timedelta(microseconds=rule.micros)
    lo = start + width * ((dt.datetime(2020, 2, 1) - start) // width)
    clause = Between("t", lo, lo + 3 * width, include_hi=False)
    cube = s.cube("t", ["x", "u"])
    assert cube.answers(clause)
    assert same(cube.histogram("x", clause), s.where(clause).histogram("x"))
    assert not cube.answers(Between("t", lo, lo + 3 * width))
    assert not cube.answers(Between("t", lo + dt.timedelta(microseconds=1), lo + 3 * width, False))
    with pytest.raises(ValueError):
        cube.histogram("y")


def test_cube_refuses_what_its_bins_cannot_tell(s):
    cube = s.cube("x", ["f"])
    assert not cube.answers(Between("x", 10.0, 30.0))
    assert not cube.answers(Between("x", 10.5, 30.0, include_hi=False))
    assert not cube.answers(ValueIs("x", "10.0"))
    assert not cube.answers(ValueIs("f", "true"))
