from __future__ import annotations

from collections import Counter

import pytest

from tallyscope import Session
from tallyscope.operators.categories import bar_totals, category_label


def counted(df) -> dict:
    return {(r.kind, r.key): r.total for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = ["a", "a", "a", "b", "b", "c", "d", None, None, ""]
    return Session.of(spark, spark.createDataFrame([(r,) for r in rows], "s string"), "mixed")


def test_nulls_and_singles(mixed):
    # the empty string is a value like any other; here it occurs once
    assert counted(mixed.value_counts("s")) == {
        ("value", "a"): 3, ("value", "b"): 2, ("unique", None): 3, ("null", None): 2,
    }


def test_one_null_row_is_not_a_single(spark):
    s = Session.of(spark, spark.createDataFrame([(None,), ("x",)], "s string"), "one_null")
    assert counted(s.value_counts("s")) == {("null", None): 1, ("unique", None): 1}


def test_values_spelled_like_markers_stay_values(spark):
    rows = ["null", "null", "unique", "unique", "rest", None, "value", "x"]
    s = Session.of(spark, spark.createDataFrame([(r,) for r in rows], "s string"), "markers")
    assert counted(s.value_counts("s")) == {
        ("value", "null"): 2, ("value", "unique"): 2, ("unique", None): 3, ("null", None): 1,
    }


def test_bar_totals_and_label(mixed):
    counts = mixed.value_counts("s")
    assert tuple(bar_totals(counts).head()) == (2, 2, 3, 10)
    assert tuple(category_label(counts).head()) == (4, 5, "4 categories")


def many(spark):
    rows = [f"v{i:02d}" for i in range(30) for _ in range(max(1, 30 - i // 2 * 2))]
    rows += [None] * 3 + ["once1", "once2"]
    return rows, Session.of(spark, spark.createDataFrame([(r,) for r in rows], "s string"), "many")


@pytest.mark.parametrize("top", [1, 5, 20, 29, 30, 40])
def test_top_and_rest(spark, top):
    rows, s = many(spark)
    counts = Counter(r for r in rows if r is not None)
    values = sorted(((-n, v) for v, n in counts.items() if n > 1))
    singles = sum(1 for n in counts.values() if n == 1)
    expected = {("value", i + 1, v): (1, -n) for i, (n, v) in enumerate(values[:top])}
    if len(values) > top:
        expected["rest", None, None] = (len(values) - top, -sum(n for n, _ in values[top:]))
    expected["unique", None, None] = (singles, singles)
    expected["null", None, None] = (1, 3)
    found = {(r.kind, r["rank"], r.key): (r.n_values, r.total) for r in s.top_values("s", top).collect()}
    assert found == expected


def test_top_without_nulls_or_rest(spark):
    s = Session.of(spark, spark.createDataFrame([("a",), ("a",)], "s string"), "short")
    assert [tuple(r) for r in s.top_values("s").collect()] == [("value", 1, "a", 1, 2, 2)]


def test_singles_are_decided_after_the_filter_or_on_the_baseline(spark):
    rows = [("shrinks", k) for k in range(10)] + [("stays", 0)] * 3 + [("alone", 0)]
    s = Session.of(spark, spark.createDataFrame(rows, "s string, k int"), "shrink")
    some = s.where_range("k", 0, 0)
    assert counted(some.value_counts("s")) == {("value", "stays"): 3, ("unique", None): 2}
    compared = {(r.kind, r.key): (r.total, r.filtered) for r in some.value_counts_compare("s").collect()}
    assert compared == {
        ("value", "shrinks"): (10, 1), ("value", "stays"): (3, 3), ("unique", None): (1, 1),
    }


def test_booleans(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (False,), (None,)], "f boolean")
    assert counted(Session.of(spark, df, "bools").value_counts("f")) == {
        ("value", "true"): 2, ("value", "false"): 2, ("null", None): 1,
    }


def test_nested_values_are_counted_by_their_json(spark):
    df = spark.sql(
        "SELECT array(1, 2) a, named_struct('x', 1) s, map('k', 1) m, X'00FF' b FROM range(2)"
    )
    s = Session.of(spark, df, "nested")
    keys = {c: s.value_counts(c).head().key for c in df.columns}
    assert keys == {"a": "[1,2]", "s": '{"x":1}', "m": '{"k":1}', "b": "00FF"}


def long_texts(spark):
    """Values of `many`, each long enough to be counted by digest first, with short ones beside them."""
    rows, s = many(spark)
    return Session.of(spark, s.base.selectExpr("CASE WHEN hash(s) % 4 = 0 THEN s ELSE concat(s, repeat('é', 30)) END AS s", "hash(s) % 3 = 0 AS k"), "many_long")


def brute(rows):
    n = Counter(rows)
    out = {("value", v): k for v, k in n.items() if v is not None and k > 1}
    lone = sum(1 for v, k in n.items() if v is not None and k == 1)
    return out | ({("unique", None): lone} if lone else {}) | ({("null", None): n[None]} if n[None] else {})


def test_long_texts_are_counted_as_short_ones(spark, monkeypatch):
    s = long_texts(spark)
    rows = s.base.collect()
    want = brute([r.s for r in rows])
    assert counted(s.value_counts("s")) == want
    few = s.where_value("k", "true")
    assert counted(few.value_counts("s")) == brute([r.s for r in rows if r.k])
    top = {(r.kind, r.key): (r.total, r.filtered) for r in few.top_values("s", 100).collect()}
    assert {k: v[0] for k, v in top.items()} == want
    # few bits, so that texts seen once pass the bitmap; and digests that collide
    monkeypatch.setattr("tallyscope.operators.seen.BITS", 2)
    assert counted(s.value_counts("s")) == want
    monkeypatch.setattr("tallyscope.operators.seen.BITS", 1 << 25)
    for module in ("seen", "selection"):
        monkeypatch.setattr(f"tallyscope.operators.{module}.DIGEST", "concat(repeat('0', 31), substring(md5({0}), 1, 1))")
    assert counted(s.value_counts("s")) == want


def test_no_rows_only_nulls_only_repeats(spark):
    long = "x" * 50
    for rows in ([("a",), ("a",)], [], [(None,)], [(long,)], [(long,), (long,)]):
        s = Session.of(spark, spark.createDataFrame(rows, "s string"), "few")
        assert counted(s.value_counts("s")) == brute([r for (r,) in rows])
        assert {(r.kind, r.key): r.total for r in s.top_values("s").collect()} == brute([r for (r,) in rows])


def test_baseline_is_asked_once_and_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    path = str(tmp_path / "t.parquet")
    spark.range(1000).selectExpr("id", "id % 7 k", "concat('value ', id % 5) s", "concat(repeat('long ', 9), id % 400) u").write.parquet(path)
    s = Session.of_file(spark, path, table="clicks")
    first = s.where_range("id", 10, 600)
    for view in ("status", "s", "u", "k"):
        ask = (lambda x: x.status()) if view == "status" else (lambda x: x.histogram_compare("k")) if view == "k" else (lambda x: x.value_counts_compare(view))
        fresh = lambda x: ask(Session(x.base, "fresh", selection=x.selection))
        for state in (first, s.where_range("id", 500, 505), s, s.where_range("id", 10, 700).where_value("k", "3"), s.where_unique("u")):
            got = ask(state)
            assert sorted(map(str, got.collect())) == sorted(map(str, fresh(state).collect()))
        plan = ask(s.where_range("id", 20, 30))
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(id,20)" in text and "InMemory" in text, text
    state = s.where_range("id", 100, 200)
    assert sorted(map(str, state.profile().collect())) == sorted(map(str, Session(s.base, "fresh", selection=state.selection).profile().collect()))
    s.close()
    assert s.status().head().label == "1,000 rows"


def test_one_hot_value(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END s")
    s = Session.of(spark, df, "hot")
    expected = {("value", "hot"): 10_000, ("unique", None): 20_000}
    assert counted(s.value_counts("s")) == expected
    assert s.where_unique("s").count().head()[0] == 20_000
