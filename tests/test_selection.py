from __future__ import annotations

import datetime as dt
import itertools
from collections import Counter

import pytest

from tallyscope import Between, IsNull, OccursOnce, Selection, Session, ValueIs


@pytest.fixture(scope="module")
def s(spark):
    rows = [
        (i, None if i % 7 == 0 else f"s{i % 4}", i % 10 / 2 if i % 11 else None,
         dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), i % 3 == 0)
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "id int, s string, x double, t timestamp_ntz, f boolean")
    return Session.of(spark, df, "crossed")


CLAUSES = {
    "s": (ValueIs("s", "s1"), lambda r: r.s == "s1"),
    "x": (Between("x", 1.0, 3.0), lambda r: r.x is not None and 1 <= r.x <= 3),
    "t": (
        Between("t", dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 6), include_hi=False),
        lambda r: dt.datetime(2020, 1, 2) <= r.t < dt.datetime(2020, 1, 6),
    ),
    "f": (ValueIs("f", "true"), lambda r: r.f is True),
}


@pytest.mark.parametrize("chosen", [c for n in range(4) for c in itertools.combinations("sxtf", n)])
def test_each_view_skips_its_own_clause(s, chosen):
    rows = s.base.collect()
    state = s
    for c in chosen:
        state = state.where(CLAUSES[c][0])

    def kept(view):
        tests = [CLAUSES[c][1] for c in chosen if c != view]
        return sum(all(t(r) for t in tests) for r in rows)

    assert state.count().head()[0] == kept(None)
    assert state.data().count() == kept(None)
    assert sum(r.total for r in state.value_counts("s").collect()) == kept("s")
    assert sum(r.n for r in state.histogram("x").collect()) == kept("x")
    compared = state.histogram_compare("t").collect()
    assert sum(r.f for r in compared) == kept("t")
    assert sum(r.n for r in compared) == len(rows)
    profile = state.profile().groupBy("column").sum("total", "filtered").collect()
    assert {r[0]: (r[1], r[2]) for r in profile} == {
        c: (len(rows), kept(c)) for c in s.columns
    }


def test_null_and_unique_clauses(spark, s):
    assert s.where_null("s").count().head()[0] == sum(1 for i in range(200) if i % 7 == 0)
    assert s.where_unique("id").count().head()[0] == 200
    assert s.where_unique("s").count().head()[0] == 0
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 2)], "v string, k int")
    u = Session.of(spark, df, "uniques").where_unique("v")
    assert {r.v for r in u.data().collect()} == {"b", "c"}
    assert [r.v for r in u.where_value("k", "1").data().collect()] == ["b"]
    two = u.where_unique("k")
    assert two.data().count() == 0
    # the value counts of the column itself skip the clause
    assert {(r.kind, r.key, r.total) for r in u.value_counts("v").collect()} == {
        ("value", "a", 2), ("unique", None, 2), ("null", None, 1),
    }


def test_state_is_immutable_and_toggles(s):
    a = ValueIs("s", "s1")
    one = s.toggle(a)
    assert s.selection == Selection() and one.selection.clauses == {"s": a}
    assert one.toggle(a).selection == Selection()
    assert one.toggle(ValueIs("s", "s2")).selection.clauses["s"].key == "s2"
    assert one.where_null("x").clear("s").selection.clauses == {"x": IsNull("x")}
    assert one.where_null("x").clear().selection == Selection()
    with pytest.raises(ValueError):
        s.where_value("nope", "1")


def test_range_leaves_out_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    t = Session.of(spark, df, "ranges")
    assert t.where_range("x", 1.0, 2.0).count().head()[0] == 2
    assert t.where_range("x", 1.0, float("inf")).count().head()[0] == 3


def test_keys_that_are_not_the_text_of_a_value_match_nothing(spark):
    df = spark.createDataFrame([(7,), (70,)], "i int")
    t = Session.of(spark, df, "ints")
    assert t.where_value("i", "7").count().head()[0] == 1
    for key in ("07", "7.0", " 7", "x", "99999999999999999999"):
        assert t.where_value("i", key).count().head()[0] == 0


def test_plain_clauses_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "CAST(id % 5 AS STRING) s", "id % 2 = 0 f", "id x").write.parquet(path)
    t = Session.of_file(spark, path, table="pushed")
    t = t.where_value("s", "1").where_range("id", 10, 20).where_value("f", "true").where_value("x", "16")
    plan = t.count()._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("EqualTo(s,1)", "GreaterThanOrEqual(id,10)", "LessThanOrEqual(id,20)", "EqualTo(x,16)"):
        assert part in pushed
    assert "ReadSchema: struct<id:bigint,s:string,f:boolean,x:bigint>" in plan


def test_sql_of_a_clause():
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a`b", T.StringType())])
    assert ValueIs("a`b", "it's \\ ${x}").sql(schema) == "`a``b` = 'it\\'s \\\\ \\u0024{x}'"
    assert "HAVING count(*) = 1" in OccursOnce("a`b").sql(schema, "`t`")


def test_many_frequent_values_are_combined_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 60_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('lone value of many letters ', id) "
        "ELSE concat('one of 200 ', id % 200) END v",
        "id % 2 AS k", "concat('other ', id % 7) AS w", "map('a', id) AS m", "id AS `odd name`",
    ).write.parquet(path)
    t = Session.of_file(spark, path, table="hot_rows").where_unique("v")
    rows = t.base.collect()
    n = Counter(r.v for r in rows)
    once = sorted(r["odd name"] for r in rows if n[r.v] == 1)
    assert t.count().head()[0] == len(once) == 20_000
    found = t.data()
    assert found.columns == ["v", "k", "w", "m", "odd name"] and found.schema["m"].dataType == t.base.schema["m"].dataType
    assert sorted(r["odd name"] for r in found.collect()) == once
    some = t.where_value("k", "1").where_range("odd name", 100, 5000)
    assert {r["odd name"] for r in some.data().collect()} == {r["odd name"] for r in rows if n[r.v] == 1 and r.k == 1 and 100 <= r["odd name"] <= 5000}
    compared = t.value_counts_compare("w").collect()
    assert sum(r.total for r in compared) == 60_000 and sum(r.filtered for r in compared) == len(once)
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("FileScan") == 1 and "Join" not in final and "partial_any_value" in final.replace("partial_first", "partial_any_value")
    # of 400 frequent values no more than one row a task is shuffled: the tasks after it get even shares
    counts = t.count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "odd name" not in plan[plan.index("ReadSchema") :].split("\n")[0]


def test_two_clauses_on_what_occurs_once(spark):
    rows = [("a", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("d", "u"), (None, "v"), ("e", None), ("f", "w" * 40), ("g" * 40, "w" * 40), ("h" * 40, "q")]
    t = Session.of(spark, spark.createDataFrame(rows, "v string, w string"), "two").where_unique("v").where_unique("w")
    n, m = Counter(v for v, _ in rows), Counter(w for _, w in rows)
    both = [(v, w) for v, w in rows if v and w and n[v] == 1 and m[w] == 1]
    assert sorted(map(tuple, t.data().collect())) == sorted(both)
    assert t.count().head()[0] == len(both)
    # each view skips its own clause
    seen = {(r.kind, r.key): (r.total, r.filtered) for r in t.value_counts_compare("v").collect()}
    assert seen["value", "d"] == (2, 2) and seen["null", None] == (1, 1)
    assert seen["unique", None] == (7, sum(1 for v, w in rows if v and n[v] == 1 and w and m[w] == 1))
