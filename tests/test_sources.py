from __future__ import annotations

import datetime as dt
import decimal
import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tallyscope import Session, preview
from tallyscope.sources import sinks
from tallyscope.sources.arrow_files import read_arrow_result, write_arrow
from tallyscope.sources.files import open_file, read_arrow_files, resolve_format
from tallyscope.sources.tables import column_names, from_data, read_query, register

ROWS = pa.table({"a": [1, 2, 3], "b": ["x", None, 'quo"te, and\ttab'], "c": [1.5, 2.5, -3.0]})


def same(df, expected=ROWS):
    found = df.toArrow().select(expected.column_names)
    assert sorted(map(str, found.to_pylist())) == sorted(map(str, expected.to_pylist()))


@pytest.mark.parametrize(
    ("path", "fmt", "found"),
    [("x.parquet", None, "parquet"), ("x.pq", None, "parquet"), ("a/b.c/x.csv", None, "csv"),
     ("x.TSV", None, "tsv"), ("s3a://b/x.json", None, "json"), ("https://h/x.parquet?version=2", None, "parquet"),
     ("x.dat", "csv", "csv"), ("x.json", "tsv", "tsv"), ("x.arrow", None, "arrow")],
)
def test_format(path, fmt, found):
    assert resolve_format(path, fmt) == found


@pytest.mark.parametrize(("path", "fmt"), [("x.xyz", None), ("csv", None), ("x", None), ("x.csv", "xlsx"), ("", None)])
def test_unknown_formats_are_refused(path, fmt):
    with pytest.raises(ValueError):
        resolve_format(path, fmt)


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Session.of_file(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "pq", "csv", "tsv", "json"])
def test_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    sinks.write(spark.createDataFrame(ROWS), path, "parquet" if fmt == "pq" else fmt)
    s = Session.of_file(spark, path, table=f"t_{fmt}")
    same(s.data())
    assert s.base.storageLevel.useMemory == (fmt in ("csv", "tsv", "json"))
    same(read_query(spark, s.export_sql().split(";\n")[-1]))
    s.base.unpersist()


def test_export_sql_runs_without_the_session(spark, tmp_path):
    path = str(tmp_path / "it's.tsv")
    sinks.write(spark.createDataFrame(ROWS), path, "tsv")
    s = Session.of_file(spark, path, table="gone", keep=False).where_range("a", 2, 3)
    text = s.export_sql()
    spark.catalog.dropTempView("gone")
    for statement in text.split(";\n"):
        last = spark.sql(statement)
    same(last, ROWS.slice(1))
    parquet = str(tmp_path / "t.parquet")
    sinks.write(spark.createDataFrame(ROWS), parquet)
    s = Session.of_file(spark, parquet, table="gone").where_unique("b")
    text = s.export_sql()
    spark.catalog.dropTempView("gone")
    assert f"FROM parquet.`{parquet}`" in text
    same(spark.sql(text), ROWS.take([0, 2]))


def test_json_lines_and_arrays(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "array.json").write_text(" \n" + json.dumps(records, indent=1))
    for name in ("lines", "array"):
        s = Session.of_file(spark, str(tmp_path / f"{name}.json"), table=name, keep=False)
        assert s.columns == ["a", "b"]
        assert sorted(r.a for r in s.data().collect()) == [1, 2]


def test_explicit_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n007,1\n008,2\n")
    s = Session.of_file(spark, str(tmp_path / "t.csv"), schema="a string, b double", keep=False)
    assert [tuple(r) for r in s.data().collect()] == [("007", 1.0), ("008", 2.0)]


def write_ipc(path, table):
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, max_chunksize=2)


def test_arrow_files(spark, tmp_path):
    folder = tmp_path / "files.arrow"
    folder.mkdir()
    for i in range(4):
        write_ipc(folder / f"{i}.arrow", ROWS)
    s = Session.of_file(spark, str(folder))
    same(s.data(), pa.concat_tables([ROWS] * 4))
    assert {r.key: r.total for r in s.value_counts("b").collect() if r.key} == {"x": 4, 'quo"te, and\ttab': 4}


def test_arrow_files_of_another_schema_or_kind_fail(spark, tmp_path):
    write_ipc(tmp_path / "0.arrow", ROWS)
    write_ipc(tmp_path / "1.arrow", pa.table({"z": [1]}))
    with pytest.raises(Exception, match="differ in schema"):
        Session.of_file(spark, str(tmp_path), fmt="arrow").data().collect()
    (tmp_path / "bad.feather").write_bytes(b"not arrow at all")
    with pytest.raises(Exception, match="not an Arrow IPC file"):
        Session.of_file(spark, str(tmp_path / "bad.feather"))


class Stream:
    def __arrow_c_stream__(self, requested_schema=None):
        return ROWS.__arrow_c_stream__(requested_schema)


class Protocol:
    """Only the dataframe protocol, with a direct way to Arrow."""

    def __init__(self, direct):
        if direct:
            self.to_arrow = lambda: ROWS

    def __dataframe__(self, nan_as_null=False, allow_copy=True):
        return ROWS.__dataframe__(nan_as_null, allow_copy)


def ipc_bytes():
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, ROWS.schema) as w:
        w.write_table(ROWS)
    return sink.getvalue().to_pybytes()


@pytest.mark.parametrize(
    "data",
    [ROWS, Stream(), ipc_bytes(), memoryview(ipc_bytes()), Protocol(True), Protocol(False),
     ROWS.to_pandas()],
    ids=["arrow", "stream", "ipc", "ipc view", "protocol direct", "protocol", "pandas"],
)
def test_in_memory_data(spark, data):
    same(from_data(spark, data))


def every_arrow_type():
    day, at = dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3, 4)
    return pa.table({
        "u8": pa.array([255, None], pa.uint8()),
        "u16": pa.array([65535, None], pa.uint16()),
        "u32": pa.array([2**32 - 1, None], pa.uint32()),
        "u64": pa.array([2**64 - 1, None], pa.uint64()),
        "f16": pa.array([1.5, None], pa.float32()).cast(pa.float16()),
        "dict": pa.array(["a", None]).dictionary_encode(),
        "ree": pc.run_end_encode(pa.array([7, 7])),
        "large": pa.array(["b", None], pa.large_string()),
        "view": pa.array(["c", None], pa.string_view()),
        "fixed": pa.array([b"xy", None], pa.binary(2)),
        "d64": pa.array([day, None], pa.date64()),
        "t32": pa.array([dt.time(1, 2, 3), None], pa.time32("s")),
        "t64": pa.array([dt.time(1, 2, 3, 4), None], pa.time64("ns")),
        "ns": pa.array([at, None], pa.timestamp("ns")),
        "tz": pa.array([at, None], pa.timestamp("ms", "UTC")),
        "dur": pa.array([dt.timedelta(seconds=1.5), None], pa.duration("ms")),
        "ll": pa.array([[1, 2], None], pa.large_list(pa.uint8())),
        "fl": pa.array([[1.0, 2.0], None], pa.list_(pa.float64(), 2)),
        "st": pa.array([{"a": 1, "b": "x"}, None], pa.struct([("a", pa.uint8()), ("b", pa.large_string())])),
        "map": pa.array([[("k", 1)], None], pa.map_(pa.string(), pa.int32())),
        "dec": pa.array([decimal.Decimal("1.25"), None], pa.decimal256(12, 2)),
        "nul": pa.nulls(2),
    })


def test_every_arrow_type(spark, tmp_path):
    table = every_arrow_type()
    write_ipc(tmp_path / "all.arrow", table)
    frames = [from_data(spark, table), Session.of_file(spark, str(tmp_path / "all.arrow")).data()]
    for df in frames:
        names = {r.column: r.type_name for r in Session.of(spark, df, "arrow_types").roles().collect()}
        assert names == {
            "u8": "int16", "u16": "int32", "u32": "int64", "u64": "decimal(20, 0)", "f16": "float32",
            "dict": "utf8", "ree": "int64", "large": "utf8", "view": "utf8", "fixed": "binary",
            "d64": "date[day]", "t32": "int64", "t64": "int64", "ns": "timestamp",
            "tz": "timestamp[tz=UTC]", "dur": "duration[µs]", "ll": "list[int16]", "fl": "list[float64]",
            "st": "struct<a: int16, b: utf8>", "map": "map<struct<key: utf8, value: int32>>",
            "dec": "decimal(12, 2)", "nul": "null",
        }
        shown = preview(df).collect()
        assert list(shown[0]) == [
            "255", "65,535", "4,294,967,295", "18,446,744,073,709,551,615", "1.5", "a", "7", "b", "c",
            "b'xy'", "2024-02-29", "3,723,000,000", "3,723,000,004", "2024-02-29T01:02:03.000004",
            "2024-02-29T01:02:03", "PT1.5S", "[1, 2]", "[1, 2]", '{"a":1,"b":"x"}', '{"k":1}', "1.25", "null",
        ]
        assert set(shown[1]) == {"null", "7"}
        assert Session.of(spark, df, "arrow_types").profile().where("total IS NULL").count() == 0


def test_polars(spark):
    polars = pytest.importorskip("polars")
    same(from_data(spark, polars.from_arrow(ROWS)))


def test_other_data_is_refused(spark):
    for data in (b"PAR1....", [1, 2], "text", 5):
        with pytest.raises(ValueError):
            from_data(spark, data)


def test_spark_frames_pass_through_and_names_are_replaced(spark):
    df = spark.range(3).toDF("a")
    assert from_data(spark, df) is df
    register(df, "named")
    register(spark.range(5).toDF("b"), "named")
    assert column_names(spark, "named") == ["b"]
    assert Session.of_table(spark, "named").count().head()[0] == 5


def test_catalog_tables(spark):
    sinks.execute(spark, "CREATE DATABASE IF NOT EXISTS other")
    sinks.save_table(spark.range(4).toDF("a"), "other.kept")
    sinks.save_table(spark.range(7).toDF("z"), "kept")
    s = Session.of_table(spark, "other.kept").where_range("a", 1, 2)
    assert s.columns == ["a"] and s.data().count() == 2
    assert spark.sql(s.sql()).count() == 2
    sinks.execute(spark, "DROP TABLE kept")
    sinks.execute(spark, "DROP TABLE other.kept")


def test_small_results(spark):
    df = spark.createDataFrame(ROWS)
    assert sinks.to_arrow(df).num_rows == 3
    same(from_data(spark, sinks.to_ipc(df)))
    assert sorted(r["a"] for r in sinks.json_records(df)) == [1, 2, 3]
    assert {"a": 2, "b": None, "c": 2.5} in list(sinks.json_records(df))


# -- SQL text ----------------------------------------------------------------


def odd(spark):
    df = spark.createDataFrame(
        [(1, "it's", 1.5, "u"), (2, "b\\s", float("nan"), "v"), (2, "${env:HOME}", 3e9, "v"), (None, None, -0.0, "w\n%")],
        "`a b` int, `x.y` string, `q\"z` double, `t``k` string",
    ).selectExpr(
        "*", "date_add(date'2020-01-01', `a b`) AS d", "CAST(`a b` AS DECIMAL(20,2)) AS n",
        "timestamp_seconds(`a b` * 1000000) AS ts", "timestamp_ntz'2020-01-01 00:00:00.5' AS tn", "`a b` = 1 AS f",
        "CAST(`x.y` AS BINARY) AS bin", "array(`a b`) AS arr",
    )
    return Session.of(spark, df, "odd")


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s,
        lambda s: s.where_value("x.y", "it's"),
        lambda s: s.where_value("x.y", "b\\s"),
        lambda s: s.where_value("x.y", "${env:HOME}"),
        lambda s: s.where_value("t`k", "w\n%"),
        lambda s: s.where_value("x.y", None).sort("a b", "desc"),
        lambda s: s.where_range('q"z', float("-inf"), 2.0),
        lambda s: s.where_range('q"z', 1.0, float("nan")),
        lambda s: s.where_range('q"z', 1e9, 1e10, include_hi=False),
        lambda s: s.where_range("d", dt.date(2020, 1, 2), dt.date(2020, 1, 2)),
        lambda s: s.where_range("ts", dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 15)),
        lambda s: s.where_range("ts", dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.date(1970, 1, 14)),
        lambda s: s.where_range("tn", dt.datetime(2020, 1, 1, 0, 0, 0, 500000), dt.datetime(2021, 1, 1)),
        lambda s: s.where_range("n", decimal.Decimal("1.5"), decimal.Decimal("2.00")),
        lambda s: s.where_range("a b", -(2**40), 2**70),
        lambda s: s.where_value("f", "true"),
        lambda s: s.where_value("bin", "69742773"),
        lambda s: s.where_value("arr", "[2]").sort("arr", "asc"),
        lambda s: s.where_value("d", "2020-01-03"),
        lambda s: s.where_unique("t`k").where_unique("a b").sort("x.y", "asc").sort("a b", "desc"),
    ],
)
def test_sql_text_gives_the_same_rows(spark, change):
    s = change(odd(spark))
    a, b = s.data(), spark.sql(s.sql())
    # a row carried along by an aggregate is nullable to Spark; names and types are the same
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    if not s.selection.once():
        assert a.schema == b.schema
    assert [str(r) for r in a.collect()] == [str(r) for r in b.collect()] or not s.sorts
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_filters_keep_something(spark):
    s = odd(spark)
    assert s.where_value("x.y", "${env:HOME}").data().count() == 1
    assert s.where_value("bin", "69742773").data().count() == 1
    assert s.where_unique("t`k").where_unique("a b").data().count() == 1
    assert s.where_range("ts", dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 15)).data().count() == 1


def test_chosen_columns(spark):
    s = Session.of(spark, odd(spark).base, "subset", columns=["t`k", "a b"])
    assert s.columns == ["t`k", "a b"]
    assert s.sql() == "SELECT `t``k`, `a b` FROM `subset`"
    assert spark.sql(s.sql()).columns == s.columns


def test_checkpoint_folder_comes_from_the_session(spark):
    from tallyscope.sources.scratch import ensure_checkpoint_dir, scratch_path

    named = spark.conf.get("spark.checkpoint.dir")
    assert named in ensure_checkpoint_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_json_folder_of_lines_and_arrays_loses_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[\n{"a": 3},\n{"a": 4}\n]\n')
    df, _ = open_file(spark, str(tmp_path), fmt="json", keep=False)
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3, 4]


def test_bad_records_and_other_headers_raise(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": oops}\n')
    with pytest.raises(Exception):
        open_file(spark, str(tmp_path / "bad.json"), schema="a bigint", keep=False)[0].collect()
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "1.csv").write_text("x,y\n1,2\n")
    (folder / "2.csv").write_text("y,x\n9,8\n")
    with pytest.raises(Exception):
        open_file(spark, str(folder), fmt="csv", schema="x bigint, y bigint", keep=False)[0].collect()


def test_csv_without_a_header_keeps_its_first_record(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1;2\n3;4\n")
    df, _ = open_file(spark, str(tmp_path / "n.csv"), keep=False, header=False, sep=";")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)]


def arrow_file(path, table, rows_a_batch):
    with pa.ipc.new_file(str(path), table.schema) as writer:
        writer.write_table(table, max_chunksize=rows_a_batch)


def test_arrow_files_are_decoded_by_record_batch(spark, tmp_path):
    folder = tmp_path / "odd name %20 #x"
    folder.mkdir()
    for i in range(3):
        arrow_file(folder / f"f{i}.arrow", pa.table({"a": list(range(i * 100, i * 100 + 100)), "b": ["x", None] * 50}), 7)
    arrow_file(folder / "none.arrow", pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.string())}), 7)
    df = read_arrow_files(spark, str(folder))
    assert sorted(r.a for r in df.collect()) == list(range(300))
    assert df.where("b IS NULL").count() == 150
    # 45 batches of 3 files are dealt out, not the files
    tasks = df.selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow_file(folder / "z.arrow", pa.table({"a": [1.5], "b": ["x"]}), 7)
    with pytest.raises(Exception, match="differ in schema"):
        read_arrow_files(spark, str(folder)).collect()


def test_arrow_results_are_what_the_manifest_lists(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('é', id) END AS `odd name`", "timestamp_micros(id * 1000001) AS t",
        "array(id, NULL) AS a", "named_struct('x', id % 2 = 0, 'd', CAST(id AS DECIMAL(20, 3))) AS s",
    )
    path = str(tmp_path / "result")
    write_arrow(df.where("id < 900"), path)  # the last task has no rows in its second half
    (tmp_path / "result" / "data" / "part-00000-of-a-failed-try.arrow").write_bytes(b"half a file")
    back = read_arrow_result(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.where("id < 900").collect()))
    write_arrow(df.where("false"), str(tmp_path / "empty"))
    assert read_arrow_result(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(ValueError):
        write_arrow(df, "viewfs://store/x")


def test_sessions_have_names_of_their_own_and_can_be_closed(spark, tmp_path):
    a = Session.of(spark, spark.range(3).toDF("x"))
    b = Session.of_query(spark, "SELECT 7 AS y")
    assert a.table != b.table
    assert spark.sql(a.sql()).count() == 3 and spark.sql(b.sql()).head().y == 7
    (tmp_path / "t.csv").write_text("1;x\n2;y\n")
    c = Session.of_file(spark, str(tmp_path / "t.csv"), header=False, sep=";", columns=["_c1"])
    assert [r[0] for r in c.data().collect()] == ["x", "y"]
    assert c._kept.is_cached
    c.close()
    assert not c._kept.is_cached


def test_exports_keep_the_schema_that_was_given(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b c\n01,2\n")
    s = Session.of_file(spark, str(tmp_path / "t.csv"), schema="a string, `b c` double", keep=False)
    *views, last = s.export_sql().split(";\n")
    for view in views:
        spark.sql(view)
    assert [tuple(r) for r in spark.sql(last).collect()] == [tuple(r) for r in s.data().collect()] == [("01", 2.0)]


def test_instants_are_written_in_utc_in_any_zone(spark):
    df = spark.sql("SELECT id, timestamp_micros(id * 3600000000) AS t, array(timestamp_micros(id)) AS l, map('k', timestamp_micros(id)) AS m, "
                   "named_struct('t', timestamp_micros(id)) AS s FROM range(3)")
    shown = [tuple(r) for r in preview(df).collect()]
    keys = [r.key for r in Session.of(spark, df.union(df)).value_counts("s").collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        again = Session.of(spark, df.union(df))
        assert [tuple(r) for r in preview(df).collect()] == shown
        assert sorted(r.key for r in again.value_counts("s").collect()) == sorted(keys)
        assert again.where_value("t", None).count().head()[0] == 0
        assert sorted(r.key for r in Session.of(spark, df.selectExpr("CAST(t AS STRING) AS z", "t").union(df.selectExpr("'' AS z", "t"))).value_counts_compare("z").collect() if r.key) == [""]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert shown[1][1:3] == ("1970-01-01T01:00:00", "[1970-01-01T00:00:00.000001]") and "1970-01-01T00:00:00.000Z" in shown[0][3]
