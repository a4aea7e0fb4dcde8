from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope import percent_text, preview
from tallyscope.functions.columns import role, type_name
from tallyscope.functions.display import duration_text, plain_number_text, time_text


def shown(spark, sql):
    return preview(spark.sql(f"SELECT {sql} AS v")).head().v


@pytest.mark.parametrize(
    ("sql", "text"),
    [
        *[(f"CAST(NULL AS {t})", "null") for t in (
            "INT", "DOUBLE", "DECIMAL(5,2)", "STRING", "BINARY", "BOOLEAN", "DATE", "TIMESTAMP",
            "TIMESTAMP_NTZ", "ARRAY<DOUBLE>", "ARRAY<BINARY>", "MAP<STRING,INT>", "STRUCT<a:INT>",
            "INTERVAL DAY TO SECOND", "INTERVAL YEAR TO MONTH")],
        ("NULL", "null"), ("array(X'61', NULL)", "[b'a', ]"), ("array(NULL, 2.5D)", "[, 2.5]"),
        ("1234567", "1,234,567"), ("-5", "-5"), ("0", "0"), ("CAST(7 AS TINYINT)", "7"),
        ("1234.5678D", "1,234.568"), ("-0.0D", "0"), ("1.0D", "1"), ("0.0005D", "0.001"),
        ("double('NaN')", "NaN"), ("double('Infinity')", "∞"), ("1E21D", "1,000,000,000,000,000,000,000"),
        ("CAST(2.5 AS FLOAT)", "2.5"), ("CAST(1234.5 AS DECIMAL(12,2))", "1,234.5"),
        ("CAST(1234567 AS DECIMAL(20,0))", "1,234,567"),
        ("CAST('0.123456' AS DECIMAL(10,6))", "0.123456"),
        ("true", "true"), ("'a, b'", "a, b"), ("''", ""),
        ("date'2024-02-29'", "2024-02-29"),
        ("timestamp_ntz'2024-01-01 00:00:07.179575'", "2024-01-01T00:00:07.179575"),
        ("timestamp_ntz'2024-01-01 00:00:00'", "2024-01-01T00:00:00"),
        ("timestamp_ntz'2024-01-01 10:00:10.5'", "2024-01-01T10:00:10.5"),
        ("timestamp'2024-01-01 00:00:00+02:00'", "2023-12-31T22:00:00"),
        ("X'6100ff7e7f'", "b'a\\x00\\xff~\\x7f'"), ("X''", "b''"),
        ("CAST(repeat('a', 40) AS BINARY)", "b'" + "a" * 32 + "...'"),
        ("CAST(repeat('a', 32) AS BINARY)", "b'" + "a" * 32 + "'"),
        ("array(1, 2)", "[1, 2]"), ("array(1, 2, 3, 4, 5)", "[1, 2, 3, 4, 5]"),
        ("array(1, NULL, 3, 4, 5, 6)", "[1, , 3, 4, 5, ...]"), ("array()", "[]"),
        ("array(1.0D, 0.5D, 0.0005D, 1E-7D, 123456789.25D)", "[1, 0.5, 0.0005, 1e-7, 123456789.25]"),
        ("array('x', 'y')", "[x, y]"),
        ("map('a', 1)", '{"a":1}'), ("named_struct('a', 1, 'b', 'x')", '{"a":1,"b":"x"}'),
        ("INTERVAL '1 02:03:04.5' DAY TO SECOND", "PT93784.5S"),
        ("INTERVAL '-90' SECOND", "-PT90S"), ("INTERVAL '0' SECOND", "PT0S"),
        ("INTERVAL '2-3' YEAR TO MONTH", "P2Y3M"), ("INTERVAL '-1' YEAR", "-P1Y"),
        ("INTERVAL '0' MONTH", "P0M"),
    ],
)
def test_value_text(spark, sql, text):
    assert shown(spark, sql) == text


@pytest.mark.parametrize(
    ("number", "text"),
    [(0.0, "0"), (-0.0, "0"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (1e-6, "0.000001"),
     (1.25e-7, "1.25e-7"), (-1e7, "-10000000"), (12345678.5, "12345678.5"), (1e20, "100000000000000000000"),
     (0.1 + 0.2, "0.30000000000000004"), (float("inf"), "Infinity"), (-5e-4, "-0.0005")],
)
def test_plain_numbers(spark, number, text):
    df = spark.createDataFrame([(number,)], "x double")
    assert df.select(plain_number_text(F.col("x")).alias("t")).head().t == text


@pytest.mark.parametrize(
    ("value", "unit", "text"),
    [(0, "s", "00:00:00"), (86399, "s", "23:59:59"), (86400, "s", "00:00:00"), (1500, "ms", "00:00:01.5"),
     (3_723_000_001, "us", "01:02:03.000001"), (86_399_999_999_999, "ns", "23:59:59.999999999"), (-1, "s", "23:59:59")],
)
def test_time_of_day(spark, value, unit, text):
    df = spark.createDataFrame([(value,)], "v bigint")
    assert df.select(time_text(F.col("v"), unit).alias("t")).head().t == text


@pytest.mark.parametrize(
    ("value", "unit", "text"),
    [(90000, "s", "PT90000S"), (1500, "ms", "PT1.5S"), (-1, "ns", "-PT0.000000001S"), (0, "us", "PT0S"),
     (2**62, "ns", "PT4611686018.427387904S")],
)
def test_durations(spark, value, unit, text):
    df = spark.createDataFrame([(value,)], "v bigint")
    assert df.select(duration_text(F.col("v"), unit).alias("t")).head().t == text


@pytest.mark.parametrize(
    ("fraction", "text"),
    [(1.0, "100%"), (0.1, "10%"), (0.126, "13%"), (0.0999, "10.0%"), (0.01, "1.0%"), (0.0099, "0.99%"),
     (0.0, "0.00%"), (0.00001, "0.00%"), (None, None)],
)
def test_percent(spark, fraction, text):
    df = spark.createDataFrame([(fraction,)], "f double")
    assert df.select(percent_text(F.col("f")).alias("t")).head().t == text


@pytest.mark.parametrize(
    ("ddl", "name", "kind"),
    [("tinyint", "int8", "number"), ("smallint", "int16", "number"), ("int", "int32", "number"),
     ("bigint", "int64", "number"), ("float", "float32", "number"), ("double", "float64", "number"),
     ("decimal(10,2)", "decimal(10, 2)", "number"), ("boolean", "bool", "category"), ("string", "utf8", "category"),
     ("binary", "binary", "category"), ("date", "date[day]", "date"), ("timestamp", "timestamp[tz=UTC]", "date"),
     ("timestamp_ntz", "timestamp", "date"), ("void", "null", "category"),
     ("array<int>", "list[int32]", "category"), ("array<array<string>>", "list[list[utf8]]", "category"),
     ("struct<a:int,b:string>", "struct<a: int32, b: utf8>", "category"),
     ("map<string,int>", "map<struct<key: utf8, value: int32>>", "category"),
     ("interval year to month", "interval[ym]", "category"),
     ("interval day to second", "duration[µs]", "category")],
)
def test_type_names_and_roles(ddl, name, kind):
    dtype = T.DataType.fromDDL(f"c {ddl}").fields[0].dataType
    assert type_name(dtype) == name
    assert role(dtype) == kind
